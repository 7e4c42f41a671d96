"""Package relations projected from the test tables; every column is a deterministic function of its row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    suffix = F.when(k % 11 == 0, "~rc1").when(k % 13 == 0, "^git2").otherwise("")
    return table(spark, sf_dir, "part").select(
        k.alias("pkg_id"),
        F.concat(F.lit("r"), (k % 2).cast("string")).alias("repo_id"),
        F.col("p_name").alias("name"),
        (k % 3).cast("int").alias("epoch"),
        F.concat(F.expr("cast(p_size div 10 as string)"), F.lit("."), (F.col("p_size") % 10).cast("string"), suffix).alias("version"),
        F.concat((k % 7).cast("string"), F.lit(".el"), (8 + k % 3).cast("string")).alias("release"),
        F.when(k % 4 == 0, "noarch").when(k % 4 == 1, "i686").otherwise("x86_64").alias("arch"),
        F.col("p_brand").alias("source_name"),
        (F.col("p_size").cast("long") * 1000 + k % 1000).alias("size_installed"),
    )


def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind provides, requires or conflicts; op NONE with null EVR, or an op with epoch 0 and an empty release (any release)."""
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "provides").when(flag == "N", "requires").otherwise("conflicts")
    shift = F.when(flag == "A", F.lit(0)).when(flag == "N", F.col("l_partkey") % 20).otherwise(F.col("l_partkey") % 10)
    op = F.when(flag == "A", F.when(line % 3 == 0, "NONE").otherwise("EQ")).otherwise(
        F.when(line % 4 == 0, "NONE").when(line % 4 == 1, "GE").when(line % 4 == 2, "EQ").otherwise("LT")
    )
    version = F.concat((order % F.when(flag == "A", F.lit(5)).otherwise(F.lit(7))).cast("string"), F.lit("."), line.cast("string"))
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("pkg_id"), kind.alias("kind"), F.concat(F.lit("cap"), (F.col("l_suppkey") + shift).cast("string")).alias("name"),
        op.alias("op"), version.alias("v"),
    )
    bare = F.col("op") == "NONE"
    return raw.select(
        "pkg_id", "kind", "name", "op", F.when(~bare, F.lit(0)).alias("epoch"), F.when(~bare, F.col("v")).alias("version"), F.when(~bare, F.lit("")).alias("release")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/usr/bin/f"), (F.col("l_orderkey") % 500).cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pkg_id"), path.alias("path"))


def profile_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as profiles, suppliers as macros."""
    from ..operators.matrix import for_every

    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("profile_id"))
    macro = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("name"), "s_suppkey", (F.col("s_suppkey") % 5).cast("long").alias("value")
    )
    defined = F.col("s_suppkey") % (F.col("profile_id") + 2) != 0
    return for_every(macro, nation).where(defined).select("profile_id", "name", "value")


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("diag_id"), F.col("event_type").alias("lint_id"), (F.col("user_id") % 12).cast("int").alias("profile_id"),
        (F.col("event_id") % 200).cast("int").alias("start"), F.col("props").alias("message"),
    )


def spec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, numbered from 1."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.col("doc_id").alias("spec_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "spec_id", (F.col("pos") + 1).cast("int").alias("line_no"), "line"
    )


#: The same projections for a SQL engine: common table expressions to put before a query.
SQL = {
    "packages": """packages AS (SELECT p_partkey AS pkg_id, 'r' || (p_partkey % 2) AS repo_id, p_name AS name, CAST(p_partkey % 3 AS INTEGER) AS epoch,
  (p_size // 10) || '.' || (p_size % 10) || CASE WHEN p_partkey % 11 = 0 THEN '~rc1' WHEN p_partkey % 13 = 0 THEN '^git2' ELSE '' END AS version,
  (p_partkey % 7) || '.el' || (8 + p_partkey % 3) AS release,
  CASE p_partkey % 4 WHEN 0 THEN 'noarch' WHEN 1 THEN 'i686' ELSE 'x86_64' END AS arch,
  p_brand AS source_name, CAST(p_size AS BIGINT) * 1000 + p_partkey % 1000 AS size_installed FROM part)""",
    "caps": """rawcaps AS (SELECT l_partkey AS pkg_id, CASE l_returnflag WHEN 'A' THEN 'provides' WHEN 'N' THEN 'requires' ELSE 'conflicts' END AS kind,
  'cap' || (l_suppkey + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN l_partkey % 20 ELSE l_partkey % 10 END) AS name,
  CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber % 3 = 0 THEN 'NONE' ELSE 'EQ' END
    ELSE CASE l_linenumber % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'GE' WHEN 2 THEN 'EQ' ELSE 'LT' END END AS op,
  (l_orderkey % CASE WHEN l_returnflag = 'A' THEN 5 ELSE 7 END) || '.' || l_linenumber AS v FROM lineitem),
caps AS (SELECT pkg_id, kind, name, op, CASE WHEN op <> 'NONE' THEN 0 END AS epoch, CASE WHEN op <> 'NONE' THEN v END AS version,
  CASE WHEN op <> 'NONE' THEN '' END AS release FROM rawcaps)""",
    "files": "files AS (SELECT l_partkey AS pkg_id, '/usr/bin/f' || (l_orderkey % 500) AS path FROM lineitem)",
    "profile_macro": """profile_macro AS (SELECT n_nationkey AS profile_id, 'm' || s_suppkey AS name, CAST(s_suppkey % 5 AS BIGINT) AS value
  FROM supplier, nation WHERE s_suppkey % (n_nationkey + 2) <> 0)""",
    "diagnostic": """diagnostic AS (SELECT event_id AS diag_id, event_type AS lint_id, CAST(user_id % 12 AS INTEGER) AS profile_id,
  CAST(event_id % 200 AS INTEGER) AS start, props AS message FROM events)""",
    "spec_line": """spec_line AS (SELECT doc_id AS spec_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))""",
}


def key_sql(v: str) -> str:
    """The SQL of version_key."""
    token = (
        "CASE WHEN t = '~' THEN '0' WHEN t = '^' THEN '2' WHEN regexp_matches(t, '^[0-9]')"
        " THEN '4' || lpad(CAST(length(ltrim(t, '0')) AS VARCHAR), 5, '0') || ltrim(t, '0') ELSE '3' || t || '!' END"
    )
    return f"array_to_string(list_transform(regexp_extract_all({v}, '(~|\\^|[0-9]+|[A-Za-z]+)', 1), lambda t: {token}), '') || '1'"


def with_sql(*names: str, query: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(SQL[n] for n in names) + query
