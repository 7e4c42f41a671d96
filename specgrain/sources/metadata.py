"""Repository metadata files as relations: rpm-md XML, release headers, contents indexes, macro dumps, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Explicit schemas: inference would read versions as numbers and single entries as structs.
_ENTRY = "struct<_name:string,_flags:string,_epoch:string,_ver:string,_rel:string>"
_ENTRIES = f"struct<`rpm:entry`:array<{_ENTRY}>>"
KINDS = ("provides", "requires", "conflicts", "obsoletes", "recommends", "suggests", "supplements", "enhances")
_PRIMARY = (
    "name string, arch string, version struct<_epoch:string,_ver:string,_rel:string>, checksum struct<_VALUE:string,_type:string>, summary string,"
    " size struct<_installed:string>, location struct<_href:string>, format struct<`rpm:sourcerpm`:string,"
    + ",".join(f"`rpm:{k}`:{_ENTRIES}" for k in KINDS)
    + ",file:array<string>>"
)
_FILELISTS = "_pkgid string, _name string, _arch string, file array<string>"
_REPOMD = "_type string, location struct<_href:string>, checksum struct<_VALUE:string,_type:string>"


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("valueTag", "_VALUE").schema(T.StructType.fromDDL(schema)).load(path)


def read_repomd(spark: SparkSession, path: str) -> DataFrame:
    """(kind, href, checksum) of a repository's index of files."""
    return _xml(spark, path, "data", _REPOMD).select(F.col("_type").alias("kind"), F.col("location._href").alias("href"), F.col("checksum._VALUE").alias("checksum"))


def read_primary(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """Packages with nested capabilities and the files that primary.xml lists; (repo_id, pkg_id) is the key, pkg_id the package's checksum."""
    p = _xml(spark, path, "package", _PRIMARY)
    return p.select(
        F.lit(repo_id).alias("repo_id"), F.lower("checksum._VALUE").alias("pkg_id"), F.lower("checksum._type").alias("checksum_alg"), "name",
        F.coalesce(F.col("version._epoch").try_cast("int"), F.lit(0)).alias("epoch"), F.col("version._ver").alias("version"), F.col("version._rel").alias("release"), "arch", "summary",
        F.col("size._installed").try_cast("long").alias("size_installed"), F.col("location._href").alias("location"), F.col("format.rpm:sourcerpm").alias("source_rpm"),
        *(F.col(f"format.`rpm:{k}`.`rpm:entry`").alias(k) for k in KINDS), F.col("format.file").alias("files"),
    )


def capabilities(primary: DataFrame) -> DataFrame:
    """(repo_id, pkg_id, kind, ord, name, op, epoch, version, release). A version without a release has the release '' (any); without an operator all three are null."""
    out = None
    for k in KINDS:
        e = F.col("e")
        rows = primary.select("repo_id", "pkg_id", F.lit(k).alias("kind"), F.posexplode(k).alias("ord", "e"))
        op = F.coalesce(F.upper("e._flags"), F.lit("NONE"))
        bare = (op == "NONE") | e["_ver"].isNull()
        one = rows.select(
            "repo_id", "pkg_id", "kind", "ord", e["_name"].alias("name"), F.when(bare, "NONE").otherwise(op).alias("op"),
            F.when(~bare, F.coalesce(e["_epoch"].try_cast("int"), F.lit(0))).alias("epoch"), F.when(~bare, e["_ver"]).alias("version"), F.when(~bare, F.coalesce(e["_rel"], F.lit(""))).alias("release"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def read_filelists(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """(repo_id, pkg_id, path) of filelists.xml."""
    f = _xml(spark, path, "package", _FILELISTS)
    return f.select(F.lit(repo_id).alias("repo_id"), F.lower("_pkgid").alias("pkg_id"), F.explode("file").alias("path"))


def write_snapshot(relation: DataFrame, path: str, revision: str) -> None:
    """One revision of a relation, partitioned by repository and revision and sorted by name for skipping; other revisions stay."""
    w = relation.withColumn("revision", F.lit(revision))
    key = [c for c in ("repo_id", "name") if c in relation.columns]
    w.sortWithinPartitions(*key).write.mode("append").partitionBy("repo_id", "revision").parquet(path)


def current_snapshot(spark: SparkSession, path: str, current: DataFrame) -> DataFrame:
    """The rows of each repository's current revision (repo_id, revision)."""
    return spark.read.parquet(path).join(current, ["repo_id", "revision"], "left_semi")


def read_release(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header (key, value) and checksum table (algorithm, hex, size, path) of a release file: indented lines belong to the last bare key."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^([A-Za-z0-9-]+):\s*(.*)$", 1)
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("key", F.when(head != "", head)).withColumn("table", F.last("key", True).over(w))
    header = t.where("key is not null").select("file", "key", F.trim(F.regexp_extract("line", r"^[A-Za-z0-9-]+:\s*(.*)$", 1)).alias("value")).where("value <> ''")
    parts = F.split(F.trim("line"), r"\s+")
    sums = t.where(F.col("key").isNull() & F.col("line").rlike(r"^\s+[0-9a-fA-F]+\s+[0-9]+\s+\S+"))
    return header, sums.select("file", F.col("table").alias("algorithm"), F.lower(parts[0]).alias("hex"), parts[1].cast("long").alias("size"), parts[2].alias("path"))


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, owner) of a contents index; lines without a tab are left out."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.col("value").contains("\t")).select(F.trim(parts[0]).alias("path"), F.trim(parts[1]).alias("owner"))


def macro_kind(value: Column) -> Column:
    return F.when(value == "<builtin>", "builtin").when(value.contains("%"), "raw").otherwise("literal")


def read_macro_dump(spark: SparkSession, path: str) -> DataFrame:
    """(profile_id, name, opts, value, kind, multiline, level) of macro dumps, one file a profile: `level: name(opts) body`, continued on the lines up to the next such head.

    Lines are grouped by a running count of heads; of several definitions of a name the last counts.
    """
    t = spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("profile_id"), F.posexplode(F.split("value", "\n")).alias("pos", "line")
    )
    m = r"^\s*(-?[0-9]+)[:=]\s?([A-Za-z_]\w*)(\([^)]*\))?(?:\s+(.*))?$"
    head = F.col("line").rlike(m)
    w = Window.partitionBy("profile_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("no", F.sum(head.cast("int")).over(w)).withColumn("head", head).where("no > 0 and not (not head and line like '========%')")
    first = F.max(F.when(F.col("head"), F.struct(*(F.regexp_extract("line", m, i).alias(f"g{i}") for i in (1, 2, 3, 4)))))
    rest = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line"))))
    g = t.groupBy("profile_id", "no").agg(first.alias("h"), rest.alias("rest"))
    body = F.concat_ws("\n", F.array(F.coalesce("h.g4", F.lit(""))), F.col("rest.line"))
    value = F.regexp_replace(body, r"\s+$", "")
    rows = g.select(
        "profile_id", "no", F.col("h.g2").alias("name"), F.when(F.col("h.g3") != "", F.col("h.g3")).alias("opts"), value.alias("value"), macro_kind(value).alias("kind"),
        F.contains(value, F.lit("\n")).alias("multiline"), F.col("h.g1").cast("int").alias("level"),
    )
    last = Window.partitionBy("profile_id", "name").orderBy(F.desc("no"))
    return rows.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "no")


BASELINE = "version int, entries array<struct<matrix_signature:string,lint_id:string,message:string,affected_profile_count:bigint>>"


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a baseline file of version 1; signatures are 16 lower-case hex digits, others are an error."""
    b = spark.read.schema(BASELINE).option("multiLine", True).json(path)
    bad = F.raise_error(F.lit("unknown baseline version"))
    e = b.select(F.explode(F.when(F.col("version") == 1, F.col("entries")).otherwise(F.when(F.lit(True), bad.cast("array<struct<matrix_signature:string,lint_id:string,message:string,affected_profile_count:bigint>>")))).alias("e")).select("e.*")
    sig = F.col("matrix_signature")
    return e.withColumn("matrix_signature", F.when(sig.rlike("^[0-9a-f]{16}$"), sig).otherwise(F.raise_error(F.concat(F.lit("bad signature: "), sig)).cast("string")))


def findings_json(findings: DataFrame) -> DataFrame:
    """(spec_id, json): one report a recipe with its findings in order of line and rule."""
    item = F.struct("line_no", "lint_id", "lint_name", "severity", "detail")
    listed = findings.groupBy("spec_id").agg(F.array_sort(F.collect_list(item)).alias("diagnostics"))
    return listed.select("spec_id", F.to_json(F.struct(F.col("spec_id").alias("path"), "diagnostics")).alias("json"))


def findings_sarif(findings: DataFrame) -> DataFrame:
    """(spec_id, json): the results of a SARIF 2.1.0 run over each recipe."""
    level = F.create_map(F.lit("deny"), F.lit("error"), F.lit("warn"), F.lit("warning"), F.lit("allow"), F.lit("note"))
    region = F.struct(F.col("line_no").alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("spec_id").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    text = F.struct(F.concat_ws(": ", "lint_name", "detail").alias("text"))
    result = F.struct(F.col("lint_id").alias("ruleId"), level[F.col("severity")].alias("level"), text.alias("message"), F.array(place).alias("locations"))
    listed = findings.groupBy("spec_id").agg(F.sort_array(F.collect_list(F.struct(F.col("line_no"), F.col("lint_id"), F.to_json(result).alias("r")))).alias("l"))
    body = F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"specgrain"}},"results":['), F.array_join(F.col("l.r"), ","), F.lit("]}]}"))
    return listed.select("spec_id", body.alias("json"))
