"""Reports across profiles and revisions: grouping, sets and multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOINED = ","


def _joined(values: Column) -> Column:
    return F.array_join(F.array_sort(values), JOINED)


def signature(lint: Column, start: Column, message: Column) -> Column:
    """16 hex digits that are equal for equal findings."""
    return F.lower(F.lpad(F.hex(F.xxhash64(lint, start, message)), 16, "0"))


def aggregate_findings(diag: DataFrame) -> DataFrame:
    """Findings of one signature (lint, start, message) as one row: the first of them, how many, and the profiles that it affects."""
    return diag.groupBy("lint_id", "start", "message").agg(
        F.min("diag_id").alias("first_id"), F.count("*").alias("findings"), _joined(F.collect_set(F.lpad(F.col("profile_id").cast("string"), 3, "0"))).alias("profiles")
    )


def new_findings(diag: DataFrame, baseline: DataFrame) -> DataFrame:
    """Signatures that the baseline lacks, with how many profiles each affects."""
    fresh = diag.join(baseline.select("lint_id", "start", "message").distinct(), ["lint_id", "start", "message"], "left_anti")
    return fresh.groupBy("lint_id", "start", "message").agg(F.countDistinct("profile_id").alias("affected"))


def equivalence_classes(footprint: DataFrame, member: str, item: str) -> DataFrame:
    """Members with the same set of items: representative (least member), size, members and items of each class."""
    sets = footprint.select(member, item).distinct().groupBy(member).agg(_joined(F.collect_list(item)).alias("items"))
    text = F.lpad(F.col(member).cast("string"), 12, "0")
    return sets.groupBy("items").agg(F.min(member).alias("representative"), F.count("*").alias("size"), _joined(F.collect_list(text)).alias("members"))


def portability(names: DataFrame, profiles: DataFrame, macros: DataFrame) -> DataFrame:
    """For each macro name: in how many profiles it is defined or missing, and whether it is portable, partial or missing."""
    total = profiles.agg(F.count("*").alias("total"))
    defined = macros.groupBy("name").agg(F.countDistinct("profile_id").alias("defined"))
    n = F.coalesce("defined", F.lit(0)).cast("long")
    status = F.when(n == F.col("total"), "portable").when(n == 0, "missing").otherwise("partial")
    return names.join(defined, "name", "left").join(F.broadcast(total)).select("name", n.alias("defined_in"), (F.col("total") - n).alias("missing_in"), status.alias("status"))


def common_macros(profiles: DataFrame, macros: DataFrame, equal_value: bool) -> DataFrame:
    """Macros that every profile defines; with equal_value those that all define alike."""
    total = profiles.agg(F.count("*").alias("total"))
    by = macros.groupBy("name").agg(F.countDistinct("profile_id").alias("n"), F.countDistinct("value").alias("values"), F.min("value").alias("value"))
    keep = by.join(F.broadcast(total)).where(F.col("n") == F.col("total"))
    return (keep.where("values = 1") if equal_value else keep).select("name", "values", "value")


def set_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys with side common, only_a or only_b."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("common")
    return x.join(y, keys, "full_outer").select(*keys, side.alias("side"))


def multiset_changes(a: DataFrame, b: DataFrame, group: list[str], item: str) -> DataFrame:
    """Per group how many items (counted with repetition) revision b adds, removes and leaves. One aggregation over both revisions; no join."""
    both = a.select(*group, item, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*group, item, F.lit(0).alias("x"), F.lit(1).alias("y")))
    n = both.groupBy(*group, item).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return n.groupBy(*group).agg(
        F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("removed"),
        F.sum(F.least("x", "y")).alias("unchanged"),
    )


def contract(required: DataFrame, forbidden: DataFrame, present: DataFrame) -> DataFrame:
    """(profile_id, name, violation): required names that a profile lacks, and forbidden ones that it has."""
    keys = ["profile_id", "name"]
    lacking = required.join(present, keys, "left_anti").select(*keys, F.lit("missing").alias("violation"))
    return lacking.unionByName(forbidden.join(present, keys, "left_semi").select(*keys, F.lit("forbidden").alias("violation")))


def snapshots_to_drop(snapshots: DataFrame, keep: int) -> DataFrame:
    """Snapshots (repo_id, revision, taken, is_current) beyond the newest `keep` of each repository, the current one never."""
    from pyspark.sql import Window

    w = Window.partitionBy("repo_id").orderBy(F.desc("taken"), "revision")
    return snapshots.withColumn("place", F.row_number().over(w)).where((F.col("place") > keep) & ~F.col("is_current")).drop("place")


def for_every(rows: DataFrame, dimension: DataFrame, most: int = 10_000) -> DataFrame:
    """rows, each once for every distinct row of a dimension, such as profiles. It has at most `most` rows, which is checked, and comes as an array of each row: nothing is joined."""
    found = dimension.distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a dimension of more than {most} rows")
    member = F.array(*(F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in dimension.schema)) for r in found))
    if not found:
        member = F.array().cast(f"array<{dimension.schema.simpleString()}>")
    return rows.withColumn("_member", F.explode(member)).select(*rows.columns, "_member.*")
