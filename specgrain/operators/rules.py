"""Rule archetypes over lines and ordered items: filters, anti-joins, duplicates, runs and shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_lines(lines: DataFrame, limit: int = 80) -> DataFrame:
    return lines.where(F.char_length("line") > limit).select("spec_id", "line_no", F.char_length("line").cast("long").alias("chars"))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines that a recipe has more than once: the first place and how many."""
    n = lines.where(F.trim("line") != "").groupBy("spec_id", "line").agg(F.min("line_no").alias("first_line"), F.count("*").alias("times"))
    return n.where("times > 1").select("spec_id", "first_line", "times")


def lines_not_starting_upper(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").rlike("^[a-z0-9]")).select("spec_id", "line_no")


def trailing_blanks(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").rlike(r"[ \t]+$")).select("spec_id", "line_no")


def tabs(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").contains("\t")).select("spec_id", "line_no")


def shared_shingles(lines: DataFrame, size: int = 3) -> DataFrame:
    """Runs of `size` lines that at least two recipes have, as a hash, with the number of recipes."""
    w = Window.partitionBy("spec_id").orderBy("line_no")
    run = [F.col("line"), *(F.lead("line", i).over(w) for i in range(1, size))]
    hashed = lines.select("spec_id", F.md5(F.concat_ws("\n", *run)).alias("shingle"), run[-1].alias("end")).where("end is not null")
    return hashed.select("spec_id", "shingle").distinct().groupBy("shingle").agg(F.count("*").alias("recipes")).where("recipes > 1")


def runs(items: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of equal values in order: group, value, start (place of the first, from 1) and length."""
    w = Window.partitionBy(*group).orderBy(*order)
    numbered = items.select(*group, value, F.row_number().over(w).alias("_n"), F.lag(value).over(w).alias("_before"))
    starts = F.sum(F.when(F.col("_before").eqNullSafe(F.col(value)), 0).otherwise(1)).over(
        Window.partitionBy(*group).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    )
    return numbered.withColumn("_run", starts).groupBy(*group, "_run", value).agg(F.min("_n").alias("start"), F.count("*").alias("length")).drop("_run")


def order_violations(items: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Items whose value is below that of the item before."""
    w = Window.partitionBy(*group).orderBy(*order)
    return items.withColumn("before", F.lag(value).over(w)).where(F.col(value) < F.col("before")).select(*group, *order, value, "before")


def duplicate_keys(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def without(items: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Items that a required part (a tag, a section) is missing of."""
    return items.join(found.select(*keys).distinct(), keys, "left_anti")
