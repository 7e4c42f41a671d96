"""Findings of recipes as they change: a stream of recipe files, each micro-batch analysed like any table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.recipe_rules import lint
from ..sources.recipes import parse


def recipe_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(spec_id, path, changed, text) of the recipe files that come into a folder."""
    s = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return s.select(F.col("_metadata.file_path").alias("spec_id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"), F.col("value").alias("text"))


def publish(stream: DataFrame, out: str, checkpoint: str, rules: list[str] | None = None) -> StreamingQuery:
    """Writes the findings of every changed recipe under out, partitioned by batch; a batch that runs again replaces its own partition.

    Windows over a recipe's lines need all of it, and a file comes whole, so a batch is a complete input for the rules.
    """

    def analyse(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("spec_id").agg(F.max_by("text", "changed").alias("text"))
        found = lint(parse(newest, keep=True), rules)
        seen = newest.select("spec_id")  # a row without a rule says that the recipe was looked at
        found.unionByName(seen, allowMissingColumns=True).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(findings: DataFrame) -> DataFrame:
    """Of each recipe the findings of its last batch; none of a recipe that has become clean."""
    last = findings.groupBy("spec_id").agg(F.max("batch").alias("batch"))
    return findings.join(last, ["spec_id", "batch"], "left_semi").where("lint_id is not null")
