"""Layered configuration: the last write wins, lists extend or replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_values(layers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value and layer_no of the highest layer that sets a key."""
    return layers.groupBy(*keys).agg(F.max(F.struct("layer_no", "value")).alias("m")).select(*keys, "m.value", "m.layer_no")


def merge_lists(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct items of list layers (keys, layer_no, mode, item): a layer of mode replace drops those below it."""
    w = Window.partitionBy(*keys)
    last = F.max(F.when(F.col("mode") == "replace", F.col("layer_no"))).over(w)
    kept = layers.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("layer_no") >= F.col("_last")))
    return kept.select(*keys, "item").where("item is not null").distinct()


def severity(default: Column, config: Column, command: Column, warnings_as_errors: bool = False) -> Column:
    """allow, warn or deny: the command line before the configuration before the rule's default."""
    s = F.coalesce(command, config, default)
    return F.when(s == "warn", F.lit("deny")).otherwise(s) if warnings_as_errors else s


def identity(markers: DataFrame) -> DataFrame:
    """profile_id and family by the first marker macro that a profile defines literally."""
    order = ["altlinux", "mageia", "suse_version", "rhel", "fedora"]
    family = F.array(*(F.lit(x) for x in ("alt", "mageia", "opensuse", "rhel", "fedora")))
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("name"))
    return markers.where(F.col("name").isin(order) & F.col("value").isNotNull()).groupBy("profile_id").agg(F.min(place).alias("p")).select(
        "profile_id", F.element_at(family, F.col("p").cast("int")).alias("family")
    )
