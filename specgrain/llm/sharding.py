"""Sharding along a Hilbert curve over document metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table

#: Levels of each dimension: 2 ** BITS.
BITS = 5


def hilbert_index(cell: tuple[int, ...], bits: int) -> int:
    """Position of a cell of a 2**bits grid along the Hilbert curve (Skilling, "Programming the Hilbert curve", 2004)."""
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] ^ t) >> b & 1
    return out


def _curve(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """cell -> place on the curve: 2 ** (dims * bits) rows, however many documents there are."""
    mask = (1 << bits) - 1
    rows = [
        (c, hilbert_index(tuple(c >> bits * (dims - 1 - i) & mask for i in range(dims)), bits))
        for c in range(1 << dims * bits)
    ]
    return spark.createDataFrame(rows, "cell int, curve int")


def string_cuts(docs: DataFrame, column: str, levels: int) -> list[str]:
    """At most levels - 1 values of a string column that cut its rows into runs of about equal size, by whole values in their order.

    Values are counted, ordered by ranges and summed up along their order, each range in its own task; the driver gets one number a range and the cuts.
    """
    counted = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).orderBy("v")
    values = materialize(counted.withColumn("at", F.monotonically_increasing_id()), "shard-values")
    part = F.shiftright("at", 33).cast("int")
    sums = sorted((r["p"], r["n"]) for r in values.groupBy(part.alias("p")).agg(F.sum("n").alias("n")).collect())  # one row a range
    total, before = sum(n for _, n in sums), 0
    if not total:
        return []
    offsets = []
    for p, n in sums:
        offsets.append((p, before))
        before += n
    offset = F.broadcast(values.sparkSession.createDataFrame(offsets, "p int, before long"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("at"))
    placed = values.withColumn("p", part).join(offset, "p").withColumn("upto", upto)
    found = placed.agg(*(F.min(F.when(F.col("upto") >= total * i / levels, F.col("at"))).alias(f"c{i}") for i in range(1, levels))).head()
    return sorted(r["v"] for r in values.where(F.col("at").isin([x for x in found if x is not None])).select("v").collect())  # levels - 1 rows at most


def hilbert_shards(
    docs: DataFrame, dims: list[str], shards: int = 8, bits: int = BITS, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Deal all rows into shards of equal row counts (at most one apart), consecutive along a Hilbert curve.

    Each dimension is quantised into 2**bits levels: numbers by approximate quantiles of all rows (a mergeable sketch), strings by whole values cut by their counts
    (string_cuts); a null takes level 0.
    The curve's place, then text, then key order the rows; runs of that order are the shards. So a shard covers a compact
    box in all the dimensions, and the min/max statistics of its files prune by any of them.

    Added columns: size (UTF-8 bytes of the text plus 1), text_crc32, law ('rows'), shard, slot (place in the shard, from 0),
    grown_shard (null: only the law 'key' has it), curve. Null text counts as no bytes, with crc32 of an empty string. Repeated rows each
    get a slot. An empty table gives no rows. Other columns of docs stay out of the result unless they are in keep (one named like an added column as doc_<name>).
    """
    spark = docs.sparkSession
    kinds = {f.name: f.dataType for f in docs.schema}
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    strings = [isinstance(kinds[c], T.StringType) for c in dims]
    ords = [(F.col(c) if s else F.col(c).cast("double")).alias(f"_o{i}") for i, (c, s) in enumerate(zip(dims, strings, strict=True))]
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve", key)
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    names = [F.col(f"_k{i}").alias(f"doc_{c}" if c in added else c) for i, c in enumerate(keep)]
    rows = docs.select(F.col(key), *ords, *kept, (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    levels = 1 << bits
    at = [i / levels for i in range(1, levels)]
    numbers = [F.percentile_approx(f"_o{i}", at, 10_000).alias(f"_c{i}") for i, s in enumerate(strings) if not s]
    quantiles = rows.agg(*numbers).head() if numbers else {}
    cuts = [string_cuts(docs, c, levels) if s else quantiles[f"_c{i}"] for i, (c, s) in enumerate(zip(dims, strings, strict=True))]
    cell = F.lit(0)
    for i in range(len(dims)):
        level = F.lit(0)
        for c in cuts[i] or []:
            level = level + F.when(F.col(f"_o{i}") > F.lit(c), 1).otherwise(0)  # strings compare by their bytes
        cell = cell * levels + level
    placed = rows.withColumn("cell", cell.cast("int")).join(F.broadcast(_curve(spark, len(dims), bits)), "cell")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "text_crc32", "size", key]
    ordered = materialize(
        placed.select(key, "size", "text_crc32", "curve", *(f"_k{i}" for i in range(len(keep))))
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()),
        "shards",
    )
    # The id's upper bits are the partition, its lower 33 bits the row's place in it: counts per partition make places global.
    part = F.shiftright("at", 33)
    counts = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    starts = spark.createDataFrame(offsets, "p long, offset long")
    ranked = ordered.withColumn("p", part).join(F.broadcast(starts), "p")
    rank = F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1)
    q, r = divmod(total, shards)
    large = r * (q + 1)
    shard = F.when(F.col("rank") < large, F.expr(f"rank div {q + 1}")).otherwise(F.expr(f"{r} + (rank - {large}) div {max(q, 1)}"))
    slot = F.when(F.col("rank") < large, F.expr(f"rank % {q + 1}")).otherwise(F.expr(f"(rank - {large}) % {max(q, 1)}"))
    return ranked.withColumn("rank", rank).select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve", *names,
    )


def write_shards(docs: DataFrame, dims: list[str], path: str, shards: int = 8, rows_a_file: int = 1_000_000) -> None:
    """All columns of docs (those named like an added one as doc_<name>), with shard and slot, as Parquet under path, a folder a shard.

    Rows are written in the order in which they were placed, without another shuffle, so each file covers a run of the curve and its statistics prune by every dimension.
    """
    placed = hilbert_shards(docs, dims, shards, keep=tuple(c for c in docs.columns if c != "doc_id"))
    placed.write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"])
