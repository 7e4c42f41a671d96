"""What the operators of this subpackage share: tables, materialisation, word hashing, components."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are tokenised in slices of about so many characters, so that a batch of long texts needs no more memory than one of short ones.
SLICE_CHARS = 2_000_000

def sliced(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about limit bytes of a text column, or one row: Python strings exist for one slice at a time only."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = f"file://{tempfile.gettempdir()}/specgrain-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df once to the shared folder and read it back: this cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame | None) -> None:
    """Delete a table that materialize wrote and that nothing reads any more."""
    if stored is None:
        return
    sc = stored.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in stored.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges over texts, each of at most limit characters or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def crc_mod(doc_id, k: int):
    """crc32 of doc_id as text, modulo k; the folds of the labelled and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def crc_mod_py(doc_id: int, k: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % k


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bounded number of words."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the ordered pair (a, b)."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b) + np.uint64(0x632BE59BD9B4E019))


def shingles(text: str | None, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of a text and how often each occurs; a shorter text is one shingle, an empty one none."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = word_hashes(words)
    k = min(k, len(words))
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = join_hash(out, h[i : i + n])
    return np.unique(out, return_counts=True)


def i64(a: np.ndarray) -> pa.Array:
    """uint64 hashes as Spark's signed longs."""
    return pa.array(np.ascontiguousarray(a).view(np.int64))


#: Bits of the filters that spare rows a shuffle, whatever the number of keys.
FILTER_BITS = 26


def filter_words(keys: DataFrame, spot: Column) -> DataFrame:
    """(word, bits): a Bloom filter of one hash, of at most 2**FILTER_BITS / 64 rows."""
    one = F.expr("shiftleft(1L, cast(spot & 63 as int))")
    return keys.select(spot.alias("spot")).select(F.shiftright("spot", 6).alias("word"), one.alias("one")).groupBy("word").agg(F.expr("bit_or(one)").alias("bits"))


def marked(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """df with `maybe`: false only where the column is not in keys; the filter is joined by broadcast."""
    spot = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    out = df.withColumn("spot", spot).withColumn("word", F.shiftright("spot", 6)).join(F.broadcast(filter_words(keys, spot)), "word", "left")
    return out.withColumn("maybe", F.coalesce(F.expr("getbit(bits, cast(spot & 63 as int)) = 1"), F.lit(False))).drop("word", "spot", "bits")


def connected_components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge (a, b) names; component is the smallest node reachable.

    Each round replaces the edges by large-star then small-star edges: every node is linked with the smallest of its
    neighbours. Only minima per node are grouped (they combine map-side), so hubs cost no memory, and each round is
    a written table. It ends when every edge leads straight to its component.
    """
    spark = edges.sparkSession
    cur = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = large.unionByName(low.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        least = stars.groupBy("a").agg(F.min("b").alias("m"))
        small = stars.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = materialize(
            small.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct(), label
        )
        roots = nxt.select(F.col("b").alias("a")).distinct()
        if nxt.join(roots, "a", "left_semi").isEmpty() and nxt.groupBy("a").count().where("count > 1").isEmpty():
            cur = nxt
            break
        cur = nxt
    else:
        raise RuntimeError("components did not settle")
    found = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
