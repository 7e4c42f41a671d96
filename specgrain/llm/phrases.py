"""Phrase collocations: n-grams exploded into rows and counted per language, scored by their worst cut, longer phrases before the shorter ones they explain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, i64, join_hash, materialize, mix, sliced, table, word_hashes

#: Bytes of text of which n-grams are counted together before they become rows.
SLICE_BYTES = 1_500_000
#: Rows of a batch that leaves a task's Python.
_BATCH = 50_000
#: Every byte between pieces becomes a full stop, A-Z become a-z, the rest stays; no byte of a longer UTF-8 character is touched.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
_ROWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64())])


class _Codes(dict):
    """word -> number in order of appearance; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The words by number, and the texts as numbers, with 0 wherever a piece or a text ends."""
    folded = "\n".join(t for t in texts if t).encode().translate(_FOLD).replace(b".", b" . ")
    codes = _Codes({b".": 0})
    words = folded.split()  # of Python's blanks only space and tab are left
    numbers = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    del words, folded
    return [w.decode() for w in codes], np.concatenate(([0], numbers, [0]))


def _joined(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    return pc.binary_join_element_wise(*(words.take(pa.array(c)) for c in columns), " ")


class Known:
    """A Bloom filter over phrases of two words of a language, of one bit each: it may only let too many through."""

    def __init__(self, bits: int, words: np.ndarray):
        self.mask, self.words = np.uint64((1 << bits) - 1), words

    @staticmethod
    def spot(lang: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix(join_hash(first, second) ^ np.uint64(lang))

    def __call__(self, lang: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = self.spot(lang, first, second) & self.mask
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _short(lang: str, texts: list[str | None]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words and pairs with their counts, and all words together as the empty phrase."""
    words, x = tokens(texts)
    names = pa.array(words)
    n = np.bincount(x, minlength=len(words))
    n[0] = 0
    seen = np.flatnonzero(n)
    yield pa.array([""]), np.array([n.sum()])
    yield names.take(pa.array(seen)), n[seen]
    pairs, n = np.unique((x[:-1] * len(words) + x[1:])[(x[:-1] > 0) & (x[1:] > 0)], return_counts=True)
    yield _joined(names, [pairs // len(words), pairs % len(words)]), n


def _long(known: Known, most: int):
    def run(lang: str, texts: list[str | None]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Phrases of three words and more all of whose pairs may be frequent."""
        words, x = tokens(texts)
        names, hashes = pa.array(words), word_hashes(words)
        good = (x[:-1] > 0) & (x[1:] > 0)
        at = np.flatnonzero(good)
        good[at] = known(int(word_hashes([lang])[0]), hashes[x[at]], hashes[x[at + 1]])
        key, at = None, np.flatnonzero(good)
        if not len(at):
            return
        _, key = np.unique(x[at] * len(words) + x[at + 1], return_inverse=True)
        for n in range(3, most + 1):
            goes_on = good[np.minimum(at + n - 2, len(good) - 1)] & (at + n - 2 < len(good))
            at, key = at[goes_on], key[goes_on]
            if not len(at):
                return
            _, first, key, count = np.unique(key * len(words) + x[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
            yield _joined(names, [x[at[first] + i] for i in range(n)]), count

    return run


def _counts(grams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced([batch], 1, SLICE_BYTES):
                part = part.sort_by("lang")
                langs = part.column(0).to_pylist()
                texts = part.column(1).to_pylist()
                start = 0
                for end in range(1, len(langs) + 1):
                    if end == len(langs) or langs[end] != langs[start]:
                        for phrases, n in grams(langs[start], texts[start:end]):
                            for i in range(0, len(n), _BATCH):
                                some = n[i : i + _BATCH].astype(np.int64)
                                yield pa.RecordBatch.from_arrays([pa.array([langs[start]]).take(pa.array(np.zeros(len(some), np.int64))), phrases[i : i + _BATCH], pa.array(some)], schema=_ROWS)
                        start = end

    return run


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter's place of each phrase of two words."""
    for batch in batches:
        langs = word_hashes(batch.column(0).to_pylist())
        halves = [p.split(" ") for p in batch.column(1).to_pylist()]
        spot = Known.spot(langs, word_hashes([a for a, _ in halves]), word_hashes([b for _, b in halves])) if halves else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([i64(spot)], ["spot"])


#: The filter has 16 to 32 bits a phrase, from 2**16 up to so many in all (128 MB); beyond that it lets more through, and the counts decide.
FILTER_BITS = 30


def _known(pairs: DataFrame, most_bits: int = FILTER_BITS) -> Known:
    bits = min(max(16, 5 + pairs.count().bit_length() - 1), most_bits)
    spots = pairs.mapInArrow(_spots, "spot long").select(F.pmod("spot", F.lit(1 << bits)).alias("spot"))
    found = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Known(bits, words)


def phrase_counts(docs: DataFrame, most: int = 4, least: int = 30, keep_words: bool = True) -> DataFrame:
    """lang, phrase (words apart by a space), size (words), f: every phrase of 1 to `most` words that occurs `least` times within pieces; the empty phrase (size 0) counts all words.

    A phrase of three words or more occurs `least` times only if each pair in it does, so those with a pair that doesn't aren't made into rows. Words and pairs are counted without
    any such test. Null languages are `und`; null texts are empty; repeated rows count each; an empty table has no phrases.
    """
    spark = docs.sparkSession
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))

    def counted(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
        return sums.where((F.col("f") >= least) | (F.col("phrase") == "")).select("lang", "phrase", size.cast("int").alias("size"), "f")

    short = materialize(counted(given.mapInArrow(_counts(_short), "lang string, phrase string, c long")), "phrases-short")
    if most < 3:
        return short.where(F.col("size") <= most)
    known = spark.sparkContext.broadcast(_known(short.where("size = 2").select("lang", "phrase")))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counts(_long(known.value, most))(batches)

    rest = materialize(counted(given.mapInArrow(long, "lang string, phrase string, c long")), "phrases-long")
    return short.unionByName(rest)


def collocations(docs: DataFrame, most: int = 4, least: int = 30, top: int = 2000, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `most` words.

    a is the phrase's count, l and r those of its parts at its lowest-scoring cut, score floor(2000000 * a / (l + r)), n the language's words. Phrases of which a one-word
    extension has 80 % of the occurrences are left out; a longer phrase never occurs more often than one between, so that covers all longer ones. Ties go by a, then by the
    phrase's bytes. Hot languages are ranked in `salts` parts first.
    """
    counts = phrase_counts(docs, most, least)
    c, dec = F.col, lambda x: x.cast("decimal(20,0)")
    words = F.split("phrase", " ")
    candidates = counts.where("size >= 2").select("lang", "phrase", c("f").alias("a"), c("size"), words.alias("words"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), c("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), c("k")), " ").alias("left"), F.array_join(F.slice("words", c("k") + 1, c("size") - c("k")), " ").alias("right"))
    parts = counts.where("size >= 1")
    cuts = cuts.join(parts.select("lang", c("phrase").alias("left"), c("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", c("phrase").alias("right"), c("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    longer = candidates.where("size >= 3").select("lang", c("a").alias("above"), F.explode(F.array(F.slice("words", F.lit(1), c("size") - 1), F.slice("words", F.lit(2), c("size") - 1))).alias("part"))
    longer = longer.groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("above").alias("above"))
    explained = longer.join(candidates.select("lang", "phrase", "a"), ["lang", "phrase"]).where(dec(c("above")) * 100 >= dec(c("a")) * 80).select("lang", "phrase")
    left = worst.join(explained, ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(c("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(c("rank") <= top)
    total = counts.where("size = 0").select("lang", c("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS size))),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts) WHERE place = 1),
inner_parts AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, a AS above FROM (
    SELECT *, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM candidates))),
explained AS (SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inner_parts p ON p.lang = c.lang AND p.phrase = c.phrase WHERE 100 * above >= 80 * a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM worst w
  WHERE NOT EXISTS (SELECT 1 FROM explained e WHERE e.lang = w.lang AND e.phrase = w.phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
