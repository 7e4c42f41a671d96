"""Document quality: random Fourier features of text statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialize, sliced, slices, table

STATS = [
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "high", "stops", "exclaims", "pipes", "symbols",
    "other_marks", "words_a_line", "distinct_words", "distinct_lines", "upper_words", "marked_words",
]

#: Class of each byte: 1 lower, 2 upper, 3 digit, 4 beyond ASCII, 5 .,;:?'"-() 6 ! 7 | 8 #$%&*@^~<>=+_\/ 9 other marks and controls, 10 space, 11 line feed.
_CLASS = np.full(256, 9, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
for _chars, _c in ((b".,;:?'\"-()", 5), (b"!", 6), (b"|", 7), (b"#$%&*@^~<>=+_\\/", 8), (b" \t\r\v\f", 10), (b"\n", 11)):
    _CLASS[list(_chars)] = _c


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATS for each text."""
    enc = [t.encode() for t in texts]
    size = np.array([len(e) for e in enc], np.int64)
    off = np.r_[0, np.cumsum(size)]
    cls = _CLASS[np.frombuffer(b"".join(enc), np.uint8)]
    ends = off[1:]

    def per_text(flags: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return c[ends] - c[off[:-1]]

    n = [per_text(cls == c) for c in range(12)]
    blank = cls >= 10
    begin = np.r_[True, blank[:-1]] & ~blank if len(cls) else np.zeros(0, bool)
    begin[off[:-1][size > 0]] = ~blank[off[:-1][size > 0]]
    words = per_text(begin)
    capital = per_text(begin & (cls == 2))
    last = np.r_[blank[1:], True] if len(cls) else blank
    last[ends[size > 0] - 1] = True
    marked = per_text(~blank & last & (cls >= 6))
    # Rates of short texts are drawn towards those of ordinary prose by a few imagined words, and so aren't extreme by chance.
    w, b, lines = words + 10.0, size + 60.0, n[11] + 1
    distinct_words = np.array([len(set(e.split())) for e in enc], float)
    distinct_lines = np.array([len(set(e.split(b"\n"))) for e in enc], float)
    letters = n[1] + n[2] + 50.0
    return np.stack(
        [
            np.log1p(size), np.log1p(words), (size - n[10] - n[11] + 50) / w, n[2] / letters, n[3] / b, n[4] / b, n[5] / w, n[6] / w, n[7] / w,
            n[8] / w, n[9] / w, np.log1p(words / lines), (distinct_words + 10) / w, distinct_lines / lines, capital / w, marked / w,
        ],
        axis=1,
    )


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep and the array of STATS of every whole text; a null text counts as empty."""

    def run(batches):
        for batch in sliced(batches, 1):
            texts = batch.column(1).to_pylist()
            x = np.concatenate([statistics(texts[a:b]) for a, b in slices(texts)] or [np.zeros((0, len(STATS)))])
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.FixedSizeListArray.from_arrays(flat, len(STATS)).cast(pa.list_(pa.float64())), *batch.columns[2:]], ["doc_id", "stats", *keep]
            )

    kind = docs.schema[key].dataType.simpleString()
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_body"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep))).mapInArrow(run, f"doc_id {kind}, stats array<double>{more}")


class Fourier:
    """z(x) = sqrt(2 / D) cos(W s(x) + b): inner products of z approximate a Gaussian kernel of the standardised statistics s(x)."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, 1 / width, (len(mean), features))
        self.b = rng.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.std, -6, 6)
        z = np.cos(s @ self.w + self.b) * math.sqrt(2 / len(self.b))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def normal_equations(rows: DataFrame, fourier: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y of rows (stats, y). Partitions sum their own rows; then row i of the matrix is summed over the partitions, so the driver gets one row of each i."""
    d = len(fourier.b) + 1

    def sums(frames):
        a = np.zeros((d, d + 1))
        for pdf in frames:
            if len(pdf):
                z = fourier(np.stack(pdf["stats"].to_numpy()))
                a[:, :d] += z.T @ z
                a[:, d] += z.T @ pdf["y"].to_numpy(float)
        yield pd.DataFrame({"i": np.arange(d), "v": [r.tobytes() for r in a]})

    def total(frames):
        acc: dict[int, np.ndarray] = {}
        for pdf in frames:
            for i, v in zip(pdf["i"], pdf["v"], strict=True):
                acc[i] = acc.get(i, 0) + np.frombuffer(v)
        yield pd.DataFrame({"i": list(acc), "v": [r.tobytes() for r in acc.values()]})

    got = rows.mapInPandas(sums, "i int, v binary").repartition("i").mapInPandas(total, "i int, v binary").collect()
    a = np.zeros((d, d + 1))
    for r in got:
        a[r["i"]] = np.frombuffer(r["v"])
    return a[:, :d], a[:, d]


def isotonic(score: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over rows sorted by score: each block's mean score and its label mean, both rising."""
    blocks: list[list[float]] = []
    for s, m, w in zip(score, mean, weight, strict=True):
        blocks.append([s, m, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            s2, m2, w2 = blocks.pop()
            s1, m1, w1 = blocks[-1]
            blocks[-1] = [(s1 * w1 + s2 * w2) / (w1 + w2), (m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def quality_scores(
    docs: DataFrame, labels: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1e-4, threshold: float = 0.7, seed: int = 7,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, keep (further columns of docs), held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold) of every document.

    Labels count only where crc32(doc_id as text) mod 4 is not 2: remainders 0 and 3 fit the ridge scores, remainder 1 the
    isotonic calibration (labels pooled in bins of 1e-4 of the score). Inputs of a score are the text's statistics alone.

    Null or empty texts have the statistics of a text without words and are scored like others. Null labels are left out; several labels of a document
    count as their mean. A null doc_id is scored and never learnt from. With no labels all scores are 0.5 and, without calibration
    rows, the clipped ridge score. Repeated rows give repeated rows; extra columns are ignored; an empty table gives no rows.
    """
    stats = materialize(document_statistics(docs, keep=keep), "quality-stats")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    fold = crc_mod(F.col("doc_id"), 4)
    train = materialize(stats.where(fold != 2).join(known, "doc_id").select("stats", "y", fold.alias("fold")), "quality-train")
    fit = train.where("fold <> 1")
    n = len(STATS)
    at = fit.select(*(F.col("stats")[i].alias(f"s{i}") for i in range(n)))
    m = at.agg(F.count("*").alias("n"), *(F.avg(f"s{i}") for i in range(n)), *(F.stddev_pop(f"s{i}") for i in range(n))).head()
    held = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    if not m[0]:
        score = F.lit(0.5)
        return stats.select("doc_id", *keep, held, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    fourier = Fourier(np.array(m[1 : n + 1], float), np.array(m[n + 1 :], float), features, width, seed)
    a, b = normal_equations(fit, fourier)
    weights = np.linalg.solve(a + ridge * m[0] * np.eye(len(a)), b)

    def scored(rows: DataFrame, extra: list[str]) -> DataFrame:
        def run(frames):
            for pdf in frames:
                raw = fourier(np.stack(pdf["stats"].to_numpy())) @ weights if len(pdf) else np.zeros(0)
                yield pdf[extra].assign(raw=raw)

        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in extra)
        return rows.select(*extra, "stats").mapInPandas(run, f"{kinds}, raw double")

    # At most 30,001 bins, whatever the number of rows.
    pooled = (
        scored(train.where("fold = 1"), ["y"])
        .groupBy(F.round(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)), 4).alias("s"))
        .agg(F.avg("y").alias("y"), F.count("*").alias("w"))
        .toPandas()
        .sort_values("s")
    )
    if len(pooled):
        xs, ys = isotonic(pooled["s"].to_numpy(float), pooled["y"].to_numpy(float), pooled["w"].to_numpy(float))
    else:
        xs, ys = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def final(frames):
        for pdf in frames:
            raw = fourier(np.stack(pdf["stats"].to_numpy())) @ weights if len(pdf) else np.zeros(0)
            score = np.clip(np.interp(raw, xs, ys), 0, 1)
            yield pdf[["doc_id", *keep]].assign(score=score, predicted=(score >= threshold).astype(np.int32))

    kind = stats.schema["doc_id"].dataType.simpleString()
    more = "".join(f", {c} {stats.schema[c].dataType.simpleString()}" for c in keep)
    return (
        stats.mapInPandas(final, f"doc_id {kind}{more}, score double, predicted int")
        .select("doc_id", *keep, held, "score", "predicted")
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
