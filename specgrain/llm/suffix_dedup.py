"""Removal of repeated 100-byte strings by prefix doubling over sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILTER_BITS, filter_words, i64, marked, materialize, mix, sliced, table

#: Threshold in bytes; length of an anchor's own string; starts in a window that share their anchor at most; starts in a block, and the bytes that all strings of a block share.
LENGTH, SEED, BLOCK = 100, 52, 8
SPREAD, CORE = LENGTH - SEED + 1, LENGTH - BLOCK + 1
#: Bytes named at once: the arrays stay in the cache, and 20 bits hold a place.
CHUNK = 1 << 16
_PLACE = np.uint64((1 << 20) - 1)
_TWO = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
#: (bytes, bytes of each half): how a string's name follows from those of two strings, overlapping if need be.
_LEVELS = ((4, 2), (8, 4), (16, 8), (32, 16), (SEED, 32), (64, 32), (CORE, 64), (LENGTH, 64))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the string whose halves are named a and b."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def names(data: np.ndarray, levels=_LEVELS) -> dict[int, np.ndarray]:
    """Names of the strings of every level at every place, by doubling."""
    n = len(data)
    h = {2: _TWO[data[:-1].astype(np.uint16) << 8 | data[1:]]}
    for size, half in levels:
        h[size] = _pair(h[half][: n - size + 1], h[half][size - half : n - half + 1]) if n >= size else np.empty(0, np.uint64)
    return h


def packs(sizes: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Work of about CHUNK bytes: documents a to b whole, or window starts from lo to hi of one longer document."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > CHUNK:
            yield start, i, 0, 0
            start, total = i, 0
        total += n
        if n > CHUNK:
            for lo in range(0, n - LENGTH + 1, CHUNK):
                yield i, i + 1, lo, min(lo + CHUNK, n - LENGTH + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes), 0, 0


def anchors(texts: list[bytes], seeds_only: bool = False) -> Iterator[dict[str, np.ndarray]]:
    """Anchors of the texts. Each start of a LENGTH-byte string is led by the SEED-byte string with the least name among the SPREAD inside it.

    Equal strings so have equal leaders at equal offsets, whatever surrounds them. A row stands for a run of starts, from `start` to
    `start + more`, with one leader `lead` bytes after its start: the leader's name `seed`, the name `whole` of all bytes that the run's strings cover, and the text's index.
    """
    sizes = [len(t) for t in texts]
    levels = _LEVELS[: next(i for i, x in enumerate(_LEVELS) if x[0] == SEED) + 1] if seeds_only else _LEVELS
    for a, b, lo, hi in packs(sizes):
        body = texts[a][lo : hi + LENGTH - 1] if hi else b"".join(texts[a:b])
        n = len(body) - LENGTH + 1
        if n <= 0:
            continue
        h = names(np.frombuffer(body, np.uint8), levels)
        least = (h[SEED] & ~_PLACE) | np.arange(len(h[SEED]), dtype=np.uint64)
        width = 1
        while width < SPREAD:
            step = min(width, SPREAD - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        ends = np.array([len(body)]) if hi else np.cumsum(sizes[a:b])
        valid = np.ones(n + 1, bool)
        for e in ends.tolist():
            valid[max(0, e - LENGTH + 1) : e] = False
        if not hi:
            for i in np.flatnonzero(np.array(sizes[a:b]) < LENGTH):
                valid[max(0, ends[i] - sizes[a + i]) : ends[i]] = False
        changed = np.ones(n + 1, bool)
        changed[1:n] = least[1:] != least[:-1]
        s = np.flatnonzero(changed[:n] & valid[:n] | valid[:n] & ~np.r_[False, valid[: n - 1]])
        if not len(s):
            continue
        p = (least[s] & _PLACE).astype(np.int64)
        if seeds_only:
            yield {"seed": h[SEED][p]}
            continue
        d = np.searchsorted(ends, s, "right")
        e = np.minimum(np.r_[s[1:], n] - 1, ends[d] - LENGTH)
        begin = np.full(len(d), -lo) if hi else ends[d] - np.array(sizes[a:b])[d]
        shape = ((e - s) << 8 | (p - s)).astype(np.uint64)
        whole = _pair(_pair(h[LENGTH][s], h[64][e + LENGTH - 64]), mix(shape))
        yield {"doc": d + a, "seed": h[SEED][p], "whole": whole, "start": s - begin, "lead": p - s, "more": e - s}


def _seeds(batches):
    for batch in sliced(batches, 0):
        found = [x["seed"] for x in anchors([t.encode() for t in batch.column(0).to_pylist()], seeds_only=True)]
        if found:
            yield pa.RecordBatch.from_arrays([i64(np.concatenate(found))], ["seed"])


ROWS = "seed long, k long, at long, what long"


def _packed(seed, k, start, crc, whole, lead, more) -> pa.RecordBatch:
    """A run of strings as ROWS. at: start and the text's crc32; what: 32 bits of the name of all its bytes, the leader's offset, and the number of further strings."""
    what = (whole >> np.uint64(32)).astype(np.int64) << 16 | lead << 8 | more
    return pa.RecordBatch.from_arrays([i64(seed), pa.array(k), pa.array(start << 32 | crc), pa.array(what)], ["seed", "k", "at", "what"])


def _rows(shared):
    """ROWS of all anchors but those whose seed the filter lacks."""

    def run(batches):
        bits = shared.value
        for batch in sliced(batches, 2):
            k, crc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found = []
            for x in anchors([t.encode() for t in batch.column(2).to_pylist()]):
                spot = x["seed"] & np.uint64((1 << FILTER_BITS) - 1)
                ok = np.flatnonzero(bits[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1))
                found.append({c: v[ok] for c, v in x.items()})
            if found:
                x = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
                yield _packed(x["seed"], k[x["doc"]], x["start"], crc[x["doc"]], x["whole"], x["lead"], x["more"])

    return run


def _joined(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of sorted, overlapping intervals: the intervals' range, and the bytes from the first begin to the last end; none much over CHUNK."""
    first = 0
    hi = np.maximum.accumulate(end)
    for i in range(1, len(begin) + 1):
        if i == len(begin) or begin[i] > hi[i - 1] or hi[i - 1] - begin[first] > CHUNK:
            yield first, i, int(begin[first]), int(end[first:i].max())
            first = i


def _finer(block: int):
    """The strings of given runs in blocks of leader offsets: a block is ranked by the bytes that all its strings share, a block of one by its string."""
    core = LENGTH - block + 1

    def blocks(part: list[tuple[bytes, np.ndarray, int, int]], k: np.ndarray, crc: np.ndarray) -> pa.RecordBatch:
        """Of pieces of texts: (bytes, sorted runs, index of the text, place of the piece in it)."""
        base = np.cumsum([0] + [len(x[0]) for x in part[:-1]])
        n = [len(x[1]) for x in part]
        runs = np.concatenate([x[1] for x in part])
        shift = np.repeat(base - np.array([x[3] for x in part]), n)
        doc = np.repeat([x[2] for x in part], n)
        start, lead, count = (runs >> 16) + shift, runs >> 8 & 255, (runs & 255) + 1
        row = np.repeat(np.arange(len(runs)), count)
        at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        j = (start[row] + lead[row] - at) // block
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (j[1:] != j[:-1])])
        s, e, row, j = at[first], at[np.r_[first[1:], len(at)] - 1], row[first], j[first]
        p = start[row] + lead[row]
        h = names(np.frombuffer(b"".join(x[0] for x in part), np.uint8))
        shape = ((e - s) << 8 | (p - s)).astype(np.uint64)
        seed = _pair(h[core][p - j * block], mix(j.astype(np.uint64)))
        whole = _pair(_pair(h[LENGTH][s], h[64][e + LENGTH - 64]), mix(shape))
        return _packed(seed, k[doc[row]], s - shift[row], crc[doc[row]], whole, p - s, e - s)

    def run(batches):
        for batch in sliced(batches, 2):
            k, crc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            part, size = [], 0
            for d, (text, runs) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                body, runs = text.encode(), np.sort(np.array(runs, np.int64))
                start, more = runs >> 16, runs & 255
                for a, b, lo, hi in _joined(start, start + more + LENGTH):
                    part.append((body[lo:hi], runs[a:b], d, lo))
                    size += hi - lo
                    if size > CHUNK:
                        yield blocks(part, k, crc)
                        part, size = [], 0
            if part:
                yield blocks(part, k, crc)

    return run


def remove_cover(text: bytes, runs: np.ndarray) -> tuple[bytes, int, int]:
    """What is left without the bytes that the runs' strings cover, how many bytes go, and in how many maximal spans."""
    if not len(runs):
        return text, 0, 0
    n = len(text)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs >> 16, 1)
    np.add.at(edge, (runs >> 16) + (runs & 255) + LENGTH, -1)
    gone = np.cumsum(edge[:n]) > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _judged(rows: DataFrame, label: str) -> DataFrame:
    """(k, crc, run, again) of rows: again where equal strings start earlier throughout; the others only where unequal runs have one seed, and they are the first of theirs."""
    place = F.struct("k", F.shiftright("at", 32).alias("start"))
    kinds = materialize(rows.groupBy("seed", "what").agg(F.min(place).alias("first"), F.max(place).alias("last")), f"{label}-kinds")
    mixed = kinds.groupBy("seed").count().where("count > 1").select("seed", F.lit(True).alias("mixed"))
    kinds = kinds.join(mixed, "seed", "left").where("mixed or first < last").select("seed", "what", "first", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    judged = rows.join(kinds, ["seed", "what"]).withColumn("again", place > F.col("first")).where("again or mixed")
    run = F.shiftleft(F.shiftright("at", 32), 16).bitwiseOR(F.col("what").bitwiseAND(65535))
    return materialize(judged.select("k", F.col("at").bitwiseAND((1 << 32) - 1).alias("crc"), run.alias("run"), "again"), f"{label}-judged")


def _by_text(runs: DataFrame) -> DataFrame:
    return runs.groupBy("k", "crc").agg(F.collect_list("run").alias("runs"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(k, crc, run) of docs (k, crc, text): starts of LENGTH-byte strings that also start earlier. run: first start, leader's offset, number of further starts.

    The rounds of prefix doubling, over sampled suffixes instead of all: (1) anchors are ranked by their SEED bytes, and those that
    are unique leave; (2) the rest is ranked again by all the bytes that their strings cover (100 to 164): of equal ones all but the
    first are repeated throughout; (3) where one seed stands in unequal surroundings, the first of each kind goes on in blocks,
    ranked by the CORE bytes that a block's strings share and then by all of them; (4) what is still undecided goes on string by
    string, at the full LENGTH. Minima and counts combine map-side in every round, and hot strings cost as many rows as places.
    """
    seeds = docs.select("text").mapInArrow(_seeds, "seed long")
    shared = materialize(seeds.groupBy("seed").count().where("count > 1").select("seed"), "suffix-seeds")
    # The filter only saves rows, whatever it lets pass; the join decides.
    got = filter_words(shared, F.pmod("seed", F.lit(1 << FILTER_BITS))).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    rows = docs.select("k", "crc", "text").mapInArrow(_rows(docs.sparkSession.sparkContext.broadcast(bits)), ROWS)
    found = [_judged(materialize(rows.join(shared, "seed", "left_semi"), "suffix-anchors"), "suffix-anchors")]
    todo = _by_text(found[0].where("not again"))
    texts = marked(docs, todo, "k").where("maybe").select("k", "crc", "text")
    texts = materialize(texts.join(todo, ["k", "crc"]), "suffix-texts")
    for block in (BLOCK, 1):
        rows = materialize(texts.select("k", "crc", "text", "runs").mapInArrow(_finer(block), ROWS), f"suffix-blocks{block}")
        found.append(_judged(rows, f"suffix-blocks{block}"))
        if block > 1:
            texts = texts.drop("runs").join(_by_text(found[-1].where("not again")), ["k", "crc"])
    out = found[0].where("again")
    for f in found[1:]:
        out = out.unionByName(f.where("again"))
    return out.select("k", "crc", "run")


def _keyed(docs: DataFrame, text: str, key: str, *keep: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        *keep, F.coalesce(F.col(key), F.lit(-(1 << 63))).cast("long").alias("k"), F.crc32(body.cast("binary")).alias("crc"), body.alias("text")
    )


def with_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, text (null as empty) and runs (null or empty: none) of every row of docs."""
    keyed = _keyed(docs, text, key, *keep)
    runs = materialize(_by_text(repeated_runs(keyed.select("k", "crc", "text"))), "suffix-runs")
    both = marked(keyed, runs, "k")
    clean = both.where("not maybe").select(*keep, "text", F.expr("cast(null as array<long>)").alias("runs"))
    return clean.unionByName(both.where("maybe").join(runs, ["k", "crc"], "left").select(*keep, "text", "runs"))


def suffix_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, without each byte covered by a 100-byte string that also starts earlier.

    Texts are UTF-8 bytes; earlier is a smaller doc_id, or a smaller start in the same document, overlaps included; matches never
    cross documents, and strings are judged on the input. Strings are compared by names of 64 bits and more.

    A null text counts as empty; texts under 100 bytes lose nothing. A null doc_id counts as smaller than all others. Rows with one doc_id
    are one document's: of equal starts in them none is earlier, so repeated rows get equal results. Extra columns are ignored. An empty table gives no rows.
    """

    def run(batches):
        for batch in sliced(batches, 1):
            out = []
            for t, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                body = t.encode()
                kept, gone, spans = remove_cover(body, np.array(runs or [], np.int64))
                out.append((len(body), gone, spans, hashlib.sha256(kept).hexdigest()))
            n, gone, spans, sha = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = with_runs(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), keep=("doc_id",))
    return rows.select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def strip_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with each text replaced by what suffix_dedup keeps of it; UTF-8 that a cut splits loses the broken character. Empty rests stay, null texts become empty; other columns are unchanged."""

    def run(batches):
        for batch in sliced(batches, 0):
            out = []
            for t, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append(remove_cover(t.encode(), np.array(runs, np.int64))[0].decode("utf-8", "ignore") if runs else t)
            rest = batch.drop_columns(["_text", "_runs"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.string())], [*rest.schema.names, "_kept"])

    names_ = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names_)
    own = dict(zip(docs.columns, names_, strict=True))
    rows = with_runs(renamed, own[text], own[key], tuple(names_)).withColumnsRenamed({"text": "_text", "runs": "_runs"}).select("_text", "_runs", *names_)
    schema = ", ".join(f"{n} {renamed.schema[n].dataType.simpleString()}" for n in names_) + ", _kept string"
    done = rows.mapInArrow(run, schema)
    return done.select(*(F.col("_kept" if c == text else n).alias(c) for c, n in own.items()))
