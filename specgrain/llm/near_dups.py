"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, i64, join_hash, marked, materialize, mix, shingles, sliced, slices, table

BANDS, ROWS = 25, 5
#: Coordinates of the sketches that choose what to verify, a byte each; members of a bucket's block.
SKETCH, BLOCK = 512, 1024
_NONE = np.uint64((1 << 64) - 1)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int, reach: float = 2.0) -> np.ndarray:
    """k coordinates of each of several weighted sets (concatenated; sizes: their elements). Two sets agree in a coordinate with probability of their weighted Jaccard similarity.

    Every element owns a strip of unit width for each unit of weight. Hashed darts fall on a strip as a Poisson process along
    the rank axis, the same darts for every set that has the strip, each aimed at one of k coordinates. Only darts below a
    rank limit are thrown: about k (ln k + reach) of them for any set, however many elements it has. The earliest dart of a
    coordinate names it; sets with an empty coordinate throw again with twice the limit.
    """
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    total = np.bincount(doc, weights, n)
    row = np.repeat(np.arange(len(elements)), weights)
    strip = np.arange(len(row)) - np.repeat(np.cumsum(weights) - weights, weights)
    limit = k * (math.log(k) + reach) / np.maximum(total, 1)
    live, at, rank = join_hash(elements[row], strip.astype(np.uint64)), doc[row], np.zeros(len(row))
    out = np.full(n * k, _NONE)
    turn = 0
    while len(live):
        turn += 1
        dart = mix(live + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53))
        below = np.flatnonzero(rank < limit[at])
        live, at, rank, dart = live[below], at[below], rank[below], mix(dart[below])
        # The rank's bits above 32 of the dart's own: the least is the earliest, and tells darts apart.
        packed = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | dart & np.uint64(0xFFFFFFFF)
        np.minimum.at(out, at * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64), packed)
    out = out.reshape(n, k)
    again = np.flatnonzero((out == _NONE).any(axis=1) & (sizes > 0))
    if len(again):
        which = np.isin(doc, again)
        out[again] = dart_signatures(elements[which], weights[which], sizes[again], k, 2 * reach + math.log(k))
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One hash a band, each of the band's number and its coordinates; a row for each signature."""
    parts = signatures.reshape(len(signatures), bands, -1)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for i in range(parts.shape[2]):
        h = join_hash(h, parts[:, :, i])
    return h


def _sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [shingles(t, k) for t in texts]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.array([len(f[0]) for f in found])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / (a[1].sum() + b[1].sum() - both) if both else 0.0


def _banded(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, band) of every text, id being a hash of the whole text: copies give equal rows."""

    def run(batches):
        for batch in sliced(batches, 1):
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                e, w, n = _sets(texts[a:b], shingle)
                some = np.flatnonzero(n)
                if len(some):
                    keys = band_keys(dart_signatures(e, w, n[some], bands * rows), bands)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b][some], bands)), i64(keys.ravel())], ["id", "band"])

    return docs.select("id", "text").mapInArrow(run, "id long, band long").distinct()


def _sketched(texts: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        for batch in sliced(batches, 1):
            own = batch.column(1).to_pylist()
            for a, b in slices(own):
                sketch = dart_signatures(*_sets(own[a:b], shingle), SKETCH).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in sketch], pa.binary())], ["id", "sketch"])

    return texts.select("id", "text").mapInArrow(run, "id long, sketch binary")


class Linked:
    """Which members of a block pair are linked so far."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def link(self, x: int, y: int) -> bool:
        p, q = self.find(x), self.find(y)
        self.root[q] = p
        return p != q


def likely_pairs(a: np.ndarray, b: np.ndarray | None, least: float) -> tuple[Linked, list[tuple[int, int]], list[tuple[float, int, int]]]:
    """Pairs of two blocks of sketches (or of one), as places in both together. The agreement of sketches tells similarity up to a deviation of
    sqrt(least (1 - least) / SKETCH); pairs over four of them below `least` are passed over. Of those over four above it, which are surely
    similar, a spanning forest is returned; those in between that it leaves apart are returned as unsure, the likeliest first."""
    other, shift = (a, 0) if b is None else (b, len(a))
    spread = 4 * math.sqrt(least * (1 - least) / SKETCH)
    linked = Linked(len(a) + (0 if b is None else len(b)))
    sure, unsure = [], []
    for i, x in enumerate(a):
        share = np.count_nonzero((other[i + 1 :] if b is None else other) == x, axis=1) / SKETCH
        for j in np.flatnonzero(share >= least - spread).tolist():
            y = j + (i + 1 if b is None else shift)
            if share[j] < least + spread:
                unsure.append((-share[j], i, y))
            elif linked.link(i, y):
                sure.append((i, y))
    return linked, sure, sorted(p for p in unsure if linked.find(p[1]) != linked.find(p[2]))


def _buckets(batches, wide: bool) -> Iterator[tuple]:
    """Rows (band, i, j, own, id, sketch and, if wide, text) in order of (band, i, j): key, ids, sketches and texts of each bucket's two blocks (the second None if i = j)."""
    key, held = None, []

    def whole():
        t = pa.Table.from_batches(held)
        own, ids = t.column(3).to_numpy(), t.column(4).to_numpy()
        sketch = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(t.num_rows, SKETCH)
        first = np.flatnonzero(own == key[1])
        second = None if key[1] == key[2] else np.flatnonzero(own == key[2])
        order = first if second is None else np.r_[first, second]
        texts = t.column(6).take(order).to_pylist() if wide else None
        return key, own[order], ids[order], sketch[first], None if second is None else sketch[second], texts

    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in range(3)]
        first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]) if batch.num_rows else []
        for s, e in zip(first, [*first[1:], batch.num_rows], strict=True):
            k = tuple(int(c[s]) for c in cols)
            if k != key and held:
                yield whole()
                held = []
            key = k
            held.append(batch.slice(s, e - s))
    if held:
        yield whole()


_CELLS = ["band", "i", "j"]
_CHOSEN = "band long, i int, j int, own int, id long, rep long"


def _likely(least: float):
    """Surely similar pairs (id, rep; own -1), and the members of buckets that have unsure ones (rep null)."""

    def run(batches):
        rows = []
        for key, own, ids, a, b, _ in _buckets(batches, False):
            _, sure, unsure = likely_pairs(a, b, least)
            rows += [(*key, -1, int(ids[x]), int(ids[y])) for x, y in sure]
            rows += [(*key, int(own[x]), int(ids[x]), None) for x in {z for p in unsure for z in p[1:]}]
            if len(rows) > 10_000:
                yield chosen(rows)
                rows = []
        yield chosen(rows)

    def chosen(rows):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        cols = zip(*rows, strict=True) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in _CHOSEN.split(", ")])

    return run


def _resolved(shingle: int, least: float):
    """Links among the members of buckets with unsure pairs, by their whole texts: a pair is compared unless earlier links join it already."""

    def run(batches):
        for _, _, ids, a, b, texts in _buckets(batches, True):
            linked, _, unsure = likely_pairs(a, b, least)
            known: dict[int, tuple] = {}
            x, y = [], []
            for _, p, q in unsure:
                if linked.find(p) != linked.find(q):
                    for z in (p, q):
                        if z not in known:
                            known[z] = shingles(texts[z], shingle)
                    if similarity(known[p], known[q]) >= least:
                        linked.link(p, q)
                        x.append(ids[p])
                        y.append(ids[q])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(id, rep, ok): whether the two texts are at least so similar."""

    def run(batches):
        last, known = None, None
        for batch in sliced(batches, 2):
            ok = []
            for rep, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if rep != last:
                    last, known = rep, shingles(b, shingle)
                ok.append(bool(similarity(shingles(a, shingle), known) >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["id", "rep", "ok"])

    both = pairs.join(texts, "id").withColumnRenamed("text", "a").join(texts.select(F.col("id").alias("rep"), F.col("text").alias("b")), "rep")
    return both.select("id", "rep", "a", "b").mapInArrow(run, "id long, rep long, ok boolean")


def similar_texts(docs: DataFrame, least: float, shingle: int, bands: int, rows: int) -> DataFrame:
    """Verified links (a, b) between the ids of different texts of docs (id, text)."""
    banded = materialize(_banded(docs, shingle, bands, rows), "near-bands")
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(banded.join(sizes, "band"), "near-buckets")
    named = members.select("id").distinct()
    # A filter of bounded size instead of a join: copies of a text then meet in map-side combination first, not in one task.
    texts = materialize(marked(docs, named, "id").where("maybe").groupBy("id").agg(F.first("text").alias("text")), "near-texts")
    sketches = materialize(_sketched(texts, shingle), "near-sketches")
    # A large bucket is dealt into blocks: a row goes to the tasks (i, j) for j >= i and (j, i) for j < i of its own block i.
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.col("id"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id").join(sketches, "id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(*_CELLS, "own", "id", "sketch").repartition(parts, *_CELLS).sortWithinPartitions(*_CELLS)
    likely = materialize(dealt.mapInArrow(_likely(least), _CHOSEN), "near-likely")
    pairs = likely.where("own < 0").select(F.greatest("id", "rep").alias("id"), F.least("id", "rep").alias("rep")).distinct()
    sure = _verified(pairs, texts, shingle, least).where("ok").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    unsure = likely.where("own >= 0").select(*_CELLS, "own", "id").join(sketches, "id").join(texts, "id")
    unsure = unsure.select(*_CELLS, "own", "id", "sketch", "text").repartition(parts, *_CELLS).sortWithinPartitions(*_CELLS)
    return materialize(sure, "near-sure").unionByName(materialize(unsure.mapInArrow(_resolved(shingle, least), "a long, b long"), "near-unsure"))


#: Names that may be shared by different texts; even 2**40 texts have only some 70,000 expected.
SHARED = 1 << 17


def text_id(docs: DataFrame) -> Column:
    """A name of 64 bits for each text of docs (text), so that texts that differ in 128 bits (the name itself, crc32 and length) have different ones."""
    name, check = F.xxhash64("text"), F.crc32(F.col("text").cast("binary")).bitwiseXOR(F.shiftleft(F.octet_length("text").cast("long"), 32))
    twice = docs.select(name.alias("id"), check.alias("c")).groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b")
    shared = [r["id"] for r in twice.select("id").limit(SHARED + 1).collect()]
    if len(shared) > SHARED:
        raise ValueError("too many texts share a name")
    return F.when(name.isin(shared), F.xxhash64("text", check)).otherwise(name) if shared else name


def near_duplicates(
    docs: DataFrame, least: float = 0.8, shingle: int = 5, bands: int = BANDS, rows: int = ROWS, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """doc_id, group_id, group_size and kept of every document.

    Groups are the components of links between documents whose weighted sets of five-word shingles (lower-cased words) have a
    Jaccard similarity of at least `least`. Exact copies are one text from the start, named by a hash of it, so copies never
    meet in pairs. Texts that share a band of their signatures are candidates (a pair at 0.8 shares none with probability 5e-5). In
    each bucket, dealt into blocks if it is large, longer sketches choose what to verify: n surely similar texts give n - 1 pairs,
    texts that are surely unlike none; unsure pairs are settled where their bucket is, one link for those that others join. All links are verified on whole texts. group_id: the group's smallest doc_id, which alone is kept.

    Texts are named by 64 bits; where two texts that differ in their crc32 or length share a name, they get longer ones (text_id).

    Null or empty texts have no shingles: they are alike as exact copies (null counts as empty). Texts of fewer than five words are
    one shingle. Of repeated rows with one doc_id all have that row's result. A null doc_id is grouped by its text, and kept only in a
    group that has no other id. Extra columns are ignored. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit("")).alias("text")
    d = docs.select(F.col(key).alias("doc_id"), body)
    d = d.withColumn("id", text_id(d))
    edges = similar_texts(d.select("id", "text"), least, shingle, bands, rows)
    named = connected_components(edges, "near-edges").select(F.col("node").alias("id"), "component")
    rows_ = materialize(d.select("doc_id", "id").join(named, "id", "left").select("doc_id", F.coalesce("component", "id").alias("group")), "near-groups")
    # A table of its own: the join then has shuffles on both sides, of which Spark can split a large group's.
    groups = materialize(rows_.groupBy("group").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")), "near-sizes")
    return rows_.join(groups, "group").select("doc_id", "group_id", "group_size", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
