"""Merkle manifest of a dataset: a mountain range of hashes for each group of rows, one over the groups' roots, and a proof for every row.

Leaves are sorted into partitions and numbered. Each partition carries its leaves up a stack of peaks with the base as fanout; runs that it holds whole become
nodes there, and what is left at its unaligned edges is merged level by level by Spark. A group's last run is hashed as it is, without padding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: Children of a node.
BASE = 16
#: Leaves in a partition at most, but for the unevenness of a range partitioning: a partition's hashes are in memory while its proofs are made.
PART_ROWS = 1 << 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(hashes: list[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def row_hash(*columns: Column) -> Column:
    """sha256 of the columns in order: `-` if null, else the UTF-8 byte count, a colon and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


class Peaks:
    """The stack of one group's leaves in one partition: for each level the nodes of the run that isn't whole yet."""

    def __init__(self, start: int, total: int, base: int, emit: Callable[[int, int, str, bool, bool], None]):
        self.next, self.total, self.base, self.emit = start, total, base, emit
        self.levels: list[tuple[int, list[str]]] = []

    def count(self, level: int) -> int:
        """Nodes of the whole group at a level."""
        return -(-self.total // self.base**level)

    def push(self, leaf: str) -> None:
        self._push(0, self.next, leaf)
        self.next += 1

    def _push(self, level: int, at: int, node: str) -> None:
        if level == len(self.levels):
            self.levels.append((at, []))
        first, pending = self.levels[level]
        if not pending:
            first = at
            self.levels[level] = (at, pending)
        pending.append(node)
        if at % self.base == self.base - 1 and self.count(level) > 1:
            self._carry(level, first, pending)

    def _carry(self, level: int, first: int, pending: list[str]) -> None:
        """A run has come to its end: it is a node if it began here too, else its nodes are an edge."""
        self.levels[level] = (0, [])
        if first % self.base:
            for i, node in enumerate(pending):
                self.emit(level, first + i, node, True, False)
        else:
            node = digest(pending)
            self.emit(level + 1, first // self.base, node, False, False)
            self._push(level + 1, first // self.base, node)

    def close(self) -> None:
        """No leaf of the group follows in this partition."""
        ends = self.next == self.total
        level = 0
        while level < len(self.levels):
            first, pending = self.levels[level]
            if pending and self.count(level) == 1:
                self.emit(level, 0, pending[0], False, True)
            elif pending and ends:
                self._carry(level, first, pending)
            else:
                for i, node in enumerate(pending):
                    self.emit(level, first + i, node, True, False)
            level += 1


_NODES = "grp string, total long, level int, idx long, hash string, edge boolean, root boolean"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_NODE_SCHEMA = pa.schema([("grp", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string()), ("edge", pa.bool_()), ("root", pa.bool_())])


def _ranges(base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """grp, kind, start, total, leaf in order: a group's leaves follow the row (kind 0) that says where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        peaks, name = None, None

        def emit(level, at, node, edge, root):
            out.append((name, peaks.total, level, at, node, edge, root))

        for grp, kind, start, total, leaf in _rows(batches):
            if kind == 0:
                if peaks:
                    peaks.close()
                peaks, name = Peaks(start, total, base, emit), grp
            else:
                peaks.push(leaf)
            if len(out) >= 10_000:
                yield _batch(out, _NODE_SCHEMA)
                out.clear()
        if peaks:
            peaks.close()
        yield _batch(out, _NODE_SCHEMA)

    return run


class Manifest(NamedTuple):
    """Tables of a mountain range: `leaves` (at, grp, leaf and what was carried along, in order of at), `spans` (grp, part, at, start, stop, total: a group's leaves in a
    partition), `ranges` (nodes that partitions made, their edges), `merged` (grp, total, level, run, kids, hash: runs across partitions)."""

    leaves: DataFrame
    spans: DataFrame
    ranges: DataFrame
    merged: DataFrame
    parts: int
    base: int

    def nodes(self) -> DataFrame:
        """grp, level, idx, hash of all nodes; level 0 holds those leaves alone that are roots."""
        made = self.ranges.where("not edge").select("grp", "level", "idx", "hash")
        return made.unionByName(self.merged.select("grp", (F.col("level") + 1).alias("level"), F.col("run").alias("idx"), "hash")).distinct()

    def roots(self) -> DataFrame:
        """grp, total, hash: the root of each group, which is the leaf itself if it is alone."""
        above = _power(self.base, "level + 1")
        return self.ranges.where("root").select("grp", "total", "hash").unionByName(self.merged.where(F.col("total") <= above).select("grp", "total", "hash"))

    def discard(self) -> None:
        for t in (self.leaves, self.spans, self.ranges, self.merged):
            discard(t)


def _power(base: int, level: str) -> Column:
    return F.expr(f"cast(power({base}, {level}) as decimal(38,0))")


def build(leaves: DataFrame, order: list[str], base: int = BASE, part_rows: int = PART_ROWS) -> Manifest:
    """The manifest of leaves (grp, leaf, further columns), in each group in the order of the given columns, then of the leaf, nulls first; grp and leaf must not be null.

    Rows that agree in all of these may come in any order: their leaves are the same. An empty table has no groups.
    """
    spark = leaves.sparkSession
    given = materialize(leaves.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-given.count() // part_rows), 1)
    by = ["grp", *order, "leaf", "tie"]
    placed = given.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    stored = materialize(placed.drop("tie"), "merkle-order").withColumn("part", F.shiftright("at", 33))
    discard(given)
    here = stored.groupBy("grp", "part").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = here.withColumn("stop", F.sum("n").over(before)).withColumn("total", F.sum("n").over(Window.partitionBy("grp")))
    spans = materialize(spans.select("grp", "part", "at", (F.col("stop") - F.col("n")).alias("start"), "stop", "total"), "merkle-spans")

    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("long")
    marks = spans.select("part", "at", "grp", F.lit(0).alias("kind"), "start", "total", none.alias("leaf"))
    rows = stored.select("part", "at", "grp", F.lit(1).alias("kind"), nothing.alias("start"), nothing.alias("total"), "leaf").unionByName(marks)
    rows = rows.repartitionByRange(parts, "part").sortWithinPartitions("at", "kind").select("grp", "kind", "start", "total", "leaf")
    ranges = materialize(rows.mapInArrow(_ranges(base), _NODES), "merkle-ranges")

    most = spans.agg(F.max("total")).first()[0] or 0
    levels, carried, level = [], None, 0
    while base**level < most:
        pending = ranges.where(F.col("edge") & (F.col("level") == level)).select("grp", "total", "idx", "hash")
        if carried is not None:
            pending = pending.unionByName(carried.where(F.col("total") > _power(base, str(level))).select("grp", "total", F.col("run").alias("idx"), "hash"))
        runs = pending.groupBy("grp", "total", F.expr(f"idx div {base}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("kids"))
        kids = F.transform("kids", lambda k: k["hash"])
        runs = runs.select("grp", "total", F.lit(level).alias("level"), "run", kids.alias("kids"), F.sha2(F.array_join(kids, ""), 256).alias("hash"))
        carried = materialize(runs, "merkle-merged")
        levels.append(carried)
        level += 1
    merged = spark.createDataFrame([], "grp string, total long, level int, run long, kids array<string>, hash string")
    for t in levels:
        merged = merged.unionByName(t)
    return Manifest(stored, spans, ranges, merged, parts, base)


def _siblings(kids: list[str], i: int) -> tuple[str, str]:
    return "".join(kids[:i]), "".join(kids[i + 1 :])


class Span:
    """A group's leaves in one partition with all that their proofs need: runs over the partition's edges, and the way from the group's root up."""

    def __init__(self, grp: str, start: int, total: int, above: list[tuple[str, str]], base: int):
        self.grp, self.start, self.total, self.above, self.base = grp, start, total, above, base
        self.given: dict[tuple[int, int], list[str]] = {}
        self.leaves: list[tuple] = []

    def fold(self, node: str, level: int, at: int) -> str:
        """The hash at the top, from a node and its siblings all the way up."""
        for left, right in self.way(level, at):
            node = hashlib.sha256(f"{left}{node}{right}".encode()).hexdigest()
        return node

    def way(self, level: int, at: int) -> list[tuple[str, str]]:
        """(left, right) siblings from a node up, the groups' tree included; remembered for levels above the leaves."""
        if level == self.height:
            return self.above
        if level and (found := self.ways.get((level, at))):
            return found
        kids = self.runs[level][at // self.base]
        out = [_siblings(kids, at % self.base), *self.way(level + 1, at // self.base)]
        if level:
            self.ways[level, at] = out
        return out

    def grow(self) -> None:
        """The runs that hold this span's leaves and their ancestors, level by level."""
        base, start, stop = self.base, self.start, self.start + len(self.leaves)
        nodes = {start + i: row[0] for i, row in enumerate(self.leaves)}
        self.runs: list[dict[int, list[str]]] = []
        self.ways: dict[tuple[int, int], list[tuple[str, str]]] = {}
        n = self.total
        while n > 1:
            level, start, stop = len(self.runs), start // base, (stop - 1) // base + 1
            runs = {r: self.given.get((level, r)) or [nodes[i] for i in range(r * base, min((r + 1) * base, n))] for r in range(start, stop)}
            nodes = {r: digest(kids) for r, kids in runs.items()}
            self.runs.append(runs)
            n = -(-n // base)
        self.height = len(self.runs)
        self.root = nodes[0] if self.runs else self.leaves[0][0]


def _spans(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[Span]:
    span = None
    for grp, kind, start, total, lefts, rights, level, run, kids, leaf, other, key in _rows(batches):
        if kind == 0:
            if span:
                span.grow()
                yield span
            span = Span(grp, start, total, list(zip(lefts, rights, strict=True)), base)
        elif kind == 1:
            span.given[level, run] = kids
        else:
            span.leaves.append((leaf, other, key))
    if span:
        span.grow()
        yield span


_WAYS = "grp string, lefts array<string>, rights array<string>, root string"
_WAY_SCHEMA = pa.schema([("grp", pa.string()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())), ("root", pa.string())])
_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOF_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def _emit(spans: Iterator[Span], schema: pa.Schema, rows: Callable[[Span], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for span in spans:
        for row in rows(span):
            out.append(row)
            if len(out) >= 5_000:
                yield _batch(out, schema)
                out.clear()
    yield _batch(out, schema)


def _ways(base: int):
    def rows(span: Span) -> Iterator[tuple]:
        for i, (leaf, _, key) in enumerate(span.leaves):
            way = span.way(0, span.start + i)
            yield key, [a for a, _ in way], [b for _, b in way], span.fold(leaf, 0, span.start + i)

    return lambda batches: _emit(_spans(batches, base), _WAY_SCHEMA, rows)


def _proofs(base: int):
    def rows(span: Span) -> Iterator[tuple]:
        root = span.root
        for left, right in span.above:
            root = hashlib.sha256(f"{left}{root}{right}".encode()).hexdigest()
        tail: dict[int, bytes] = {}
        folds: dict[str, str] = {}
        for i, (leaf, other, key) in enumerate(span.leaves):
            at = span.start + i
            run = at // base
            if run not in tail:  # the leaves of a run share what is above it
                upper = span.way(1, run) if span.height else span.above
                tail, folds = {run: "".join(a + b for a, b in upper).encode()}, {}
            node = other or leaf
            if span.height:
                left, right = _siblings(span.runs[0][run], at % base)
                proof = hashlib.sha256(f"{left}{right}".encode() + tail[run]).hexdigest()
                node = hashlib.sha256(f"{left}{node}{right}".encode()).hexdigest()
            else:
                proof = hashlib.sha256(tail[run]).hexdigest()
            if node not in folds:
                folds[node] = span.fold(node, min(1, span.height), run if span.height else 0)
            yield key, leaf, span.root, root, proof, folds[node], folds[node] == root

    return lambda batches: _emit(_spans(batches, base), _PROOF_SCHEMA, rows)


def _with_ways(m: Manifest, above: DataFrame | None, key: str, other: str | None) -> DataFrame:
    """A partition's rows in order: of each span its place and the way above its group (kind 0), the merged runs that it touches (1), its leaves (2)."""
    names = ("grp", "kind", "start", "total", "lefts", "rights", "level", "run", "kids", "leaf", "other", "key")
    types = ("string", "int", "long", "long", "array<string>", "array<string>", "int", "long", "array<string>", "string", "string", dict(m.leaves.dtypes)[key])

    def row(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("part", "at", *(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in zip(names, types, strict=True)))

    c = F.col
    spans = m.spans.withColumn("lefts", F.array().cast("array<string>")).withColumn("rights", F.col("lefts")) if above is None else m.spans.join(above.select("grp", "lefts", "rights"), "grp")
    most = m.spans.agg(F.max("total")).first()[0] or 0
    levels = next(i for i in range(65) if m.base**i >= most)
    touched = m.spans.select("grp", "part", "at", "start", "stop", F.explode(F.array(*map(F.lit, range(levels))).cast("array<int>")).alias("level"))
    width = _power(m.base, "level + 1")
    touched = touched.select("grp", "part", "at", "level", F.explode(F.array_distinct(F.array(F.floor(c("start") / width).cast("long"), F.floor((c("stop") - 1) / width).cast("long")))).alias("run"))
    runs = touched.join(m.merged.select("grp", "level", "run", "kids"), ["grp", "level", "run"])
    rows = row(spans, grp=c("grp"), kind=F.lit(0), start=c("start"), total=c("total"), lefts=c("lefts"), rights=c("rights"))
    rows = rows.unionByName(row(runs, kind=F.lit(1), level=c("level"), run=c("run"), kids=c("kids")))
    rows = rows.unionByName(row(m.leaves, kind=F.lit(2), leaf=c("leaf"), other=c(other) if other else F.lit(None), key=c(key)))
    return rows.repartitionByRange(m.parts, "part").sortWithinPartitions("at", "kind").select(*names)


def ways(m: Manifest, key: str) -> DataFrame:
    """grp (the key's values), lefts, rights, root: of every leaf its siblings to the left and right, level by level, and the root that it folds to."""
    return _with_ways(m, None, key, None).mapInArrow(_ways(m.base), _WAYS)


def proofs(m: Manifest, above: DataFrame, key: str, other: str) -> DataFrame:
    """doc_id (the key), leaf, subroot, root, proof_sha256, folded_root (from `other` where it isn't null) and verified of every leaf, through its group's root and the way above that."""
    return _with_ways(m, above, key, other).mapInArrow(_proofs(m.base), _PROOFS)


def document_manifest(docs: DataFrame, part_rows: int = PART_ROWS) -> tuple[Manifest, Manifest]:
    """Manifests of the documents by source, and of the sources' roots (sources in UTF-8 byte order, null first).

    Null columns hash as `-`, so that they differ from empty ones; a null doc_id comes first; rows of one doc_id go by their leaf; repeated rows are leaves each;
    other columns are ignored; an empty table has no nodes. `other` is the leaf of a row that was tampered with: where 5 divides crc32 of doc_id, the text in lower case.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    low = F.translate("text", _UPPER, _LOWER)
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("grp"), "doc_id", row_hash(*map(F.col, fields), F.col("text")).alias("leaf"),
        F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, row_hash(*map(F.col, fields), low)).alias("other"),
    )
    groups = build(leaves, ["doc_id"], part_rows=part_rows)
    top = build(groups.roots().select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("hash").alias("leaf")), ["name"], part_rows=part_rows)
    return groups, top


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, top = document_manifest(table(spark, sf_dir, "documents"))
    return proofs(groups, materialize(ways(top, "name"), "merkle-ways"), "doc_id", "other")


_SQL_LEAF = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({t}) || ':' || {t} END" for c, t in [("doc_id", "CAST(doc_id AS VARCHAR)"), ("source", "source"), ("lang", "lang"), ("n_chars", "CAST(n_chars AS VARCHAR)"), ("text", "{text}")])
_SQL_CRC = (
    "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: "
    "list_reduce(list_prepend(xor(c, b), [0,0,0,0,0,0,0,0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"
)

#: Trees by recursion over levels: all nodes, then the way of each leaf through its source's root.
OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS total FROM (
    SELECT doc_id, source, sha256({_SQL_LEAF.format(text="text")}) AS leaf,
      CASE WHEN xor({_SQL_CRC}, 4294967295) % 5 = 0 THEN sha256({_SQL_LEAF.format(text=f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS other FROM documents)),
nodes AS (
  SELECT source, 0 AS level, idx, total AS n, leaf AS hash FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 16, CAST(ceil(n / 16.0) AS BIGINT), sha256(string_agg(hash, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY source, level, idx // 16, n),
subroots AS (SELECT source, hash AS leaf, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS total FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, idx, total AS n, leaf AS hash FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, CAST(ceil(n / 16.0) AS BIGINT), sha256(string_agg(hash, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 16, n),
runs AS (SELECT source, level, idx // 16 AS run, list(hash ORDER BY idx) AS kids FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, idx // 16 AS run, list(hash ORDER BY idx) AS kids FROM tops WHERE n > 1 GROUP BY ALL),
way AS (
  SELECT l.doc_id, l.source, l.leaf, l.idx AS row_no, 0 AS level, l.idx, l.total AS n, '' AS siblings, coalesce(other, leaf) AS folded FROM leaves l
  UNION ALL
  SELECT w.doc_id, w.source, w.leaf, w.row_no, w.level + 1, w.idx // 16, CAST(ceil(w.n / 16.0) AS BIGINT),
    siblings || array_to_string(kids[1:(w.idx % 16)], '') || array_to_string(kids[(w.idx % 16) + 2:], ''),
    sha256(array_to_string(kids[1:(w.idx % 16)], '') || folded || array_to_string(kids[(w.idx % 16) + 2:], ''))
  FROM way w JOIN runs r ON r.source IS NOT DISTINCT FROM w.source AND r.level = w.level AND r.run = w.idx // 16 WHERE w.n > 1),
top_way AS (
  SELECT w.doc_id, w.source, w.leaf, w.row_no, s.leaf AS subroot, 0 AS level, s.idx, s.total AS n, siblings, folded FROM way w JOIN subroots s ON s.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.source, w.leaf, w.row_no, w.subroot, w.level + 1, w.idx // 16, CAST(ceil(w.n / 16.0) AS BIGINT),
    siblings || array_to_string(kids[1:(w.idx % 16)], '') || array_to_string(kids[(w.idx % 16) + 2:], ''),
    sha256(array_to_string(kids[1:(w.idx % 16)], '') || folded || array_to_string(kids[(w.idx % 16) + 2:], ''))
  FROM top_way w JOIN top_runs r ON r.level = w.level AND r.run = w.idx // 16 WHERE w.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM top_way w, (SELECT hash AS root FROM tops WHERE n = 1) WHERE w.n = 1
"""
