"""Benchmark decontamination by template canonicalisation: numbers, names and units become typed placeholders. Verbatim copies match by their own words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, sliced, table

#: Tokens in a window; the fewest template tokens of an item that can match re-parameterised; covered tokens that make a leak of any item, and the share of its windows that does for a short one.
WINDOW, SHORTEST, COVERED, SHARE = 8, 5, 13, 0.8
#: Diagonals of the narrower bands in which the parts of an edited copy count together; the wider ones follow the item's length.
NEAR = 16
#: Bytes of texts that are read at a time.
READ = 200_000
#: Bits of the filter of benchmark windows: a table of 2**26 / 64 numbers at most, whatever the benchmark's size.
FILTER_BITS = 26

_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?:;\n%$€£°]|[-+*/=<>^×÷−]+")
_END = frozenset(".!?:;\n")
UNITS = frozenset(
    "% $ € £ ° mm cm m km inch inches foot feet mile miles mg g kg gram grams ton tons ml l litre litres liter liters gallon gallons s sec second"
    " seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros pound pounds"
    " degree degrees watt watts volt volts hz khz mhz ghz kb mb gb tb".split()
)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    " thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
_LITERAL, _NUMBER, _NAME, _STOP, _UNIT, _SIGN = range(6)
_SIGNS = frozenset("-+*/=<>^×÷−")
_PLACEHOLDER = mix(np.arange(1, 7, dtype=np.uint64))
#: Odd factors of the tokens of a window: its hash is the scrambled sum of their products.
_FACTORS = mix(np.arange(11, 11 + WINDOW, dtype=np.uint64)) | np.uint64(1)


class _Tokens(dict):
    """token -> a hash of it in lower case, the lowest three bits telling what it may be."""

    def __missing__(self, t: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        low = t.lower()
        if t in _END:
            kind = _STOP
        elif t[0] in _SIGNS:
            kind = _SIGN
        elif t[0].isdecimal() or low in NUMBER_WORDS:
            kind = _NUMBER
        elif low in UNITS:
            kind = _UNIT
        else:
            kind = _NAME if t[0].isupper() and t[1:].islower() else _LITERAL
        self[t] = h = xxhash.xxh64_intdigest(low) & ~7 | kind
        return h


_tokens = _Tokens()


def template(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Template of a text: a hash and a kind for each template token, the first word that it stands for (and one bound more), and all words.

    A number, a unit right after a number and a run of names (capitalised words that don't begin a sentence) each become one placeholder.
    """
    return _read(_TOKEN.findall(text))[:4]


def _read(found: list[str]) -> tuple:
    """The template, and a hash for each word or sign (run of operators) as it is, and for each word: these don't depend on what stands around a word. Last what each token found may be."""
    code = np.fromiter(map(_tokens.__getitem__, found), np.uint64, len(found))
    raw = kind = (code & np.uint64(7)).astype(np.int8)
    own = mix(code[kind != _STOP] | np.uint64(7))
    plain = own
    if (kind == _SIGN).any():
        plain = own[kind[kind != _STOP] != _SIGN]
        at = np.flatnonzero(kind != _SIGN)
        code, kind, found = code[at], kind[at], [found[i] for i in at.tolist()]
    word = np.flatnonzero(kind != _STOP)
    opens = np.r_[True, kind[:-1] == _STOP] if len(kind) else np.zeros(0, bool)
    code, kind, opens = code[word], kind[word], opens[word]
    before = np.r_[np.int8(_LITERAL), kind[:-1]] if len(kind) else kind
    kind = np.where((kind == _NAME) & opens | (kind == _UNIT) & ((before != _NUMBER) | opens), _LITERAL, kind)
    more = np.r_[False, (kind[1:] == _NAME) & (kind[:-1] == _NAME)] if len(kind) else np.zeros(0, bool)
    first = np.flatnonzero(~more)
    kind = kind[first]
    code = np.where(kind == _LITERAL, plain[first], _PLACEHOLDER[kind])
    return code, kind, np.r_[first, len(word)], [found[i] for i in word.tolist()], own, plain, raw


def _sums(code: np.ndarray, size: int) -> np.ndarray:
    return mix(np.correlate(code, _FACTORS[:size], "valid"))


def windows(code: np.ndarray, kind: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first tokens of the windows of `size` template tokens of which at least half are words."""
    n = len(code) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words = np.r_[0, np.cumsum(kind == _LITERAL)]
    at = np.flatnonzero(2 * (words[size:] - words[:-size]) >= size)
    return _sums(code, size)[at], at


def opened(code: np.ndarray, kind: np.ndarray, bound: np.ndarray, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that begin with the first word of a run of names, read as a word as it would be at the beginning of a sentence: hashes,
    the run's template token, and whether more names of it follow (they are the window's second token)."""
    n = len(code)
    i = np.flatnonzero(kind == _NAME)
    run = (bound[i + 1] - bound[i] > 1).astype(np.int64)
    fits = i + size - run <= n
    i, run = i[fits], run[fits]
    if not len(i):
        return np.empty(0, np.uint64), i, run.astype(bool)
    rest = code[(i - run)[:, None] + np.arange(1, size)]
    h = mix(own[bound[i]] * _FACTORS[0] + (rest * _FACTORS[1:size]).sum(1, dtype=np.uint64))
    words = np.r_[0, np.cumsum(kind == _LITERAL)]
    ok = 2 * (1 + words[i + size - run] - words[i]) >= size
    return h[ok], i[ok], run[ok].astype(bool)


def verbatim(own: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` words or signs."""
    return _sums(own, size) if len(own) >= size else np.empty(0, np.uint64)


def slots(kind: np.ndarray, bound: np.ndarray, words: list[str], at: int, size: int) -> list[str]:
    """What the placeholders of a window stand for."""
    return [" ".join(words[bound[i] : bound[i + 1]]).lower() for i in range(at, at + size) if kind[i] != _LITERAL]


#: size is negative in windows of words as they are; at counts words there, and template tokens elsewhere.
_ROWS = "id long, hash long, at int, size int, total int, slots array<string>"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    ids, h, at, size, total, own = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(h, pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(total, pa.int32()), pa.array(own, pa.list_(pa.string()))],
        ["id", "hash", "at", "size", "total", "slots"],
    )


def _item_windows(batches):
    for batch in batches:
        rows = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            code, kind, bound, words, own, _, _ = _read(_TOKEN.findall(t))
            size = min(WINDOW, len(own))
            if size:
                h = verbatim(own, size)
                rows += [(i, int(x), a, -size, len(h), []) for a, x in enumerate(h.view(np.int64))]
            size = min(WINDOW, len(code))
            if size < SHORTEST:
                continue
            h, at = windows(code, kind, size)
            rows += [(i, int(x), int(a), size, len(h), slots(kind, bound, words, a, size)) for x, a in zip(h.view(np.int64), at, strict=True)]
        if rows:
            yield _emit(rows)


def leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id"
) -> DataFrame:
    """doc_id, item_id, windows, item_windows, covered, share, reparameterised: documents that hold (part of) a benchmark item, one row a pair.

    Windows of templates are joined by hash; a document's window matches too if its first word reads as a name only because no sentence begins there.
    Matches count along one diagonal (same distance of places in document and item) and together with those of near diagonals, so that words put
    in or left out don't part a copy. Slots must be consistent among them: each value of the item's numbers, names and units has one value in the document, and
    no two names share one; windows with a slot that isn't are left out unless they are verbatim. A pair is a leak if its windows cover COVERED template tokens, or the share SHARE of the item's windows. reparameterised: some slot's value differs.

    The document side drops windows that a filter of all benchmark windows lacks: the filter has a bounded size and only saves rows; the join decides.
    Windows of words as they are (numbers, names, units and runs of operators too, in lower case) are joined in the same way and judged alone, so a verbatim
    copy is found whatever it consists of, and an item of under WINDOW words by all of them in a row. Only re-parameterised matching asks for
    windows with half their tokens literal and items of SHORTEST template tokens. windows, item_windows and covered are those of the kind that matched best.
    Items without a word or operator match nothing; null or empty texts have no windows. Documents with a null id are judged each by itself and
    returned with that null id; items with a null id are left out. Repeated rows count once;
    extra columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    known = items.mapInArrow(_item_windows, _ROWS).distinct().cache()
    spot = F.pmod("hash", F.lit(1 << FILTER_BITS))
    bits = known.select(F.shiftright(spot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(hash, {1 << FILTER_BITS}) & 63 as int))").alias("one"))
    words = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    got = bits.groupBy("word").agg(F.expr("bit_or(one)").alias("bits")).toArrow()  # at most 2**20 rows
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # of -WINDOW to WINDOW
    shared = spark.sparkContext.broadcast(words)

    def hits(batches):
        filled = shared.value

        def known_windows(h: np.ndarray) -> np.ndarray:
            s = h & np.uint64((1 << FILTER_BITS) - 1)
            return np.flatnonzero(filled[s >> np.uint64(6)] >> (s & np.uint64(63)) & np.uint64(1))

        # Texts are read many at a time, a stop between them: a sentence opens with each, so no run of names crosses. Windows that cross are left out.
        for batch in sliced(batches, 1, READ):
            ids, rows = batch.column(0).to_numpy(), []
            found, ends = [], []
            for t in batch.column(1).to_pylist():
                found += _TOKEN.findall(t)
                found.append("\n")
                ends.append(len(found))
            code, kind, bound, words, own, plain, raw = _read(found)
            last = np.array(ends) - 1
            word_ends = np.cumsum((raw != _STOP) & (raw != _SIGN))[last]  # words, and words or signs, up to each text's end
            own_ends = np.cumsum(raw != _STOP)[last]

            def text_of(place: np.ndarray, upto: np.ndarray) -> np.ndarray:
                return np.searchsorted(upto, place, "right")

            for size in sizes:
                if size < 0:
                    h = verbatim(own, -size)
                    ok = known_windows(h)
                    doc = text_of(ok, own_ends)
                    ok, doc = (x[doc == text_of(ok - size - 1, own_ends)] for x in (ok, doc))
                    if size > -WINDOW:  # the whole of an item: one place is enough
                        once = np.unique(np.stack([doc.astype(np.uint64), h[ok]]), axis=1, return_index=True)[1]
                        ok, doc = ok[once], doc[once]
                    rows += [(int(ids[d]), int(h[i].view(np.int64)), int(i - (own_ends[d - 1] if d else 0)), size, 0, []) for i, d in zip(ok.tolist(), doc.tolist(), strict=True)]
                    continue
                h, at = windows(code, kind, size)
                ok = known_windows(h)
                at, h = at[ok], h[ok]
                first = np.searchsorted(bound, np.r_[0, word_ends[:-1]])  # each text's first template token
                doc = text_of(bound[at], word_ends)
                same = np.flatnonzero(doc == text_of(bound[at + size] - 1, word_ends))
                rows += [(int(ids[doc[i]]), int(h[i].view(np.int64)), int(at[i] - first[doc[i]]), size, 0, slots(kind, bound, words, at[i], size)) for i in same.tolist()]
                h, at, run = opened(code, kind, bound, plain, size)
                ok = known_windows(h)
                doc = text_of(bound[at], word_ends)
                for i in ok.tolist():
                    a, more, d = int(at[i]), int(run[i]), int(doc[i])
                    if bound[a + size - more] <= word_ends[d]:
                        rest = [" ".join(words[bound[a] + 1 : bound[a + 1]]).lower()] if more else []
                        rows.append((int(ids[d]), int(h[i].view(np.int64)), int(a - more - first[d]), size, 0, rest + slots(kind, bound, words, a + 1, size - 1 - more)))
            for i in range(0, len(rows), 20_000):
                yield _emit(rows[i : i + 20_000])

    d = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null")
    named = d.where("id is not null").mapInArrow(hits, _ROWS).withColumn("nameless", F.lit(False))
    # A document without an id goes by its text's hash.
    nameless = d.where("id is null").select(F.xxhash64("text").alias("id"), "text").mapInArrow(hits, _ROWS).withColumn("nameless", F.lit(True))
    seen = named.unionByName(nameless).select(F.struct("nameless", F.col("id").alias("id")).alias("doc"), "hash", "size", F.col("at").alias("d_at"), F.col("slots").alias("d_slots"))
    both = seen.join(known.select(F.col("id").alias("item_id"), "hash", "size", "at", "total", "slots"), ["hash", "size"])
    both = both.where(F.size("slots") == F.size("d_slots"))
    # Each match counts on its own diagonal and among its neighbours: bands of two widths, each at two offsets, so that close diagonals share one.
    diagonal = F.col("d_at") - F.col("at")
    wide = F.greatest(2 * (F.col("total") + F.abs("size")), F.lit(NEAR))
    bands = [(0, diagonal)] + [
        (i, F.floor((diagonal + shift) / width).cast("int"))
        for i, (width, shift) in enumerate(((F.lit(NEAR), F.lit(0)), (F.lit(NEAR), F.lit(NEAR // 2)), (wide, F.lit(0)), (wide, wide / 2)), 1)
    ]
    each = both.withColumn("band", F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), x.alias("at")) for i, x in bands))))
    pair = F.arrays_zip(F.col("slots").alias("b"), F.col("d_slots").alias("d"))
    by = each.groupBy("doc", "item_id", "size", "total", "band").agg(F.collect_set(F.struct("at", pair.alias("pairs"))).alias("hits"))
    # A value of the item with several values in the document, or a name that stands for several of the item's names, takes its windows out; what is verbatim stays.
    by = by.withColumn("pairs", F.array_distinct(F.flatten("hits.pairs")))
    # 'if bob' and 'bob' are one value: a run of names may begin with a word that opens a sentence.
    def differ(p, q):
        return (p != q) & ~p.endswith(F.concat(F.lit(" "), q)) & ~q.endswith(F.concat(F.lit(" "), p))

    def clashes(p, q):
        names = ~p["d"].rlike(r"^\d") & ~p["b"].rlike(r"^\d") & ~q["b"].rlike(r"^\d")
        return (p["b"] == q["b"]) & differ(p["d"], q["d"]) | (p["d"] == q["d"]) & differ(p["b"], q["b"]) & names

    clash = F.filter("pairs", lambda p: F.exists("pairs", lambda q: clashes(p, q)))
    by = by.withColumn("clash", clash)
    fits = F.filter("hits", lambda x: ~F.exists(x["pairs"], lambda p: p["b"] != p["d"]) | ~F.arrays_overlap(x["pairs"], F.col("clash")))
    by = by.withColumn("hits", fits).withColumn("ats", F.sort_array(F.array_distinct("hits.at")))
    n = F.size("ats")
    # Tokens under the windows: each window adds what lies past the one before it.
    covered = F.aggregate(
        "ats",
        F.struct(F.lit(0).alias("c"), F.lit(-1_000_000).alias("last")),
        lambda a, x: F.struct((a["c"] + F.least(F.abs("size"), x - a["last"])).alias("c"), x.alias("last")),
        lambda a: a["c"],
    )
    fit = by.select(
        "doc", "item_id", n.alias("windows"), F.col("total").alias("item_windows"), covered.alias("covered"), (n / F.col("total")).alias("share"),
        F.exists(F.flatten("hits.pairs"), lambda p: p["b"] != p["d"]).alias("reparameterised"),
    ).where((F.col("covered") >= COVERED) | (F.col("share") >= SHARE))
    best = F.struct("windows", "covered", "item_windows", "share", (~F.col("reparameterised")).alias("same"))
    out = fit.groupBy("doc", "item_id").agg(F.max(best).alias("m"))
    return out.select(
        F.when(~F.col("doc.nameless"), F.col("doc.id")).alias("doc_id"), "item_id", "m.windows", "m.item_windows", "m.covered", "m.share", (~F.col("m.same")).alias("reparameterised")
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
