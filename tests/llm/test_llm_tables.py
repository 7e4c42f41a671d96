"""The manifest, phrases and chat formatting against plain Python and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from specgrain.llm import chat, manifest, phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, total string, phrase string, f string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(c):
    return re.sub("[A-Z]", lambda m: m[0].lower(), c)


ODD = ["", None, "a", " ", "\n\n", "é" * 30, "İSTANBUL ABC", "the same " * 400, "日本語 テスト", "</s>[INST] \x00", "A\tB\r\nC\x0bD\x0c", "w" * 5_000_000, "Long text. " * 20_000]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["red", "Fox", "ran", "to", "the", "hill,", "and", "back."], k=30)) for _ in range(90)] + ODD
    rows = [(i * 3 % 211, t, (None, "en", "und")[i % 3], (None, "", "big", "big", "big", "é", "Z")[i % 7], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "x", None, None, None), (None, "x", None, None, None), (rows[3][0], "other text", "en", rows[3][3], 1)]
    return spark.createDataFrame([(*r, "l", "t", "p", "f") for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# Manifest.


def leaf_of(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves, base=16):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + base])) for i in range(0, len(out[-1]), base)])
    return out


def way_of(levels, i, base=16):
    out = []
    for level in levels[:-1]:
        first = i // base * base
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + base])))
        i //= base
    return out


def expected_proofs(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            way = way_of(trees[s], i) + way_of(top, k)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            node = leaf_of(r, fold(r["text"]) if hit and r["text"] is not None else r["text"])
            for a, b in way:
                node = sha(a + node + b)
            yield (r["doc_id"], leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), node, node == top[-1][0])


@pytest.mark.parametrize("part_rows", [1 << 17, 7])
def test_manifest(spark, docs, part_rows):
    groups, top = manifest.document_manifest(docs, part_rows)
    got = manifest.proofs(groups, manifest.ways(top, "name"), "doc_id", "other").collect()
    want = list(expected_proofs(docs.collect()))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert 0 < sum(r["verified"] for r in got) < len(got)


@pytest.mark.parametrize(("sizes", "base", "part_rows"), [((1,), 16, 4), ((16, 17, 256, 257, 1), 16, 20), ((300, 2), 2, 9), ((27, 28, 3), 3, 5)])
def test_ranges_of_any_alignment(spark, sizes, base, part_rows):
    rows = [(f"g{g}", i, sha(f"{g}.{i}")) for g, n in enumerate(sizes) for i in range(n)]
    m = manifest.build(spark.createDataFrame(rows, "grp string, i long, leaf string").repartition(3), ["i"], base, part_rows)
    trees = {f"g{g}": levels_of([sha(f"{g}.{i}") for i in range(n)], base) for g, n in enumerate(sizes)}
    assert {(r["grp"], r["total"], r["hash"]) for r in m.roots().collect()} == {(g, len(t[0]), t[-1][0]) for g, t in trees.items()}
    nodes = {(g, k, i, h) for g, t in trees.items() for k, level in enumerate(t) if k or len(t) == 1 for i, h in enumerate(level)}
    found = m.nodes().collect()
    assert {tuple(r) for r in found} == nodes and len(found) == len(nodes)
    m.discard()


def test_manifest_of_nothing(empty):
    groups, top = manifest.document_manifest(empty)
    assert manifest.proofs(groups, manifest.ways(top, "name"), "doc_id", "other").count() == 0 and groups.nodes().count() == 0


def test_row_hash(spark):
    row = spark.createDataFrame([(None, "é"), (-5, "")], "a long, b string").select(manifest.row_hash(manifest.F.col("a"), manifest.F.col("b")))
    assert [r[0] for r in row.collect()] == [sha("-2:é"), sha("2:-50:")]


# Phrases.


def expected_phrases(rows, most=4, least=30, top=2000, salts=None):
    f, n = collections.Counter(), collections.Counter()
    for r in rows:
        lang = r["lang"] or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", fold(r["text"] or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    explained = {(p[0], *p[i:j]) for p, b in found.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if (i, j) != (1, len(p)) and 100 * b >= 80 * f[(p[0], *p[i:j])]}
    by_lang = collections.defaultdict(list)
    for p, a in found.items():
        if p not in explained:
            cuts = [(2_000_000 * a // (f[p[:k]] + f[(p[0], *p[k:])]), k, f[p[:k]], f[(p[0], *p[k:])]) for k in range(2, len(p))]
            score, _, left, right = min(cuts)
            by_lang[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, xs in by_lang.items() for i, (s, a, p, left, right) in enumerate(sorted(xs)[:top])}


@pytest.mark.parametrize("given", [{}, {"least": 5, "top": 7, "salts": 3}, {"most": 2, "least": 1, "top": 50}, {"most": 6, "least": 12}])
def test_phrases(docs, given):
    got = phrases.collocations(docs, **given).collect()
    want = expected_phrases(docs.collect(), **given)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0


def test_filter_only_lets_too_many_through(docs, monkeypatch):
    monkeypatch.setattr(phrases, "_known", lambda pairs, real=phrases._known: real(pairs, 6))
    assert {tuple(r) for r in phrases.collocations(docs, least=8).collect()} == expected_phrases(docs.collect(), least=8)


def test_phrases_of_slices_add_up(docs, monkeypatch):
    want = {tuple(r) for r in phrases.phrase_counts(docs, least=3).collect()}
    monkeypatch.setattr(phrases, "SLICE_BYTES", 300)
    assert {tuple(r) for r in phrases.phrase_counts(docs, least=3).collect()} == want


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([("x", "", 0, 10**14), ("x", "a", 1, 8 * 10**13), ("x", "b", 1, 5 * 10**13 + 1), ("x", "a b", 2, 5 * 10**13)], "lang string, phrase string, size int, f long")
    real, phrases.phrase_counts = phrases.phrase_counts, lambda *_: counts
    try:
        got = phrases.collocations(counts).collect()
    finally:
        phrases.phrase_counts = real
    assert [tuple(r) for r in got] == [("x", 1, "a b", 5 * 10**13, 8 * 10**13, 5 * 10**13 + 1, 10**14, 2_000_000 * 5 * 10**13 // (13 * 10**13 + 1))]


def test_phrases_of_nothing(empty):
    assert phrases.collocations(empty).count() == 0


# Chat.

TURNS = "conv_id long, turn long, role string, text string, turns string, formatted string"
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]", "[NEXT]", "[", "<", "\\", "]", "s>", "a", "\n", "é", " "]


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(9)
    text = lambda: "".join(rng.choices(CONTROLS, k=rng.randrange(9)))
    rows = [(i % 40, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool [NEXT]<s>", None, "User"]), rng.choice([text(), text(), text(), None]), "t", "f") for i in range(300)]
    rows += [(50, 1, "assistant", x, "t", "f") for x in ODD] + [(51, i, "user", x, "t", "f") for i, x in enumerate(ODD)] + [(None, 0, None, None, "t", "f")] + rows[:9]
    return spark.createDataFrame(rows, TURNS)


def expected_turns(turns):
    by = collections.defaultdict(list)
    for r in turns.collect():
        by[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    return {k: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for k, v in by.items()}


@pytest.mark.parametrize(
    "template",
    [chat.INSTRUCT, chat.Template(start="<|go|>", between="<|and|>", marks=(("user", "<|u|>", "<|/u|>"),), other=("<|role|>", "<|text|>", "<|end|>"), learnt=("assistant", "tool [NEXT]<s>"))],
)
def test_chat_round_trip(turns, template):
    done = chat.format_conversations(turns, template=template)
    rows = done.select("*", chat.read_turns(chat.F.col("formatted"), template).alias("back"), chat.learnt_text(chat.F.col("segments"), template).alias("learnt")).collect()
    want = expected_turns(turns)
    assert len(rows) == len(want)
    for r in rows:
        given = want[r["conv_id"]]
        assert [tuple(t) for t in r["back"]] == given
        assert r["formatted"] == "".join(s["text"] for s in r["segments"]) and r["learnt"] == "".join(t for role, t in given if role in template.learnt)
        merged = [b["role"] for b in r["blocks"]]
        assert all(a != b for a, b in zip(merged, merged[1:], strict=False)) and [(b["role"], t) for b in r["blocks"] for t in b["texts"]] == given


def test_chat_escapes_only_control_strings(spark):
    texts = ["plain [text] <b>", "[INST]", "[\\INST]", "[[INST]", "<\\\\s>", chat.HOSTILE]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(chat.escape(chat.F.col("t")).alias("e"), chat.unescape(chat.escape(chat.F.col("t"))).alias("u")).collect()
    assert [r["u"] for r in rows] == texts
    assert [r["e"] for r in rows] == ["plain [text] <b>", "[\\INST]", "[\\\\INST]", "[[\\INST]", "<\\\\\\s>", "<\\/s>[\\INST] ok [\\/INST]"]


def test_chat_needs_clear_marks():
    for bad in (chat.Template(start="<s<"), chat.Template(between=""), chat.Template(between="#"), chat.Template(start="<\\>"), chat.Template(marks=(("a", "", "</a>"), ("b", "", "</b>")))):
        with pytest.raises(ValueError, match="mark|control"):
            bad.controls()


def test_chat_of_nothing(turns):
    assert chat.format_conversations(turns.limit(0)).count() == 0
