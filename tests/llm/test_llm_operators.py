"""The numbered operators against brute force, public libraries and odd rows."""

import collections
import gzip
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from specgrain.llm import decontamination, embedding_dups, lm_scores, near_dups, quality, sentencepieces, sharding, suffix_dedup, token_counts, warc

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=300, words=400):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary, n))


ODD = ["", None, "a", " ", "\n\n", "é" * 30, "x" * 5000, "the same " * 400, "日本語 テスト", "<|endoftext|> <s> %d \x00 end", "!!! ??? ---", "A\tB\r\nC"]


def rows_of(texts):
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(1)
    near = base.split()
    near[17] = "changed"
    texts = [base, " ".join(near), base, prose(2), prose(3, 900), prose(4, 20), *ODD, prose(2)[:900] + prose(5), prose(3, 900)]
    rows = rows_of(texts)
    rows += [rows[3], (None, prose(6), None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def text_of(r):
    return r["text"] or ""


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(0)
    good = [prose(100 + i, int(rng.integers(40, 200))) for i in range(120)]
    bad = [" ".join(w + "###" for w in prose(300 + i, int(rng.integers(40, 200))).split()) for i in range(120)]
    table = spark.createDataFrame(rows_of(good + bad), DOCS).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.quality_scores(table, labels).collect()}
    assert len(out) == 240 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [r for r in out.values() if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] < 120) for r in held]) > 0.95
    assert quality.quality_scores(docs, labels.limit(0)).where("score = 0.5").count() == docs.count()
    assert quality.quality_scores(docs, labels).count() == docs.count()
    assert quality.quality_scores(empty, labels).count() == 0


def test_statistics_depend_on_the_text_alone():
    texts = [*(t or "" for t in ODD), "#### $$", "a b", "", "x\n#"]
    whole = quality.statistics(texts)
    assert all(np.array_equal(whole[i], quality.statistics([t])[0]) for i, t in enumerate(texts))


def test_isotonic_is_the_least_squares_fit():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.5]), np.ones(6))
    assert np.allclose(y, [0, 0.5, 2.5 / 3]) and (np.diff(x) > 0).all()


def test_decontamination(spark, empty):
    item = "If Alice has 12 apples and gives 5 apples to Zed, how many apples does Alice have left over after that?"
    asked = "If Bob has 3 apples and gives 2 apples to Carol, how many apples does Bob have left over after that?"
    mixed = "If Bob has 3 apples and gives 2 apples to Bob, how many apples does Dan have left over after that?"
    table = spark.createDataFrame([(1, "Well. " + asked), (2, mixed), (3, f"see: {item} ok"), (4, prose(1)), (5, None), (None, item), (6, ""), (3, f"see: {item} ok")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "too short", "x"), (7, item, "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontamination.leaks(table, bench).collect()}
    assert got == {(1, 7, True), (3, 7, False), (None, 7, False)}
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(table, bench.limit(0)).count() == 0


def found_leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontamination.leaks(docs, bench).collect()}


def test_decontamination_finds_copies_of_any_tokens(spark):
    table = "Paris 1980 3 km 4 kg, Rome 1985 5 km 6 kg, Oslo 1990 7 km 8 kg"
    sums = "3 + 4 = 7, 12 - 5 = 7"
    four, whole = "Name the largest moon.", "Who wrote it?"
    texts = [f"so {table} and on", f"they said {sums} then", "asked to name the largest moon today " * 3, "3 4 7 12 5 7", table.replace("1985", "1986").replace("km", "g").replace("kg", "m"), "name the small moon", "x Who Wrote It y"]
    assert found_leaks(spark, texts, [table, sums, four, whole, "!!!", ""]) == {(0, 0): False, (1, 1): False, (2, 2): False, (6, 3): False}


def test_decontamination_judges_items_as_a_whole(spark):
    long = "the quick brown fox jumps over a lazy dog while seven small cats sleep under some very old wooden table".replace("seven", "many").split()
    edited = long[:10] + ["really"] + long[10:]
    shorter = long[:10] + long[11:]
    short, asked = "If Ann has 3 red apples then who eats them", "they say If Bob has 4 red apples then who eats them"
    count = "She bought 12 eggs and 5 pears at the market before she went home to cook them for 12 guests who came by"
    again = "She bought 7 eggs and 7 pears at the market before she went home to cook them for 7 guests who came by"
    clash = "She bought 7 eggs and 4 pears at the market before she went home to cook them for 9 guests who came by"
    twice = f"{short.replace('Ann', 'Eve')}. {short.replace('Ann', 'Joe')}."
    texts = [f"so {' '.join(edited)} now", f"so {' '.join(shorter)} now", asked, again, f"And: {clash}", twice, " ".join(long[:9])]
    assert found_leaks(spark, texts, [" ".join(long), short, count]) == {(0, 0): False, (1, 0): False, (2, 1): True, (3, 2): True, (4, 2): True, (5, 1): True}


def test_template_types():
    code, kind, bound, words = decontamination.template("Then Ann Lee paid 3.50 dollars. Ann left 3 km away.")
    same, _, _, _ = decontamination.template("Then Bob Roe paid 7 euros. Bob left 12 miles away.")
    assert code[:4].tolist() == same[:4].tolist() and code[-4:].tolist() == same[-4:].tolist()
    assert decontamination.slots(kind, bound, words, 0, len(code))[:3] == ["ann lee", "3.50", "dollars"]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", "<title>T &amp; U</title><p>Hi<br>you <a href='/x?a=1&amp;b=2'>go</a><script>if(a<b){}</script>"), (2, None, None), (3, "u", "<!-- open"), (3, "u", "<!-- open")], "page_id long, url string, html string")
    responses = warc.page_responses(pages)
    records = warc.derivatives(responses)
    rows = records.collect()
    assert len(rows) == 8 and {r["warc_type"] for r in rows} == {"metadata", "conversion"}
    ids = {r["record_id"] for r in responses.collect()}
    assert {r["refers_to"] for r in rows} == ids
    first = {r["warc_type"]: r for r in rows if r["target_uri"] == "http://a/é"}
    assert first["conversion"]["block"] == "Hi\nyou go" and "outlink: /x?a=1&b=2\r\n" in first["metadata"]["block"] and "title: T & U\r\n" in first["metadata"]["block"]
    assert all(r["content_length"] == len(r["block"].encode()) and r["block_digest"] == warc.digest(r["block"].encode()) for r in rows)
    warc.write_records(records, str(tmp_path / "w"))
    data = b"".join(r["warc"] for r in spark.read.parquet(str(tmp_path / "w")).collect())
    (tmp_path / "out.warc.gz").write_bytes(data)
    lines = spark.read.option("lineSep", warc._SEPARATOR.decode()).text(str(tmp_path / "out.warc.gz")).select(warc.F.col("value").cast("binary").alias("v"))
    back = list(warc.parse_records(iter(r["v"] for r in lines.collect())))
    assert sorted(b.decode() for _, b in back) == sorted(r["block"] for r in rows)
    assert {dict(h)["WARC-Record-ID"]: h for h, _ in back} == {r["record_id"]: [(x["name"], x["value"]) for x in r["headers"]] for r in rows}
    assert warc.derivatives(responses.limit(0)).count() == 0
    kept = warc.derivatives(responses.withColumn("date", warc.F.lit("d")).withColumn("block", warc.F.col("page_id")), keep=("page_id", "block", "date"))
    assert {r["source_block"] for r in kept.collect()} == {1, 2, 3} and kept.columns[:3] == ["page_id", "source_block", "source_date"]


def test_warc_keeps_bytes_headers_and_digests(spark, tmp_path):
    page = "<meta charset=x><p>café \u2013 50 €</p>"
    plain = page.replace("\u2013", "-").replace(" €", "").encode("latin-1")
    packed = gzip.compress(page.encode())
    chunks = b"".join(b"%x\r\n%b\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    inner = b"<p>one\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\ntwo</p>"
    bodies = {
        "a": (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Long: one\r\n two\r\n\r\n", plain, "café - 50"),
        "b": (b"HTTP/1.1 404 Not Found\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", chunks, "café \u2013 50 €"),
        "c": (b"HTTP/1.1 200 OK\r\n\r\n", inner, "one\nWARC/1.0\nWARC-Type: response\ntwo"),
        "d": (b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip, nonsense\r\n\r\n", b"caf\xe9 <b>", "café"),
        "e": (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=no-such\r\n\r\n", "ü".encode(), "ü"),
    }
    records = []
    for name, (head, body, _) in bodies.items():
        block = head + body
        records.append(([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{name}>"), ("WARC-Target-URI", "http://b/"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:SAID{name}"), ("WARC-Concurrent-To", "<urn:q>"), ("WARC-Concurrent-To", "<urn:r>"), ("WARC-IP-Address", "192.0.2.1"), ("WARC-Block-Digest", "sha1:B"), ("Content-Length", str(len(block)))], block))
        records.append(([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:other>"), ("Content-Length", "3")], b"GET"))
    gz = b"".join(warc.record_bytes(h, b) for h, b in records)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.warc.gz").write_bytes(gz)
    (tmp_path / "in" / "y.warc").write_bytes(gzip.decompress(gz)[:-40])  # the last record, a request, is cut
    got = warc.read_responses(spark, str(tmp_path / "in")).withColumnRenamed("record_id", "record_id").collect()
    assert sorted(r["record_id"] for r in got) == sorted([f"<urn:{n}>" for n in bodies] * 2)
    for r in got:
        head, body, _ = bodies[r["record_id"][5]]
        assert bytes(r["payload"]) == body and [x["value"] for x in r["source_headers"] if x["name"] == "WARC-Concurrent-To"] == ["<urn:q>", "<urn:r>"]
    out = warc.derivatives(warc.read_responses(spark, str(tmp_path / "in" / "x.warc.gz"))).collect()
    for r in out:
        name = r["refers_to"][5]
        headers = [(x["name"], x["value"]) for x in r["headers"]]
        assert r["source_digest"] == f"sha1:SAID{name}" and ("WARC-Refers-To-Payload-Digest", r["source_digest"]) in headers and ("WARC-IP-Address", "192.0.2.1") in headers
        assert [v for k, v in headers if k == "WARC-Concurrent-To"] == ["<urn:q>", "<urn:r>"]
        if r["warc_type"] == "conversion":
            assert r["block"] == bodies[name][2], name
        elif name == "a":
            assert "http-set-cookie: a=1\r\nhttp-set-cookie: b=2\r\nhttp-x-long: one two\r\n" in r["block"] and "source-warc-ip-address: 192.0.2.1\r\n" in r["block"]
    bare = {"record_id": None, "target_uri": None, "date": None, "status": None, "http_headers": None, "payload": b"caf\xe9", "source_headers": None}
    assert warc.derive(bare)[0]["source_digest"] == warc.digest(b"caf\xe9") and warc.derive(bare) == warc.derive(dict(bare))
    assert warc.unchunked(b"not chunked") == b"not chunked" and warc.unchunked(b"5\r\nab") == b"ab"


def test_token_counts_match_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    out = token_counts.token_counts(docs, path)
    rows, texts = out.collect(), [text_of(r) for r in docs.collect()]
    assert [r["n_tokens"] for r in rows] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [r["n_bytes"] for r in rows] == [len(t.encode()) for t in texts]
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    more = ["aaaa aaaaa aaaaaaa", "²³ Ⅷ ½ ٣ a_b __ x\x1cy", "I'll we've DON'T 'S", "　 \x85  z", "😀😀 é"]
    assert token_counts.tokenizer(path).count_texts(more) == [len(e.ids) for e in library.encode_batch(more, add_special_tokens=False)]
    assert token_counts.token_counts(empty, path).count() == 0


def test_embedding_near_duplicates(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.05, base[:5] + rng.normal(size=(5, 16)) * 0.14, base[:3]])
    rows = [(i, [float(v) for v in np.float32(e)], int(i % 2 and i < 10)) for i, e in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [1.0] * 15, 1), (904, rows[0][1], None), (905, [], 1), (906, [None] + [1.0] * 15, 1), (907, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    links = {i: set() for i, _, _ in rows}
    for i, a, p in rows:
        for j, b, q in rows:
            if i < j and p == q and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    assert sum(map(len, links.values())) > 20

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    for cell, block in ((2048, 4096), (6, 4)):
        monkeypatch.setattr(embedding_dups, "CELL", cell)
        monkeypatch.setattr(embedding_dups, "BLOCK", block)
        out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dups.embedding_near_duplicates(table).collect()}
        assert out == {i: (len(links[i]), least(i), least(i) == i) for i in links} | {i: (0, i, True) for i, _, _ in odd}
    assert embedding_dups.embedding_near_duplicates(table.limit(0)).count() == 0
    a, b, c = [1.0, 0.0], [0.0, 1.0], [1.0, 0.01]
    rows = [(1, a, 1, "x"), (1, a, 1, "x"), (2, c, 1, "x"), (2, b, 0, "x"), (None, a, 1, "x"), (3, b, 1, "x")]
    again = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string")
    got = sorted(tuple(r) for r in embedding_dups.embedding_near_duplicates(again).where("vec_id is not null").collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_hilbert_curve_steps_to_neighbours():
    cells = sorted((sharding.hilbert_index((a, b, c), 2), (a, b, c)) for a in range(4) for b in range(4) for c in range(4))
    assert [i for i, _ in cells] == list(range(64))
    assert all(sum(abs(p - q) for p, q in zip(x, y, strict=True)) == 1 for (_, x), (_, y) in zip(cells, cells[1:], strict=False))


def test_hilbert_shards(docs, empty):
    rows = sharding.hilbert_shards(docs, ["lang", "source", "n_chars"]).collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == docs.count() and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))
    by = {r["doc_id"]: r for r in rows}
    for r in docs.where("doc_id is not null").collect():
        assert by[r["doc_id"]]["size"] == len(text_of(r).encode()) + 1 and by[r["doc_id"]]["text_crc32"] == zlib.crc32(text_of(r).encode())
    places = sorted((r["shard"], r["slot"], r["curve"]) for r in rows)
    assert [p[2] for p in places] == sorted(p[2] for p in places)
    assert sharding.hilbert_shards(empty, ["lang", "source"]).count() == 0 and sharding.hilbert_shards(docs.limit(3), ["lang"]).count() == 3


def test_shards_cut_whole_strings_and_are_written(spark, tmp_path):
    rows = [(i, f"t{i}", f"https://{'abcdefgh'[i % 8]}.example/{i % 3}", i % 7, "x") for i in range(400)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, slot string")
    values = sorted(r[2] for r in rows[:400])
    cuts = sharding.string_cuts(docs, "source", 8)
    assert cuts == sorted({values[-(-400 * i // 8) - 1] for i in range(1, 8)}) and sharding.string_cuts(docs.limit(0), "source", 8) == []
    sharding.write_shards(docs, ["source"], str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r["doc_id"], r["text"], r["source"], r["n"], r["doc_slot"]) for r in back.where("doc_id is not null").collect()) == rows[:400] and back.count() == 401
    ranges = {r["shard"]: (r["a"], r["b"]) for r in back.groupBy("shard").agg(sharding.F.min("source").alias("a"), sharding.F.max("source").alias("b")).collect()}
    assert len(ranges) == 8 and max(sum(a <= v <= b for a, b in ranges.values()) for v in set(values)) <= 3
    assert spark.read.parquet(str(tmp_path / "s" / "shard=3")).select("slot").toPandas()["slot"].sort_values().tolist() == list(range(50))


def test_sentencepiece_matches_the_library(spark, docs, empty, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepieces.encode_documents(docs, path)
    rows, texts = out.collect(), [text_of(r) for r in docs.collect()]
    assert [r["ids"] for r in rows] == library.encode(texts) and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    assert [r["text"] for r in sentencepieces.decode_documents(out, path).collect()] == texts
    assert sentencepieces.encode_documents(empty, path).count() == 0
    # The same pieces as a unigram model; penalties small enough for the library's single precision.
    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -40000.0) / 1000
    own = str(tmp_path / "unigram.model")
    with open(own, "wb") as f:
        f.write(m.SerializeToString())
    plain = [t for t in texts if t.isascii() and "\n" not in t and "\x00" not in t and len(t) < 3000]
    mine, theirs = sentencepieces.Pieces(own), sentencepiece.SentencePieceProcessor(model_file=own)
    score = [sum(theirs.get_score(i) for i in ids) for ids in theirs.encode(plain)]
    assert np.allclose([sum(theirs.get_score(int(i)) for i in ids) for ids in mine.encode(plain)], score, atol=1e-2)


def brute_suffixes(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        own = []
        for j in range(len(b) - 99):
            x = b[j : j + 100]
            if x in seen:
                gone[j : j + 100] = True
            seen.add(x)
            own.append(x)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, empty, monkeypatch):
    shared = prose(50, 60)
    texts = [r["text"] for r in docs.where("doc_id is not null").distinct().orderBy("doc_id").collect()]
    texts += [prose(60) + shared + prose(61), shared + prose(62), "q" + shared[:150] + prose(63) + shared[100:] + "é" + shared, prose(61)[40:300], "ab" * 300, "zz" + "ab" * 80, "é" * 49 + "zz", "é" * 49 + "zzz", "é" * 90]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for chunk in (1 << 16, 256):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        got = {r[0]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(table).collect()}
        want = brute_suffixes([(i, t or "") for i, t in enumerate(texts)])
        assert got == want
    assert sum(r[1] > 0 for r in want.values()) > 5
    out = suffix_dedup.suffix_dedup(docs).collect()
    assert len(out) == docs.count()
    kept = suffix_dedup.strip_repeats(table.withColumn("extra", table.doc_id))
    assert kept.columns == ["doc_id", "text", "extra"]
    assert all(r["extra"] == r["doc_id"] and len(r["text"].encode()) <= want[r["doc_id"]][0] - want[r["doc_id"]][1] for r in kept.collect())
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def lm_probability(c, tables, roots, d0):
    """P(word | context) of the model, from customers c[context, word], their tables, and tables of words at the root; also of the unknown word (None)."""
    d, theta = lm_scores.DISCOUNT, lm_scores.STRENGTH
    m = collections.Counter()
    for (_, w), t in tables.items():
        m[w] += t
    held, opened = collections.Counter(), collections.Counter()
    for (b, w), k in c.items():
        held[b] += k
        opened[b] += tables[b, w]
    total, all_roots, u = sum(m.values()), sum(roots.values()), 1 / (len(m) + 1)

    def p(b, w):
        root = (m[w] - d0 * roots[w] if w in m else 0) + (theta + d0 * all_roots) * u
        own = c[b, w] - d * tables[b, w] if (b, w) in c else 0
        return (own + (theta + d * opened[b]) * root / (theta + total)) / (theta + held[b])

    return p, m


@pytest.mark.parametrize(("head", "hot"), [(1 << 18, 1 << 40), (30, 40)])
def test_lm_scores(spark, docs, empty, monkeypatch, head, hot):
    rows = [(r["doc_id"], text_of(r)) for r in docs.where("doc_id is not null").distinct().collect()]
    toks = {i: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [b" "] for i, t in rows}
    train = {i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2}
    c = collections.Counter(w for i in train for w in toks[i])
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(x for i in train for x in zip([b" ", *toks[i]], toks[i]))
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, slice string")
    monkeypatch.setattr(lm_scores, "HEAD", head)
    monkeypatch.setattr(lm_scores, "HOT", hot)
    monkeypatch.setattr(lm_scores, "SLICE", 3000)
    monkeypatch.setattr(lm_scores, "BUCKET", 300)

    def halves(c, r, p, rest, scale, d, theta, rng):
        return (c + 1) / 2, (c + 1) // 2

    out = {r["doc_id"]: r for r in lm_scores.lm_scores(table, sampler=halves).collect()}
    tables = {x: (k + 1) // 2 for x, k in pairs.items()}
    _, m = lm_probability(pairs, tables, collections.Counter(), 0)
    d0 = lm_scores._discount(sum(x == 1 for x in m.values()), sum(x == 2 for x in m.values()))
    roots = {w: (x + 1) / 2 for w, x in m.items()}
    whole, _ = lm_probability(pairs, tables, roots, d0)
    d, theta = lm_scores.DISCOUNT, lm_scores.STRENGTH
    held = collections.Counter()
    extra = collections.Counter()  # the mean number of tables beyond the last sample's, which are the root's customers
    for (b, w), k in pairs.items():
        held[b] += k
        extra[b] += (k + 1) / 2 - tables[b, w]

    def p(b, w):
        root = (m[w] - d0 * roots[w] if w in m else 0) + (theta + d0 * sum(roots.values())) / (v + 1)
        more = d * extra[b] * root / (theta + sum(m.values())) - (d * ((pairs[b, w] + 1) / 2 - tables[b, w]) if (b, w) in pairs else 0)
        return whole(b, w) + more / (theta + held[b])

    assert set(out) == set(toks)
    for i, r in out.items():
        assert r["held_out"] == (i not in train) and r["n_tokens"] == len(toks[i]) and r["train_tokens"] == n and r["n_known"] == sum(c[w] > 0 for w in toks[i])
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks[i]), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(b, w)) for b, w in zip([b" ", *toks[i]], toks[i])), rel_tol=1e-6)
        assert math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"]), rel_tol=1e-9)
    for b in [b" ", b"the", b"never seen", *list(c)[:20]]:
        assert math.isclose(sum(p(b, w) for w in [*c, None]), 1, rel_tol=1e-9)
    sampled = {r["doc_id"]: r for r in lm_scores.lm_scores(table).collect()}
    assert sum(sampled[i]["score"] for i in train) > sum(sampled[i]["base_score"] for i in train)


def test_lm_odd_rows(spark, docs, empty):
    assert lm_scores.lm_scores(docs).count() == docs.count() and lm_scores.lm_scores(empty).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert all(r["train_tokens"] == 0 and math.isclose(r["score"], 0) for r in lm_scores.lm_scores(held).collect())  # nothing known: one outcome


def test_lm_tokens():
    texts = ["", "A b", "  x ", "\tq\n", "é É A a", "w" * 100_000 + " z", " ", "b a B A", "\xa0\x1c x\x00"]
    for chunk in (1 << 21, 8):
        lm_scores._CHUNK, before = chunk, lm_scores._CHUNK
        h, n = lm_scores.tokens(pa.array([t.encode() for t in texts], pa.binary()))
        lm_scores._CHUNK = before
        want = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [b" "] for t in texts]
        assert n.tolist() == [len(w) for w in want]
        names = dict(zip((w for ws in want for w in ws), h.tolist()))
        assert [names[w] for ws in want for w in ws] == h.tolist() and len(set(names.values())) == len(names) and names[b" "] == lm_scores.END
    assert len(lm_scores.tokens(pa.array([], pa.binary()))[0]) == 0


def test_lm_settings_do_not_matter(spark, monkeypatch):
    """Which words are in the head, and how large slices and buckets are, changes scores by no more than another seed does."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    weight = 1 / np.arange(1, 3001)
    texts = [" ".join(rng.choice(vocabulary, 150, p=weight / weight.sum())) for _ in range(120)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)

    def held_out(seed=None, **given):
        for k, v in ({"HEAD": 1 << 18, "SLICE": 10_000_000, "BUCKET": 1_000_000} | given).items():
            monkeypatch.setattr(lm_scores, k, v)
        sampler = lm_scores.gibbs if seed is None else lambda *a: lm_scores.gibbs(*a[:-1], np.random.default_rng(a[-1].integers(1 << 40) + seed))
        return lm_scores.lm_scores(table, sampler=sampler).where("held_out").agg({"score": "sum"}).head()[0]

    seeds = [held_out(s) for s in range(4)]
    spread = max(seeds) - min(seeds)
    middle = sum(seeds) / len(seeds)
    for given in ({"HEAD": 20}, {"SLICE": 4000}, {"HEAD": 0, "SLICE": 9000, "BUCKET": 2000}):
        assert abs(held_out(**given) - middle) < 2 * spread


def test_lm_gibbs_samples_the_posterior(monkeypatch):
    """Tables of one dish: the weight of t tables is the number of seatings, by discounted sizes, times new tables' weights."""
    d, theta, p, n = 0.6, 1.0, 0.3, 7
    ways = {(1, 1): 1.0}
    for k in range(1, n):
        for t in range(1, k + 1):
            ways[k + 1, t] = ways.get((k + 1, t), 0) + ways[k, t] * (k - d * t)
            ways[k + 1, t + 1] = ways[k, t]
    monkeypatch.setattr(lm_scores, "BURN_IN", 20)
    weight = {t: ways[n, t] * p**t * math.prod(theta + d * i for i in range(1, t)) for t in range(1, n + 1)}
    want = sum(t * x for t, x in weight.items()) / sum(weight.values())
    k = 20_000
    mean, last = lm_scores.gibbs(np.full(k, n), np.arange(k), np.full(k, p), np.zeros(k), np.ones(k), d, theta, np.random.default_rng(3))
    assert abs(mean.mean() - want) < 0.03 and abs(last.mean() - want) < 0.04
    # A pair stays apart with probability new / (new + 1 - d), new being the strength and the discounts of all tables but its own, times the dish's probability.
    twos = np.full(k, 2)
    mean, last = lm_scores.gibbs(twos, np.arange(k), np.full(k, p), np.full(k, 3.0), np.ones(k), d, theta, np.random.default_rng(4))
    new = (theta + d * 4) * p
    assert abs(mean.mean() - 1 - new / (new + 1 - d)) < 0.01 and abs(last.mean() - mean.mean()) < 0.02
    big, _ = lm_scores.gibbs(np.array([5000, 2, 2]), np.zeros(3, int), np.array([0.2, 0.1, 1e-9]), np.zeros(1), np.ones(1), d, theta, np.random.default_rng(3))
    assert 1 < big[0] < 5000 and big[2] < 1.2


def test_near_duplicates(spark, docs, empty):
    texts = [r["text"] for r in docs.where("doc_id is not null").distinct().orderBy("doc_id").collect()]
    rng = np.random.default_rng(9)
    for rate in (0.005, 0.02, 0.05):
        base = prose(70 + int(rate * 1000), 400).split()
        for _ in range(8):
            texts.append(" ".join(f"n{rng.integers(1000)}" if rng.random() < rate else w for w in base))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def grams(t):
        w = re.findall(r"\w+", (t or "").lower())
        k = min(5, len(w))
        return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else collections.Counter()

    g = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both, either = sum((g[i] & g[j]).values()), sum((g[i] | g[j]).values())
            if (texts[i] or "") == (texts[j] or "") or (either and both / either >= 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(table).collect()}
    assert {i: r["group_id"] for i, r in got.items()} == {i: find(i) for i in range(len(texts))}
    assert all(r["kept"] == (i == r["group_id"]) for i, r in got.items())
    assert near_dups.near_duplicates(docs).count() == docs.count() and near_dups.near_duplicates(empty).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(1, 1 << 60, 300).astype(np.uint64))
    w, x = rng.integers(1, 6, len(a)), rng.integers(1, 6, len(a))
    s = near_dups.dart_signatures(np.r_[a, a], np.r_[w, x], np.array([len(a), len(a)]), 4000)
    true = np.minimum(w, x).sum() / np.maximum(w, x).sum()
    assert abs((s[0] == s[1]).mean() - true) < 0.04
    assert math.isclose(near_dups.similarity((a, w), (a, x)), true)


def test_blocked_buckets_find_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = prose(90, 300).split()
    texts = [" ".join(f"n{rng.integers(1000)}" if rng.random() < 0.012 else w for w in base) for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = []
    for block in (1024, 4):
        monkeypatch.setattr(near_dups, "BLOCK", block)
        out.append({r["doc_id"]: r["group_id"] for r in near_dups.near_duplicates(table).collect()})
    assert out[0] == out[1]
