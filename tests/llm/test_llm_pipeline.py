"""The pipeline's stages and the registered queries."""

import numpy as np

import corpus_pipeline
from specgrain.llm import queries


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(names)


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    item, shared = text(40), text(60)
    good = [text(150) for _ in range(120)]
    good[1] = good[0]
    good[2] = good[3] + " " + item + " " + text(20)
    good[4], good[5] = text(50) + " " + shared + " " + text(50), shared + " " + text(90)
    texts = good + [" ".join(w + "###" for w in text(150).split()) for _ in range(120)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = {r["doc_id"]: r for r in out.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    assert set(seen["quality classifier"]) >= set(range(114)) - {2} and sum(i >= 120 for i in seen["quality classifier"]) <= 3
    assert 0 in seen["near duplicates"] and 1 not in seen["near duplicates"]
    passages = seen["repeated passages"]
    assert shared in passages[4]["text"] and shared not in passages[5]["text"] and passages[5]["n_chars"] == len(passages[5]["text"])
    assert 2 not in seen["benchmark decontamination"] and len(seen["benchmark decontamination"]) == len(passages) - 1
    assert all(r["round_trip"] for r in seen["sentencepiece encoding"].values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["sentencepiece encoding"])


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, ties, clashing rows of an id, empty tables and extra columns in every stage."""
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    item, one, two = text(40), text(80), text(80)
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, band int"
    rows = [(None, one), (None, one), (7, two), (7, two), (7, text(60)), (8, None), (9, ""), (None, f"{text(9)} {item} {text(9)}"), (7, item), (10, text(90))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], schema)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    def after(name, d):
        out = stages[name](spark, d, str(tmp_path))
        assert out.columns == d.columns
        found = out.collect()
        assert all(r["_row"] == "x" for r in found)
        return sorted(((r["doc_id"], r["text"]) for r in found), key=str)

    odd = sorted(rows, key=str)
    assert after("quality classifier", docs) == odd
    assert after("near duplicates", docs) == sorted([r for i, r in enumerate(rows) if i not in (1, 3, 6)], key=str)
    assert after("benchmark decontamination", docs) == sorted([r for i, r in enumerate(rows) if i not in (7, 8)], key=str)
    passages = after("repeated passages", docs)
    assert len(passages) == len(rows) and (None, one) in passages and (7, two) in passages and (8, "") in passages
    assert stages["sentencepiece encoding"](spark, docs, str(tmp_path)).count() == len(rows)
    assert all(stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0 for name in stages)
    bad = spark.createDataFrame([(i, text(50) if i % 2 else "##### $$$$ %%%%", "en", "s", 1, "x", 1) for i in range(80)] + [(None, "##### $$$$ %%%%", "en", "s", 1, "x", 1), (1, "##### $$$$ %%%%", "en", "s", 1, "x", 1)], schema)
    (tmp_path / "more").mkdir()
    spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "more" / "labels.parquet"))
    kept = stages["quality classifier"](spark, bad, str(tmp_path / "more")).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(1, 80, 2)) and all("#" not in r["text"] for r in kept), [r for r in kept if r["doc_id"] == 1]
