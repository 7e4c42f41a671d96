"""Changed recipes as a stream."""

from specgrain.streaming.findings import latest, publish, recipe_stream


def test_changed_recipes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.spec").write_text("Name: a\nSummary: small.\n")
    run = lambda: publish(recipe_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), ["RPM055", "RPM056"]).awaitTermination()
    run()
    (tmp_path / "in" / "b.spec").write_text("Name: b\nSummary: Large.\n")
    run()
    rows = latest(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert sorted((r["spec_id"][-6:], r["lint_id"], r["batch"]) for r in rows) == [("a.spec", "RPM055", 0), ("a.spec", "RPM056", 0), ("b.spec", "RPM055", 1)]
    (tmp_path / "in" / "a2.spec").write_text("Name: a2\nSummary: Fine\n")
    run()
    assert latest(spark.read.parquet(str(tmp_path / "out"))).count() == 3
    cleaned = spark.createDataFrame([("a", "RPM055", 0), ("a", None, 0), ("a", None, 1), ("b", "RPM055", 0), ("b", None, 0)], "spec_id string, lint_id string, batch int")
    assert [r["spec_id"] for r in latest(cleaned).collect()] == ["b"]
