"""Reports on pairs of closures."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from specgrain.operators import closure_reports as reports

PACKAGE = "pkg_id long, name string, epoch int, version string, release string, arch string"


@pytest.mark.parametrize("name, op, kind", [
    ("libz.so.1()(64bit)", "NONE", "soname"), ("/usr/lib64/libz.so.1", "NONE", "soname"), ("libz.so", "GE", "soname"), ("/usr/bin/sohail", "NONE", "path"), ("cmake", "GE", "versioned"),
    ("soap", "NONE", "plain"), ("a.sock", "NONE", "plain"), ("perl(Foo)", "EQ", "versioned"),
])
def test_bucket(spark, name, op, kind):
    assert spark.range(1).select(reports.bucket(F.lit(name), F.lit(op)).alias("k")).head()["k"] == kind


def test_diff_against_brute_force(spark):
    rng = random.Random(4)
    packages = [(k, f"n{k % 9}", k % 2, str(k % 3), "1", "x") for k in range(30)]
    closed = [(root, k, rng.randrange(4)) for root in "abcd" for k in rng.sample(range(30), 9)]
    pairs = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("a", "nothing"), ("d", "d"), ("no", "none")]
    names = defaultdict(lambda: defaultdict(list))
    for root, k, depth in closed:
        names[root][packages[k][1]].append((f"{k % 2}:{k % 3}-1.x", depth))
    of = lambda root, n: names.get(root, {}).get(n, [])
    want = {}
    for a, b in set(pairs):
        for n in {*names.get(a, ()), *names.get(b, ())}:
            x, y = (sorted({e for e, _ in of(s, n)}) or None for s in (a, b))
            side = "only_a" if not y else "only_b" if not x else "common" if x == y else "version_only"
            want[a, b, n] = (side, x, y, *(min((d for _, d in of(s, n)), default=None) for s in (a, b)))
    p, c = spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(closed, "root string, pkg_id long, depth int")
    diff = reports.closure_diff(p, c, spark.createDataFrame(packages + packages[:5], PACKAGE))
    got = diff.collect()
    assert {(r["a"], r["b"], r["name"]): (r["side"], r["evra_a"], r["evra_b"], r["depth_a"], r["depth_b"]) for r in got} == want and len(got) == len(want)
    assert {r["side"] for r in got} == {"common", "version_only", "only_a", "only_b"}
    rounds = reports.rounds_diff(diff).collect()
    assert sum(r["common"] + r["version_only"] + r["only_a"] + r["only_b"] for r in rounds) == len(want)
    assert reports.closure_diff(p.where("false"), c, spark.createDataFrame(packages, PACKAGE)).count() == 0


def test_unmet_and_verdicts(spark):
    closed = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 2, 0), ("c", 3, 0)], "root string, pkg_id long, depth int")
    cap = "pkg_id long, kind string, name string, op string, epoch int, version string, release string"
    dep = lambda name, op="NONE": (name, op, 0 if op != "NONE" else None, "2" if op != "NONE" else None, "" if op != "NONE" else None)
    caps = [(1, "requires", *dep("x", "GE")), (1, "requires", *dep("x", "GE")), (2, "requires", *dep("x", "GE")), (2, "requires", *dep("/bin/y")), (2, "conflicts", *dep("q")), (1, "requires", *dep("libq.so.3")), (3, "requires", *dep("fine"))]
    found = [(*dep("x", "GE"), "version_unsatisfied"), (*dep("/bin/y"), "no_provider"), (*dep("libq.so.3"), "no_provider"), (*dep("fine"), "satisfied"), (*dep("q"), "no_provider")]
    lost = reports.unmet(closed, spark.createDataFrame(caps, cap), spark.createDataFrame(found, "name string, op string, epoch int, version string, release string, outcome string"))
    assert {(r["root"], r["name"], r["bucket"], r["reason"], r["parents"], r["depth"]) for r in lost.collect()} == {
        ("a", "x", "versioned", "version_unsatisfied", 2, 0), ("a", "/bin/y", "path", "no_provider", 1, 1), ("a", "libq.so.3", "soname", "no_provider", 1, 0),
        ("b", "x", "versioned", "version_unsatisfied", 1, 0), ("b", "/bin/y", "path", "no_provider", 1, 0),
    }
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert {tuple(r) for r in reports.unmet_diff(pairs, lost).collect()} == {
        ("a", "b", "versioned", "version_unsatisfied", 1, 0, 0), ("a", "b", "path", "no_provider", 1, 0, 0), ("a", "b", "soname", "no_provider", 0, 1, 0),
        ("b", "c", "versioned", "version_unsatisfied", 0, 1, 0), ("b", "c", "path", "no_provider", 0, 1, 0),
    }
    labels = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "root string")
    assert {tuple(r) for r in reports.verdicts(labels, closed, lost).collect()} == {("a", "unsat", 2, 3), ("b", "unsat", 1, 2), ("c", "ok", 1, 0), ("d", "skipped", 0, 0)}
