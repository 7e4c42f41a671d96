"""Conditions of recipes against a brute-force truth table and hand-made cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from specgrain.functions import expressions as x
from specgrain.operators import conditions
from specgrain.sources.recipes import parse

CASES = [
    ("if", "1", True, None), ("if", "0", False, None), ("if", "0%{?fedora} >= 40", True, None), ("if", "0%{?rhel}", False, None), ("if", "%{rhel}", None, "undefined-macro"),
    ("if", "1 || %{rhel}", None, "undefined-macro"), ("if", '"%{dist}" == ".fc40"', True, None), ("if", '"a" == 1', None, "type-mismatch"), ("if", '"a" < "b"', None, "type-mismatch"),
    ("if", "!0 && (2 + 3 * 2 == 8)", True, None), ("if", "%{with x}", True, None), ("if", "%{without x}", False, None), ("if", "%{with y}", None, "undeclared-build-option"),
    ("if", "%(date)", None, "unsupported-form"), ("if", "1 / 0", None, "division-by-zero"), ("if", "%{?fedora:1}%{!?fedora:0}", True, None), ("if", "foo", None, "bare-word"), ("if", "(1", None, "not-understood"),
    ("if", "", None, "empty"), ("ifarch", "x86_64 aarch64", True, None), ("ifnarch", "x86_64", False, None), ("ifos", "linux", True, None), ("else", "", True, None),
]


@pytest.mark.parametrize("how,text,want,reason", CASES)
def test_truth(how, text, want, reason):
    assert x.truth(how, text, {"fedora": "40", "dist": ".fc40"}, {"x": True}, "x86_64", "linux") == (want, reason)


def test_normal_form_keeps_the_truth_table():
    rng = random.Random(5)

    def make(depth):
        if depth == 0:
            return f"%{{{rng.choice('abc')}}}"
        kind = rng.choice(["&&", "||", "!"])
        return f"!({make(depth - 1)})" if kind == "!" else f"({make(depth - 1)} {kind} {make(depth - 1)})"

    for _ in range(200):
        text = make(rng.randrange(1, 4))
        cubes = x.dnf(text)
        for bits in itertools.product([0, 1], repeat=3):
            values = dict(zip("abc", map(str, bits), strict=True))
            want = bool(x.value_of(x.parse(x.substitute(text, values, {}))))
            assert want == any(all((values[a[2:-1]] == "1") != neg for a, neg in cube) for cube in cubes)


SPEC = """%bcond_without docs
%if 0%{?rhel}
Requires: a
%elif 0%{?fedora} >= 40
Requires: b
%else
Requires: c
%endif
%if %{with docs}
Requires: d
%endif
%if %{nope}
Requires: e
%endif
"""


def test_coverage_over_profiles(spark):
    r = parse(spark.createDataFrame([("s", SPEC)], "spec_id string, text string"))
    profiles = spark.createDataFrame([("el9", "x86_64", "linux"), ("fc40", "x86_64", "linux"), ("fc39", "x86_64", "linux")], "profile_id string, arch string, os string")
    macros = spark.createDataFrame([("el9", "rhel", "9"), ("fc40", "fedora", "40"), ("fc39", "fedora", "39")], "profile_id string, name string, value string")
    told = conditions.evaluate(r.branches, profiles, macros, conditions.build_options(r.lines)).withColumn("branch", F.col("line_no")).cache()
    cover = {x["line_no"]: (x["active"], x["inactive"], x["indeterminate"], x["class"]) for x in conditions.coverage(told, ["spec_id", "line_no"]).collect()}
    assert cover == {2: (1, 2, 0, "conditional"), 4: (1, 2, 0, "conditional"), 6: (3, 0, 0, "always"), 9: (3, 0, 0, "always"), 12: (0, 0, 3, "indeterminate")}
    chosen = conditions.select_branches(told, ["spec_id", "profile_id", "depth", "chain"])
    taken = {(c["profile_id"], c["line_no"]) for c in chosen.where("selected").collect()}
    assert taken == {("el9", 2), ("fc40", 4), ("fc39", 6), ("el9", 9), ("fc40", 9), ("fc39", 9)}
    ends = {2: 4, 4: 6, 6: 8, 9: 11, 12: 14}
    bounded = chosen.withColumn("next", F.create_map(*(F.lit(v) for kv in ends.items() for v in kv))[F.col("line_no")])
    seen = conditions.active_lines(r.body, bounded.select("spec_id", "profile_id", "line_no", "next", "selected"))
    got = {(c["profile_id"], c["line"][-1]) for c in seen.where("line like 'Requires%'").collect()}
    assert got == {("el9", "a"), ("fc40", "b"), ("fc39", "c"), ("el9", "d"), ("fc40", "d"), ("fc39", "d")}
    off = spark.createDataFrame([("docs", False)], "name string, state boolean")
    assert conditions.build_options(r.lines, off).head()["state"] is False


def test_cubes_as_a_column(spark):
    t = spark.createDataFrame([("%{a} || (%{a} && %{b})",), ("%{a} && !%{a}",), ("%{a} || !%{a}",), ("(",), (None,)], "c string")
    rows = [r["d"] for r in t.select(x.condition_cubes("c").alias("d")).collect()]
    assert rows[0] == [[1], [1, 2]] and rows[1] == [] and rows[3] is None and rows[4] is None
    t = t.limit(1).select(x.condition_cubes("c").alias("d")).select(conditions.drop_subsumed(F.col("d")).alias("d"))
    assert t.head()["d"] == [[1]]
