"""Cubes along nested branches against truth tables, and the rules on them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from specgrain.functions import expressions
from specgrain.operators import paths
from specgrain.operators.recipe_rules import lint
from specgrain.sources.recipes import parse

ATOMS = "pqrs"


def table(cubes):
    """The assignments for which a form holds."""
    def met(cube, true):
        return all((x[1:] not in true) if x[0] == "!" else (x in true) for x in cube)

    return {t for n in range(len(ATOMS) + 1) for t in map(frozenset, itertools.combinations(ATOMS, n)) if any(met(c, t) for c in cubes)}


def test_algebra_against_truth_tables(spark):
    rng = random.Random(8)
    cube = lambda: sorted({rng.choice(["", "!"]) + x for x in rng.sample(ATOMS, rng.randrange(1, 4))})
    forms = [[], [[]], *([cube() for _ in range(rng.randrange(1, 5))] for _ in range(40))]
    rows = [(a, b) for a in forms for b in rng.sample(forms, 8)]
    t = spark.createDataFrame(rows, "a array<array<string>>, b array<array<string>>")
    a, b = F.col("a"), F.col("b")
    got = t.select("a", "b", paths.conjoin(a, b).alias("both"), paths.negate(a).alias("none"), paths.implies(a, b).alias("so"), paths.holds_in(F.lit("p"), paths.conjoin(a, b)).alias("p")).collect()
    every = table([[]])
    for r in got:
        x, y = table(r["a"]), table(r["b"])
        assert table(r["both"]) == x & y and table(r["none"]) == every - x and r["so"] == (x <= y)
        assert r["p"] == all("p" in s for s in x & y)
        assert (r["both"] == []) == (not x & y)


def test_forms_beyond_the_bound_are_unknown(spark):
    wide = [[f"a{i}", f"b{i}"] for i in range(7)]  # its negation has 128 cubes
    r = spark.createDataFrame([(wide,)], "a array<array<string>>").select(paths.negate(F.col("a")).alias("n"), paths.implies(F.lit(None).cast("array<array<string>>"), F.col("a")).alias("i")).head()
    assert expressions.CUBES == 64 and r["n"] is None and r["i"] is None


NESTED = """Name: x
%if %{a} && "%{v}" == "s"
%if %{b}
%elif !%{b} && %{c}
%else
%ifarch arm x86
BuildRequires: deep
%endif
%endif
%else
%if "%{v}" == "s" && %{d}
%endif
%endif
%if a(
%if %{b}
%endif
%endif
"""


def test_paths(spark):
    rows = paths.branch_paths(parse(spark.createDataFrame([("k", NESTED)], "spec_id string, text string"))).collect()
    got = {r["line_no"]: (r["own"], r["before"], r["path"]) for r in rows}
    outer = [["%{a}", "%{v} == s"]]
    assert got[2] == (outer, [[]], [[]]) and got[3] == ([["%{b}"]], [[]], outer) and got[4] == ([["!%{b}", "%{c}"]], [["!%{b}"]], outer)
    assert got[5][0] == [[]] and sorted(got[5][1]) == [["!%{b}", "!%{c}"]]
    assert got[6][0] == [["arch arm"], ["arch x86"]] and got[6][2] == [["!%{b}", "!%{c}", "%{a}", "%{v} == s"]]
    assert sorted(got[11][2]) == [["!%{a}"], ["!%{v} == s"]]
    assert got[14][0] is None and got[15][2] is None


#: rule -> bodies that break it, bodies that don't.
CASES = {
    "RPM430": (
        ["%if %{a}\n%if %{a} && %{b}\n%endif\n%endif", "%if %{a} && %{c}\n%if %{z}\n%if %{b} && %{c}\n%endif\n%endif\n%endif", "%if %{a}\n%else\n%if !%{a} && %{b}\n%endif\n%endif", "%if %{a} || (%{a} && %{d})\n%if %{a} && %{b}\n%endif\n%endif"],
        ["%if %{a}\n%if %{b} && %{c}\n%endif\n%endif", "%if %{a}\n%if %{a}\n%endif\n%endif", "%if %{a} || %{c}\n%if %{a} && %{b}\n%endif\n%endif", "%if a(\n%if %{a} && %{b}\n%endif\n%endif", "%if %{a}\n%if (%{a} && %{b}) || %{c}\n%endif\n%endif", "%if %{a} && %{b}\n%endif"],
    ),
    "RPM431": (
        ["%if %{a}\n%elif !%{a} && %{b}\n%endif", "%if %{a}\n%elif %{c}\n%elif %{b} && !%{c}\n%endif", "%if %{z}\n%if %{a}\n%elif %{z} && %{b}\n%endif\n%endif"],
        ["%if %{a}\n%elif %{b} && %{c}\n%endif", "%if %{a} && %{c}\n%elif !%{a} && %{b}\n%endif", "%if %{a}\n%elif !%{a}\n%endif", "%if a(\n%elif !%{a} && %{b}\n%endif"],
    ),
    "RPM433": (["%if (%{a} || %{b}) && (%{a} || %{c})\n%endif", "%if (%{b}||%{a}) && (%{a} || %{c}) && (%{d} || %{a})\n%endif"], ["%if (%{a} || %{b}) && (%{d} || %{c})\n%endif", "%if (%{a} && %{b}) || (%{a} && %{c})\n%endif", "%if (%{a} || %{b}) && %{a}\n%endif"]),
    "RPM451": (
        ["%if %{a}\nRequires: y\n%endif\n%if %{a} && %{b}\nRequires: y\n%endif", "%ifarch arm x86\nRequires: y\n%endif\n%ifarch arm\nRequires: y\n%endif", "%if %{a}\n%if %{b}\nRequires: y > 1\n%endif\n%endif\n%if %{b} || %{c}\nRequires: y > 1\n%endif"],
        ["%if %{a}\nRequires: y\n%endif\n%if %{b}\nRequires: y\n%endif", "%if %{a}\nRequires: y\n%endif\n%if %{a}\nRequires: y\n%endif", "%if %{a}\nRequires: y\n%endif\n%if %{a} && %{b}\nRequires: z\nBuildRequires: y\n%endif", "%if a(\nRequires: y\n%endif\n%if %{a}\nRequires: y\n%endif", "Requires: y\n%if %{a}\nRequires: y\n%endif"],
    ),
}


@pytest.fixture(scope="module")
def broken(spark):
    rows = [(f"{i}|{good}|{n}", f"Name: x\n{text}\n") for i, (bad, fine) in CASES.items() for good, texts in ((0, bad), (1, fine)) for n, text in enumerate(texts)]
    return {(r["spec_id"], r["lint_id"]) for r in lint(parse(spark.createDataFrame([*rows, ("null", None)], "spec_id string, text string")), list(CASES)).collect()}


@pytest.mark.parametrize("id", CASES)
def test_rules(broken, id):
    bad, fine = CASES[id]
    assert [n for n in range(len(bad)) if (f"{id}|0|{n}", id) not in broken] == [] and [n for n in range(len(fine)) if (f"{id}|1|{n}", id) in broken] == []


def test_nothing(spark):
    assert lint(parse(spark.createDataFrame([], "spec_id string, text string")), list(CASES)).count() == 0
