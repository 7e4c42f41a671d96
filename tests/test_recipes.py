"""Recipe relations and rules on small recipes written for the purpose."""

import pytest
from recipe_examples import CASES, CLEAN, changed, example

from specgrain.operators import branch_rules, parser_rules  # noqa: F401  register their rules
from specgrain.operators.recipe_rules import RULES, lint
from specgrain.sources.recipes import parse

@pytest.fixture(scope="module")
def findings(spark):
    texts = {"clean": CLEAN, "RPM064p": changed("after", "Source0:", "Patch1: x.patch")}
    texts |= {id: example(id) for id in CASES}
    table = spark.createDataFrame([*texts.items(), ("null", None)], "spec_id string, text string")
    recipes = parse(table)
    for name in ("lines", "sections", "tags", "atoms", "body", "files", "changelog", "comments", "macros", "branches"):
        setattr(recipes, name, getattr(recipes, name).cache())
    found = {}
    for id in sorted(RULES):
        for r in RULES[id].find(recipes).collect():
            if not RULES[id].families or "fedora" in RULES[id].families or r["spec_id"] == id:
                found.setdefault(r["spec_id"], set()).add(id)
    return found


def test_the_clean_recipe_has_no_findings(findings):
    assert findings.get("clean", set()) == set() and "null" not in findings


@pytest.mark.parametrize("id", sorted(CASES))
def test_rule(findings, id):
    assert id in findings.get(id, set())


def test_all_rules_as_one_table(spark):
    out = lint(parse(spark.createDataFrame([("a", CLEAN.replace("greeter\n", "greeter.\n"))], "spec_id string, text string")), ["RPM055", "RPM056", "RPM001"])
    assert [(r["lint_id"], r["lint_name"], r["severity"], r["line_no"]) for r in out.collect()] == [("RPM055", "summary-ends-with-dot", "warn", 4)]


def rules_of(spark, text, *ids, **kw):
    return [(r["lint_id"], r["line_no"]) for r in lint(parse(spark.createDataFrame([("a", text)], "spec_id string, text string")), list(ids), **kw).orderBy("line_no").collect()]


def test_rules_by_their_fixed_values(spark):
    at_ = lambda text: changed("after", "BuildRequires:", text)
    assert rules_of(spark, at_("Requires: foo, foo >= 1, bar\nProvides: x, x = 2"), "RPM320") == [("RPM320", 9), ("RPM320", 10)]
    assert rules_of(spark, at_("Provides: foo\nProvides: foo = 2\nObsoletes: old\nObsoletes: old < 2"), "RPM596") == []
    assert rules_of(spark, changed("after", "URL:", "Distribution: x\nPrefix: /usr\nVendor: y"), "RPM020") == [("RPM020", 9)]
    tools = "Requires: cargo\nRequires: pkgconf\nRequires: pkgconfig(zlib)\nRequires: zlib-devel"
    assert rules_of(spark, at_(tools), "RPM323") == [("RPM323", 9), ("RPM323", 11), ("RPM323", 12)]
    assert rules_of(spark, at_(tools).replace("hello\n", "gcc-c++\n", 1), "RPM323") == [] and rules_of(spark, at_("\n%package devel\nSummary: X\n" + tools), "RPM323") == []
    build = changed("after", "%make_build", "cargo build\nlibtoolize\npkgconf x\npkg-config y")
    assert rules_of(spark, build, "RPM324") == [("RPM324", 20), ("RPM324", 21)] and rules_of(spark, build, "RPM324", "RPM001", family=None) == []
    split = changed("after", "%make_build", "%if 0%{?a}\nx\n%endif\n" * 9)
    assert rules_of(spark, split.replace("URL:", "%if 0%{?a}\n%global z 1\n%endif\n" * 15 + "URL:"), "RPM092") == []
    assert rules_of(spark, changed("after", "%license", "%if 0%{?a}\nx\n%endif\n" * 8).replace("URL:", "%if 0%{?a}\n%global z 1\n%endif\n" * 8 + "URL:"), "RPM092") == [("RPM092", 1)]


def test_lines_of_dealt_sources_are_not_shuffled(spark, tmp_path):
    """Placing the lines of texts that are dealt by recipe needs no further exchange; with keep only the relations that are asked for are written."""
    from specgrain.session import dealt
    from specgrain.sources import recipes

    texts = [(i, "Name: a\n%if 1\nRequires: b\n%else\n%if 0\n%endif\n%endif\n%package -n c\n%files -f x sub\n%changelog" if i % 3 else "%build\nmake\n%endif") for i in range(40)]
    sources = dealt(spark.createDataFrame(texts, "spec_id long, text string"), "spec_id", 7)
    lines = recipes.parse(sources).lines
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and sources.rdd.getNumPartitions() >= 6, plan
    r = recipes.parse(sources, keep=True)
    assert "branches" not in vars(r) and r.branches.count() == 26 * 3 and "branches" in vars(r) and "tags" not in vars(r)
    one = {tuple(x) for x in r.body.where("spec_id = 1").select("line_no", "sec", "depth", "chain", "kind", "pkg").collect()}
    assert one == {(1, 0, 0, None, "preamble", ""), (2, 0, 1, 2, "preamble", ""), (3, 0, 1, 2, "preamble", ""), (4, 0, 1, 2, "preamble", ""), (5, 0, 2, 5, "preamble", ""), (6, 0, 2, 5, "preamble", ""), (7, 0, 1, 2, "preamble", "")}
    assert {tuple(x) for x in r.sections.where("spec_id in (1, 3)").select("spec_id", "sec", "line_no", "kind", "pkg", "absolute").collect()} == {
        (1, 0, 0, "preamble", "", False), (1, 1, 8, "package", "c", True), (1, 2, 9, "files", "%{name}-sub", False), (1, 3, 10, "changelog", "", False), (3, 1, 1, "build", "", False)}
    assert r.specs.count() == 40
