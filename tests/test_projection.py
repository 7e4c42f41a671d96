"""What profiles see of a recipe, against a reading by hand, and the repository findings of it."""

import re

import pytest
from pyspark.sql import functions as F

from specgrain.operators import conditions, profiles, projection, resolve
from specgrain.plans import recipe_queries
from specgrain.sources.recipes import parse

RECIPE = """Name: kiln
Version: 3
%bcond_without docs
%{!?mode:%global mode slow}
%define both glaze clay
%define deep %{mode}-%{both}
%define lost %(uname)
%if "%{mode}" == "fast"
%global fuel gas
%ifarch arm
%global fuel wood
%endif
%else
%global fuel coal
BuildRequires: bellows
%endif
%if "%{fuel}" == "wood" || %{with docs}
BuildRequires: %{fuel} >= %{version}, %both
%endif
%if "%{lost}" == "x"
Requires: never
%else
Requires: neither
%endif
%if %{nowhere} > 1
Requires: unknown
%endif
%global fuel late
Requires: %{name}-%{fuel} = 1:%{version}-2
%files
/srv/%{deep}
/srv/%{lost}
%dir /srv/100%%
"""


@pytest.fixture(scope="module")
def seen(spark):
    r = parse(spark.createDataFrame([("k", RECIPE), ("null", None), ("plain", "Name: x\nRequires: y\n%if 1\nno end")], "spec_id string, text string"))
    who = spark.createDataFrame([(1, "arm", "linux"), (2, "x86", "linux"), (3, "arm", "linux")], "profile_id long, arch string, os string")
    macros = spark.createDataFrame([(1, "mode", "fast"), (2, "mode", "fast"), (3, "bothered", "x")], "profile_id long, name string, value string")
    return projection.project(r, who, macros, conditions.build_options(r.lines))


def test_each_profile_sees_its_own(seen):
    atoms = {}
    for r in seen.atoms.where("spec_id = 'k'").collect():
        atoms.setdefault(r["profile_id"], []).append((r["line_no"], r["told"]))
    common = [(29, "kiln-late = 1:3-2")]
    assert {k: sorted(v, key=str) for k, v in atoms.items()} == {
        1: sorted([(18, "wood >= 3"), (18, "glaze clay"), *common], key=str),
        2: sorted([(18, "gas >= 3"), (18, "glaze clay"), *common], key=str),
        3: sorted([(15, "bellows"), (18, "coal >= 3"), (18, "glaze clay"), *common], key=str),
    }
    files = {(r["profile_id"], r["line_no"], r["told"]) for r in seen.files.collect()}
    assert files == {(p, n, t) for p, m in ((1, "fast"), (2, "fast"), (3, "slow")) for n, t in ((31, f"/srv/{m}-glaze clay"), (32, None), (33, "/srv/100%"))}
    assert {r["told"] for r in seen.atoms.where("spec_id = 'plain'").collect()} == {"y"}


def test_branches_say_why(seen):
    got = {(r["profile_id"], r["line_no"]): (r["truth"], r["reason"], r["selected"]) for r in seen.branches.collect()}
    assert got[1, 8] == (True, None, True) and got[3, 8] == (False, None, False) and got[3, 13] == (True, None, True) and got[1, 13] == (True, None, False)
    assert got[2, 10] == (False, None, False) and got[1, 10] == (True, None, True)
    assert {got[p, 20] for p in (1, 2, 3)} == {(None, "unresolved-macro", False)} and not got[1, 22][2]
    assert {got[p, 25][:2] for p in (1, 2, 3)} == {(None, "undefined-macro")}


def test_definitions_hold_where_they_are_seen(seen):
    got = {(r["profile_id"], r["line_no"], r["value"]) for r in seen.definitions.where("name in ('fuel', 'mode')").collect()}
    assert got == {(1, 9, "gas"), (1, 11, "wood"), (2, 9, "gas"), (3, 14, "coal"), (3, 4, "slow"), *((p, 28, "late") for p in (1, 2, 3))}


def test_requirements_of_what_is_seen(spark, seen):
    deps = {(r["profile_id"], r["name"], r["op"], r["epoch"], r["version"], r["release"]) for r in profiles.projected_requirements(seen).where("spec_id = 'k'").collect()}
    assert {d for d in deps if d[0] == 3} == {(3, "bellows", "NONE", None, None, None), (3, "coal", "GE", 0, "3", ""), (3, "glaze", "NONE", None, None, None), (3, "clay", "NONE", None, None, None)}
    p = spark.createDataFrame([(1, "r", n, 0, v, "1") for n, v in (("coal", "2"), ("gas", "3"), ("glaze", "1"), ("bellows", "1"))], "pkg_id long, repo_id string, name string, epoch int, version string, release string")
    p = p.withColumn("pkg_id", F.monotonically_increasing_id())
    caps = spark.createDataFrame([], "pkg_id long, kind string, name string, op string, epoch int, version string, release string")
    found = profiles.projected_findings(seen, resolve.providers(p, caps)).where("spec_id = 'k' and lint_id <> 'RPM-REPO-002'").collect()
    assert {(r["lint_id"], r["profile_id"], r["detail"]) for r in found} == {("RPM-REPO-001", 1, "wood GE 3"), ("RPM-REPO-003", 3, "coal GE 3"), *(("RPM-REPO-001", k, "clay NONE") for k in (1, 2, 3))}


def test_profiles_share_what_is_the_same_for_them(spark, monkeypatch):
    """150 profiles, of which every third has a macro and one no architecture: each sees what its like among the first three sees, and no round's rows grow with the profiles."""
    rows, stored = {}, projection.stored
    monkeypatch.setattr(projection, "stored", lambda df, label: rows.setdefault(label, []).append(out := stored(df, label)) or out)
    r = parse(spark.createDataFrame([("k", RECIPE)], "spec_id string, text string"))
    who = spark.createDataFrame([(i, None if i == 149 else "arm" if i % 3 else "x86", "linux") for i in range(150)], "profile_id long, arch string, os string")
    macros = spark.createDataFrame([(i, "mode", "fast") for i in range(0, 150) if i % 3 < 2], "profile_id long, name string, value string")
    p = projection.project(r, who, macros, conditions.build_options(r.lines))
    seen = {}
    for x in p.atoms.collect():
        seen.setdefault(x["profile_id"], []).append((x["line_no"], x["told"]))
    like = {i: sorted(v, key=str) for i, v in seen.items()}
    assert len(like) == 150 and all(like[i] == like[i % 3] for i in range(150))
    assert (18, "gas >= 3") in like[0] and (18, "wood >= 3") in like[1] and (18, "coal >= 3") in like[2]
    truth = {(x["profile_id"], x["line_no"]): (x["truth"], x["reason"], x["selected"]) for x in p.branches.collect()}
    assert len(truth) == 7 * 150 and truth[149, 10] == (None, "unknown-target", False) and truth[148, 10] == (True, None, True) and truth[147, 10] == (False, None, False)
    # Three runs of 64 profiles, and at most three values in each.
    assert max(t.count() for t in rows["project-definitions"]) <= 3 * (3 * 11)


def test_only_profiles_are_broadcast(spark, monkeypatch):
    """Stored tables compress so well that Spark takes any of them for small: none that grows with the recipes may be sent through the driver, in no round and for no result."""
    plans, stored = [], projection.stored
    monkeypatch.setattr(projection, "stored", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or stored(df, label))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        r = parse(spark.createDataFrame([(f"k{i}", RECIPE) for i in range(3)], "spec_id string, text string"), keep=True)
        who = spark.createDataFrame([(1, "arm", "linux"), (2, "x86", "linux")], "profile_id long, arch string, os string")
        p = projection.project(r, who, spark.createDataFrame([(1, "mode", "fast")], "profile_id long, name string, value string"), conditions.build_options(r.lines))
        plans += [(x, getattr(p, x)._jdf.queryExecution().executedPlan().toString()) for x in ("branches", "definitions", "tags", "atoms", "files")]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    sent = []
    for label, plan in plans:
        under = None
        for line in plan.split("\n"):
            depth = re.search(r"[A-Za-z*]|$", line).start()
            if under is not None and depth <= under:
                under = None
            if under is None and "BroadcastExchange" in line:
                under = depth
            sent += [(label, t) for t in re.findall(r"/((?:recipe|project)-[a-z]+)-[0-9a-f]{32}", line) if under is not None]
    assert {t for _, t in sent} == {"project-profiles", "project-runs"}, sent
    assert {(x["spec_id"], x["profile_id"], x["count"]) for x in p.atoms.groupBy("spec_id", "profile_id").count().collect()} == {(f"k{i}", k, n) for i in range(3) for k, n in ((1, 3), (2, 4))}


def test_nothing_to_project(spark, seen):
    r = parse(spark.createDataFrame([], "spec_id string, text string"))
    who = spark.createDataFrame([(1, "arm", "linux")], "profile_id long, arch string, os string")
    p = projection.project(r, who, spark.createDataFrame([], "profile_id long, name string, value string"))
    assert p.atoms.count() == 0 and p.branches.count() == 0


def test_written_recipes_break_most_rules():
    assert sum(map(len, recipe_queries.FAMILIES.values())) >= 85
