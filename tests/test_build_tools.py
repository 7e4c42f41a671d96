"""Programs of build scripts, their owners, and closures of many roots."""

from specgrain.operators import build_tools, projection, resolve
from specgrain.sources.recipes import parse

PACKAGE = "pkg_id long, repo_id string, name string, epoch int, version string, release string, arch string"
CAP = "pkg_id long, kind string, name string, op string, epoch int, version string, release string"

PACKAGES = [(n, "main", name, 0, "3.1", "2", "noarch") for n, name in enumerate(("loom", "weft-tools", "dyer", "spindle", "needle"), 10)] + [(20, "extra", "loom", 0, "9", "1", "noarch")]
#: dyer needs spindle, which needs needle, which needs dyer again.
NEEDS = [(12, "requires", "spindle", "NONE", None, None, None), (13, "requires", "needle", "GE", 0, "3", ""), (14, "requires", "dyer", "NONE", None, None, None)]
FILES = [(10, "/usr/bin/loom"), (20, "/usr/bin/loom"), (11, "/usr/sbin/weft"), (11, "/usr/libexec/warp"), (12, "/usr/bin/dye"), (13, "/opt/mill/bin/spin"), (14, "/usr/bin/sew"), (14, "/usr/bin/libsew.so.1"), (20, "/bin/weft"), (12, "/usr/bin/make")]

RECIPES = {
    "bare": "BuildRequires: dyer\n%build\nloom x\nloom y && weft z | sew\n%check\ndye\n",
    "declared": "BuildRequires: loom, weft-tools >= 3\nBuildRequires: (needle if (dyer and x) else spindle)\n%build\nloom; weft; sew\n/opt/mill/bin/spin\n",
    "unless": "BuildRequires: (needle without loom)\n%build\nloom && sew\n",
    "paths": "%global tools /usr/bin\n%install\ncp %{tools}/sew %{unknown}/dye /usr/bin/cat a\n/opt/mill/bin/spin -q\nls /usr/libexec/warp /usr/bin/libsew.so.1\n",
    "quiet": "%build\n# loom\nmake > /usr/bin/sew\ncat <<E\nloom\nE\n%loom\n$loom\nx=loom\necho 'loom'\nloom | dye)\n%post\nloom\n",
    "branch": "%build\n%if 0%{?big}\nloom\n%else\ndye\n%endif\n",
    "none": None, "empty": "", "long": "%build\n" + "loom a;" * 20_000,
}


def _found(spark, recipes, packages=PACKAGES, files=FILES):
    r = parse(spark.createDataFrame(list(recipes.items()), "spec_id string, text string"))
    profiles = spark.createDataFrame([(1, "x86_64", "linux"), (2, "x86_64", "linux")], "profile_id int, arch string, os string")
    macros = spark.createDataFrame([(2, "big", "1")], "profile_id int, name string, value string")
    p, c = spark.createDataFrame(packages, PACKAGE), spark.createDataFrame(NEEDS, CAP)
    f = spark.createDataFrame(files, "pkg_id long, path string")
    out = build_tools.missing_tools(r, projection.project(r, profiles, macros), profiles, macros, p, c, resolve.providers(p, c), f).collect()
    return sorted((x["spec_id"], x["profile_id"], x["lint_id"][-3:], x["line_no"], x["tool"], x["owner"], x["reached"]) for x in out)


def test_missing_tools(spark):
    rows = _found(spark, RECIPES)
    one = [x[:1] + x[2:] for x in rows if x[1] == 1]
    assert one == [
        ("bare", "010", 3, "loom", "loom", False), ("bare", "010", 4, "sew", "needle", True), ("bare", "010", 4, "weft", "weft-tools", False),
        ("branch", "010", 5, "dye", "dyer", False), ("long", "010", 2, "loom", "loom", False),
        ("paths", "011", 3, "/usr/bin/sew", "needle", False), ("paths", "011", 4, "/opt/mill/bin/spin", "spindle", False), ("unless", "010", 3, "loom", "loom", False),
    ]
    assert [x[2:] for x in rows if x[1] == 2 and x[0] == "branch"] == [("010", 3, "loom", "loom", False)]
    assert [x[:1] + x[2:] for x in rows if x[1] == 2 and x[0] != "branch"] == [x for x in one if x[0] != "branch"]


def test_missing_tools_of_nothing(spark):
    assert _found(spark, {"none": None}) == [] and _found(spark, {"a": "%build\nloom\n"}, files=[]) == []


def test_closures_of_many_roots(spark):
    edge = [(1, 2), (2, 3), (3, 1), (4, 4), (5, 6), (6, 3), (7, 8)]
    roots = [("a", 1), ("b", 5), ("b", 5), ("c", 4), ("c", 9), ("d", 1), ("e", 1), ("e", 5), ("f", None)]
    e = spark.createDataFrame(edge, "pkg_id long, needs long")
    r = spark.createDataFrame(roots, "root string, pkg_id long")
    want = {}
    for name in {n for n, k in roots if k}:
        level, seen, depth = {k for n, k in roots if n == name}, {}, 0
        while level:
            seen |= dict.fromkeys(level, depth)
            level, depth = {b for a, b in edge if a in level} - set(seen), depth + 1
        want |= {(name, k): n for k, n in seen.items()}
    got = resolve.closures(r, e).collect()
    assert {(x["root"], x["pkg_id"]): x["depth"] for x in got} == want and len(got) == len(want)
    members, closed = resolve.shared_closures(r, e)
    assert members.count() == 5 and closed.select("set_id").distinct().count() == 4
    assert resolve.closures(r.where("false"), e).count() == 0


def test_closures_of_more_sets_than_a_word_has_bits(spark):
    """A ring of 140 packages, each a root of its own: every set's bit, the highest of a word included, goes all the way round, and sets are numbers."""
    n = 140
    e = spark.createDataFrame([(k, (k + d) % n) for k in range(n) for d in (1, 9)], "pkg_id long, needs long")
    r = spark.createDataFrame([(f"r{k}", k) for k in range(n)], "root string, pkg_id long")
    far, level, depth = {0: 0}, {0}, 0
    while level:
        depth += 1
        level = {(k + d) % n for k in level for d in (1, 9)} - set(far)
        far |= dict.fromkeys(level, depth)
    got = {(x["root"], x["pkg_id"]): x["depth"] for x in resolve.closures(r, e).collect()}
    assert got == {(f"r{k}", (k + j) % n): depth for k in range(n) for j, depth in far.items()}
    assert resolve.shared_closures(r, e)[1].schema["set_id"].dataType.typeName() == "long"


def test_reached_like_closures(spark, monkeypatch):
    """Over a random graph with cycles, for more asked packages than a row has bits."""
    import random

    monkeypatch.setattr(resolve, "_WORDS", 1)
    rng = random.Random(5)
    nodes = range(70)
    edges = sorted({(a, rng.choice(nodes)) for a in nodes for _ in range(rng.randrange(6))})
    roots = [(f"r{i}", rng.choice(nodes)) for i in range(40) for _ in range(rng.randrange(2))] + [("r0", None)]
    asked = [(f"r{rng.randrange(42)}", rng.choice([*nodes, 999])) for _ in range(2000)]
    e, r, a = (spark.createDataFrame(x, s) for x, s in ((edges, "pkg_id long, needs long"), (roots, "root string, pkg_id long"), (asked, "root string, pkg_id long")))
    closed = {x for x in roots if x[1] is not None}
    while more := {(x, b) for x, n in closed for a_, b in edges if a_ == n} - closed:
        closed |= more
    got = [(x["root"], x["pkg_id"]) for x in resolve.reached(a, r, e).collect()]
    assert len(got) == len(set(got)) and set(got) == closed & set(asked) and 50 < len(got) < len(set(asked))
    assert resolve.reached(a.where("false"), r, e).isEmpty()
