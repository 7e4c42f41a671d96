"""Versions, resolution, conditions, layers and sources against brute force and hand-made files."""

import itertools
import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from specgrain.functions import evr, macros
from specgrain.operators import conditions, layers, matrix, repo, resolve, solver
from specgrain.sources import metadata


def compare_versions(a, b):
    """Segment by segment: tilde below the end, the end below caret, caret below letters, letters below digits."""
    x, y = (re.findall(r"~|\^|[0-9]+|[A-Za-z]+", v) for v in (a, b))

    def rank(t):
        if t is None:
            return (1,)
        if t in "~^":
            return (0,) if t == "~" else (2,)
        return (4, int(t)) if t.isdigit() else (3, t)

    for p, q in itertools.zip_longest(x, y):
        p, q = rank(p), rank(q)
        if p != q:
            return -1 if p < q else 1
    return 0


def test_version_key_orders_like_segments(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("01239abZ.~^-_+") for _ in range(rng.randrange(10))) for _ in range(400)]
    words += ["1.0", "1.0~rc1", "1.0^git1", "1.0a", "1.0.1", "10", "9", "010", ""]
    keys = {r["v"]: r["k"] for r in spark.createDataFrame([(w,) for w in words], "v string").select("v", evr.version_key(F.col("v")).alias("k")).collect()}
    for a, b in itertools.islice(itertools.combinations(words, 2), 40_000):
        assert compare_versions(a, b) == (keys[a] > keys[b]) - (keys[a] < keys[b]), (a, b)


def test_version_texts(spark):
    rows = [("1:2.3-4.el9",), ("2.3-4",), ("2.3",), ("x:2-3",), ("1:2:3-4",), ("-4",), (None,), ("99999999999:1-1",)]
    got = [r["e"] for r in spark.createDataFrame(rows, "s string").select(evr.evr_parse(F.col("s")).alias("e")).collect()]
    assert [tuple(e) if e else None for e in got][:2] == [(1, "2.3", "4.el9"), (0, "2.3", "4")] and got[2] is None and got[3] is None and got[5:] == [None, None, None]
    one = spark.createDataFrame([("clay-pot-5.1-2.src.rpm", "(MIT OR Apache-2.0) and BSD", 1536, 0, "1", "2")], "s string, l string, n long, e int, v string, r string")
    r = one.select(
        evr.source_rpm_name(F.col("s")).alias("a"), evr.spdx_atoms(F.col("l")).alias("b"), evr.byte_size_text(F.col("n")).alias("c"), evr.evr_text(F.col("e"), F.col("v"), F.col("r")).alias("d"),
        evr.capability_text(F.lit("x"), F.lit("GE"), F.lit(1), F.lit("2"), F.lit("")).alias("f"),
    ).head()
    assert tuple(r) == ("clay-pot", ["MIT", "Apache-2.0", "BSD"], "1.5 KiB", "1-2", "x >= 1:2")
    assert evr.like_escaped(r"a%b_c\d") == r"a\%b\_c\\d"


PACKAGES = "pkg_id long, repo_id string, name string, epoch int, version string, release string, arch string, source_name string, size_installed long"
CAPS = "pkg_id long, kind string, name string, op string, epoch int, version string, release string"


def published(spark, rows):
    """Packages of (pkg_id, repo_id, name, 'epoch:version-release')."""
    cut = [(i, repo_id, name, *re.fullmatch(r"(\d+):(.+)-(.+)", evr).groups()) for i, repo_id, name, evr in rows]
    return spark.createDataFrame([(i, q, n, int(e), v, r, "noarch", n, 7) for i, q, n, e, v, r in cut], PACKAGES)


def wants(spark, rows):
    """Capabilities of (pkg_id, kind, 'name' or 'name OP [epoch:]version')."""
    out = []
    for i, kind, text in rows:
        name, op, version = [*text.split(" "), "NONE", ""][:3] if not text.startswith("(") else (text, "NONE", "")
        epoch, _, bare = version.rpartition(":")
        out.append((i, kind, name, op, *((int(epoch or 0), bare, "") if version else (None, None, None))))
    return spark.createDataFrame(out, CAPS)


@pytest.fixture(scope="module")
def desk(spark):
    """A quill of three epochs in two repositories, ink that only one package gives with a version, a nib before and after its release, and two owners of a pen."""
    p = published(spark, [
        (11, "edge", "quill", "1:0.9-3"), (12, "edge", "quill", "0:2.5-1"), (13, "main", "quill", "2:0.1-1"), (21, "edge", "inkwell", "0:5-2"), (22, "edge", "inkwell", "0:5-10"),
        (31, "main", "nib", "0:1~rc2-1"), (32, "main", "nib", "0:1-1"), (41, "main", "blotter", "0:3^g1-4"), (42, "edge", "blotter", "0:3-4"),
    ])
    c = wants(spark, [
        (21, "provides", "ink(black) EQ 2"), (22, "provides", "ink(black) EQ 3"), (32, "provides", "tip"), (31, "provides", "tip"),
        (11, "requires", "ink(black) GE 2"), (11, "requires", "(felt or wool)"), (22, "requires", "nib LT 1"), (31, "requires", "blotter"), (42, "requires", "quill"),
        (41, "conflicts", "quill LT 1:1"), (42, "conflicts", "tip"), (31, "conflicts", "nib"),
    ])
    return p, c, spark.createDataFrame([(41, "/opt/desk/pen"), (32, "/opt/desk/pen"), (41, "/opt/desk/pen"), (11, "/opt/desk/cap")], "pkg_id long, path string")


def test_lookup(spark, desk):
    p, c, f = desk
    asked = {
        "quill": ("satisfied", 11), "quill GE 2:0": ("satisfied", 13), "quill LT 3": ("satisfied", 12), "quill LT 1": ("version_unsatisfied", 11), "inkwell EQ 5": ("satisfied", 22),
        "inkwell GT 5": ("version_unsatisfied", 22), "ink(black) LE 2": ("satisfied", 21), "ink(black) GE 4": ("version_unsatisfied", 22), "nib": ("satisfied", 32), "nib LT 1": ("satisfied", 31),
        "tip GE 0": ("version_unsatisfied", 32), "tip": ("satisfied", 32), "blotter": ("satisfied", 42), "blotter GT 3": ("satisfied", 41), "/opt/desk/pen": ("satisfied", 32), "wax": ("no_provider", None), "(felt or wool)": None,
    }
    rows = {x: wants(spark, [(0, "requires", x)]).head() for x in asked}
    deps = spark.createDataFrame([tuple(r)[2:] for r in rows.values()], "name string, op string, epoch int, version string, release string")
    got = {(r["name"], r["op"], r["epoch"], r["version"]): (r["outcome"], r["pkg_id"]) for r in resolve.lookup(deps, resolve.providers(p, c, f)).collect()}
    assert {x: got.get(tuple(rows[x])[2:6]) for x in asked} == asked


@pytest.mark.parametrize("together", [1, 2, 100])
def test_conflict_counts_in_blocks(spark, desk, together):
    """The counts of conflicts by values equal those by pairs: with names that many provide, one that a package itself provides, blocks of packages with the same Conflicts, and none."""
    p, c, _ = desk
    more = [(i, "conflicts", x) for i in (11, 12, 13, 41) for x in ("tip", "nib EQ 1", "wax")] + [(32, "conflicts", "tip"), (32, "provides", "tip EQ 4"), (21, "conflicts", "inkwell EQ 5"), (99, "provides", "tip")]
    c = c.unionByName(wants(spark, [*more, *more[:4]]))
    want = {}
    for r in resolve.conflicts(c, resolve.providers(p, c)).collect():
        want.setdefault(r["pkg_id"], []).append(r)
    got = {r["pkg_id"]: (r["victims"], r["via"]) for r in resolve.conflict_counts(c, resolve.provides(p, c), together).collect()}
    assert got == {i: (len({r["victim"] for r in rows}), min(r["via"] for r in rows)) for i, rows in want.items()} and got[13] == (2, "nib") and got[32] == (1, "tip")


def test_closure_and_conflicts(spark, desk):
    p, c, _ = desk
    provided = resolve.providers(p, c)
    found = resolve.lookup(c.where("kind = 'requires'"), provided)
    closed = resolve.closure(p.where("pkg_id = 11"), resolve.edges(c, found))
    assert {tuple(r) for r in closed.collect()} == {(11, 0), (22, 1), (31, 2), (42, 3)}
    pairs = resolve.conflicts(c, provided)
    assert {tuple(r) for r in pairs.collect()} == {(41, 11, "quill"), (41, 12, "quill"), (42, 31, "tip"), (42, 32, "tip"), (31, 32, "nib")}
    assert [(r["pkg_id"], r["victim"], r["via"]) for r in resolve.conflicts_within(closed, pairs).collect()] == [(42, 31, "tip")]
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "pkg_id long, needs long")
    assert resolve.closure(spark.createDataFrame([(1,)], "pkg_id long"), loop).count() == 3


def test_compatible_compare(spark):
    rows = [("set:a", "", "set:b", "", 0), ("1", "2", "1", "", 0), ("1", "2", "1", "3", -1), ("2", "", "1", "9", 1)]
    t = spark.createDataFrame(rows, "v string, r string, w string, s string, want int")
    z = F.lit(0)
    assert all(r["got"] == r["want"] for r in t.select("want", evr.compatible_compare((z, F.col("v"), F.col("r")), (z, F.col("w"), F.col("s"))).alias("got")).collect())


def test_upgrades_and_owners(spark, desk):
    p, _, f = desk
    new = spark.createDataFrame([("quill", 1, "0.9", "3"), ("quill", 0, "9", "1"), ("inkwell", 0, "5", "9"), ("blotter", 0, "3^g1", "1"), ("wax", 0, "1", "1")], "name string, epoch int, version string, release string")
    got = {(r["name"], r["epoch"]): r["verdict"] for r in resolve.upgrades(new, p.where("repo_id = 'edge'")).collect()}
    assert got == {("quill", 1): "same", ("quill", 0): "epoch_dropped", ("inkwell", 0): "regress", ("blotter", 0): "upgrade", ("wax", 0): "new"}
    assert {tuple(r) for r in repo.first_owner(f, p).select("path", "pkg_id").collect()} == {("/opt/desk/pen", 32), ("/opt/desk/cap", 11)}
    assert [tuple(r) for r in repo.shared_paths(f, p).collect()] == [("/opt/desk/pen", "blotter", "nib", 2)]


def test_boolean_algebra(spark):
    cases = [([[1], [-1]], 1), ([[1, 2], [-1], [-2]], 2), ([[1, 2], [-1]], 2), ([[]], 0), ([[1, -2, 3], [2], [-1], [-3]], 3)]
    for cubes, atoms in cases:
        truth = all(any(all((a >> abs(x) - 1 & 1) == (x > 0) for x in c) for c in cubes) for a in range(1 << atoms))
        t = spark.createDataFrame([(cubes,)], "c array<array<int>>")
        assert t.select(conditions.tautology(F.col("c"), atoms).alias("t")).head()["t"] == truth
    t = spark.createDataFrame([([[1], [1, 2], [-2, 3], [3, -2, 4]],)], "c array<array<int>>")
    assert t.select(conditions.drop_subsumed(F.col("c")).alias("d")).head()["d"] == [[1], [-2, 3]]
    t = spark.createDataFrame([([1, 2, -1],), ([1, 2],)], "c array<int>")
    assert [r["x"] for r in t.select(conditions.contradicts(F.col("c")).alias("x")).collect()] == [True, False]


def test_branch_selection(spark):
    rows = [(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, None), (2, 2, True), (3, 1, False), (3, 2, None)]
    b = spark.createDataFrame(rows, "chain int, branch int, truth boolean")
    strict = {(r["chain"], r["branch"]) for r in conditions.select_branches(b, ["chain"]).where("selected").collect()}
    loose = {(r["chain"], r["branch"]) for r in conditions.select_branches(b, ["chain"], skip_unknown=False).where("selected").collect()}
    assert strict == {(1, 2)} and loose == {(1, 2), (2, 1), (2, 2), (3, 2)}
    x = spark.createDataFrame([(True, None)], "a boolean, b boolean").select(conditions.both_known(F.col("a"), F.col("b"), F.col("a") | F.col("b")).alias("x"))
    assert x.head()["x"] is None


def test_layers(spark):
    rows = [("a", 1, "replace", "x"), ("a", 2, "extend", "y"), ("a", 3, "replace", "z"), ("a", 4, "extend", "w"), ("b", 1, "extend", "q"), ("c", 2, "replace", None)]
    t = spark.createDataFrame(rows, "list string, layer_no int, mode string, item string")
    assert {tuple(r) for r in layers.merge_lists(t, ["list"]).collect()} == {("a", "z"), ("a", "w"), ("b", "q")}
    s = spark.createDataFrame([("warn", None, None), ("warn", "allow", None), ("deny", "allow", "warn")], "d string, c string, k string")
    pick = lambda w: [r["s"] for r in s.select(layers.severity(F.col("d"), F.col("c"), F.col("k"), w).alias("s")).collect()]
    assert pick(False) == ["warn", "allow", "warn"] and pick(True) == ["deny", "allow", "deny"]
    m = spark.createDataFrame([("p", "fedora", "40"), ("p", "rhel", "9"), ("q", "altlinux", None), ("q", "fedora", "1")], "profile_id string, name string, value string")
    assert {tuple(r) for r in layers.identity(m).collect()} == {("p", "rhel"), ("q", "fedora")}


def test_multisets_and_snapshots(spark):
    a, b = (spark.createDataFrame([(1, x) for x in s], "g int, i string") for s in ("aab", "abbc"))
    assert tuple(matrix.multiset_changes(a, b, ["g"], "i").head()) == (1, 2, 1, 2)
    s = spark.createDataFrame([("r", f"v{i}", i, i == 1) for i in range(5)], "repo_id string, revision string, taken int, is_current boolean")
    assert {r["revision"] for r in matrix.snapshots_to_drop(s, 2).collect()} == {"v0", "v2"}


PRIMARY = """<?xml version="1.0"?>
<metadata xmlns="http://linux.duke.edu/metadata/common" xmlns:rpm="http://linux.duke.edu/metadata/rpm" packages="2">
<package type="rpm"><name>tool</name><arch>x86_64</arch><version epoch="1" ver="2.30" rel="4"/><checksum type="sha256" pkgid="YES">AB01</checksum><summary>T</summary>
<size package="1" installed="77"/><location href="t.rpm"/><format><rpm:sourcerpm>tool-2.30-4.src.rpm</rpm:sourcerpm>
<rpm:provides><rpm:entry name="tool" flags="EQ" epoch="1" ver="2.30" rel="4"/></rpm:provides>
<rpm:requires><rpm:entry name="lib" flags="GE" ver="4.12"/><rpm:entry name="sh"/></rpm:requires><file>/usr/bin/tool</file></format></package>
<package type="rpm"><name>lib</name><arch>noarch</arch><version epoch="0" ver="3" rel="1"/><checksum type="sha256">cd02</checksum><format/></package>
</metadata>"""


def test_package_metadata(spark, tmp_path):
    (tmp_path / "primary.xml").write_text(PRIMARY)
    p = metadata.read_primary(spark, str(tmp_path / "primary.xml"), "r0")
    rows = {r["name"]: r for r in p.collect()}
    assert (rows["tool"]["pkg_id"], rows["tool"]["epoch"], rows["tool"]["version"], rows["tool"]["size_installed"], rows["tool"]["files"]) == ("ab01", 1, "2.30", 77, ["/usr/bin/tool"])
    caps = {tuple(r)[2:] for r in metadata.capabilities(p).collect()}
    assert caps == {("provides", 0, "tool", "EQ", 1, "2.30", "4"), ("requires", 0, "lib", "GE", 0, "4.12", ""), ("requires", 1, "sh", "NONE", None, None, None)}
    (tmp_path / "filelists.xml").write_text('<filelists><package pkgid="AB01" name="tool" arch="x"><version ver="1"/><file>/a</file><file type="dir">/b</file></package></filelists>')
    (tmp_path / "repomd.xml").write_text('<repomd><data type="primary"><checksum type="sha256">99</checksum><location href="x/primary.xml.gz"/></data></repomd>')
    assert [tuple(r) for r in metadata.read_repomd(spark, str(tmp_path / "repomd.xml")).collect()] == [("primary", "x/primary.xml.gz", "99")]
    path = str(tmp_path / "snap")
    metadata.write_snapshot(metadata.capabilities(p), path, "v1")
    metadata.write_snapshot(metadata.capabilities(p).limit(1), path, "v2")
    current = spark.createDataFrame([("r0", "v2")], "repo_id string, revision string")
    assert metadata.current_snapshot(spark, path, current).count() == 1


def test_text_metadata(spark, tmp_path):
    (tmp_path / "release").write_text("Archive: base\nLabel: Tiny\nMD5Sum:\n d41d8cd98f00b204e9800998ecf8427e 12 base/pkglist\n")
    head, sums = metadata.read_release(spark, str(tmp_path / "release"))
    assert {(r["key"], r["value"]) for r in head.collect()} == {("Archive", "base"), ("Label", "Tiny")}
    assert tuple(sums.drop("file").head()) == ("MD5Sum", "d41d8cd98f00b204e9800998ecf8427e", 12, "base/pkglist")
    (tmp_path / "contents").write_text("/usr/bin/a\tpkg-a\nbroken\n/b\tpkg-b\n")
    assert {tuple(r) for r in metadata.read_contents(spark, str(tmp_path / "contents")).collect()} == {("/usr/bin/a", "pkg-a"), ("/b", "pkg-b")}
    (tmp_path / "p1.dump").write_text("intro\n-14: _bindir\t/usr/bin\n-13: twice(x:)\tone %{_bindir}\ntwo\n-12: _bindir\t/bin\n")
    rows = {r["name"]: r for r in metadata.read_macro_dump(spark, str(tmp_path / "p1.dump")).collect()}
    assert rows["_bindir"]["value"] == "/bin" and rows["twice"]["opts"] == "(x:)" and rows["twice"]["multiline"] and rows["twice"]["kind"] == "raw" and rows["twice"]["profile_id"] == "p1"
    (tmp_path / "base.json").write_text(json.dumps({"version": 1, "entries": [{"matrix_signature": "0" * 16, "lint_id": "RPM1", "message": "m", "affected_profile_count": 3}]}))
    assert metadata.read_baseline(spark, str(tmp_path / "base.json")).head()["affected_profile_count"] == 3
    (tmp_path / "base2.json").write_text(json.dumps({"version": 2, "entries": []}))
    with pytest.raises(Exception, match="version"):
        metadata.read_baseline(spark, str(tmp_path / "base2.json")).collect()


def test_reports(spark):
    f = spark.createDataFrame([("RPM1", "a", "deny", "s", 3, "x"), ("RPM2", "b", "warn", "s", 1, "y")], "lint_id string, lint_name string, severity string, spec_id string, line_no int, detail string")
    one = json.loads(metadata.findings_json(f).head()["json"])
    assert one["path"] == "s" and [d["lint_id"] for d in one["diagnostics"]] == ["RPM2", "RPM1"]
    run = json.loads(metadata.findings_sarif(f).head()["json"])["runs"][0]
    assert [r["level"] for r in run["results"]] == ["warning", "error"]


def test_macro_expansion(spark):
    m = spark.createDataFrame(
        [("p", "a", "literal", "A"), ("p", "b", "raw", "<%{a}%a>"), ("p", "loop", "raw", "%loop"), ("p", "shell", "raw", "%(date)"), ("q", "a", "literal", "Q")],
        "profile_id string, name string, kind string, value string",
    )
    texts = [(1, "p", "x %{b} 100%% %a"), (2, "p", "%{?a}"), (3, "p", "%nope"), (4, "p", "%loop"), (5, "p", "%shell"), (6, "q", "%{a}%a"), (7, "p", "plain"), (8, "p", "%{a:1}")]
    got = {r["key"]: r["value"] for r in macros.expand(spark.createDataFrame(texts, "key int, profile_id string, body string"), m).collect()}
    assert got == {1: "x <AA> 100% A", 2: None, 3: None, 4: None, 5: None, 6: "QQ", 7: "plain", 8: None}


def test_queries_match_their_sql(spark):
    """Every query with SQL, over the smallest tables."""
    import __spark_entry__

    from pathlib import Path

    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in d.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    text = lambda x: "None" if x is None or x != x else (str(int(x)) if isinstance(x, float) and x == int(x) else str(x))
    for name, sql in __spark_entry__.oracle_sql().items():
        if name.startswith("op"):
            continue
        df = __spark_entry__.queries()[name](spark, str(d))
        rel = con.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns), name
        cols = sorted(df.columns)
        mine = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
        place = [rel.columns.index(c) for c in cols]
        theirs = sorted(tuple(text(r[i]) for i in place) for r in rel.fetchall())
        assert mine == theirs, name
    assert __spark_entry__.entry(spark).count() > 0


#: name -> roots (ids), packages ('name=version' by id, from 1), capabilities, file owners, requirements, and what is expected: pins by id with their paths, unmet (dependency, reason, blocker).
SOLVED = {
    "walk": ([1], "abc", [(1, "requires", "b"), (2, "requires", "c GE 1"), (3, "requires", "a"), (2, "requires", "b")], [], [], {1: "a", 2: "a/b", 3: "a/b/c"}, set()),
    "lacks": ([1], "abc", [(1, "requires", "absent"), (1, "requires", "b GE 2"), (1, "requires", "(x or y)")], [], [], {1: "a"}, {("absent", "no_provider", None), ("b", "no_provider", None)}),
    "asked": (
        [], "abcd", [(2, "requires", "d"), (3, "requires", "gone")], [], ["b", "c", "b GE 0", "(p and q)", "lost"], {2: "b", 3: "c", 4: "b/d"},
        {("gone", "no_provider", None), ("lost", "no_provider", None)},
    ),
    "one a name": (
        [1], ["a", "b=1", "b=2", "c"], [(1, "requires", "b"), (1, "requires", "c"), (4, "requires", "b EQ 1"), (4, "requires", "b GE 1")], [], [], {1: "a", 3: "a/b", 4: "a/c"}, {("b", "other_version", 3)},
    ),
    "one a name at once": ([1], ["a", "b=1", "b=2"], [(1, "requires", "b LE 1"), (1, "requires", "b GE 2")], [], [], {1: "a", 3: "a/b"}, {("b", "other_version", 3)}),
    # b falls to a, so it keeps nothing out: c comes in, and d falls to c.
    "chain": (
        [1], "abcde", [*((1, "requires", x) for x in "bcde"), (2, "conflicts", "c"), (3, "conflicts", "d"), (4, "conflicts", "e"), (1, "conflicts", "b")], [], [],
        {1: "a", 3: "a/c", 5: "a/e"}, {("b", "conflict", 1), ("d", "conflict", 3)},
    ),
    "chain within": (
        [1], "abcde", [*((1, "requires", x) for x in "bcde"), (2, "conflicts", "c"), (3, "conflicts", "d"), (4, "conflicts", "e")], [], [],
        {1: "a", 2: "a/b", 4: "a/d"}, {("c", "conflict", 2), ("e", "conflict", 4)},
    ),
    "later": (
        [1], "abcd", [(1, "requires", "b"), (2, "requires", "c"), (1, "conflicts", "c LT 2"), (1, "conflicts", "d GE 2"), (2, "requires", "d")], [], [], {1: "a", 2: "a/b", 4: "a/b/d"}, {("c", "conflict", 1)},
    ),
    "both say so": ([], "xy", [(1, "conflicts", "y"), (2, "conflicts", "x")], [], ["x", "y"], {1: "x"}, {("y", "conflict", 1)}),
    # Two owners of a path exclude each other; whichever is pinned, the path needs no other.
    "first owner": (
        [], "abcd", [(2, "conflicts", "c"), (3, "conflicts", "b"), (1, "requires", "/x"), (4, "requires", "/x")], [(2, "/x"), (3, "/x")], ["b", "a", "d"], {1: "a", 2: "b", 4: "d"}, set(),
    ),
    "other owner": (
        [], "abcd", [(2, "conflicts", "c"), (3, "conflicts", "b"), (1, "requires", "/x"), (4, "requires", "/x")], [(2, "/x"), (3, "/x")], ["c", "a", "d"], {1: "a", 3: "c", 4: "d"}, set(),
    ),
    "owner first": ([1], "abc", [(1, "requires", "/x"), (2, "requires", "c"), (3, "conflicts", "b")], [(2, "/x"), (3, "/x")], [], {1: "a", 2: "a/b"}, {("c", "conflict", 2)}),
}


@pytest.fixture(scope="module")
def solved(spark):
    """Every scenario's pins and unmet dependencies, from one solution: names and paths of a scenario are its own."""
    p, c, f, roots, asked = [], [], [], [], []
    for k, (root, packages, given, files, wanted, _, _) in enumerate(SOLVED.values()):
        own = lambda x, k=k: f"({x[1:]}" if x[0] == "(" else f"/{k}{x}" if x[0] == "/" else f"{k}.{x}"
        for i, x in enumerate(packages, 1):
            name, version = [*x.split("="), "1"][:2]
            p.append((100 * k + i, "main", own(name), f"0:{version}-1"))
        c += [(100 * k + i, kind, own(x)) for i, kind, x in given]
        f += [(100 * k + i, own(x)) for i, x in files]
        roots += [(100 * k + i,) for i in root]
        asked += [(0, "requires", own(x)) for x in wanted]
    p, c, f = published(spark, p), wants(spark, c), spark.createDataFrame(f, "pkg_id long, path string")
    pins, unmet = solver.solve(spark.createDataFrame(roots, "pkg_id long"), p, c, resolve.providers(p, c, f), f, wants(spark, asked).select(*resolve.DEP))
    out = [({}, set()) for _ in SOLVED]
    bare = lambda x: x.partition("." if "." in x else "/")[2]
    for r in pins.collect():
        out[r["pkg_id"] // 100][0][r["pkg_id"] % 100] = "/".join(map(bare, r["path"]))
    for r in unmet.collect():
        out[int(re.match(r"/?(\d+)", r["name"])[1])][1].add((bare(r["name"]), r["reason"], r["blocker"] and r["blocker"] % 100))
    return dict(zip(SOLVED, out, strict=True))


@pytest.mark.parametrize("name", SOLVED)
def test_solver(solved, name):
    assert solved[name] == SOLVED[name][-2:]


def test_solver_of_nothing(spark, desk):
    p, c, f = desk
    pins, unmet = solver.solve(p.where("false"), p, c, resolve.providers(p, c, f), f)
    assert pins.count() == 0 and unmet.count() == 0


def test_independent_sets_against_one_by_one(spark):
    rng = random.Random(5)
    for n, links in ((40, 60), (30, 200), (25, 0)):
        rows = [(i, f"n{rng.randrange(n * 2 // 3)}", rng.randrange(10**6) * 100 + i) for i in range(n)]
        pairs = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(links)) if a != b}
        pairs |= {(b, a) for a, b in pairs}
        kept, names = set(), set()
        for i, name, _ in sorted(rows, key=lambda r: r[2]):
            if name not in names and not any((i, k) in pairs for k in kept):
                kept.add(i)
                names.add(name)
        w = spark.createDataFrame(rows, "pkg_id long, name string, place long")
        assert {r["pkg_id"] for r in solver.independent(w, spark.createDataFrame(sorted(pairs) or [(-1, -2)], "pkg_id long, blocker long")).collect()} == kept


def test_solver_reports(spark):
    rows = [("x", "NONE", None, None, None, 1, ["a", "b"], "no_provider", None), ("x", "NONE", None, None, None, 2, ["a"], "no_provider", None), ("y", "NONE", None, None, None, 2, ["a"], "conflict", 1)]
    u = spark.createDataFrame(rows, "name string, op string, epoch int, version string, release string, parent long, path array<string>, reason string, blocker long")
    pins = spark.createDataFrame([(1, "b", 2, 1, ["a", "b"]), (2, "a", None, 0, ["a"])], "pkg_id long, name string, parent long, depth int, path array<string>")
    assert {(r["name"], r["parents"], *r["path"]) for r in solver.unmet_core(u).collect()} == {("x", 2, "a"), ("y", 1, "a")}
    assert [tuple(r) for r in solver.chains(pins, u).collect()] == [("y", "conflict", ["a"], 1, ["a", "b"])]
    p = published(spark, [(1, "main", "b", "0:1-1"), (2, "main", "a", "0:1-1"), (2, "main", "a", "0:1-1"), (3, "main", "c", "0:1-1")])
    assert tuple(solver.summary(pins, u, p).head()) == (2, 14, 2, False)
    rich = wants(spark, [(1, "requires", "(p or q)"), (3, "requires", "(z or q)"), (0, "requires", "(s if t)")])
    assert {r["name"] for r in solver.skipped(pins, rich, rich.where("pkg_id = 0")).collect()} == {"(p or q)", "(s if t)"}


def test_caps_by_kind_without_a_kind(spark):
    """A package without a kind has none of it, whether it has others or not."""
    p = spark.createDataFrame([(1, "bowl"), (2, "jug"), (3, "cup")], "pkg_id long, name string")
    c = spark.createDataFrame([(1, "requires", "water", "NONE", None), (1, "requires", "clay", "GE", "2"), (2, "provides", "jar", "NONE", None), (2, "conflicts", "bowl", "NONE", None)], "pkg_id long, kind string, name string, op string, version string")
    got = sorted((r["pkg_id"], r["provides"], r["requires"], r["conflicts"]) for r in repo.caps_by_kind(p, c).collect())
    assert got == [(1, None, "clay GE 2,water NONE -", None), (2, "jar NONE -", None, "bowl NONE -"), (3, None, None, None)]


def test_first_owner_never_sorts_files(spark):
    """Repeated files, a null repository and equal paths of several repositories; what is sorted is only what the minima leave."""
    p = spark.createDataFrame([(7, "b", "i686"), (9, "a", "noarch"), (8, "a", "x86_64"), (3, None, "i686"), (1, "b", "i686")], "pkg_id long, repo_id string, arch string")
    f = spark.createDataFrame([(7, "/x"), (9, "/x"), (8, "/x"), (9, "/x"), (1, "/x"), (3, "/y"), (1, "/y"), (5, "/z")], "pkg_id long, path string")
    owners = repo.first_owner(f, p)
    assert sorted(tuple(r) for r in owners.collect()) == [("/x", "a", 8, "x86_64"), ("/y", None, 3, "i686")]
    plan = owners._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_shared_paths_counts_by_name_first(spark):
    """Owners of one name are counted before paths meet; repeated files count once, and files are hashed, not sorted, for their packages."""
    p = spark.createDataFrame([(1, "jug"), (2, "jug"), (3, "cup"), (4, None)], "pkg_id long, name string")
    f = spark.createDataFrame([(1, "/x"), (2, "/x"), (2, "/x"), (3, "/x"), (4, "/x"), (1, "/y"), (2, "/y"), (4, "/z")], "pkg_id long, path string")
    shared = repo.shared_paths(f, p)
    assert [tuple(r) for r in shared.collect()] == [("/x", "cup", "jug", 4)]
    assert "ShuffledHashJoin" in shared._jdf.queryExecution().sparkPlan().toString()


def test_solver_compares_each_version_once(spark, monkeypatch):
    """40 packages provide one capability in two versions: two offers are compared, not 40, the first package by place is pinned, and conflicts meet by number."""
    seen, stored = {}, solver.stored
    monkeypatch.setattr(solver, "stored", lambda df, label: seen.setdefault(label, []).append(out := stored(df, label)) or out)
    p = spark.createDataFrame([(i, "r", f"p{i}", 0, "1", "1") for i in range(40)] + [(99, "r", "top", 0, "1", "1")], "pkg_id long, repo_id string, name string, epoch int, version string, release string")
    rows = [(i, "provides", "x", "EQ", 0, str(i % 2), "") for i in range(40)] + [(99, "requires", "x", "GE", 0, "1", ""), (99, "requires", "/f", "NONE", None, None, None), (1, "conflicts", "p7", "NONE", None, None, None)]
    c = spark.createDataFrame(rows * 2, "pkg_id long, kind string, name string, op string, epoch int, version string, release string")
    f = spark.createDataFrame([(1, "/f"), (5, "/f"), (5, "/f")], "pkg_id long, path string")
    asked = c.where("pkg_id = 99 and kind = 'requires'").select(*resolve.DEP)
    pins, unmet = solver.solve(spark.createDataFrame([(99,)], "pkg_id long"), p, c, resolve.providers(p, c, f), f, asked)
    assert {(r["pkg_id"], r["parent"], r["depth"], *r["path"]) for r in pins.collect()} == {(99, None, 0, "top"), (1, None, 1, "p1")} and unmet.count() == 0
    assert seen["solve-offers"][0].where("name = 'x'").count() == 2 and [tuple(r) for r in seen["solve-conflict-rows"][0].select("pkg_id").collect()] == [(1,)]


def test_edges_hash_dependencies(spark):
    """What packages require isn't sorted by its five columns; dependencies without a version and repeated rows meet their providers once."""
    none = (None, None, None)
    c = spark.createDataFrame([(1, "requires", "a", "NONE", *none), (2, "requires", "a", "NONE", *none), (2, "requires", "b", "GE", 0, "1", "")] * 2 + [(3, "provides", "a", "NONE", *none)],
                              "pkg_id long, kind string, name string, op string, epoch int, version string, release string")
    found = spark.createDataFrame([("a", "NONE", *none, "satisfied", 7), ("b", "GE", 0, "1", "", "version_unsatisfied", 8)], "name string, op string, epoch int, version string, release string, outcome string, pkg_id long")
    e = resolve.edges(c, found)
    assert {tuple(r) for r in e.collect()} == {(1, 7), (2, 7)} and e.count() == 2
    assert "ShuffledHashJoin" in e._jdf.queryExecution().executedPlan().toString()


def test_package_order_is_dealt(spark, monkeypatch):
    """Packages that one task reads get their keys in several, which the sort by ranges reads back; places keep the order, and repeated provides stay one offer."""
    seen, stored = {}, resolve.stored
    monkeypatch.setattr(resolve, "stored", lambda df, label: seen.setdefault(label, []).append(out := stored(df, label)) or out)
    rows = [(i, f"r{i % 2}", f"p{i % 5}", i % 3, f"{i % 4}.{i % 7}" + "~rc1" * (i % 6 == 0), str(i % 11)) for i in range(200)]
    p = spark.createDataFrame(rows, "pkg_id long, repo_id string, name string, epoch int, version string, release string").coalesce(1)
    order = [r["pkg_id"] for r in resolve.package_order(p).orderBy("place").collect()]
    key = lambda v: [(4, int(t)) if t.isdigit() else (0 if t == "~" else 3, t) for t in re.findall(r"~|[0-9]+|[a-z]+", v)] + [(1,)]
    want = sorted(rows, key=lambda r: (r[2], r[0]))
    for k in (lambda r: key(r[5]), lambda r: key(r[4]), lambda r: r[3]):
        want.sort(key=k, reverse=True)  # stable: equal ones are turned round neither
    want.sort(key=lambda r: r[1])
    assert order == [r[0] for r in want]
    assert len(seen["package-keys"][0].inputFiles()) > 1


def test_lookup_goes_through_provides_once(spark, desk, tmp_path):
    """Provides are read once for a lookup, repeated ones included, and the best provider of each dependency comes out of the minima with its place."""
    p, c, f = desk
    resolve.providers(p, c.unionByName(c), f).write.parquet(str(tmp_path / "provided"))
    provided = spark.read.parquet(str(tmp_path / "provided"))
    found = resolve.lookup(wants(spark, [(0, "requires", x) for x in ("quill", "quill LT 3", "quill LT 1", "tip GE 0", "/opt/desk/pen", "wax")] * 2), provided)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    got = {(r["name"], r["op"], r["version"]): (r["outcome"], r["pkg_id"]) for r in found.collect()}
    assert found.count() == 6 and got == {
        ("quill", "NONE", None): ("satisfied", 11), ("quill", "LT", "3"): ("satisfied", 12), ("quill", "LT", "1"): ("version_unsatisfied", 11),
        ("tip", "GE", "0"): ("version_unsatisfied", 32), ("/opt/desk/pen", "NONE", None): ("satisfied", 32), ("wax", "NONE", None): ("no_provider", None),
    }


def test_constraints_by_sign(spark):
    """Each operator against each sign; a null sign meets only NONE, and an operator that isn't known or is null meets nothing."""
    meets = {"NONE": (-1, 0, 1, None), "EQ": (0,), "LT": (-1,), "LE": (-1, 0), "GT": (1,), "GE": (0, 1), "NE": (), None: ()}
    t = spark.createDataFrame([(op, sign) for op in meets for sign in (-1, 0, 1, None)], "op string, sign int")
    holds = evr.constraint_holds(F.col("op"), F.col("sign"))
    assert all(r["holds"] == (r["sign"] in meets[r["op"]]) for r in t.select("op", "sign", holds.alias("holds")).collect())
    assert holds._jc.toString().count("sign") == 1


def test_closure_of_repeated_edges(spark):
    """What a closure goes over may have rows twice, as needs has; each package comes out once, at its least distance."""
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (5, 6), (3, 4)] * 3, "pkg_id long, needs long")
    assert sorted(tuple(r) for r in resolve.closure(spark.createDataFrame([(1,), (1,)], "pkg_id long"), e).collect()) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    none = (None, None, None)
    c = spark.createDataFrame([(1, "requires", "a", "NONE", *none)] * 2, CAPS)
    found = spark.createDataFrame([("a", "NONE", *none, "satisfied", 7)], "name string, op string, epoch int, version string, release string, outcome string, pkg_id long")
    assert [tuple(r) for r in resolve.needs(c, found).collect()] == [(1, 7)] * 2
