"""Target sets, macro lookups, fixes and repository findings of recipes."""

from specgrain.operators import fixes, profiles, resolve
from specgrain.operators.recipe_rules import lint
from specgrain.sources.recipes import parse

BROKEN = """Name: hello
Version: 1
Release: 1%{?dist}
Summary: Greeter.
Copyright: MIT
Provides: hello
BuildRequires: cmake >= 3.28, gcc

%prep
%setup -n %{name}-%{version}  

%build
\tegrep x y | fgrep z
%if !!0%{?a}
ls $RPM_BUILD_ROOT/${RPM_SOURCE_DIR}
%endif

%install
%makeinstall
cp a %{_prefix}/bin

%files
%defattr(-,root,root,-)
"""


def test_fixes_settle(spark):
    s = spark.createDataFrame([("a", BROKEN), ("clean", "Name: x\n"), ("none", None)], "spec_id string, text string")
    out = {r["spec_id"]: r for r in fixes.fix(s).collect()}
    text = out["a"]["text"]
    assert out["a"]["changed"] and not out["clean"]["changed"] and out["clean"]["text"] == "Name: x\n" and out["none"]["text"] is None
    for part in ("Summary: Greeter\n", "%setup -q\n", "grep -E x y | grep -F z", "%if 0%{?a}", "ls %{buildroot}/%{_sourcedir}", "%make_install", "cp a %{_bindir}"):
        assert part in text, part
    assert "Copyright" not in text and "Provides" not in text and "defattr" not in text and "\t" not in text
    left = lint(parse(spark.createDataFrame([("a", text)], "spec_id string, text string")), [*fixes.REWRITES, *fixes.DROPS])
    assert left.count() == 0
    one = fixes.fix_once(s, ["RPM055"]).where("spec_id = 'a'").head()["text"]
    assert "Summary: Greeter\n" in one and "Copyright" in one and "egrep" in one


def test_profiles(spark):
    t = spark.createDataFrame([("all", "b", 0), ("all", "a", 1), ("all", "b", 2), ("all", "c", 5)], "target string, profile_id string, ord int")
    assert [tuple(r) for r in profiles.target_members(t).orderBy("ord").collect()] == [("all", "b", 0), ("all", "a", 1), ("all", "c", 2)]
    m = spark.createDataFrame(
        [("a", "x", "literal", "1", "dump"), ("b", "x", "raw", "%{y}!", "dump"), ("b", "y", "literal", "Y", "override"), ("c", "x", "raw", "%(no)", "dump")],
        "profile_id string, name string, kind string, value string, source string",
    )
    p = spark.createDataFrame([(x,) for x in "abcd"], "profile_id string")
    got = {r["profile_id"]: (r["status"], r["value"]) for r in profiles.explain_macro(p, m, "x").collect()}
    assert got == {"a": ("literal", "1"), "b": ("expanded", "Y!"), "c": ("unresolved", "%(no)"), "d": ("undefined", None)}
    assert profiles.macro_table(p, m, "x").where("value is null").count() == 1
    assert profiles.list_macros(m, "Y").count() == 1 and profiles.list_macros(m, None, "dump").count() == 3
    r = parse(spark.createDataFrame([("s", "%global own 1\nName: %{own}%x\n# %nope\nLicense: MIT and GPL-9\n")], "spec_id string, text string"))
    assert {tuple(x) for x in profiles.used_macros(r).collect()} == {("s", "own", True), ("s", "x", False)}
    licenses = spark.createDataFrame([("a", "MIT"), ("b", "GPL-9"), ("b", "MIT")], "profile_id string, name string")
    assert [tuple(x) for x in profiles.license_findings(r, licenses).collect()] == [("s", "a", "GPL-9")]


def test_repository_findings(spark):
    r = parse(spark.createDataFrame([("s", BROKEN + "\n%package x\nRequires: nowhere\nRequires: cmake\n")], "spec_id string, text string"))
    packages = spark.createDataFrame([(1, "r0", "cmake", 0, "3.26", "1", "x86_64")], "pkg_id long, repo_id string, name string, epoch int, version string, release string, arch string")
    caps = spark.createDataFrame([], "pkg_id long, kind string, name string, op string, epoch int, version string, release string")
    got = {(x["lint_id"], x["detail"]) for x in profiles.repository_findings(r, resolve.providers(packages, caps)).collect()}
    assert got == {("RPM-REPO-003", "cmake GE 3.28"), ("RPM-REPO-001", "gcc NONE"), ("RPM-REPO-002", "nowhere NONE")}
    old = spark.createDataFrame([(1, "r0", "hello", 1, "1", "1", "x", "hello"), (2, "r0", "plain", 0, "2", "1", "x", "plain")], "pkg_id long, repo_id string, name string, epoch int, version string, release string, arch string, source_name string")
    spec = "Name: {}\nVersion: 2\nRelease: 1\n%files\n/usr/bin/a\n/usr/bin/b*\n"
    r = parse(spark.createDataFrame([("h", spec.format("hello")), ("p", spec.format("plain")), ("n", spec.format("new"))], "spec_id string, text string"))
    assert {(x["lint_id"], x["spec_id"]) for x in profiles.published_findings(r, old).collect()} == {("RPM-REPO-031", "h"), ("RPM-REPO-030", "p")}
    files = spark.createDataFrame([(2, "/usr/bin/a")], "pkg_id long, path string")
    assert {(x["spec_id"], x["detail"]) for x in profiles.file_findings(r, old, files).collect()} == {("h", "/usr/bin/a plain"), ("n", "/usr/bin/a plain")}
