"""Recipe rules: each is a query over the relations of sources.recipes and gives (spec_id, line_no, detail).

Ids, names, severities and thresholds are fixed values.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions
from ..sources import shell
from ..sources.recipes import BUILD_SECTIONS, DEPENDENCY_TAGS, SCRIPTLETS, Recipes
from . import conditions


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    find: Callable[[Recipes], DataFrame]
    #: The families of distributions that it holds for; all if empty.
    families: tuple[str, ...] = ()
    #: Whether a finding's detail is a macro that the profile must have.
    gated: bool = False


RULES: dict[str, Rule] = {}


def rule(id: str, name: str, severity: str = "warn", families: tuple[str, ...] = (), gated: bool = False):
    def add(f):
        RULES[id] = Rule(id, name, severity, f, families, gated)
        return f

    return add


def at(df: DataFrame, detail: Column | str = "") -> DataFrame:
    d = F.lit(detail) if isinstance(detail, str) else detail
    return df.select("spec_id", F.col("line_no").cast("int").alias("line_no"), d.cast("string").alias("detail"))


def lint(r: Recipes, ids: list[str] | None = None, family: str | None = "fedora", macros: DataFrame | None = None) -> DataFrame:
    """Findings of all rules (or of ids) that hold for a family of distributions: lint_id, lint_name, severity, spec_id, line_no, detail.

    macros (name): those that the profile has; rules that advise a macro do so only if it is among them, or if none are given.
    """
    out = None
    chosen = [i for i in ids or sorted(RULES) if not RULES[i].families or family in RULES[i].families]
    if not chosen:
        raise ValueError("none of the rules holds for this family")
    for i in chosen:
        found = RULES[i].find(r)
        if RULES[i].gated and macros is not None:
            found = found.join(macros.select(F.col("name").alias("detail")).distinct(), "detail", "left_semi")
        found = found.select(F.lit(i).alias("lint_id"), F.lit(RULES[i].name).alias("lint_name"), F.lit(RULES[i].severity).alias("severity"), "spec_id", "line_no", "detail")
        out = found if out is None else out.unionByName(found)
    return out


# Required and repeated parts.


def _without(r: Recipes, found: DataFrame, detail: str) -> DataFrame:
    return at(r.specs.join(found.select("spec_id").distinct(), "spec_id", "left_anti").withColumn("line_no", F.lit(1)), detail)


def _missing_tag(key: str):
    return lambda r: _without(r, r.tags.where((F.col("key") == key) & (F.col("pkg") == "")), key)


def _missing_section(kind: str):
    return lambda r: _without(r, r.sections.where(F.col("kind") == kind), kind)


rule("RPM001", "missing-changelog")(_missing_section("changelog"))
for _id, _key, _severity in (("010", "name", "deny"), ("011", "version", "deny"), ("012", "release", "deny"), ("013", "license", "deny"), ("014", "summary", "deny"), ("015", "url", "warn")):
    rule(f"RPM{_id}", f"missing-{_key}-tag", _severity)(_missing_tag(_key))
for _id, _kind in (("016", "prep"), ("017", "build"), ("018", "install")):
    rule(f"RPM{_id}", f"missing-{_kind}-section")(_missing_section(_kind))


def _again(df: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy("spec_id", *keys).orderBy("line_no")
    return df.withColumn("_n", F.row_number().over(w)).where("_n > 1")


@rule("RPM022", "multiple-changelog-sections", "deny")
def multiple_changelogs(r):
    return at(_again(r.sections.where("kind = 'changelog' and depth = 0"), "kind"))


@rule("RPM023", "duplicate-buildscript-section", "deny")
def duplicate_buildscript(r):
    return at(_again(r.sections.where(F.col("kind").isin(*BUILD_SECTIONS)), "kind"), F.col("kind"))


@rule("RPM021", "deprecated-clean-section")
def clean_section(r):
    return at(r.sections.where("kind = 'clean'"))


@rule("RPM300", "duplicate-singleton-tag")
def duplicate_singleton(r):
    single = ("name", "version", "release", "license", "url", "summary", "epoch", "buildarch", "autoreq", "autoprov", "autoreqprov")
    return at(_again(r.tags.where(F.col("key").isin(*single) & (F.col("depth") == 0)), "pkg", "key"), F.col("tag"))


@rule("RPM301", "subpackage-name-collision", "deny")
def subpackage_collision(r):
    return at(_again(r.sections.where("kind = 'package' and depth = 0"), "pkg"), F.col("pkg"))


@rule("RPM020", "obsolete-tag")
def obsolete_tag(r):
    """Tags that were renamed or dropped."""
    old = ("copyright", "serial", "prereq", "buildprereq", "buildroot", "packager", "vendor")
    return at(r.tags.where(F.col("key").isin(*old)), F.col("tag"))


@rule("RPM123", "package-without-description", "allow")
def without_description(r):
    d = r.sections.where("kind = 'description'").select("spec_id", "pkg").distinct()
    return at(r.sections.where("kind = 'package'").join(d, ["spec_id", "pkg"], "left_anti"), F.col("pkg"))


@rule("RPM124", "package-without-files", "allow")
def without_files(r):
    d = r.sections.where("kind = 'files'").select("spec_id", "pkg").distinct()
    return at(r.sections.where("kind = 'package'").join(d, ["spec_id", "pkg"], "left_anti"), F.col("pkg"))


def _section_body(r: Recipes, kind: str) -> DataFrame:
    """One row a section of that kind: its trimmed body, blank lines at both ends apart."""
    text = r.body.where(F.col("kind") == kind).groupBy("spec_id", "sec").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    joined = F.trim(F.regexp_replace(F.array_join(F.col("l.line"), "\n"), r"^\s+|\s+$", ""))
    heads = r.sections.where(F.col("kind") == kind)
    return heads.join(text.select("spec_id", "sec", joined.alias("text")), ["spec_id", "sec"], "left").withColumn("text", F.coalesce("text", F.lit("")))


@rule("RPM002", "empty-description")
def empty_description(r):
    return at(_section_body(r, "description").where("text = ''"))


@rule("RPM389", "disabled-check-section")
def disabled_check(r):
    did = r.body.where((F.col("kind") == "check") & ~F.col("line").rlike(r"^\s*(#.*|%dnl.*|:|true|exit 0)?\s*$")).select("spec_id", "sec").distinct()
    return at(r.sections.where("kind = 'check'").join(did, ["spec_id", "sec"], "left_anti"))


@rule("RPM554", "subpackage-description-copied-from-main")
def copied_description(r):
    d = _section_body(r, "description").where("text <> ''")
    main = d.where("pkg = ''").select("spec_id", F.col("text").alias("main"))
    return at(d.where("pkg <> ''").join(main, "spec_id").where("text = main"), F.col("pkg"))


@rule("RPM555", "description-equals-summary")
def description_is_summary(r):
    s = r.tags.where("key = 'summary'").select("spec_id", "pkg", F.col("value").alias("summary"))
    return at(_section_body(r, "description").join(s, ["spec_id", "pkg"]).where("text = summary"))


@rule("RPM126", "description-leads-with-this-package", "allow")
def this_package(r):
    return at(_section_body(r, "description").where(F.col("text").rlike(r"(?i)^(this package|the \S+ package)\b")))


@rule("RPM059", "description-shorter-than-summary", "allow")
def short_description(r):
    s = r.tags.where("key = 'summary' and pkg = ''").select("spec_id", F.col("value").alias("summary"))
    d = _section_body(r, "description").where("pkg = '' and text <> ''")
    return at(d.join(s, "spec_id").where(F.length("text") < F.length("summary")))


@rule("RPM573", "canonical-major-section-order", "allow")
def section_order(r):
    order = F.array(*(F.lit(k) for k in ("description", "prep", "build", "install", "check", "files", "changelog")))
    p = r.sections.withColumn("p", F.array_position(order, F.col("kind"))).where("p > 0 and depth = 0")
    w = Window.partitionBy("spec_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return at(p.withColumn("_max", F.max("p").over(w)).where("p < _max"), F.col("kind"))


@rule("RPM305", "source-patch-list-mixing")
def list_mixing(r):
    lists = r.sections.where("kind in ('sourcelist', 'patchlist')").select("spec_id", "line_no", F.regexp_replace("kind", "list", "").alias("key"))
    return at(lists.join(r.tags.where("key in ('source', 'patch')").select("spec_id", "key").distinct(), ["spec_id", "key"]), F.col("key"))


# Tags.


def _summary(r: Recipes) -> DataFrame:
    return r.tags.where("key = 'summary'")


@rule("RPM055", "summary-ends-with-dot")
def summary_dot(r):
    return at(_summary(r).where(F.col("value").endswith(".") & ~F.col("value").endswith("..")))


@rule("RPM056", "summary-not-capitalized")
def summary_case(r):
    return at(_summary(r).where(F.col("value").rlike("^[a-z]")))


@rule("RPM057", "summary-too-long")
def summary_long(r):
    return at(_summary(r).where(F.char_length("value") > 80))


@rule("RPM058", "name-in-summary", "allow")
def summary_name(r):
    name = r.tags.where("key = 'name' and pkg = ''").select("spec_id", F.lower("value").alias("own"))
    s = _summary(r).where("pkg = ''").join(name, "spec_id")
    return at(s.where(F.array_contains(F.split(F.lower("value"), r"[^a-z0-9_+.-]+"), F.col("own"))))


@rule("RPM302", "invalid-name-version-release-epoch-format", "deny")
def nvre(r):
    v, k = F.col("value"), F.col("key")
    plain = F.regexp_replace(v, r"%\{[^}]*\}|%[A-Za-z_]\w*|%\([^)]*\)", "")
    bad = ((k == "name") & plain.rlike(r"[^A-Za-z0-9._+-]")) | (k.isin("version", "release") & plain.rlike(r"[^A-Za-z0-9._+~^]")) | ((k == "epoch") & (v == "0"))
    return at(r.tags.where(bad), F.concat_ws(": ", "tag", "value"))


@rule("RPM106", "conditional-buildarch", "allow")
def conditional_buildarch(r):
    return at(r.tags.where("key = 'buildarch' and depth > 0"))


@rule("RPM107", "conditional-name-tag", "allow")
def conditional_name(r):
    return at(r.tags.where("key = 'name' and depth > 0"))


@rule("RPM125", "source-without-url")
def source_url(r):
    return at(r.tags.where((F.col("key") == "source") & ~F.col("value").rlike(r"^(https?|ftp)://|^%\{(url|source\d*)\}")), F.col("value"))


@rule("RPM304", "source-version-mismatch")
def source_version(r):
    version = r.tags.where("key = 'version' and pkg = ''").select("spec_id", F.col("value").alias("own"))
    found = F.regexp_extract("value", r"[-_/v]([0-9]+(?:\.[0-9]+)+)(?:\.tar|\.zip|\.tgz|/)", 1)
    return at(r.tags.where("key = 'source'").join(version, "spec_id").where((found != "") & (found != F.col("own")) & ~F.col("own").contains("%")), found)


@rule("RPM308", "autoreqprov-disabled-without-comment")
def autoreqprov(r):
    off = r.tags.where(F.col("key").isin("autoreq", "autoprov", "autoreqprov") & F.lower("value").isin("no", "0"))
    beside = r.comments.select("spec_id", F.explode(F.array(F.col("line_no") - 1, F.col("line_no") + 1)).alias("line_no")).distinct()
    return at(off.join(beside, ["spec_id", "line_no"], "left_anti"), F.col("tag"))


@rule("RPM310", "arch-policy-contradiction")
def arch_policy(r):
    t = r.tags.where(F.col("key").isin("buildarch", "exclusivearch", "excludearch"))
    arch = t.select("spec_id", "line_no", "key", F.explode(F.split("value", r"[\s,]+")).alias("arch")).where("arch <> ''")
    noarch = arch.where("key = 'buildarch' and arch = 'noarch'").select("spec_id").distinct()
    with_noarch = arch.where("key <> 'buildarch' and arch <> 'noarch'").join(noarch, "spec_id").select("spec_id", "line_no").distinct()
    excluded = arch.where("key = 'excludearch'").select("spec_id", "arch").distinct()
    both = arch.where("key = 'exclusivearch'").join(excluded, ["spec_id", "arch"]).select("spec_id", "line_no")
    return at(with_noarch.unionByName(both).distinct())


@rule("RPM404", "macro-shell-expansion-in-metadata")
def shell_in_metadata(r):
    keys = ("name", "version", "release", "epoch", "source", "patch", "url")
    return at(r.tags.where(F.col("key").isin(*keys) & F.col("value").rlike(r"%\(|%\{lua:")), F.col("tag"))


@rule("RPM303", "release-disttag-policy", families=("fedora", "rhel"))
def disttag(r):
    v = F.col("value")
    return at(r.tags.where((F.col("key") == "release") & (F.col("pkg") == "") & (v.rlike(r"\.(fc|el)[0-9]+") | ~v.rlike(r"%\{\??dist\}|%\{?autorelease|%\?dist"))), v)


@rule("RPM552", "redundant-subpackage-version-release")
def redundant_version(r):
    main = r.tags.where("pkg = '' and key in ('version', 'release')").select("spec_id", "key", F.col("value").alias("main"))
    own = r.tags.where("pkg <> '' and key in ('version', 'release')").join(main, ["spec_id", "key"])
    return at(own.where(F.col("value").isin("%{version}", "%{release}") | (F.col("value") == F.col("main"))), F.col("tag"))


@rule("RPM553", "repeated-subpackage-boilerplate", "allow")
def boilerplate(r):
    t = r.tags.where("pkg <> '' and key not in ('summary', 'requires', 'provides')")
    sets = t.groupBy("spec_id", "pkg").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "key", "value"))), "\n").alias("set"))
    return at(_again(sets.where("n >= 3"), "set"), F.col("pkg"))


@rule("RPM550", "prefer-relative-subpackage-name")
def relative_name(r):
    name = r.tags.where("key = 'name' and pkg = ''").select("spec_id", F.col("value").alias("own"))
    s = r.sections.where("absolute").join(name, "spec_id")
    return at(s.where(F.col("pkg").startswith("%{name}-") | F.col("pkg").startswith(F.concat("own", F.lit("-")))), F.col("pkg"))


@rule("RPM574", "preamble-tag-clustering", "allow")
def clustering(r):
    k = F.col("key")
    group = F.when(k.isin("name", "version", "release", "epoch", "summary", "license", "url", "group"), 1).when(k.isin("source", "patch"), 2).when(k == "buildrequires", 3).when(k == "requires", 4)
    t = r.tags.where("pkg = '' and depth = 0").withColumn("g", group).where("g is not null")
    w = Window.partitionBy("spec_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return at(t.withColumn("_max", F.max("g").over(w)).where("g < _max"), F.col("tag"))


@rule("RPM498", "long-literal-prefix-macro-candidate", "allow")
def literal_prefix(r):
    t = r.tags.where(F.col("key").isin("source", "patch", "url")).withColumn("prefix", F.regexp_extract("value", r"^([^%]{25,})/", 1)).where("prefix <> ''")
    n = t.groupBy("spec_id", "prefix").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    return at(n.where("n >= 3"), F.col("prefix"))


@rule("RPM477", "long-patch-list-to-patchlist", "allow")
def patchlist(r):
    n = r.tags.where("key = 'patch'").groupBy("spec_id").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    return at(n.where("n >= 5"), F.col("n"))


# Dependencies.


def _own_names(r: Recipes) -> DataFrame:
    name = r.tags.where("key = 'name' and pkg = ''").select("spec_id", F.lit("").alias("pkg"), F.col("value").alias("own"))
    main = name.select("spec_id", F.col("own").alias("main"))
    subs = r.sections.where("kind = 'package'").join(main, "spec_id").select("spec_id", "pkg", F.expr("replace(pkg, '%{name}', main)").alias("own"))
    both = name.unionByName(subs)
    return both.unionByName(both.join(main, "spec_id").select("spec_id", "pkg", F.expr("case when own = main then '%{name}' else replace(own, main, '%{name}') end").alias("own"))).distinct()


def _of_itself(r: Recipes, *keys: str) -> DataFrame:
    return r.atoms.where(F.col("key").isin(*keys)).join(_own_names(r), ["spec_id", "pkg"]).where("name = own").dropDuplicates(["spec_id", "line_no", "atom"])


@rule("RPM033", "self-obsoletion", "deny")
def self_obsoletion(r):
    return at(_of_itself(r, "obsoletes"), F.col("atom"))


@rule("RPM035", "useless-explicit-provides")
def useless_provides(r):
    return at(_of_itself(r, "provides"), F.col("atom"))


@rule("RPM040", "self-conflict", "deny")
def self_conflict(r):
    return at(_of_itself(r, "conflicts"), F.col("atom"))


_WEAK = ("recommends", "suggests", "supplements", "enhances")


@rule("RPM322", "self-weak-dependency")
def self_weak(r):
    return at(_of_itself(r, *_WEAK), F.col("atom"))


@rule("RPM031", "requires-equal-version")
def equal_version(r):
    a = r.atoms.where((F.col("key").isin("requires", "buildrequires")) & (F.col("op") == "=") & F.col("evr").contains("-"))
    return at(a.where(~F.col("name").contains("%{name}")), F.col("atom"))


@rule("RPM034", "obsolete-without-provides")
def without_provides(r):
    p = r.atoms.where("key = 'provides'").select("spec_id", "pkg", "name").distinct()
    return at(r.atoms.where("key = 'obsoletes' and op is null").join(p, ["spec_id", "pkg", "name"], "left_anti"), F.col("atom"))


@rule("RPM320", "duplicate-dependency-atom")
def duplicate_atom(r):
    """One name (with its qualifier in parentheses) twice in a tag's value, whatever the versions."""
    n = r.atoms.where("not rich and name not like '%\\%%'").groupBy("spec_id", "line_no", "key", "name").agg(F.count("*").alias("n"))
    return at(n.where("n > 1"), F.col("name"))


@rule("RPM321", "weak-dep-duplicates-strong-dep")
def weak_duplicates(r):
    strong = r.atoms.where("key = 'requires'").select("spec_id", "pkg", "name").distinct()
    return at(r.atoms.where(F.col("key").isin(*_WEAK)).join(strong, ["spec_id", "pkg", "name"], "left_semi"), F.col("atom"))


@rule("RPM323", "runtime-requires-looks-like-build-requires")
def build_like(r):
    """Tools that only builds need, endings of packages for development, and names of compilers and build systems, whose own packages may need such tools."""
    tools = ("gcc", "g++", "clang", "make", "cmake", "meson", "ninja", "autoconf", "automake", "libtool", "rustc", "cargo")
    endings = ("-devel", "-static", "-headers", "-dev")
    chains = ("gcc", "clang", "llvm", "rustc", "rust", "mingw", "cross-gcc", "automake", "autoconf", "cmake", "meson", "ninja-build", "make", "cargo", "golang", "nodejs", "python3", "ruby", "perl")
    named = r.tags.where("key = 'name' and pkg = ''").groupBy("spec_id").agg(F.lower(F.first("value")).alias("main"))
    a = r.atoms.where("key = 'requires' and not rich").join(named, "spec_id", "left").withColumn("main", F.coalesce("main", F.lit("")))
    owner, n = F.lower(F.when(F.col("pkg") == "", F.col("main")).otherwise(F.col("pkg"))), F.col("name")
    devel = functools.reduce(lambda x, e: x | owner.endswith(e), endings, F.lit(False))
    chain = functools.reduce(lambda x, c: x | (F.col("main") == c) | F.col("main").startswith(f"{c}-") | F.col("main").contains(f"-{c}"), chains, F.lit(False))
    return at(a.where(~devel & ~chain & (n.isin(*tools) | n.endswith("-devel") | n.startswith("pkgconfig("))), n)


@rule("RPM327", "contradictory-dependency-qualifiers", "deny")
def qualifiers(r):
    q = F.split(F.lower("qualifiers"), r"\s*,\s*")
    return at(r.tags.where(F.array_contains(q, "meta") & F.arrays_overlap(q, F.array(*(F.lit(x) for x in ("pre", "post", "preun", "postun", "pretrans", "posttrans"))))), F.col("qualifiers"))


@rule("RPM450", "guarded-item-already-unconditional")
def guarded_again(r):
    free = r.atoms.where("depth = 0").select("spec_id", "pkg", "key", "atom").distinct()
    return at(r.atoms.where("depth > 0").join(free, ["spec_id", "pkg", "key", "atom"], "left_semi"), F.col("atom"))


@rule("RPM596", "dependency-constraint-subsumption")
def subsumed(r):
    keys = ["spec_id", "pkg", "key", "name"]
    asked = r.atoms.where("key not in ('provides', 'obsoletes')")
    versioned = asked.where("op is not null and depth = 0").select(*keys).distinct()
    return at(asked.where("op is null and depth = 0 and not rich").join(versioned, keys, "left_semi"), F.col("atom"))


@rule("RPM597", "guarded-dependency-constraint-subsumption")
def guarded_subsumed(r):
    keys = ["spec_id", "pkg", "key", "name"]
    versioned = r.atoms.where("op is not null and depth = 0").select(*keys).distinct()
    return at(r.atoms.where("op is null and depth > 0 and not rich").join(versioned, keys, "left_semi"), F.col("atom"))


@rule("RPM590", "richdep-singleton")
def rich_singleton(r):
    return at(r.atoms.where(F.col("rich") & F.col("atom").rlike(r"^\(\s*[^\s()]+(\s*[<>=]+\s*[^\s()]+)?\s*\)$")), F.col("atom"))


@rule("RPM591", "richdep-idempotent")
def rich_idempotent(r):
    parts = F.split(F.regexp_extract("atom", r"^\(([^()]*)\)$", 1), r"\s+(?:and|or)\s+")
    return at(r.atoms.where(F.col("rich") & (F.size(parts) > F.size(F.array_distinct(parts)))), F.col("atom"))


@rule("RPM594", "richdep-same-then-else")
def rich_same(r):
    m = r"^\(\s*(.+?)\s+(?:if|unless)\s+.+?\s+else\s+(.+?)\s*\)$"
    return at(r.atoms.where(F.col("rich") & F.col("atom").rlike(m) & (F.regexp_extract("atom", m, 1) == F.regexp_extract("atom", m, 2))), F.col("atom"))


# Conditionals.


@rule("RPM070", "deep-conditional-nesting")
def deep(r):
    return at(r.branches.where("depth > 4 and how like 'if%'"), F.col("depth"))


@rule("RPM071", "unreachable-elif-branch")
def unreachable_elif(r):
    b = r.branches.where("how <> 'else'")
    return at(_again(b, "depth", "chain", "condition").where("how like 'elif%'"), F.col("condition"))


@rule("RPM072", "constant-condition")
def constant(r):
    return at(r.branches.where(F.col("how").isin("if", "elif") & F.col("condition").rlike(r"^[0-9]+$")), F.col("condition"))


@rule("RPM077", "ifarch-empty-list")
def empty_arch(r):
    return at(r.branches.where(F.col("how").rlike("arch|os$") & (F.col("condition") == "")))


@rule("RPM090", "ifarch-noarch")
def arch_noarch(r):
    return at(r.branches.where(F.col("how").contains("arch") & F.array_contains(F.split("condition", r"[\s,]+"), "noarch")))


@rule("RPM091", "duplicate-arch-in-list")
def duplicate_arch(r):
    a = F.split("condition", r"[\s,]+")
    return at(r.branches.where(F.col("how").rlike("arch|os$") & (F.size(a) > F.size(F.array_distinct(a)))), F.col("condition"))


@rule("RPM087", "double-negation-in-expr")
def double_negation(r):
    return at(r.branches.where(F.col("condition").rlike(r"!\s*!")), F.col("condition"))


@rule("RPM088", "self-comparison-in-expr")
def self_comparison(r):
    return at(r.branches.where(F.col("condition").rlike(r"(?:^|[\s(!&|])([^\s()!&|<>=]+)\s*(?:==|!=|<=|>=|<|>)\s*\1(?:$|[\s)&|])")), F.col("condition"))


@rule("RPM086", "idempotent-in-expr")
def idempotent(r):
    c = F.col("condition")
    same = lambda op: (F.size(F.split(c, op)) > F.size(F.array_distinct(F.transform(F.split(c, op), lambda x: F.trim(x))))) & ~c.contains("(")
    return at(r.branches.where((same(r"&&") & ~c.contains("||")) | (same(r"\|\|") & ~c.contains("&&"))), c)


@rule("RPM093", "condition-mentioned-many-times")
def many_times(r):
    n = r.branches.where("how = 'if' and condition <> ''").groupBy("spec_id", "condition").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    return at(n.where("n >= 5"), F.col("condition"))


@rule("RPM094", "line-continuation-in-condition")
def continuation(r):
    return at(r.branches.where(F.col("condition").endswith("\\")))


@rule("RPM095", "prefer-bcond-for-build-options", "allow")
def prefer_bcond(r):
    return at(r.branches.where(F.col("condition").rlike(r"0?%\{\?_?with(out)?_\w+\}")), F.col("condition"))


@rule("RPM435", "unnecessary-condition-parentheses")
def parentheses(r):
    return at(r.branches.where(F.col("condition").rlike(r"^\([^()]*\)$|\(\s*\(|\(\s*[^\s()&|<>=!]+\s*\)")), F.col("condition"))


@rule("RPM434", "negated-comparison-simplify")
def negated_comparison(r):
    return at(r.branches.where(F.col("condition").rlike(r"!\s*\(\s*[^()&|]+(?:==|!=|<=|>=|<|>)[^()&|]+\)")), F.col("condition"))


@rule("RPM436", "bcond-negation-canonical")
def bcond_negation(r):
    return at(r.branches.where(F.col("condition").rlike(r"!\s*%\{with(out)? \w+\}")), F.col("condition"))


@rule("RPM439", "target-cpu-equality-to-ifarch")
def target_cpu(r):
    return at(r.branches.where(F.col("condition").rlike(r'"?%\{_target_cpu\}"?\s*=='))  , F.col("condition"))


def _content(r: Recipes) -> DataFrame:
    """How many lines of content each branch has directly or deeper: the lines up to the chain's next branch or its end."""
    w = Window.partitionBy("spec_id", "depth", "chain").orderBy("line_no")
    ends = r.body.where("closes and chain is not null").select("spec_id", "depth", "chain", F.col("line_no").alias("end"))
    b = r.branches.join(ends, ["spec_id", "depth", "chain"]).withColumn("next", F.coalesce(F.lead("line_no").over(w), F.col("end")))
    line = r.body.where("not (opens or closes or turns)").select("spec_id", F.col("line_no").alias("l"), F.trim("line").alias("t"))
    inside = (F.col("l") > F.col("line_no")) & (F.col("l") < F.col("next"))
    j = b.join(line.where("t <> ''").withColumnRenamed("spec_id", "s"), (F.col("spec_id") == F.col("s")) & inside, "left")
    return j.groupBy("spec_id", "line_no", "depth", "chain", "how", "condition", "next").agg(
        F.count_if(~F.col("t").startswith("#")).alias("items"), F.count_if(F.col("t").startswith("#")).alias("notes"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l", "t"))), lambda x: x["t"]), "\n")).alias("hash"),
    )


@rule("RPM073", "empty-conditional-branch")
def empty_branch(r):
    n = _content(r).groupBy("spec_id", "depth", "chain").agg(F.sum("items").alias("items"), F.sum("notes").alias("notes"), F.min("line_no").alias("line_no"))
    return at(n.where("items = 0 and notes = 0"))


@rule("RPM074", "identical-conditional-branches")
def identical_branches(r):
    n = _content(r).groupBy("spec_id", "depth", "chain").agg(
        F.count("*").alias("n"), F.countDistinct("hash").alias("kinds"), F.count_if(F.col("how") == "else").alias("other"), F.min("line_no").alias("line_no"), F.min("items").alias("items")
    )
    return at(n.where("n > 1 and kinds = 1 and other = 1 and items > 0"))


@rule("RPM081", "empty-else-drop")
def empty_else(r):
    return at(_content(r).where("how = 'else' and items = 0 and notes = 0"))


@rule("RPM089", "single-comment-only-branch")
def comment_branch(r):
    return at(_content(r).where("items = 0 and notes > 0"))


@rule("RPM099", "merge-elif-same-body")
def same_body(r):
    w = Window.partitionBy("spec_id", "depth", "chain").orderBy("line_no")
    c = _content(r).withColumn("before", F.lag("hash").over(w))
    return at(c.where("hash = before and how like 'elif%' and items > 0"), F.col("condition"))


@rule("RPM076", "adjacent-mergeable-conditionals")
def mergeable(r):
    """A block that opens with the condition of the block that ended just before it, blank lines apart."""
    heads = r.branches.where("how like 'if%'").select("spec_id", "depth", "chain", "condition", "how", "line_no")
    ends = r.body.where("closes").select("spec_id", "depth", "chain", F.col("line_no").alias("end"))
    w = Window.partitionBy("spec_id", "depth").orderBy("line_no")
    b = heads.join(ends, ["spec_id", "depth", "chain"])
    b = b.select("*", F.lag("end").over(w).alias("before_end"), F.lag("condition").over(w).alias("before"), F.lag("how").over(w).alias("before_how"))
    text = r.lines.where(F.trim("line") != "").select("spec_id", "line_no", F.row_number().over(Window.partitionBy("spec_id").orderBy("line_no")).alias("k"))
    near = b.join(text, ["spec_id", "line_no"]).join(text.select("spec_id", F.col("line_no").alias("before_end"), F.col("k").alias("bk")), ["spec_id", "before_end"])
    return at(near.where("k = bk + 1 and condition = before and how = before_how"), F.col("condition"))


# Macros and comments.


@rule("RPM032", "macro-redefinition")
def redefinition(r):
    return at(_again(r.macros.where("depth = 0"), "name"), F.col("name"))


@rule("RPM036", "macro-in-hash-comment")
def macro_in_comment(r):
    return at(r.comments.where(F.col("text").rlike(r"(^|[^%])%(\{|\(|[A-Za-z_])")), F.col("text"))


@rule("RPM118", "unused-conditional-global", "allow")
def unused_global(r):
    used = r.lines.select("spec_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"%\{?[!?]*([A-Za-z_]\w*)"), 1)).alias("name"))
    m = r.macros.where("how = 'global'").select("spec_id", F.col("line_no").alias("def_no"), "name")
    hit = m.join(used, ["spec_id", "name"]).where("line_no <> def_no").select("spec_id", "def_no", "name").distinct()
    return at(m.join(hit, ["spec_id", "def_no", "name"], "left_anti").withColumnRenamed("def_no", "line_no"), F.col("name"))


@rule("RPM492", "single-use-private-macro", "allow")
def single_use(r):
    used = r.lines.select("spec_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"%\{?[!?]*([A-Za-z_]\w*)"), 1)).alias("name"))
    m = r.macros.where("how = 'global' and depth = 0").select("spec_id", F.col("line_no").alias("def_no"), "name")
    n = m.join(used, ["spec_id", "name"]).where("line_no <> def_no").groupBy("spec_id", "def_no", "name").agg(F.count("*").alias("n")).where("n = 1")
    return at(n.withColumnRenamed("def_no", "line_no"), F.col("name"))


@rule("RPM493", "macro-alias-of-builtin")
def alias(r):
    """Well-known macros of paths and of a recipe's identity. Names that begin with two underscores are reserved."""
    known = (
        "_bindir", "_sbindir", "_libdir", "_libexecdir", "_includedir", "_datadir", "_mandir", "_infodir", "_localstatedir", "_sharedstatedir", "_sysconfdir", "_unitdir", "_userunitdir",
        "_tmpfilesdir", "_sysusersdir", "_docdir", "_defaultlicensedir", "_prefix", "_exec_prefix", "_localedir", "buildroot", "name", "version", "release", "epoch",
    )
    whole = F.regexp_extract("value", r"^%(?:\{(\w+)\}|(\w+))$", 0)
    return at(r.macros.where((whole != "") & F.regexp_replace(whole, r"[%{}]", "").isin(*known) & ~F.col("name").startswith("__")), F.col("name"))


@rule("RPM494", "no-op-conditional-macro")
def no_op_macro(r):
    return at(r.lines.where(F.col("line").rlike(r"%\{!?\?\w+:\}")))


@rule("RPM497", "duplicate-macro-bodies", "allow")
def duplicate_bodies(r):
    return at(_again(r.macros.where(F.length("value") >= 3), "value"), F.col("name"))


@rule("RPM499", "macro-name-shadows-bcond-helper")
def shadows(r):
    return at(r.macros.where(F.col("name").rlike(r"^with(out)?_\w+")), F.col("name"))


def _bconds(r: Recipes) -> DataFrame:
    m = r"^\s*%bcond(?:_with|_without)?\s+(\w+)"
    return r.lines.where(F.col("line").rlike(m)).select("spec_id", "line_no", F.regexp_extract("line", m, 1).alias("name"))


def _bcond_uses(r: Recipes) -> DataFrame:
    return r.lines.select("spec_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"%\{\??with(?:out)?\s+(\w+)\}"), 1)).alias("name"))


@rule("RPM401", "bcond-defined-but-unused")
def bcond_unused(r):
    return at(_bconds(r).join(_bcond_uses(r).select("spec_id", "name").distinct(), ["spec_id", "name"], "left_anti"), F.col("name"))


@rule("RPM402", "with-condition-without-bcond")
def bcond_missing(r):
    return at(_bcond_uses(r).join(_bconds(r).select("spec_id", "name").distinct(), ["spec_id", "name"], "left_anti"), F.col("name"))


@rule("RPM400", "prefer-bcond-new-syntax")
def bcond_old(r):
    return at(r.lines.where(F.col("line").rlike(r"^\s*%bcond_with(out)?\s")))


@rule("RPM406", "include-not-expanded", "allow")
def include(r):
    return at(r.lines.where(F.col("line").rlike(r"^\s*%include\s")))


@rule("RPM570", "commented-out-spec-code", "allow")
def commented_code(r):
    code = r.comments.withColumn("code", F.col("text").rlike(r"^#+\s*(%|[A-Z][A-Za-z]+[0-9]*(\([^)]*\))?:\s|Requires|BuildRequires)"))
    run = code.where("code").withColumn("g", F.col("line_no") - F.row_number().over(Window.partitionBy("spec_id").orderBy("line_no")))
    n = run.groupBy("spec_id", "g").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"))
    return at(n.where("n >= 3"), F.col("n"))


@rule("RPM571", "stale-disabled-source-or-patch")
def disabled_source(r):
    return at(r.comments.where(F.col("text").rlike(r"^#+\s*(Source|Patch)[0-9]*\s*:")), F.col("text"))


@rule("RPM572", "excessive-section-separators", "allow")
def separators(r):
    return at(r.comments.where(F.col("text").rlike(r"^#[#=\-*_ ]{7,}$")))


# Changelog.


@rule("RPM037", "empty-changelog-entry")
def empty_entry(r):
    return at(r.changelog.where("body_lines = 0"))


@rule("RPM038", "changelog-future-date")
def future(r):
    return at(r.changelog.where(F.col("date") > F.current_date()), F.col("date"))


@rule("RPM039", "changelog-implausible-date")
def implausible(r):
    return at(r.changelog.where((F.col("date").isNull() & F.col("year").isNotNull()) | (F.col("year") < 1990)), F.concat_ws("-", "year", "month", "day"))


@rule("RPM311", "changelog-order-weekday-evr")
def changelog_order(r):
    w = Window.partitionBy("spec_id", "sec").orderBy("line_no")
    c = r.changelog.withColumn("before", F.lag("date").over(w))
    day = F.date_format("date", "EEE")
    return at(c.where((F.col("date") > F.col("before")) | (F.col("date").isNotNull() & (day != F.col("weekday")))), F.col("date"))


# Shell bodies.


def _shell(r: Recipes, *kinds: str) -> DataFrame:
    return r.body.where(F.col("kind").isin(*(kinds or (*BUILD_SECTIONS, *SCRIPTLETS))) & ~F.col("line").rlike(r"^\s*#"))


def _command(words: str) -> str:
    """A line that runs one of the words as a command, at its start or after a separator."""
    return rf"(?:^|[;&|(]|\bthen|\bdo|\belse)\s*(?:sudo\s+)?(?:{words})(?:\s|$)"


def _shell_rule(id: str, name: str, pattern: str, kinds: tuple[str, ...] = (), severity: str = "warn", unless: str | None = None):
    def find(r: Recipes) -> DataFrame:
        s = _shell(r, *kinds).where(F.col("line").rlike(pattern))
        return at(s.where(~F.col("line").rlike(unless)) if unless else s, F.trim("line"))

    rule(id, name, severity)(find)


_BUILDROOT = r"%\{?buildroot\}?|\$\{?RPM_BUILD_ROOT"
_shell_rule("RPM053", "rpm-buildroot-shell-var", r"\$\{?RPM_BUILD_ROOT\b")
_shell_rule("RPM054", "rpm-source-dir-shell-var", r"\$\{?RPM_SOURCE_DIR\b")
_shell_rule("RPM060", "python-setup-test-deprecated", r"setup\.py\s+test\b", severity="allow")
_shell_rule("RPM061", "python-setup-install-deprecated", r"setup\.py\s+install\b", severity="allow")
_shell_rule("RPM062", "egrep-fgrep-deprecated", _command("egrep|fgrep"))
_shell_rule("RPM063", "setup-without-q-flag", r"^\s*%setup\b", ("prep",), unless=r"\s-\w*q")
_shell_rule("RPM120", "make-without-make-build", _command("make"), ("build",), unless=r"\binstall\b")
_shell_rule("RPM121", "make-install-without-make-install", _command("make") + r".*\binstall\b", ("install",))
_shell_rule("RPM122", "configure-without-configure-macro", r"(?:^|\s)\.{1,2}/configure\b", ("build",))
_shell_rule("RPM341", "scriptlet-upgrade-test-eq-two", r"\$1\"?\s*(?:-eq|=|==)\s*\"?2\b", SCRIPTLETS)
_shell_rule("RPM342", "direct-systemctl-in-scriptlet", r"\bsystemctl\s+(?:-\S+\s+)*(?:enable|disable|start|stop|restart|reload|try-restart|reload-or-restart|preset|preset-all|mask|unmask|daemon-reload|daemon-reexec)\b", SCRIPTLETS)
_shell_rule("RPM346", "ldconfig-scriptlet-style", r"^\s*/sbin/ldconfig\b", ("post", "postun"))
_shell_rule("RPM349", "scriptlet-state-outside-rpm-state", r"/(?:var/)?tmp/", SCRIPTLETS)
_shell_rule("RPM381", "rm-rf-buildroot-in-install", rf"^\s*(?:%\{{?__rm\}}?|rm)\s+-\w*[rf]\w*\s+\"?(?:{_BUILDROOT})\"?\s*$".replace("RPM_BUILD_ROOT", r"RPM_BUILD_ROOT\}?"), ("install",))
_shell_rule("RPM382", "makeinstall-without-underscore", r"^\s*%\{?makeinstall\b", ("install",))
_shell_rule("RPM383", "make-install-missing-destdir", _command("make") + r".*\binstall\b", ("install",), "deny", r"DESTDIR=|INSTALL_ROOT=|prefix=")
_shell_rule("RPM384", "install-chown-or-owner", _command("chown|chgrp") + r"|\binstall\s.*\s-[og]\s", ("install",))
_shell_rule("RPM385", "optflags-overridden", r"(?:^|\s)(?:CFLAGS|CXXFLAGS|LDFLAGS|FFLAGS)=", ("build",), unless=r"optflags|RPM_OPT_FLAGS|build_(?:c|cxx|ld)flags|\$\{?(?:CFLAGS|CXXFLAGS|LDFLAGS)")
_shell_rule("RPM386", "werror-not-disabled", r"(?:^|\s|=|\"|')(?:-Werror(?:\s|$|\"|')|--enable-werror)", ("build", "check"))
_shell_rule("RPM387", "j1-without-comment", r"\bmake\b.*\s-j\s*1(?:\s|$)", ("build", "install", "check"))
_shell_rule("RPM472", "redundant-setup-default-name", r"^\s*%(?:auto)?setup\b.*-n\s+%\{name\}-%\{version\}(?:\s|$)", ("prep",))
_shell_rule("RPM473", "manual-tar-cd-to-setup", _command("tar") + r".*%\{?SOURCE0?\}?(?:\s|$)", ("prep",))
_shell_rule("RPM474", "manual-patch-command-to-patch-macro", r"\bpatch\s.*<\s*%\{?PATCH\d+", ("prep",))
_shell_rule("RPM476", "manual-extra-source-unpack-to-setup-a-b", _command("tar") + r".*%\{?SOURCE[1-9]\d*\}?", ("prep",))


@rule("RPM470", "setup-autopatch-to-autosetup")
def to_autosetup(r):
    p = _shell(r, "prep")
    auto = p.where(F.col("line").rlike(r"^\s*%\{?autopatch\b")).select("spec_id").distinct()
    return at(p.where(F.col("line").rlike(r"^\s*%setup\b")).join(auto, "spec_id", "left_semi"))


def _patches(r: Recipes) -> DataFrame:
    """Declared patches with their number; one without a number follows the one before."""
    w = Window.partitionBy("spec_id").orderBy("line_no")
    p = r.tags.where("key = 'patch'")
    return p.withColumn("patch", F.coalesce(F.when(F.col("number") != "", F.col("number").cast("int")), F.row_number().over(w) - 1))


def _applied(r: Recipes) -> DataFrame:
    m = r"^\s*%\{?patch\s*(?:.*?-P\s*)?(\d+)"
    return _shell(r, "prep").where(F.col("line").rlike(m)).select("spec_id", "line_no", F.regexp_extract("line", m, 1).cast("int").alias("patch"))


@rule("RPM064", "patch-defined-not-applied")
def patch_not_applied(r):
    every = r.body.where((F.col("kind") == "prep") & F.col("line").rlike(r"%\{?(autosetup|autopatch|patches|PATCH)")).select("spec_id").distinct()
    return at(_patches(r).join(every, "spec_id", "left_anti").join(_applied(r).select("spec_id", "patch").distinct(), ["spec_id", "patch"], "left_anti"), F.col("patch"))


@rule("RPM306", "patch-applied-more-than-once")
def patch_twice(r):
    return at(_again(_applied(r), "patch"), F.col("patch"))


@rule("RPM535", "duplicate-shell-block", "allow")
def duplicate_block(r):
    w = Window.partitionBy("spec_id", "sec").orderBy("line_no")
    s = _shell(r).where(F.trim("line") != "").withColumn("b", F.concat_ws("\n", "line", F.lead("line", 1).over(w), F.lead("line", 2).over(w))).withColumn("third", F.lead("line", 2).over(w)).where("third is not null")
    n = s.groupBy("spec_id", "b").agg(F.min("line_no").alias("line_no"), F.countDistinct("sec").alias("n"))
    return at(n.where("n > 1"))


def _adjacent(df: DataFrame) -> DataFrame:
    """Rows of a section that directly follow another of the same set."""
    w = Window.partitionBy("spec_id", "sec").orderBy("line_no")
    return df.withColumn("_before", F.lag("line_no").over(w)).where("line_no = _before + 1")


@rule("RPM534", "repeated-rm-f-combine", "allow")
def rm_f(r):
    return at(_adjacent(_shell(r).where(F.col("line").rlike(r"^\s*rm\s+-f\s"))))


@rule("RPM532", "combine-install-dirs", "allow")
def install_dirs(r):
    return at(_adjacent(_shell(r, "install").where(F.col("line").rlike(r"^\s*(install\s+-d|mkdir\s+-p)\s"))))


# Commands.


def _once(found: DataFrame, detail: Column, *keys: str) -> DataFrame:
    """The first finding of a section, or of each of the keys' values in it."""
    return at(found.withColumn("detail", detail).groupBy("spec_id", "sec", *keys).agg(F.min_by("detail", F.struct("line_no", "nth")).alias("detail"), F.min("line_no").alias("line_no")), F.col("detail"))


@rule("RPM348", "unsafe-useradd-groupadd")
def unguarded_accounts(r):
    """A guard comes before its command, so the command doesn't begin the line."""
    makers = ("useradd", "groupadd", "usermod", "groupmod", "adduser", "addgroup")
    c = r.commands.where(F.col("kind").isin(*SCRIPTLETS) & (F.col("nth") == 1) & F.col("lead") & F.col("name").isin(*makers))
    return _once(c, F.col("name"))


@rule("RPM380", "install-writes-outside-buildroot", "deny")
def outside_buildroot(r):
    """The first argument, options and their values apart, that is a path of the system."""
    system = "^/(?:usr|etc|var|opt|boot|lib|lib64)/"
    valued = lambda args, i: (i > 0) & F.coalesce(F.get(args, i - 1).isin("-m", "-o", "-g", "-t", "-S"), F.lit(False))
    c = r.commands.where((F.col("kind") == "install") & F.col("name").isin("install", "cp", "mv", "ln", "mkdir", "touch", "dd", "tee"))
    bad = c.withColumn("bad", F.get(F.filter("args", lambda a, i: a.rlike(system) & ~valued(F.col("args"), i)), 0)).where("bad is not null")
    return at(bad, F.concat_ws(" ", "name", "bad"))


#: Subcommands that need the network, and the option with which they don't.
_NETWORK = {
    "git": (("clone", "fetch", "pull", "push", "remote-update"), None), "pip": (("install", "download", "wheel"), "--no-index"), "cargo": (("install", "update", "fetch", "search", "publish"), None),
    "npm": (("install", "ci", "update", "i"), "--offline"), "go": (("get", "mod"), None), "gem": (("install", "fetch", "update"), None),
}


@rule("RPM388", "network-access-in-build", families=("fedora", "rhel", "opensuse", "mageia", "alt"))
def network(r):
    tool = F.when(F.col("name") == "pip3", "pip").when(F.col("name").isin("yarn", "pnpm"), "npm").otherwise(F.col("name"))
    sub = shell.first_argument(F.col("args"))
    reaches = F.when(tool.isin("curl", "wget", "aria2c", "fetch"), "download")
    for name, (subs, offline) in _NETWORK.items():
        there = (tool == name) & sub.isin(*subs)
        reaches = reaches.when(there & ~F.array_contains("args", offline) if offline else there, name)
    c = r.commands.where(F.col("kind").isin(*BUILD_SECTIONS)).withColumn("reaches", reaches).where("reaches is not null")
    return _once(c, F.concat_ws(" ", "name", sub), "reaches")


@rule("RPM390", "buildsystem-macro-modernization", gated=True)
def build_systems(r):
    """The macros that stand for a build system's steps."""
    name, args, sub = F.col("name"), F.col("args"), shell.first_argument(F.col("args"))
    has = lambda x: F.array_contains(args, x)
    python = name.isin("python", "python3")
    wheel = F.exists(F.sequence(F.lit(1), F.size(args)), lambda i: (F.get(args, i - 1) == "-m") & (F.get(args, i) == "build"))
    macro = (
        F.when((name == "cmake") & has("--build"), "cmake_build").when((name == "cmake") & has("--install"), "cmake_install").when(name == "cmake", "cmake")
        .when((name == "meson") & (sub.isNull() | (sub == "setup")), "meson").when((name == "meson") & (sub == "compile"), "meson_build").when((name == "meson") & (sub == "install"), "meson_install")
        .when((name == "cargo") & (sub == "build"), "cargo_build").when((name == "cargo") & (sub == "install"), "cargo_install")
        .when(python & has("setup.py") & has("build"), "py3_build").when(python & has("setup.py") & has("install"), "py3_install").when(python & ~has("setup.py") & (F.size(args) > 1) & wheel, "pyproject_wheel")
        .when((name == "go") & (sub == "build"), "gobuild").when((name == "go") & (sub == "install"), "goinstall")
    )
    c = r.commands.where(F.col("kind").isin("build", "install")).withColumn("macro", macro).where("macro is not null")
    return _once(c, F.col("macro"), "macro")


# Lines.


#: Directories that have a macro, and paths that everybody knows by their names.
_DIRECTORIES = ("/usr/lib64", "/usr/libexec", "/usr/include", "/usr/share", "/usr/bin", "/usr/sbin", "/usr/lib", "/var/log", "/var/lib", "/etc")
_LITERAL = (
    "/etc/rc.d/init.d", "/etc/rc.d/rc.local", "/etc/os-release", "/etc/passwd", "/etc/group", "/etc/shadow", "/etc/hosts", "/etc/fstab", "/etc/resolv.conf", "/etc/nsswitch.conf", "/etc/sysctl.conf",
)


@rule("RPM050", "hardcoded-paths")
def hardcoded(r):
    """Paths below the build root, dependencies, scriptlets and texts are meant as they stand."""
    words = F.col("kind").isin("changelog", "description", *SCRIPTLETS) | F.col("line").rlike(r"^\s*#")
    meant = r.tags.where(F.col("key").isin("source", "patch", "url", "summary", "license", "group", *DEPENDENCY_TAGS)).select("spec_id", "line_no")
    edge = r"(?=[^A-Za-z0-9_.-]|$)"
    known = rf"(?:\$\{{RPM_BUILD_ROOT\}}|%\{{\??buildroot\}}|\$RPM_BUILD_ROOT)/|(?:{'|'.join(re.escape(x) for x in _LITERAL)}){edge}"
    rest = F.regexp_replace("line", known, " ")
    return at(r.body.where(~words & rest.rlike(rf"(?:{'|'.join(_DIRECTORIES)}){edge}")).join(meant, ["spec_id", "line_no"], "left_anti"), F.trim("line"))


@rule("RPM051", "tab-indent")
def tab_indent(r):
    return at(r.lines.where(F.col("line").rlike(r"^ *\t")))


@rule("RPM052", "trailing-whitespace", "allow")
def trailing(r):
    return at(r.lines.where(F.col("line").rlike(r"[ \t]+$")))


@rule("RPM490", "macro-composition-to-specific-macro")
def composition(r):
    return at(r.lines.where(F.col("line").rlike(r"%\{_prefix\}/(bin|sbin|lib|libexec|share|include)\b|%\{_datadir\}/(man|info|doc)\b")))


# Files.


#: How the names of license files begin.
_LICENSES = ("license", "licence", "copying", "copyright", "notice", "authors", "mit-license", "legal", "unlicense", "gpl", "lgpl", "agpl", "apache-license")


def _files_rule(id: str, name: str, test: Callable[[], Column], severity: str = "warn"):
    rule(id, name, severity)(lambda r: at(r.files.where(test()), F.col("path")))


def _p(pattern: str) -> Column:
    return F.col("path").rlike(pattern)


_files_rule("RPM360", "etc-file-not-config", lambda: _p(r"^(/etc|%\{_sysconfdir\})/") & ~F.col("is_config") & ~F.col("is_ghost") & ~F.col("is_dir") & ~_p(r"/(init|rc)\.d/|/$"))
_files_rule("RPM361", "config-under-usr", lambda: F.col("is_config") & _p(r"^(/usr|%\{_(prefix|bindir|libdir|datadir|sbindir|libexecdir)\})"))
_files_rule("RPM363", "license-file-marked-doc", lambda: F.col("is_doc") & _p(rf"(?i)(^|/)({'|'.join(_LICENSES)})([^a-z0-9/][^/]*)?$"))
_files_rule("RPM364", "devel-file-in-non-devel-package", lambda: _p(r"(\.h|\.hpp|\.pc|Config\.cmake|/lib[^/]*\.so)$") & ~F.col("pkg").rlike("devel|static"))
_files_rule("RPM365", "locale-file-not-lang", lambda: _p(r"/locale/.*\.mo$") & ~F.col("has_lang"))
_files_rule("RPM367", "standard-dir-owned", lambda: _p(r"^(%\{_(bindir|sbindir|libdir|datadir|includedir|mandir|sysconfdir|libexecdir|unitdir)\}|/usr|/etc|/var|/usr/(bin|sbin|lib|lib64|share|include))/?$"))
_files_rule("RPM368", "broad-files-glob", lambda: _p(r"^(%\{_(bindir|sbindir|libdir|datadir|includedir|mandir|sysconfdir)\}|/usr|/etc)/\*\*?$"))
_files_rule("RPM369", "var-run-var-lock-not-ghost", lambda: _p(r"^(/var/run|/run|/var/lock|%\{_rundir\})/") & ~F.col("is_ghost"))
_files_rule("RPM370", "suspicious-attr-permissions", lambda: F.col("mode").rlike(r"^0?[0-7]?[0-7][0-7][2367]$|^[2467][0-7]{3}$|^0[2467][0-7]{3}$") & ~(F.col("is_dir") & F.col("mode").rlike("^0?1777$")))
_files_rule("RPM371", "debuginfo-path-in-main-files", lambda: _p(r"^/usr/lib/debug|\.build-id|\.debug$"), "deny")
_files_rule("RPM344", "systemd-unit-under-etc-or-config", lambda: _p(r"\.(service|socket|timer|target|path|mount)$") & (F.col("is_config") | _p(r"^(/etc|%\{_sysconfdir\})/systemd/system")))


@rule("RPM362", "plain-config-without-comment")
def plain_config(r):
    before = r.comments.select("spec_id", (F.col("line_no") + 1).alias("line_no"))
    return at(r.files.where("is_config and not noreplace").join(before, ["spec_id", "line_no"], "left_anti"), F.col("path"))


@rule("RPM366", "duplicate-files-in-files-sections")
def duplicate_files(r):
    return at(_again(r.files.where(F.col("path") != "").withColumn("norm", F.regexp_replace("path", "/+$", "")), "norm"), F.col("path"))


@rule("RPM512", "redundant-default-defattr")
def defattr(r):
    return at(r.body.where((F.col("kind") == "files") & F.col("line").rlike(r"^\s*%defattr\s*\(\s*-\s*,\s*root\s*,\s*root\s*(,\s*-\s*)?\)")))


@rule("RPM510", "adjacent-doc-lines-merge")
def doc_lines(r):
    return at(_adjacent(r.files.where("is_doc")), F.col("path"))


@rule("RPM511", "adjacent-license-lines-merge")
def license_lines(r):
    return at(_adjacent(r.files.where("is_license")), F.col("path"))


@rule("RPM513", "files-directory-subsumes-child", "allow")
def subsumes_child(r):
    owner = r.files.where("not is_dir and not is_glob and path like '%/'").select("spec_id", "sec", F.col("path").alias("dir"))
    return at(r.files.join(owner, ["spec_id", "sec"]).where("path <> dir and startswith(path, dir)").dropDuplicates(["spec_id", "line_no"]), F.col("path"))


@rule("RPM343", "systemd-unit-without-helper-macros")
def unit_without_helpers(r):
    helped = r.body.where(F.col("line").rlike(r"%\{?(systemd_|service_)\w+")).select("spec_id").distinct()
    return at(r.files.where(_p(r"\.(service|socket|timer)$")).join(helped, "spec_id", "left_anti"), F.col("path"))


@rule("RPM347", "tmpfiles-without-create")
def tmpfiles(r):
    helped = r.body.where(F.col("line").rlike(r"%\{?tmpfiles_create")).select("spec_id").distinct()
    return at(r.files.where(_p(r"(tmpfiles\.d|_tmpfilesdir\})/[^/]*\.conf$")).join(helped, "spec_id", "left_anti"), F.col("path"))


@rule("RPM325", "pkgconfig-file-without-pkgconfig-br")
def pc_without_br(r):
    br = r.atoms.where((F.col("key") == "buildrequires") & F.col("name").rlike(r"^pkgconfig|^pkgconf")).select("spec_id").distinct()
    return at(r.files.where(_p(r"\.pc$")).join(br, "spec_id", "left_anti"), F.col("path"))


# Conditions by their normal form.


def _cubes(r: Recipes) -> DataFrame:
    b = r.branches.where("how in ('if', 'elif')").select("spec_id", "line_no", "condition", expressions.condition_cubes("condition").alias("cubes"))
    most = F.array_max(F.transform(F.flatten("cubes"), lambda x: F.abs(x)))
    return b.where("cubes is not null").withColumn("atoms", F.coalesce(most, F.lit(0)))


@rule("RPM110", "boolean-dnf-redundancy")
def dnf_redundancy(r):
    c = _cubes(r).where("atoms > 0")
    return at(c.where(F.size(conditions.drop_subsumed(F.col("cubes"))) < F.size("cubes")), F.col("condition"))


@rule("RPM111", "boolean-tautology-by-cubes")
def tautology(r):
    c = _cubes(r)
    test = F.lit(False)
    for n in range(1, 9):
        test = F.when(F.col("atoms") == n, conditions.tautology(F.col("cubes"), n)).otherwise(test)
    return at(c.where(test), F.col("condition"))


@rule("RPM112", "boolean-contradiction-by-cubes")
def contradiction(r):
    return at(_cubes(r).where((F.size("cubes") == 0) & ~F.col("condition").rlike("^[0-9]+$")), F.col("condition"))


@rule("RPM103", "inequality-contradiction")
def inequality_contradiction(r):
    """Integer bounds of one operand, in conditions of && alone, that can't all hold."""
    m = r"^\(?\s*(\S+)\s*(==|<=|>=|<|>)\s*([0-9]+)\s*\)?$"
    b = r.branches.where(~F.col("condition").contains("||") & ~F.col("condition").contains("!"))
    part = F.trim(F.col("p"))
    each = b.select("spec_id", "line_no", F.explode(F.split("condition", "&&")).alias("p")).where(part.rlike(m))
    bounds = each.select("spec_id", "line_no", F.regexp_extract(part, m, 1).alias("operand"), F.regexp_extract(part, m, 2).alias("op"), F.regexp_extract(part, m, 3).try_cast("long").alias("n"))
    return at(conditions.interval_conflicts(bounds, ["spec_id", "line_no", "operand"]), F.col("operand"))
