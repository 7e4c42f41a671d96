"""Recipe rules on the structure of conditionals, on shell and file idioms, and on tools and dependencies. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions
from ..sources.recipes import BUILD_SECTIONS, SCRIPTLETS, Recipes
from .recipe_rules import _applied, _cubes, _patches, _shell, at, rule

_KEY = ["spec_id", "depth", "chain"]


def extents(r: Recipes) -> DataFrame:
    """branches with `next` (the line that ends the branch), `end` (of its chain), `no` (place in the chain), `size` and `other` (whether the chain has an else)."""
    ends = r.body.where("closes and chain is not null").select(*_KEY, F.col("line_no").alias("end"))
    w = Window.partitionBy(*_KEY).orderBy("line_no")
    whole = Window.partitionBy(*_KEY)
    b = r.branches.join(ends, _KEY)
    return b.select(
        "*", F.coalesce(F.lead("line_no").over(w), F.col("end")).alias("next"), F.row_number().over(w).alias("no"), F.count("*").over(whole).alias("size"),
        (F.max((F.col("how") == "else").cast("int")).over(whole) == 1).alias("other"),
    )


def contents(r: Recipes) -> DataFrame:
    """extents with what a branch holds directly: `items` (its own lines in order, comments and blank lines apart), and `blocks` (conditionals directly in it)."""
    b = extents(r)
    line = r.body.where("not (closes or turns)").select(F.col("spec_id").alias("s"), F.col("line_no").alias("l"), F.trim("line").alias("t"), "opens", F.col("depth").alias("d"))
    line = line.where("t <> '' and t not like '#%'")
    inside = (F.col("spec_id") == F.col("s")) & (F.col("l") > F.col("line_no")) & (F.col("l") < F.col("next"))
    j = b.join(line, inside, "left")
    own = F.when((F.col("d") == F.col("depth")) & ~F.col("opens"), F.struct("l", "t"))
    return j.groupBy(*b.columns).agg(
        F.transform(F.array_sort(F.collect_list(own)), lambda x: x["t"]).alias("items"), F.count_if(F.col("opens") & (F.col("d") == F.col("depth") + 1)).alias("blocks")
    )


def parents(r: Recipes) -> DataFrame:
    """Branches with the innermost branch around each: columns of the outer one start with `p_`."""
    b = extents(r)
    outer = b.select(*(F.col(c).alias(f"p_{c}") for c in b.columns))
    around = (F.col("spec_id") == F.col("p_spec_id")) & (F.col("p_depth") == F.col("depth") - 1) & (F.col("p_line_no") < F.col("line_no")) & (F.col("line_no") < F.col("p_next"))
    return b.join(outer, around)


@rule("RPM075", "redundant-nested-condition")
def redundant_nested(r):
    return at(parents(r).where("no = 1 and condition <> '' and condition = p_condition and how = 'if' and p_how in ('if', 'elif')"), F.col("condition"))


@rule("RPM442", "arch-subset-under-parent")
def arch_subset(r):
    words = lambda c: F.split(F.col(c), r"[\s,]+")
    return at(parents(r).where((F.col("how") == "ifarch") & (F.col("p_how") == "ifarch") & (F.size(F.array_except(words("p_condition"), words("condition"))) == 0)), F.col("condition"))


@rule("RPM080", "nested-and-collapse")
def nested_collapse(r):
    one = contents(r).where("size = 1 and how = 'if' and blocks = 1 and size(items) = 0").select("spec_id", F.col("line_no").alias("p_line_no"))
    return at(parents(r).where("size = 1 and how = 'if'").join(one, ["spec_id", "p_line_no"]), F.col("condition"))


@rule("RPM100", "collapse-else-if-into-elif")
def else_if(r):
    return at(contents(r).where("how = 'else' and blocks = 1 and size(items) = 0"))


@rule("RPM082", "invert-empty-if-arch")
def invert_arch(r):
    c = contents(r)
    full = c.where("how = 'else' and size = 2 and (size(items) > 0 or blocks > 0)").select(*_KEY)
    return at(c.where("no = 1 and how in ('ifarch', 'ifnarch', 'ifos', 'ifnos') and size(items) = 0 and blocks = 0").join(full, _KEY), F.col("condition"))


@rule("RPM083", "collapse-elif-into-else")
def elif_constant(r):
    return at(extents(r).where((F.col("how") == "elif") & (F.col("no") == F.col("size")) & F.col("condition").rlike(r"^[1-9][0-9]*$")))


@rule("RPM085", "constant-tautology-in-expr")
def constant_operand(r):
    return at(r.branches.where(F.col("condition").rlike(r"(?:&&|\|\|)\s*\(?\s*[01]\s*\)?(?:\s*$|\s*&&|\s*\|\|)|^\s*\(?\s*[01]\s*\)?\s*(?:&&|\|\|)")), F.col("condition"))


@rule("RPM092", "conditional-cyclomatic-complexity")
def complexity(r):
    """Branches of the whole recipe, those in shell bodies apart."""
    kinds = r.sections.where(~F.col("kind").isin(*BUILD_SECTIONS, *SCRIPTLETS)).select("spec_id", "sec")
    n = r.branches.join(kinds, ["spec_id", "sec"]).groupBy("spec_id").agg(F.count("*").alias("n"), F.lit(1).alias("line_no"))
    return at(n.where("n > 15"), F.col("n"))


@rule("RPM096", "if-only-buildrequires", "allow")
def only_buildrequires(r):
    c = contents(r).where("size = 1 and blocks = 0 and size(items) > 0")
    return at(c.where(F.forall("items", lambda t: t.rlike(r"(?i)^BuildRequires\s*:"))), F.col("condition"))


def _edges(r: Recipes, place: int) -> DataFrame:
    c = contents(r).where("size > 1 and other").withColumn("e", F.get("items", F.lit(0)) if place == 0 else F.element_at(F.when(F.size("items") > 0, F.col("items")), -1))
    n = c.groupBy(*_KEY, "size").agg(F.count("e").alias("n"), F.countDistinct("e").alias("kinds"), F.min("line_no").alias("line_no"), F.min("e").alias("e"))
    return n.where("n = size and kinds = 1")


@rule("RPM097", "hoist-common-prefix-from-branches")
def common_prefix(r):
    return at(_edges(r, 0), F.col("e"))


@rule("RPM098", "hoist-common-suffix-from-branches")
def common_suffix(r):
    return at(_edges(r, -1), F.col("e"))


@rule("RPM456", "branch-item-subset")
def item_subset(r):
    c = contents(r).where("other and size = 2 and blocks = 0 and size(items) > 0").select(*_KEY, "no", "line_no", "items")
    a, b = c.where("no = 1"), c.where("no = 2").select(*_KEY, F.col("items").alias("items2"))
    x, y = F.col("items"), F.col("items2")
    strict = lambda p, q: (F.size(F.array_except(p, q)) == 0) & (F.size(F.array_except(q, p)) > 0)
    return at(a.join(b, _KEY).where(strict(x, y) | strict(y, x)))


@rule("RPM105", "inverted-if-else")
def inverted(r):
    return at(extents(r).where((F.col("how") == "if") & (F.col("size") == 2) & F.col("other") & F.col("condition").rlike(r"^!\s*[^&|]*$")), F.col("condition"))


@rule("RPM102", "inequality-redundancy")
def inequality(r):
    m = r"^\(?\s*(\S+)\s*(<=|>=|<|>)\s*([0-9]+)\s*\)?$"
    part = F.trim("p")
    each = r.branches.where(~F.col("condition").contains("||")).select("spec_id", "line_no", F.explode(F.split("condition", "&&")).alias("p")).where(part.rlike(m))
    n = each.groupBy("spec_id", "line_no", F.regexp_extract(part, m, 1).alias("operand"), F.substring(F.regexp_extract(part, m, 2), 1, 1).alias("way")).agg(F.count("*").alias("n"))
    return at(n.where("n > 1"), F.col("operand"))


def _operands(r: Recipes, between: str) -> DataFrame:
    """(spec_id, line_no, left, right): equalities that a condition joins by one operator alone."""
    m = r"^\(?\s*(\S+)\s*==\s*(\S+?)\s*\)?$"
    b = r.branches.where(F.col("condition").contains(between))
    part = F.trim("p")
    return b.select("spec_id", "line_no", F.explode(F.split("condition", F.lit(r"\|\|" if between == "||" else between))).alias("p")).where(part.rlike(m)).select(
        "spec_id", "line_no", F.regexp_extract(part, m, 1).alias("left"), F.regexp_extract(part, m, 2).alias("right")
    )


@rule("RPM104", "string-set-redundancy")
def string_set(r):
    n = _operands(r, "||").groupBy("spec_id", "line_no", "left", "right").agg(F.count("*").alias("n"))
    return at(n.where("n > 1"), F.col("left"))


@rule("RPM443", "equality-chain-to-range")
def equality_chain(r):
    e = _operands(r, "||").withColumn("n", F.col("right").try_cast("int")).where("n is not null").distinct()
    g = e.groupBy("spec_id", "line_no", "left").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    return at(g.where("k >= 3 and hi - lo = k - 1"), F.col("left"))


@rule("RPM432", "condition-common-factor", "allow")
def common_factor(r):
    c = _cubes(r).where("size(cubes) > 1")
    shared = F.aggregate(F.slice("cubes", 2, 64), F.get("cubes", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    return at(c.where(F.size(shared) > 0), F.col("condition"))


@rule("RPM437", "optional-macro-boolean-shortening", "allow")
def boolean_shortening(r):
    return at(r.lines.where(F.col("line").rlike(r"%\{\?(\w+):1\}%\{!\?\1:0\}")))


@rule("RPM438", "empty-optional-macro-arm")
def empty_arm(r):
    return at(r.lines.where(F.col("line").rlike(r"%\{\?(\w+):[^}]+\}%\{!\?\1:\}|%\{!\?(\w+):[^}]+\}%\{\?\2:\}")))


@rule("RPM117", "macro-defined-makes-if-trivial", "allow")
def trivial_by_macro(r):
    """Conditions that name only macros which the recipe itself has defined, literally and once, further up."""
    names = F.array_distinct(F.regexp_extract_all("condition", F.lit(r"%\{?[!?]*([A-Za-z_]\w*)"), 1))
    b = r.branches.where("how in ('if', 'elif')").select("spec_id", "line_no", "how", "condition", names.alias("names")).where("size(names) > 0")
    once = r.macros.groupBy("spec_id", "name").agg(F.count("*").alias("n"), F.min("line_no").alias("def_no"), F.min("value").alias("value"), F.min("depth").alias("d"))
    once = once.where("n = 1 and d = 0 and value not like '%\\%%'").drop("n", "d")
    j = b.select("*", F.explode("names").alias("name")).join(once, ["spec_id", "name"]).where("def_no < line_no")
    g = j.groupBy("spec_id", "line_no", "how", "condition", F.size("names").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("values")).where(F.size("values") == F.col("k"))
    none = F.lit(None)
    told = expressions.branch_truth("how", "condition", "values", none.cast("map<string,boolean>"), none.cast("string"), none.cast("string"))
    return at(g.withColumn("t", told).where("t.truth is not null"), F.col("condition"))


def _neighbours(r: Recipes) -> DataFrame:
    """Blocks of one branch and, with `q_`, the block of one branch that follows with only blank lines between."""
    c = contents(r).where("size = 1").select("spec_id", "depth", "line_no", "end", "how", "condition", "items", "blocks")
    text = r.lines.where(F.trim("line") != "").select("spec_id", "line_no", F.lead("line_no").over(Window.partitionBy("spec_id").orderBy("line_no")).alias("q_line_no"))
    after = text.withColumnRenamed("line_no", "end")
    q = c.select("spec_id", "depth", *(F.col(x).alias(f"q_{x}") for x in ("line_no", "how", "condition", "items", "blocks")))
    return c.join(after, ["spec_id", "end"]).join(q, ["spec_id", "depth", "q_line_no"])


@rule("RPM084", "if-not-x-after-if-x")
def not_x(r):
    n = _neighbours(r)
    pair = F.array(F.col("how"), F.col("q_how"))
    opposed = F.array_contains(pair, "ifarch") & F.array_contains(pair, "ifnarch") | F.array_contains(pair, "ifos") & F.array_contains(pair, "ifnos")
    return at(n.where(opposed & (F.col("condition") == F.col("q_condition"))).withColumn("line_no", F.col("q_line_no")), F.col("condition"))


@rule("RPM444", "adjacent-mutually-exclusive-ifs-to-elif")
def exclusive(r):
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^!\s*", ""), r"^\((.*)\)$", "$1")
    n = _neighbours(r).where("how = 'if' and q_how = 'if'")
    one = F.col("condition").startswith("!") != F.col("q_condition").startswith("!")
    return at(n.where(one & (bare(F.col("condition")) == bare(F.col("q_condition")))), F.col("condition"))


@rule("RPM445", "same-body-different-conditions-merge")
def same_bodies(r):
    n = _neighbours(r).where("how = 'if' and q_how = 'if' and condition <> q_condition and blocks = 0 and q_blocks = 0 and size(items) > 0")
    return at(n.where(F.col("items") == F.col("q_items")), F.col("q_condition"))


@rule("RPM446", "same-body-arch-blocks-to-arch-list")
def same_arch_bodies(r):
    n = _neighbours(r).where("how = 'ifarch' and q_how = 'ifarch' and condition <> q_condition and blocks = 0 and q_blocks = 0 and size(items) > 0")
    return at(n.where(F.col("items") == F.col("q_items")), F.col("q_condition"))


@rule("RPM454", "same-guard-clustering-in-commutative-context")
def clustering_guards(r):
    c = contents(r).where("size = 1 and depth = 1 and blocks = 0 and size(items) > 0 and condition <> ''")
    c = c.where(F.forall("items", lambda t: t.rlike(r"(?i)^(Build)?(Requires|Conflicts)(\([^)]*\))?\s*:|^(Provides|Obsoletes|Recommends|Suggests)\s*:")))
    w = Window.partitionBy("spec_id", "how", "condition").orderBy("line_no")
    return at(c.withColumn("_n", F.row_number().over(w)).where("_n > 1"), F.col("condition"))


@rule("RPM575", "repeated-comment-before-identical-guards", "allow")
def repeated_comment(r):
    before = r.comments.select("spec_id", (F.col("line_no") + 1).alias("line_no"), "text")
    b = r.branches.where("how like 'if%'").join(before, ["spec_id", "line_no"])
    w = Window.partitionBy("spec_id", "condition", "text").orderBy("line_no")
    return at(b.withColumn("_n", F.row_number().over(w)).where("_n > 1"), F.col("text"))


@rule("RPM452", "complementary-guards-same-item")
def complementary(r):
    """A dependency atom that every branch of a chain with an else has."""
    b = extents(r).where("other").select("spec_id", "depth", "chain", "size", F.col("line_no").alias("from"), "next")
    a = r.atoms.select("spec_id", F.col("line_no").alias("l"), "pkg", "key", "atom", "depth", "chain")
    j = a.join(b, ["spec_id", "depth", "chain"]).where("l > from and l < next")
    n = j.groupBy("spec_id", "depth", "chain", "size", "pkg", "key", "atom").agg(F.countDistinct("from").alias("n"), F.min("l").alias("line_no"))
    return at(n.where("n = size"), F.col("atom"))


# Tags and dependencies.


@rule("RPM127", "legacy-license-syntax")
def legacy_license(r):
    """Short names from before SPDX identifiers."""
    old = r"(?:^|[\s(])(?:[AL]?GPLv[0-9.]+\+?|[AL]?GPL\+?|BSD|ASL [0-9.]+|MPLv[0-9.]+|Public Domain|Artistic)(?:$|[\s)])"
    return at(r.tags.where((F.col("key") == "license") & F.col("value").rlike(old)), F.col("value"))


@rule("RPM309", "buildarch-reparse-hazard")
def reparse(r):
    first = r.tags.where("key = 'buildarch'").groupBy("spec_id").agg(F.min("line_no").alias("arch_no"))
    return at(r.macros.where(F.col("value").rlike(r"%\(|%\{lua:")).join(first, "spec_id").where("line_no < arch_no"), F.col("name"))


@rule("RPM312", "spec-filename-mismatch")
def filename(r):
    """Where recipes are known by their file's path."""
    base = F.regexp_extract("spec_id", r"([^/]+)\.spec$", 1)
    n = r.tags.where("key = 'name' and pkg = ''").where((base != "") & (base != F.col("value")) & ~F.col("value").contains("%"))
    return at(n, F.col("value"))


@rule("RPM551", "mixed-subpackage-reference-style")
def mixed_style(r):
    name = r.tags.where("key = 'name' and pkg = ''").select("spec_id", F.col("value").alias("own"))
    s = r.sections.where("pkg <> ''").join(name, "spec_id").withColumn("full", F.expr("replace(pkg, '%{name}', own)"))
    n = s.groupBy("spec_id", "full").agg(F.countDistinct("absolute").alias("n"), F.max("line_no").alias("line_no"))
    return at(n.where("n > 1"), F.col("full"))


@rule("RPM592", "richdep-absorption")
def absorption(r):
    m = r"^\(\s*(\S+)\s+or\s+\(\s*(\S+)\s+and\s+(\S+?)\s*\)\s*\)$"
    other = r"^\(\s*(\S+)\s+and\s+\(\s*(\S+)\s+or\s+(\S+?)\s*\)\s*\)$"
    hit = F.lit(False)
    for p in (m, other):
        x = [F.regexp_extract("atom", p, i) for i in (1, 2, 3)]
        hit = hit | (F.col("atom").rlike(p) & ((x[0] == x[1]) | (x[0] == x[2])))
    return at(r.atoms.where(F.col("rich") & hit), F.col("atom"))


@rule("RPM593", "richdep-common-factor", "allow")
def rich_factor(r):
    m = r"^\(\s*\(\s*(\S+)\s+and\s+(\S+?)\s*\)\s+or\s+\(\s*(\S+)\s+and\s+(\S+?)\s*\)\s*\)$"
    x = [F.regexp_extract("atom", m, i) for i in (1, 2, 3, 4)]
    return at(r.atoms.where(F.col("rich") & F.col("atom").rlike(m) & F.arrays_overlap(F.array(x[0], x[1]), F.array(x[2], x[3]))), F.col("atom"))


@rule("RPM595", "richdep-nested-same-operator-flatten")
def flatten(r):
    return at(r.atoms.where(F.col("rich") & F.col("atom").rlike(r"^\([^()]*\s(and|or)\s+\([^()]*\s\1\s[^()]*\)[^()]*\)$")), F.col("atom"))


#: Commands of build scripts and scriptlets, and what provides them.
BUILD_TOOLS = {
    "cmake": "cmake", "meson": "meson", "ninja": "ninja-build", "autoreconf": "autoconf", "automake": "automake", "libtoolize": "libtool", "pkg-config": "pkgconfig", "pkgconf": "pkgconfig",
    "desktop-file-install": "desktop-file-utils", "desktop-file-validate": "desktop-file-utils", "appstreamcli": "appstream", "update-mime-database": "shared-mime-info",
    "gtk-update-icon-cache": "gtk-update-icon-cache", "glib-compile-schemas": "glib2",
}
SCRIPT_TOOLS = {
    "systemctl": "systemd", "useradd": "shadow-utils", "groupadd": "shadow-utils", "usermod": "shadow-utils", "groupmod": "shadow-utils", "getent": "glibc-common",
    "update-alternatives": "alternatives", "install-info": "info", "glib-compile-schemas": "glib2", "gtk-update-icon-cache": "gtk-update-icon-cache", "update-mime-database": "shared-mime-info",
}
#: Families whose packages these tools' names hold for.
KNOWN_FAMILIES = ("fedora", "rhel", "opensuse", "mageia", "alt")


def _tools(r: Recipes, tools: dict[str, str], key: str, *kinds: str) -> DataFrame:
    """First use of a tool of each package that a recipe doesn't ask for by that name."""
    found = F.regexp_extract("line", r"(?:^\s*|[;&|(]\s*)(?:/usr)?(?:/s?bin/)?(" + "|".join(tools) + r")(?:\s|$)", 1)
    of = F.create_map(*(F.lit(x) for kv in tools.items() for x in kv))
    used = _shell(r, *kinds).withColumn("tool", found).where("tool <> ''").withColumn("name", of[F.col("tool")])
    first = used.groupBy("spec_id", "name").agg(F.min(F.struct("line_no", "tool")).alias("m")).select("spec_id", "name", "m.line_no", "m.tool")
    return first.join(r.atoms.where(F.col("key") == key).select("spec_id", "name").distinct(), ["spec_id", "name"], "left_anti")


@rule("RPM324", "build-tool-used-without-buildrequires", families=KNOWN_FAMILIES)
def build_tool(r):
    return at(_tools(r, BUILD_TOOLS, "buildrequires", *BUILD_SECTIONS), F.col("tool"))


@rule("RPM328", "scriptlet-command-without-requires", families=KNOWN_FAMILIES)
def script_tool(r):
    return at(_tools(r, SCRIPT_TOOLS, "requires", *SCRIPTLETS), F.col("tool"))


@rule("RPM128", "group-tag-required-on-suse", families=("opensuse",))
def group_required(r):
    """The main package and every subpackage must say its group."""
    heads = r.sections.where("kind in ('preamble', 'package')").select("spec_id", "pkg", F.greatest("line_no", F.lit(1)).alias("line_no"))
    return at(heads.join(r.tags.where("key = 'group'").select("spec_id", "pkg").distinct(), ["spec_id", "pkg"], "left_anti"), F.col("pkg"))


@rule("RPM129", "bcond-on-non-fedora", families=("opensuse", "mageia", "alt"))
def foreign_bcond(r):
    return at(r.lines.where(F.col("line").rlike(r"^\s*%bcond_with(out)?\b")))


@rule("RPM307", "patch-status-comment-missing", families=("opensuse",))
def patch_status(r):
    """Markers of a patch's status. The comments right above a patch must hold one."""
    marker = r"PATCH-(?:FIX-|FEATURE-|NEEDS-|PORT-|ENABLE-|DISABLE-|MISSING-TAG)"
    text = r.body.where("kind = 'preamble'").select("spec_id", "line_no", F.trim("line").alias("t")).where("t <> ''")
    w = Window.partitionBy("spec_id").orderBy("line_no")
    run = text.withColumn("note", F.col("t").startswith("#")).withColumn("g", F.sum((~F.col("note")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = run.where(F.col("note") & F.col("t").rlike(marker)).select("spec_id", F.coalesce("g", F.lit(0)).alias("g")).distinct()
    patches = r.tags.where("key = 'patch'").select("spec_id", "line_no", "tag").join(run.select("spec_id", "line_no", F.coalesce("g", F.lit(0)).alias("g")), ["spec_id", "line_no"])
    return at(patches.join(marked, ["spec_id", "g"], "left_anti"), F.col("tag"))


# Shell.


@rule("RPM340", "scriptlet-exit-not-guaranteed-zero")
def exit_zero(r):
    s = _shell(r, "pre", "post", "preun", "postun").where((F.trim("line") != "") & ~F.col("line").rlike(r"^\s*%"))
    last = s.groupBy("spec_id", "sec").agg(F.max(F.struct("line_no", "line")).alias("m")).select("spec_id", "m.line_no", "m.line")
    return at(last.where(~F.col("line").rlike(r"\|\|\s*(:|true|exit 0)|^\s*(:|true|exit 0|fi|done|esac|\})\s*;?\s*$|^\s*/sbin/ldconfig|^\s*(echo|:)\b")), F.trim("line"))


@rule("RPM471", "patch-sequence-to-autopatch")
def patch_sequence(r):
    m = r"^\s*%\{?patch\s*.*?-p\s*(\d+)"
    strips = _shell(r, "prep").where(F.col("line").rlike(m)).groupBy("spec_id").agg(F.countDistinct(F.regexp_extract("line", m, 1)).alias("strips"), F.min("line_no").alias("line_no"))
    declared = _patches(r).groupBy("spec_id").agg(F.countDistinct("patch").alias("declared"))
    applied = _applied(r).groupBy("spec_id").agg(F.countDistinct("patch").alias("applied"))
    return at(strips.join(declared, "spec_id").join(applied, "spec_id").where("strips = 1 and declared = applied and declared > 1"), F.col("declared"))


@rule("RPM475", "redundant-cd-after-setup")
def cd_after_setup(r):
    w = Window.partitionBy("spec_id", "sec").orderBy("line_no")
    p = r.body.where("kind = 'prep'").where(F.trim("line") != "").withColumn("before", F.lag("line").over(w))
    return at(p.where(F.col("before").rlike(r"^\s*%(?:auto)?setup\b") & F.col("line").rlike(r"^\s*cd\s+%\{name\}-%\{version\}\s*$")))


def _pairs(r: Recipes, first: str, second: str, *kinds: str) -> DataFrame:
    """Lines that match `second` right after one that matches `first`; a and b are what their patterns' first groups matched."""
    w = Window.partitionBy("spec_id", "sec").orderBy("line_no")
    s = _shell(r, *kinds).where(F.trim("line") != "").withColumn("before", F.lag("line").over(w))
    return s.where(F.col("line").rlike(second) & F.col("before").rlike(first)).select("spec_id", "line_no", F.regexp_extract("before", first, 1).alias("a"), F.regexp_extract("line", second, 1).alias("b"))


_MKDIR = r"^\s*(?:mkdir\s+-p|install\s+-d)\s+(\S+?)/?\s*$"


@rule("RPM530", "mkdir-install-to-install-d")
def mkdir_install(r):
    return at(_pairs(r, _MKDIR, r"^\s*install\s+(?!.*-D)(?:-\S+\s+)*\S+\s+(\S+)/[^/\s]+\s*$", "install").where("a = b"), F.col("a"))


@rule("RPM531", "redundant-mkdir-before-install-d")
def mkdir_install_d(r):
    return at(_pairs(r, _MKDIR, r"^\s*install\s+(?=.*-D)(?:-\S+\s+)*\S+\s+(\S+)/[^/\s]+\s*$", "install").where("a = b"), F.col("a"))


@rule("RPM533", "cp-chmod-to-install-m", "allow")
def cp_chmod(r):
    return at(_pairs(r, r"^\s*cp\s+(?:-\S+\s+)*\S+\s+(\S+)\s*$", r"^\s*chmod\s+\S+\s+(\S+)\s*$", "install").where("a = b"), F.col("a"))


@rule("RPM536", "near-duplicate-shell-block", "allow")
def near_block(r):
    """Three lines in a row of as many words that differ in one place, the same in all."""
    w = Window.partitionBy("spec_id", "sec").orderBy("line_no")
    s = _shell(r).where(F.trim("line") != "").withColumn("t", F.split(F.trim("line"), r"\s+"))
    s = s.withColumn("t1", F.lead("t", 1).over(w)).withColumn("t2", F.lead("t", 2).over(w)).where("size(t) > 2 and size(t) = size(t1) and size(t) = size(t2)")

    def places(a: str, b: str) -> Column:
        return F.filter(F.transform(F.arrays_zip(a, b), lambda p, i: F.when(p[a] != p[b], i)), lambda i: i.isNotNull())

    return at(s.where((F.size(places("t", "t1")) == 1) & (places("t", "t1") == places("t1", "t2")) & (places("t", "t1") == places("t", "t2"))), F.trim("line"))


# Macros.


@rule("RPM495", "unused-macro-parameter")
def unused_parameter(r):
    m = r.macros.where("options <> ''").select("*", F.explode(F.regexp_extract_all("options", F.lit("([A-Za-z])"), 1)).alias("flag"))
    whole = F.col("value").contains("%*") | F.col("value").rlike(r"%\{lua:")
    return at(m.where(~whole & ~F.expr("contains(value, concat('-', flag))")), F.concat_ws(" -", "name", "flag"))


@rule("RPM496", "macro-called-always-with-same-argument", "allow")
def same_argument(r):
    m = r.macros.where("options <> ''").select("spec_id", F.col("line_no").alias("def_no"), "name")
    call = r"^\s*%([A-Za-z_]\w*)\s+(\S.*?)\s*$"
    c = r.lines.where(F.col("line").rlike(call)).select("spec_id", "line_no", F.regexp_extract("line", call, 1).alias("name"), F.regexp_extract("line", call, 2).alias("arg"))
    n = c.join(m, ["spec_id", "name"]).groupBy("spec_id", "name", "def_no").agg(F.count("*").alias("n"), F.countDistinct("arg").alias("kinds"))
    return at(n.where("n > 1 and kinds = 1").withColumnRenamed("def_no", "line_no"), F.col("name"))


# Files.


@rule("RPM514", "files-glob-subsumes-explicit-entry")
def glob_subsumes(r):
    same = ["is_config", "is_ghost", "is_doc", "is_license", "is_dir", "mode"]
    glob = r.files.where("is_glob").select("spec_id", "sec", F.col("path").alias("glob"), *(F.col(c).alias(f"g_{c}") for c in same))
    like = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("glob", r"([.+(){}|^$%\\])", r"\\$1"), r"\*", "[^/]*"), r"\?", "[^/]"), F.lit("$"))
    j = r.files.where("not is_glob").join(glob, ["spec_id", "sec"]).withColumn("like", like)
    alike = F.lit(True)
    for c in same:
        alike = alike & (F.col(c) == F.col(f"g_{c}"))
    return at(j.where(alike & F.expr("path rlike like")).dropDuplicates(["spec_id", "line_no"]), F.col("path"))


@rule("RPM516", "repeated-files-prefix-to-directory-entry", "allow")
def repeated_prefix(r):
    p = r.files.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).where(F.size(F.split("dir", "/")) > 2)
    n = p.groupBy("spec_id", "sec", "dir").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    return at(n.where("n >= 4"), F.col("dir"))


@rule("RPM517", "files-section-sort-blocks", "allow")
def files_order(r):
    group = F.when(F.col("is_license"), 1).when(F.col("is_doc"), 2).when(F.col("is_config"), 3).otherwise(4)
    w = Window.partitionBy("spec_id", "sec").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    f = r.files.withColumn("g", group)
    late = f.withColumn("_max", F.max("g").over(w)).where("g < _max")
    return at(late.groupBy("spec_id", "sec").agg(F.min("line_no").alias("line_no")))


# Conditions under what holds around them, as propositions.


def _under(df: DataFrame, text: Column) -> DataFrame:
    """df with `cubes` of a combined condition: none are left if it can't hold; null where it isn't understood."""
    return df.withColumn("joint", text).withColumn("cubes", expressions.condition_cubes("joint"))


def _both(a: str, b: str, *, negated: bool = False) -> Column:
    return F.concat(F.lit("("), F.col(a), F.lit(") && !(" if negated else ") && ("), F.col(b), F.lit(")"))


def _nested_conditions(r: Recipes) -> DataFrame:
    return parents(r).where("how in ('if', 'elif') and p_how in ('if', 'elif') and condition <> '' and p_condition <> '' and condition <> p_condition")


@rule("RPM113", "unreachable-branch-under-parent")
def unreachable_under_parent(r):
    return at(_under(_nested_conditions(r), _both("p_condition", "condition")).where("size(cubes) = 0"), F.col("condition"))


@rule("RPM114", "always-true-branch-under-parent")
def always_under_parent(r):
    return at(_under(_nested_conditions(r).where("how = 'if'"), _both("p_condition", "condition", negated=True)).where("size(cubes) = 0"), F.col("condition"))


def _chains(r: Recipes) -> DataFrame:
    """Branches of chains of %if and %elif with `before`: all earlier conditions of the chain, joined by or."""
    w = Window.partitionBy(*_KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    c = extents(r).where("how in ('if', 'elif', 'else')")
    part = F.concat(F.lit("("), F.col("condition"), F.lit(")"))
    return c.withColumn("before", F.array_join(F.collect_list(F.when(F.col("condition") != "", part)).over(w), " || "))


@rule("RPM115", "dead-elif-after-parent")
def dead_elif(r):
    c = _chains(r).where("how = 'elif' and condition <> '' and before <> ''")
    return at(_under(c, _both("condition", "before", negated=True)).where("size(cubes) = 0"), F.col("condition"))


@rule("RPM116", "mutex-branches-spell-out-else")
def spelt_out_else(r):
    c = _chains(r).where("how = 'elif' and no = size and not other and condition <> '' and before <> ''")
    text = F.concat(F.lit("!("), F.col("before"), F.lit(") && !("), F.col("condition"), F.lit(")"))
    return at(_under(c, text).where("size(cubes) = 0"), F.col("condition"))


@rule("RPM101", "absorption-in-expr")
def absorbed(r):
    m = r"^\(?\s*([^\s()&|]+)\s*\)?\s*(\|\||&&)\s*\(\s*(?:\1\s*(?:&&|\|\|)|.*(?:&&|\|\|)\s*\1\s*\))"
    return at(r.branches.where(F.col("condition").rlike(m)), F.col("condition"))


@rule("RPM119", "common-leaf-line-hoistable")
def hoistable_leaf(r):
    """A line that every branch of a chain with an else has, directly or in every branch of a chain with an else inside it."""
    c = contents(r).where("size > 1 and other")
    direct = c.select("spec_id", "depth", "chain", "line_no", "size", F.explode(F.array_distinct("items")).alias("t"))
    full = direct.groupBy("spec_id", "depth", "chain", "size", "t").agg(F.count("*").alias("n"), F.min("line_no").alias("first")).where("n = size")
    inner = full.select("spec_id", F.col("depth").alias("i_depth"), F.col("chain").alias("i_chain"), "t")
    outer = parents(r).where("no = 1").select("spec_id", F.col("depth").alias("i_depth"), F.col("chain").alias("i_chain"), F.col("p_line_no").alias("line_no"))
    lifted = inner.join(outer, ["spec_id", "i_depth", "i_chain"]).select("spec_id", "line_no", "t")
    keys = c.select("spec_id", "depth", "chain", "line_no", "size")
    every = direct.select("spec_id", "depth", "chain", "line_no", "size", "t").unionByName(lifted.join(keys, ["spec_id", "line_no"]).select("spec_id", "depth", "chain", "line_no", "size", "t")).distinct()
    n = every.groupBy("spec_id", "depth", "chain", "size", "t").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no")).where("n = size")
    return at(n.join(full.select("spec_id", "depth", "chain", "t"), ["spec_id", "depth", "chain", "t"], "left_anti"), F.col("t"))
