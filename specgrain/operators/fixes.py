"""Safe fixes of recipes: line rewrites and dropped lines, as column expressions over the lines of all recipes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.recipes import BUILD_SECTIONS, SCRIPTLETS, parse
from .recipe_rules import lint

_SHELL = (*BUILD_SECTIONS, *SCRIPTLETS)
#: rule -> (kinds of section, or none for all; pattern; replacement), in the order in which they are applied.
REWRITES = {
    "RPM052": ((), r"[ \t]+$", ""),
    "RPM051": ((), r"^( *)\t", "$1        "),
    "RPM055": (("preamble", "package"), r"^(Summary(?:\([^)]*\))?\s*:.*[^.])\.$", "$1"),
    "RPM053": (_SHELL, r"\$\{RPM_BUILD_ROOT\}|\$RPM_BUILD_ROOT\b", "%{buildroot}"),
    "RPM054": (_SHELL, r"\$\{RPM_SOURCE_DIR\}|\$RPM_SOURCE_DIR\b", "%{_sourcedir}"),
    "RPM062": (_SHELL, r"(^|[;&|(]\s*|\s)([ef])grep\s", "$1grep -$2 "),
    "RPM063": (("prep",), r"^(\s*%setup)(?!.*\s-\w*q)(\s|$)", "$1 -q$2"),
    "RPM087": ((), r"^(\s*%(?:if|elif)\s.*?)!\s*!", "$1"),
    "RPM382": (("install",), r"^(\s*)%\{?makeinstall\}?", "$1%make_install"),
    "RPM472": (("prep",), r"^(\s*%(?:auto)?setup\b.*?)\s+-n\s+%\{name\}-%\{version\}(\s|$)", "$1$2"),
    "RPM490": ((), r"%\{_prefix\}/(bin|sbin|include|libexec|share)\b", "%{_PATH_$1}"),
}
#: Rules whose findings name lines to drop.
DROPS = ("RPM020", "RPM035", "RPM512")
ROUNDS = 8


def rewritten(body: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Lines (spec_id, line_no, line) after the rewrites of the given rules, or of all."""
    line = F.col("line")
    for id, (kinds, pattern, text) in REWRITES.items():
        if rules is None or id in rules:
            new = F.regexp_replace(line, pattern, text)
            if id == "RPM062":
                new = F.regexp_replace(F.regexp_replace(new, r"grep -e ", "grep -E "), r"grep -f ", "grep -F ")
            if id == "RPM490":
                for part, name in (("bin", "bindir"), ("sbin", "sbindir"), ("include", "includedir"), ("libexec", "libexecdir"), ("share", "datadir")):
                    new = F.regexp_replace(new, r"%\{_PATH_" + part + r"\}", "%{_" + name + "}")
            line = F.when(F.col("kind").isin(*kinds), new).otherwise(line) if kinds else new
    return body.select("spec_id", "line_no", line.alias("line"))


def fix_once(sources: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """(spec_id, text) after one round of fixes."""
    r = parse(sources)
    heads = r.lines.where("head").select("spec_id", "line_no", F.regexp_replace("line", r"[ \t]+$", "").alias("line"))
    lines = rewritten(r.body, rules).unionByName(heads)
    drops = [x for x in DROPS if rules is None or x in rules]
    if drops:
        lines = lines.join(lint(r, drops).select("spec_id", "line_no").distinct(), ["spec_id", "line_no"], "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    fixed = lines.groupBy("spec_id").agg(text.alias("text"))
    return sources.select("spec_id", F.col("text").alias("_old")).join(fixed, "spec_id", "left").select("spec_id", F.coalesce("text", "_old").alias("text"))


def fix(sources: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """(spec_id, text, changed) after rounds of fixes until nothing changes, ROUNDS at most."""
    from ..session import stored

    cur = sources.select("spec_id", "text")
    for _ in range(ROUNDS):
        nxt = stored(fix_once(cur, rules), "recipe-fixes")
        same = nxt.join(cur.withColumnRenamed("text", "before"), "spec_id").where(~F.col("text").eqNullSafe(F.col("before"))).isEmpty()
        cur = nxt
        if same:
            break
    before = sources.select("spec_id", F.col("text").alias("before"))
    return cur.join(before, "spec_id").select("spec_id", "text", (~F.col("text").eqNullSafe(F.col("before"))).alias("changed"))
