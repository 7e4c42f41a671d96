"""Recipe (spec) files as relations: lines are numbered, placed in sections and branches by windows, and cut by patterns. No UDF."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from . import shell

BUILD_SECTIONS = ("prep", "generate_buildrequires", "conf", "build", "install", "check", "clean")
SCRIPTLETS = ("pre", "post", "preun", "postun", "pretrans", "posttrans", "preuntrans", "postuntrans", "verifyscript", "triggerprein", "triggerin", "triggerun", "triggerpostun",
              "filetriggerin", "filetriggerun", "filetriggerpostun", "transfiletriggerin", "transfiletriggerun", "transfiletriggerpostun")
OTHER_SECTIONS = ("package", "description", "files", "changelog", "sourcelist", "patchlist")
DEPENDENCY_TAGS = ("requires", "buildrequires", "provides", "obsoletes", "conflicts", "buildconflicts", "recommends", "suggests", "supplements", "enhances",
                   "orderwithrequires", "prereq", "buildprereq")

_SECTION = r"^%(" + "|".join(sorted((*BUILD_SECTIONS, *SCRIPTLETS, *OTHER_SECTIONS), key=len, reverse=True)) + r")(?:\s+(.*?))?\s*$"
_IF = r"^\s*%(if|ifarch|ifnarch|ifos|ifnos)\b\s*(.*?)\s*$"
_ELSE = r"^\s*%(elif|elifarch|elifos|else)\b\s*(.*?)\s*$"
_END = r"^\s*%endif\b"
_TAG = r"^([A-Za-z][A-Za-z]*?)([0-9]*)(?:\(([^)]*)\))?\s*:\s*(.*?)\s*$"
_DEFINE = r"^\s*%(?:\{!\?[A-Za-z_]\w*:\s*%)?(global|define)\s+([A-Za-z_]\w*)(\([^)]*\))?\s+(.*?)\s*$"
ATOM = r"\(.*\)|[^\s,<>=]+(?:\s*(?:<=|>=|=|<|>)\s*[^\s,]+)?"


@dataclass
class Recipes:
    """The relations of a set of recipes. Every one has spec_id and line_no; those with a place in a branch have depth (0: unconditional)."""

    lines: DataFrame
    sections: DataFrame
    tags: DataFrame
    atoms: DataFrame
    body: DataFrame
    files: DataFrame
    changelog: DataFrame
    comments: DataFrame
    macros: DataFrame
    branches: DataFrame

    @cached_property
    def commands(self) -> DataFrame:
        """The commands of build sections and scriptlets (shell.commands)."""
        plain = self.body.where("not (opens or closes or turns)")
        return shell.commands(plain.where(F.col("kind").isin(*BUILD_SECTIONS, *SCRIPTLETS)))

    @property
    def specs(self) -> DataFrame:
        # Every text has a first line.
        return self.lines.where("line_no = 1").select("spec_id").distinct()


class Kept(Recipes):
    """Relations of which each is stored when it is first asked for, so that nothing is written that no rule reads."""

    def __init__(self, relations: dict[str, DataFrame]):
        self._relations = relations

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._relations:
            raise AttributeError(name)
        setattr(self, name, stored(self._relations[name], f"recipe-{name}"))
        return getattr(self, name)


def read_recipes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(spec_id, path, text) of recipe files; spec_id is the path."""
    t = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return t.select(F.col("path").alias("spec_id"), "path", "text")


def _running(c: Column, w) -> Column:
    return F.sum(c).over(w)


def parse(sources: DataFrame, keep: bool = False) -> Recipes:
    """Relations of sources (spec_id, text). Continuation lines of conditionals aren't joined; a null text has no lines.

    Sources that are partitioned by spec_id (session.dealt) stay so, and no line is shuffled. With keep the placed lines are stored, and a relation taken from them when it is first asked for,
    so that many rules scan them instead of cutting and windowing the texts again.
    """
    raw = sources.where("text is not null").select("spec_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("spec_id").orderBy("pos")
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    percent = F.ltrim("line").startswith("%")
    opens, closes, turns = (percent & F.col("line").rlike(x) for x in (_IF, _END, _ELSE))
    head = F.col("line").startswith("%") & F.col("line").rlike(_SECTION)
    kind = F.regexp_extract("line", _SECTION, 1)
    args = F.coalesce(F.regexp_extract("line", _SECTION, 2), F.lit(""))
    absolute = F.regexp_extract("args", r"-n\s+(\S+)", 1)
    relative = F.regexp_extract(F.regexp_replace("args", r"-[npfq]\s+\S+|--?[a-z]+\b", " "), r"^\s*([^\s-]\S*)", 1)
    pkg = F.when(F.col("kind") == "changelog", "").when(absolute != "", absolute).when(relative != "", F.concat(F.lit("%{name}-"), relative)).otherwise("")
    lines = raw.select(
        "spec_id", (F.col("pos") + 1).cast("int").alias("line_no"), "pos", "line", opens.alias("opens"), closes.alias("closes"), turns.alias("turns"), head.alias("head")
    )
    lines = lines.withColumns({"kind": F.when(F.col("head"), kind), "args": F.when(F.col("head"), args)}).withColumn("pkg", F.when(F.col("head"), pkg))
    number = lambda c: F.col(c).cast("int")
    lines = lines.select(
        *lines.columns, _running(number("head"), to_here).alias("sec"), (_running(number("opens"), to_here) - _running(number("closes"), to_here) + number("closes")).alias("depth"),
        F.last(F.when(F.col("head"), F.struct("kind", "pkg")), True).over(to_here).alias("in"),
    )
    # Depth inside the line's own block: an opening line counts, a closing one still does.
    lines = lines.withColumn("depth", F.greatest("depth", F.lit(0)))
    at_depth = Window.partitionBy("spec_id", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("chain", F.when(F.col("depth") > 0, F.last(F.when(F.col("opens"), F.col("line_no")), True).over(at_depth)))
    placed = ["spec_id", "line_no", "pos", "line", "opens", "closes", "turns", "head", "sec", "depth", "chain"]
    lines = lines.select(*placed, "args", F.coalesce("in.kind", F.lit("preamble")).alias("kind"), F.coalesce("in.pkg", F.lit("")).alias("pkg"))
    if keep:
        lines = stored(lines, "recipe-lines")
    heads = lines.where("head").select("spec_id", "sec", "line_no", "depth", "kind", "args", "pkg", (absolute != "").alias("absolute"))
    first = lines.where("sec = 0 and line_no = 1").select("spec_id").distinct()
    first = first.select("spec_id", F.lit(0).cast("long").alias("sec"), F.lit(0).alias("line_no"), F.lit(0).cast("long").alias("depth"), F.lit("preamble").alias("kind"), F.lit("").alias("args"), F.lit("").alias("pkg"), F.lit(False).alias("absolute"))
    sections = first.unionByName(heads)
    body = lines.where("not head and spec_id is not null").select("spec_id", "sec", *(c for c in placed if c not in ("spec_id", "sec")), "kind", "pkg")
    lines = lines.select(*placed)
    plain = body.where("not (opens or closes or turns)")
    comment = F.col("line").rlike(r"^\s*#")
    tagged = plain.where(F.col("kind").isin("preamble", "package") & ~comment & F.col("line").rlike(_TAG)).select(
        "spec_id", "line_no", "sec", "pkg", "depth", "chain", F.regexp_extract("line", _TAG, 1).alias("tag"), F.regexp_extract("line", _TAG, 2).alias("number"),
        F.regexp_extract("line", _TAG, 3).alias("qualifiers"), F.regexp_extract("line", _TAG, 4).alias("value"),
    ).withColumn("key", F.lower("tag"))
    atom = F.col("atom")
    op = F.regexp_extract(atom, r"(<=|>=|=|<|>)", 1)
    bare = F.trim(F.regexp_extract(atom, r"^([^\s,<>=]+)", 1))
    rich = atom.startswith("(")
    atoms = tagged.where(F.col("key").isin(*DEPENDENCY_TAGS)).select(
        "*", F.explode(F.regexp_extract_all("value", F.lit(ATOM), 0)).alias("atom")
    ).select(
        "spec_id", "line_no", "pkg", "depth", "chain", "key", "qualifiers", F.trim(atom).alias("atom"), rich.alias("rich"), F.when(rich, F.trim(atom)).otherwise(bare).alias("name"),
        F.when(~rich & (op != ""), op).alias("op"), F.when(~rich & (op != ""), F.trim(F.regexp_extract(atom, r"(?:<=|>=|=|<|>)\s*(\S+)$", 1))).alias("evr"),
    )
    entry = F.trim("line")
    in_files = plain.where((F.col("kind") == "files") & ~comment & (entry != ""))
    path = F.element_at(F.split(F.trim(F.regexp_replace(entry, r"%(?:attr|verify|lang|config|caps)\s*\([^)]*\)|%(?:config|doc|license|dir|ghost|docdir|exclude|artifact|missingok|readme)\b", " ")), r"\s+"), 1)
    files = in_files.where(~F.col("line").rlike(r"^\s*%(?:defattr|defverify|define|global)")).select(
        "spec_id", "line_no", "sec", "pkg", "depth", "line", path.alias("path"), entry.rlike(r"%config\b").alias("is_config"), entry.rlike(r"%config\s*\(\s*[^)]*noreplace").alias("noreplace"),
        entry.rlike(r"%ghost\b").alias("is_ghost"), entry.rlike(r"%doc\b").alias("is_doc"), entry.rlike(r"%license\b").alias("is_license"), entry.rlike(r"%dir\b").alias("is_dir"),
        entry.rlike(r"%lang\s*\(").alias("has_lang"), F.regexp_extract(entry, r"%attr\s*\(\s*([0-7]+)", 1).alias("mode"), path.rlike(r"[*?\[]").alias("is_glob"),
    )
    log = plain.where("kind = 'changelog'")
    star = r"^\*\s+(\w{3})\w*\s+(\w{3})\w*\s+([0-9]{1,2})(?:\s+[0-9:]+\s+\S+)?\s+([0-9]{4})\s*(.*?)\s*$"
    entries = log.withColumn("entry", _running(F.col("line").startswith("*").cast("int"), to_here)).where("entry > 0")
    months = F.array(*(F.lit(m) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")))
    lead = entries.where(F.col("line").startswith("*")).select(
        "spec_id", "line_no", "sec", "entry", F.regexp_extract("line", star, 1).alias("weekday"), F.array_position(months, F.regexp_extract("line", star, 2)).cast("int").alias("month"),
        F.regexp_extract("line", star, 3).try_cast("int").alias("day"), F.regexp_extract("line", star, 4).try_cast("int").alias("year"), F.regexp_extract("line", star, 5).alias("rest"),
    )
    said = entries.where(~F.col("line").startswith("*") & (F.trim("line") != "")).groupBy("spec_id", "entry").agg(F.count("*").alias("body_lines"))
    changelog = lead.join(said, ["spec_id", "entry"], "left").withColumn("body_lines", F.coalesce("body_lines", F.lit(0)))
    changelog = changelog.withColumn("date", F.when(F.col("month").between(1, 12), F.expr("try_to_date(format_string('%04d-%02d-%02d', year, month, day), 'yyyy-MM-dd')")))
    comments = body.where(comment).select("spec_id", "line_no", "sec", "kind", F.trim("line").alias("text"))
    macros = plain.where(F.col("line").rlike(_DEFINE)).select(
        "spec_id", "line_no", "depth", "chain", F.regexp_extract("line", _DEFINE, 1).alias("how"), F.regexp_extract("line", _DEFINE, 2).alias("name"),
        F.regexp_extract("line", _DEFINE, 3).alias("options"),
        # The brace that closes an unless-defined wrapper isn't the value's.
        F.when(F.col("line").rlike(r"^\s*%\{!\?"), F.regexp_replace(F.regexp_extract("line", _DEFINE, 4), r"\s*\}$", "")).otherwise(F.regexp_extract("line", _DEFINE, 4)).alias("value"),
    )
    branches = body.where("opens or turns").select(
        "spec_id", "line_no", "chain", "depth", "sec",
        F.when(F.col("opens"), F.regexp_extract("line", _IF, 1)).otherwise(F.regexp_extract("line", _ELSE, 1)).alias("how"),
        F.regexp_replace(F.when(F.col("opens"), F.regexp_extract("line", _IF, 2)).otherwise(F.regexp_extract("line", _ELSE, 2)), r"\s+", " ").alias("condition"),
    )
    if keep:
        kept = Kept({"sections": sections, "tags": tagged, "atoms": atoms, "files": files, "changelog": changelog, "comments": comments, "macros": macros, "branches": branches})
        kept.lines, kept.body = lines, body
        return kept
    return Recipes(lines, sections, tagged, atoms, body, files, changelog, comments, macros, branches)
