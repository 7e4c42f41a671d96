"""What each profile sees of a recipe: branches decided with the recipe's own macros, and its active tags, dependencies and files with their macros filled in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions
from ..functions.macros import references
from ..session import stored
from ..sources.recipes import Recipes

#: Tags of the main package that are macros from their line on.
OWN_TAGS = ("name", "version", "release", "epoch", "url")
#: Forms that plain filling can't tell: shell, expressions, conditional references, arguments.
_ODD = r"%\(|%\[|%\{[!?]|%\{[A-Za-z_]\w*[:\s]"
#: References in conditions.
_CALLED = r"%\{?[!?]*([A-Za-z_]\w*)"
_PLACE = ["spec_id", "profile_id", "line_no"]
_RUN = ["spec_id", "run"]


@dataclass
class Projection:
    """branches: branch columns, profile_id, truth, reason, selected. definitions (spec_id, profile_id, line_no, name, value): active ones, value null where it can't be told.
    tags, atoms and files: those of the recipes that a profile sees, with profile_id and `told` (the value, atom or path with its macros filled in, else null)."""

    branches: DataFrame
    definitions: DataFrame
    tags: DataFrame
    atoms: DataFrame
    files: DataFrame


def with_ends(r: Recipes) -> DataFrame:
    """Branches with `next`, the line of the chain's next branch or of its end; chains that don't end are left out."""
    w = Window.partitionBy("spec_id", "depth", "chain").orderBy("line_no")
    ends = r.body.where("closes and chain is not null").groupBy("spec_id", "depth", "chain").agg(F.min("line_no").alias("end"))
    b = r.branches.join(_merged(ends), ["spec_id", "depth", "chain"])
    return b.withColumn("next", F.coalesce(F.lead("line_no").over(w), F.col("end"))).drop("end", "sec")


def _merged(rows: DataFrame) -> DataFrame:
    """rows that a join sorts and merges in each partition, on disk if need be. Without it Spark goes by a stored table's compressed files, and sends what is 30 to 170 times their size through the driver."""
    return rows.hint("merge")


def visible(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """rows (spec_id, profile_id, line_no) that lie in no branch that the profile doesn't select."""
    off = selected.where("not selected").select(F.col("spec_id").alias("_s"), F.col("profile_id").alias("_p"), F.col("line_no").alias("_from"), F.col("next").alias("_next"))
    inside = (F.col("spec_id") == F.col("_s")) & (F.col("profile_id") == F.col("_p")) & (F.col("line_no") > F.col("_from")) & (F.col("line_no") < F.col("_next"))
    return rows.join(off, inside, "left_anti")


def as_of(uses: DataFrame, definitions: DataFrame, macros: DataFrame) -> DataFrame:
    """uses (spec_id, profile_id, line_no, name) with value: the profile's macro, else that of the last active definition above the line; null without one or where that can't be told.

    One window over uses and definitions together, so no pair of a use and an earlier definition is ever made. `known` says whether there is one at all.
    """
    rows = uses.select(*_PLACE, "name", F.lit(None).cast("string").alias("given"), F.lit(False).alias("defines"))
    rows = rows.unionByName(definitions.select(*_PLACE, "name", F.col("value").alias("given"), F.lit(True).alias("defines")))
    w = Window.partitionBy("spec_id", "profile_id", "name").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("defines"), F.struct("given")), True).over(w)
    found = rows.withColumn("last", last).where("not defines").drop("defines", "given")
    own = macros.select("profile_id", "name", F.col("value").alias("own"), F.lit(True).alias("mine"))
    j = found.join(own, ["profile_id", "name"], "left")
    mine = F.coalesce("mine", F.lit(False))
    return j.select(*_PLACE, "name", F.when(mine, F.col("own")).otherwise(F.col("last.given")).alias("value"), (mine | F.col("last").isNotNull()).alias("known"))


def fill(text: Column, known: Column) -> Column:
    """text with %name and %{name} replaced from a map; null if one isn't in it or a form is odd. %% becomes a percent sign."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "%%", "\u0001"), r"%\{([A-Za-z_]\w*)\}", "\u0002$1\u0003"), r"%([A-Za-z_]\w*)", "\u0002$1\u0003")
    pieces = F.split(marked, "\u0002")
    done = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(known[F.substring_index(p, "\u0003", 1)], F.substring_index(p, "\u0003", -1))))
    lost = F.exists(done, lambda p: p.isNull())
    return F.when(~text.rlike(_ODD) & ~lost, F.regexp_replace(F.array_join(done, ""), "\u0001", "%"))


def filled(rows: DataFrame, column: str, definitions: DataFrame, macros: DataFrame) -> DataFrame:
    """rows with `told`: the column filled with what its macros stand for at its line. Each text of a line is filled once."""
    texts = rows.select(*_PLACE, column).distinct()
    uses = texts.select(*_PLACE, F.explode(F.array_distinct(references(F.col(column)))).alias("name")).distinct()
    values = as_of(uses, definitions, macros).where("value is not null")
    maps = values.groupBy(*_PLACE).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_known"))
    j = rows.join(maps, _PLACE, "left").withColumn("_known", F.coalesce("_known", F.create_map().cast("map<string,string>")))
    return j.withColumn("told", fill(F.col(column), F.col("_known"))).drop("_known")


def _merge(bits: Column) -> Column:
    """Bits that any of an array's elements (with `who`) has."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(h["who"]))


def _holding(name: Column, line: Column) -> Column:
    """What a name stands for above a line, as an array of (value, known, who) whose bits share out all profiles of the run: the profile's own macro, else the last active definition's value.

    Reads the columns own, defs (by line) and everyone of the recipe's row; `known` says whether there is a value or definition at all.
    """
    mine = F.flatten(F.transform(F.filter("own", lambda o: o["name"] == name), lambda o: o["held"]))
    above = F.reverse(F.filter("defs", lambda d: (d["name"] == name) & (d["line_no"] < line)))
    held = lambda value, known, who: F.array(F.struct(value.alias("value"), F.lit(known).alias("known"), who.alias("who")))
    rest = lambda who, taken: who.bitwiseAND(F.bitwise_not(taken))
    return F.aggregate(
        above, F.struct(mine.alias("held"), _merge(mine).alias("taken")),
        lambda a, d: F.struct(F.concat(a["held"], held(d["value"], True, rest(d["who"], a["taken"]))).alias("held"), a["taken"].bitwiseOR(d["who"]).alias("taken")),
        lambda a: F.filter(F.concat(a["held"], held(F.lit(None).cast("string"), False, rest(F.col("everyone"), a["taken"]))), lambda h: h["who"] != 0),
    )


def _cases(axes: Column, who: Column) -> Column:
    """All combinations (vals, who) of one element (value, known, who) of each axis that some profile of `who` has; their bits don't overlap, so there are at most 64."""
    start = F.array(F.struct(F.array().cast("array<struct<value:string,known:boolean>>").alias("vals"), who.alias("who")))
    both = lambda a, h: F.struct(F.concat(a["vals"], F.array(F.struct(h["value"].alias("value"), h["known"].alias("known")))).alias("vals"), a["who"].bitwiseAND(h["who"]).alias("who"))
    some = lambda cases: F.filter(cases, lambda c: c["who"] != 0)
    return F.aggregate(axes, some(start), lambda acc, axis: some(F.flatten(F.transform(acc, lambda a: F.transform(axis, lambda h: both(a, h))))))


def _shown() -> Column:
    """The profiles that see a line: those with no branch around it (offs) that they don't select."""
    around = F.filter("offs", lambda o: (o["line_no"] < F.col("line_no")) & (o["next"] > F.col("line_no")))
    return F.col("everyone").bitwiseAND(F.bitwise_not(_merge(around)))


def _named(column: str) -> Column:
    return F.array_distinct(references(F.col(column)))


def _fill_cases(rows: DataFrame, column: str, who: Column) -> DataFrame:
    """rows of recipes' lines joined with their recipe's row, once for each case of the values of the macros in a column: `told` and who."""
    cases = rows.withColumn("_names", _named(column)).withColumn("_case", F.explode(_cases(F.transform("_names", lambda n: _holding(n, F.col("line_no"))), who)))
    entries = F.transform("_names", lambda n, i: F.struct(n.alias("name"), F.col("_case.vals")[i]["value"].alias("value")))
    known = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return cases.withColumn("told", fill(F.col(column), known)).withColumn("who", F.col("_case.who"))


def _each_profile() -> Column:
    """The profiles whose bits `who` has."""
    return F.explode(F.filter("ids", lambda x, i: F.call_function("getbit", F.col("who"), i) == 1))


def _each_place() -> Column:
    """Bit and profile of those whose bits `who` has."""
    return F.inline(F.filter(F.transform("ids", lambda x, i: F.struct(i.alias("p"), x.alias("profile_id"))), lambda x: F.call_function("getbit", F.col("who"), x["p"]) == 1))


def _runs(profiles: DataFrame, macros: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles in runs of 64 (run, everyone, ids by bit, archs, oses), and (name, run, held): what each name stands for among the profiles' own macros."""
    who = F.expr("shiftleft(1L, int(no % 64))")
    p = profiles.select("profile_id", "arch", "os").distinct().orderBy("profile_id").select("*", F.monotonically_increasing_id().alias("no"))
    p = stored(p.select("profile_id", "arch", "os", F.expr("no div 64").alias("run"), F.expr("no % 64").alias("bit"), who.alias("who")), "project-profiles")
    held = lambda value, known: F.collect_list(F.struct(value.alias("value"), F.lit(known).alias("known"), F.col("who")))
    by = lambda column: p.groupBy("run", column).agg(F.bit_or("who").alias("who")).groupBy("run").agg(held(F.col(column), False).alias(f"{column}s"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("bit", "profile_id"))), lambda x: x["profile_id"])
    runs = stored(p.groupBy("run").agg(F.bit_or("who").alias("everyone"), ids.alias("ids")).join(by("arch"), "run").join(by("os"), "run"), "project-runs")
    own = macros.select("profile_id", "name", "value").join(p.select("profile_id", "run", "who"), "profile_id").groupBy("name", "run", "value").agg(F.bit_or("who").alias("who"))
    return runs, own.groupBy("name", "run").agg(held(F.col("value"), True).alias("held"))


def _decided(branches: DataFrame, recipes: DataFrame, runs: DataFrame) -> DataFrame:
    """The branches' cases: run, who, truth and reason of each group of profiles with the same values for what a condition names."""
    nobody = F.array(F.struct(F.lit(None).cast("string").alias("value"), F.lit(False).alias("known"), F.col("everyone").alias("who")))
    names = F.array_distinct(F.regexp_extract_all("condition", F.lit(_CALLED), 1))
    target = F.when(F.col("how").endswith("arch"), F.col("archs")).when(F.col("how").endswith("os"), F.col("oss")).otherwise(nobody)
    axes = F.concat(F.transform("_names", lambda n: _holding(n, F.col("line_no"))), F.array(target))
    j = branches.withColumn("_names", names).join(_merged(recipes), _RUN).join(F.broadcast(runs.drop("everyone")), "run").withColumn("_case", F.explode(_cases(axes, F.col("everyone"))))
    vals = F.col("_case.vals")
    entries = F.transform("_names", lambda n, i: F.struct(n.alias("name"), vals[i]["value"].alias("value")))
    entries = F.array_sort(F.filter(entries, lambda e: e["value"].isNotNull()))
    own = F.element_at(vals, -1)["value"]
    j = j.select(*branches.columns, "everyone", "ids", "chosen", F.col("_case.who").alias("who"), F.map_from_entries(entries).alias("entries"), own.alias("own"),
                 F.exists(vals, lambda v: v["known"] & v["value"].isNull()).alias("lost"))
    j = j.withColumn("t", expressions.branch_truth("how", "condition", "entries", F.map_from_entries("chosen"), "own", "own"))
    # A macro that is defined with a value that can't be told isn't an undefined one.
    truth, reason = F.when(~F.col("lost"), F.col("t.truth")), F.when(F.col("lost"), "unresolved-macro").otherwise(F.col("t.reason"))
    return j.select(*branches.columns, "everyone", "ids", "who", truth.alias("truth"), reason.alias("reason"))


def _selected(decided: DataFrame) -> DataFrame:
    """Branches with `chosen`, the profiles that select them (conditions.select_branches by bits): what can't be told isn't taken and keeps the rest of its chain out."""
    b = decided.repartition(*_RUN).groupBy(*_RUN, "line_no", "depth", "chain", "next", "everyone").agg(
        *(F.bit_or(F.when(when, F.col("who")).otherwise(F.lit(0))).alias(c) for c, when in (("yes", F.coalesce("truth", F.lit(False))), ("maybe", F.col("truth").isNull())))
    )
    before = Window.partitionBy(*_RUN, "depth", "chain").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.bit_or(F.col("yes").bitwiseOR(F.col("maybe"))).over(before), F.lit(0).cast("long"))
    return b.withColumn("chosen", F.col("yes").bitwiseAND(F.bitwise_not(gone)))


def project(r: Recipes, profiles: DataFrame, macros: DataFrame, options: DataFrame | None = None, rounds: int = 50) -> Projection:
    """The projection of recipes for profiles (profile_id, arch, os) with macros (profile_id, name, value); options (spec_id, name, state) are build options.

    Definitions sit in branches whose conditions may name macros that others define, so branches and definitions are worked out in turn until neither changes; a definition reaches only
    what stands below it, so each round settles at least one more of them from the top. A profile's own macro beats the recipe's; of the recipe's own the last active one above a use
    counts. A `%{!?name:...}` definition holds only where name has no value above it. A branch that can't be told isn't taken and keeps the rest of its chain out.
    Null texts, recipes without branches and empty tables have nothing to decide. Every round's definitions are a stored table.

    Profiles are bits of a row, in runs of 64, so a condition or text is worked out once for all profiles that have the same values for what it names; only what is returned has a row a
    profile. A recipe's definitions and branches that are off are arrays of its row, as its text is one value, and its lines meet them by one join. Tables that grow
    with the recipes are sorted and merged in partitions; only profiles and their macros are broadcast.
    """
    runs, facts = _runs(profiles, macros)
    branches = stored(with_ends(r).crossJoin(F.broadcast(runs.select("run"))), "project-branches")
    unset = r.lines.where(F.col("line").rlike(r"^\s*%\{!\?")).select("spec_id", "line_no", F.lit(True).alias("unset"))
    made = r.macros.where(F.col("options") == "").join(_merged(unset), ["spec_id", "line_no"], "left")
    made = made.select("spec_id", "line_no", "name", F.col("value").alias("body"), F.coalesce("unset", F.lit(False)).alias("unset"))
    own = r.tags.where(F.col("key").isin(*OWN_TAGS) & (F.col("pkg") == "")).select("spec_id", "line_no", F.col("key").alias("name"), F.col("value").alias("body"), F.lit(False).alias("unset"))
    bodies = stored(made.unionByName(own), "project-bodies")

    named = r.lines.select("spec_id", F.explode(F.regexp_extract_all("line", F.lit(_CALLED), 1)).alias("name")).unionByName(bodies.select("spec_id", "name"))
    named = named.join(F.broadcast(facts.select("name").distinct()), "name", "left_semi").distinct()
    mine = named.join(F.broadcast(facts), "name").groupBy(*_RUN).agg(F.collect_list(F.struct("name", "held")).alias("own"))
    recipes = r.specs.where("spec_id is not null").crossJoin(F.broadcast(runs.select("run", "everyone"))).join(_merged(mine), _RUN, "left")
    if options is None:
        recipes = recipes.withColumn("chosen", F.lit(None).cast("array<struct<name:string,state:boolean>>"))
    else:
        chosen = options.groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct("name", "state"))).alias("chosen"))
        recipes = recipes.join(_merged(chosen), "spec_id", "left")
    recipes = recipes.withColumns({c: F.coalesce(c, F.array().cast(recipes.schema[c].dataType)) for c in ("own", "chosen")})
    recipes = stored(recipes, "project-recipes")

    who = F.lit(0).cast("long").alias("who")
    definitions, before = bodies.select("spec_id", F.lit(0).cast("long").alias("run"), "line_no", "name", F.lit(None).cast("string").alias("value"), who).where("false"), None
    for _ in range(rounds):
        defs = definitions.groupBy(*_RUN).agg(F.array_sort(F.collect_list(F.struct("line_no", "name", "value", "who"))).alias("defs"))
        state = recipes.join(_merged(defs), _RUN, "left").withColumn("defs", F.coalesce("defs", F.array().cast(defs.schema["defs"].dataType)))
        decided = _decided(branches, state, runs)
        off = F.col("everyone").bitwiseAND(F.bitwise_not(F.col("chosen")))
        offs = _selected(decided).select(*_RUN, F.struct("line_no", "next", off.alias("who")).alias("off")).where("off.who <> 0").groupBy(*_RUN).agg(F.collect_list("off").alias("offs"))
        state = state.join(_merged(offs), _RUN, "left").withColumn("offs", F.coalesce("offs", F.array().cast(offs.schema["offs"].dataType)))
        state = stored(state.select(*_RUN, "everyone", "own", "defs", "offs"), "project-state")
        has = _merge(F.filter(_holding(F.col("name"), F.col("line_no")), lambda h: h["known"]))
        here = F.when(F.col("unset"), _shown().bitwiseAND(F.bitwise_not(has))).otherwise(_shown())
        now = _fill_cases(bodies.join(_merged(state), "spec_id").withColumn("here", here), "body", F.col("here"))
        now = stored(now.groupBy(*_RUN, "line_no", "name", F.col("told").alias("value")).agg(F.bit_or("who").alias("who")), "project-definitions")
        # Their number and two sums of hashes tell whether any of them has changed.
        hashes = (F.xxhash64(*now.columns), F.xxhash64(F.lit(1), *reversed(now.columns)))
        mark = tuple(now.agg(F.count(F.lit(1)), *(F.sum(h.cast("decimal(38,0)")) for h in hashes)).first())
        if mark == before or mark[0] == 0:
            break
        definitions, before = now, mark
    else:
        raise RuntimeError("the definitions did not settle")

    ids = F.broadcast(runs.select("run", "ids"))

    def each(rows: DataFrame, column: str) -> DataFrame:
        seen = _fill_cases(rows.join(_merged(state), "spec_id"), column, _shown())
        return seen.join(ids, "run").select(*rows.columns, _each_profile().alias("profile_id"), "told")

    chosen = _selected(decided).select(*_RUN, "line_no", "chosen")
    told = decided.join(_merged(chosen), [*_RUN, "line_no"]).select(*(c for c in branches.columns if c != "run"), "truth", "reason", "chosen", _each_place().alias("p", "profile_id"))
    told = told.withColumn("selected", F.call_function("getbit", F.col("chosen"), F.col("p")) == 1).drop("chosen", "p")
    shown = definitions.join(ids, "run").select("spec_id", _each_profile().alias("profile_id"), "line_no", "name", "value")
    return Projection(told, shown, each(r.tags, "value"), each(r.atoms, "atom"), each(r.files, "path"))
