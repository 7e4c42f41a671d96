"""Conditional branches: three-valued selection, coverage, and boolean algebra over cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions
from .matrix import for_every

#: Truth of a branch in a profile; null is indeterminate and isn't SQL's unknown: it never gives way to a known operand.


def both_known(a: Column, b: Column, value: Column) -> Column:
    """A binary operator without short circuit: unknown if either side is."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(value)


def select_branches(branches: DataFrame, keys: list[str], skip_unknown: bool = True) -> DataFrame:
    """branches (keys, branch, truth) with `selected`: in each chain the first branch that is true.

    With skip_unknown an indeterminate branch blocks the rest of its chain, and is not taken; otherwise it is taken together with what may follow.
    """
    before = Window.partitionBy(*keys).orderBy("branch").rowsBetween(Window.unboundedPreceding, -1)
    truth = F.col("truth")
    taken = F.coalesce(F.max(F.when(truth, 1)).over(before), F.lit(0)) == 1
    unknown = F.coalesce(F.max(F.when(truth.isNull(), 1)).over(before), F.lit(0)) == 1
    if skip_unknown:
        chosen = ~taken & ~unknown & F.coalesce(truth, F.lit(False))
    else:
        chosen = ~taken & F.coalesce(truth, F.lit(True))
    return branches.withColumn("selected", chosen)


def coverage(branches: DataFrame, keys: list[str]) -> DataFrame:
    """Per branch (keys) how many profiles have it active, inactive or indeterminate, and its class; the first that fits counts."""
    n = branches.groupBy(*keys).agg(
        F.count_if(F.col("truth")).alias("active"), F.count_if(~F.col("truth")).alias("inactive"), F.count_if(F.col("truth").isNull()).alias("indeterminate")
    )
    kind = (
        F.when((F.col("active") == 0) & (F.col("indeterminate") == 0), "dead")
        .when((F.col("inactive") == 0) & (F.col("indeterminate") == 0), "always")
        .when(F.col("indeterminate") == 0, "conditional")
        .when((F.col("active") == 0) & (F.col("inactive") == 0), "indeterminate")
        .otherwise("mixed")
    )
    return n.withColumn("class", kind)


def drop_subsumed(cubes: Column) -> Column:
    """A DNF (array of cubes, each a sorted array of literals) without the cubes that strictly contain another."""
    return F.filter(cubes, lambda c: ~F.exists(cubes, lambda o: (F.size(F.array_except(o, c)) == 0) & (F.size(o) < F.size(c))))


def contradicts(cube: Column) -> Column:
    """Whether a cube has a literal and its negation: literals are atom numbers from 1, negated ones negative."""
    return F.exists(cube, lambda x: F.array_contains(cube, -x))


def tautology(cubes: Column, atoms: int) -> Column:
    """Whether every assignment of at most 8 atoms meets a cube; null beyond."""
    if atoms > 8:
        return F.lit(None).cast("boolean")

    def met(a: Column) -> Column:
        return F.exists(cubes, lambda c: F.forall(c, lambda x: (F.shiftright(a, 0).bitwiseAND(F.pow(F.lit(2), F.abs(x) - 1).cast("int")) > 0) == (x > 0)))

    return F.forall(F.sequence(F.lit(0), F.lit((1 << atoms) - 1)), met)


def interval_conflicts(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """keys whose integer constraints (op, n) on one variable can't all hold: the highest lower bound is above the lowest upper one."""
    op, n = F.col("op"), F.col("n")
    low = F.when(op == ">", n + 1).when(op.isin(">=", "=="), n)
    high = F.when(op == "<", n - 1).when(op.isin("<=", "=="), n)
    return bounds.groupBy(*keys).agg(F.max(low).alias("low"), F.min(high).alias("high")).where("low > high")


def evaluate(branches: DataFrame, profiles: DataFrame, macros: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """branches (spec_id, line_no, chain, depth, how, condition) for each profile (profile_id, arch, os), with truth and reason (why it can't be told).

    Only the macros that a condition names are joined to it. options (spec_id, name, state): build options as declared or overridden.
    """
    names = F.array_distinct(F.regexp_extract_all("condition", F.lit(r"%\{?[!?]*([A-Za-z_]\w*)"), 1))
    pairs = for_every(branches, profiles)
    key = ["spec_id", "line_no", "profile_id"]
    wanted = pairs.select(*key, F.explode(names).alias("name")).join(macros.select("profile_id", "name", "value"), ["profile_id", "name"])
    values = wanted.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("values"))
    joined = pairs.join(values, key, "left")
    if options is not None:
        own = options.groupBy("spec_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "state"))).alias("options"))
        joined = joined.join(own, "spec_id", "left")
    else:
        joined = joined.withColumn("options", F.lit(None).cast("map<string,boolean>"))
    told = expressions.branch_truth("how", "condition", "values", "options", "arch", "os")
    return joined.withColumn("t", told).select(*branches.columns, "profile_id", "t.truth", "t.reason")


def build_options(lines: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(spec_id, name, state) of %bcond, %bcond_with (off) and %bcond_without (on) declarations; overrides (name, state) win."""
    m = r"^\s*%bcond(_without|_with)?\s+(\w+)\s*(\S*)"
    d = lines.where(F.col("line").rlike(m)).select(
        "spec_id", "line_no", F.regexp_extract("line", m, 2).alias("name"), F.regexp_extract("line", m, 1).alias("style"), F.regexp_extract("line", m, 3).alias("given")
    )
    state = F.when(F.col("style") == "_with", F.lit(False)).when(F.col("style") == "_without", F.lit(True)).otherwise(F.col("given") == "1")
    first = d.groupBy("spec_id", "name").agg(F.min_by(state, "line_no").alias("declared"))
    if overrides is None:
        return first.select("spec_id", "name", F.col("declared").alias("state"))
    return first.join(overrides.select("name", F.col("state").alias("own")), "name", "left").select("spec_id", "name", F.coalesce("own", "declared").alias("state"))


def active_lines(body: DataFrame, selected: DataFrame) -> DataFrame:
    """Lines of a recipe that a profile sees: those inside no branch that it doesn't select.

    selected: branches (spec_id, profile_id, line_no, next, selected), `next` being the line that ends the branch.
    """
    off = selected.where("not selected").select(F.col("spec_id").alias("s"), "profile_id", F.col("line_no").alias("from"), "next")
    profiles = selected.select("spec_id", "profile_id").distinct()
    lines = body.where("not (opens or closes or turns)").join(profiles, "spec_id")
    hidden = (F.col("spec_id") == F.col("s")) & lines["profile_id"].eqNullSafe(off["profile_id"]) & (F.col("line_no") > F.col("from")) & (F.col("line_no") < F.col("next"))
    return lines.join(off, hidden, "left_anti")
