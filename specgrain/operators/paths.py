"""Conditions along the nesting of branches: cubes of literals carried from branch to branch, with earlier arms negated, and the rules that need them.

A disjunctive form is an array of cubes, a cube a sorted array of literals, a literal an atom's text or, negated, that with a leading `!`. No cube is false, an empty cube is true;
null is what can't be told: a condition that isn't understood, or more cubes than are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions
from ..session import stored
from ..sources.recipes import Recipes
from .conditions import drop_subsumed
from .projection import with_ends
from .recipe_rules import at, rule

_DNF = "array<array<string>>"


def true() -> Column:
    return F.array(F.array().cast("array<string>"))


def opposite(literal: Column) -> Column:
    return F.when(F.startswith(literal, F.lit("!")), F.substr(literal, F.lit(2))).otherwise(F.concat(F.lit("!"), literal))


def conjoin(a: Column, b: Column) -> Column:
    """Both hold: every cube of one with every cube of the other, contradictions and cubes that another covers left out; null beyond CUBES."""
    every = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array_sort(F.array_distinct(F.concat(x, y))))))
    held = F.array_distinct(F.filter(every, lambda c: ~F.exists(c, lambda x: F.array_contains(c, opposite(x)))))
    kept = drop_subsumed(held)
    return F.when(F.size(kept) <= expressions.CUBES, kept)


def negate(a: Column) -> Column:
    """None of the cubes holds: one literal of each is false."""
    return F.aggregate(a, true(), lambda acc, cube: conjoin(acc, F.transform(cube, lambda x: F.array(opposite(x)))))


def implies(a: Column, b: Column) -> Column:
    """Whether a holds only where b does."""
    return F.size(conjoin(a, negate(b))) == 0


def holds_in(literal: Column, path: Column) -> Column:
    """Whether every cube of a path has the literal: then, and only then, the path implies it."""
    return F.forall(path, lambda c: F.array_contains(c, literal))


def branch_paths(r: Recipes) -> DataFrame:
    """Branches (spec_id, line_no, depth, chain, how, condition, next) with `own` (the condition itself), `before` (no earlier arm of the chain), `path` (all that holds around the chain).

    Architectures and systems are atoms of their own; a list of them is a disjunction. Each distinct condition is parsed once. Blocks that don't end are left out, and so is what
    stands in them. A level of nesting is a stored table.
    """
    b = with_ends(r)
    said = b.where("how in ('if', 'elif')").select("condition").distinct().withColumn("dnf", expressions.condition_literals("condition"))
    kind = F.when(F.col("how").endswith("arch"), "arch ").when(F.col("how").endswith("os"), "os ")
    listed = F.transform(F.filter(F.split(F.trim("condition"), r"[\s,]+"), lambda x: x != ""), lambda x: F.array(F.concat(kind, x)))
    plain = ~F.col("condition").contains("%")
    own = F.when(F.col("how") == "else", true()).when(F.col("how").isin("if", "elif"), F.col("dnf")).when(plain & F.col("how").startswith("ifn"), negate(listed)).when(plain, listed)
    b = b.join(said, "condition", "left").withColumn("own", own.cast(_DNF)).drop("dnf")
    earlier = Window.partitionBy("spec_id", "depth", "chain").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    arms = F.collect_list(F.struct("own")).over(earlier)
    b = b.withColumn("arms", arms).withColumn("before", F.aggregate("arms", true(), lambda acc, x: conjoin(acc, negate(x["own"])))).drop("arms")
    b = stored(b, "branch-own")
    columns = ["spec_id", "line_no", "depth", "chain", "how", "condition", "next", "own", "before", "path"]
    above = b.where("depth = 1").withColumn("path", true()).select(*columns)
    out = above
    for depth in range(2, (b.agg(F.max("depth")).first()[0] or 0) + 1):
        around = above.select(F.col("spec_id").alias("s"), F.col("line_no").alias("from"), F.col("next").alias("to"), conjoin(F.col("path"), conjoin(F.col("before"), F.col("own"))).alias("path"))
        inner = b.where(F.col("depth") == depth)
        above = stored(inner.join(around, (F.col("spec_id") == F.col("s")) & (F.col("chain") > F.col("from")) & (F.col("chain") < F.col("to"))).select(*columns), "branch-paths")
        out = out.unionByName(above)
    return out


def _partly(r: DataFrame, context: Column) -> DataFrame:
    """Conditions that are one conjunction of which a part, not all, holds in the context, with that part."""
    c = r.withColumn("context", context).withColumn("cube", F.get("own", F.lit(0))).where("size(own) = 1 and size(cube) > 1 and size(context) > 0")
    c = c.withColumn("given", F.filter("cube", lambda x: holds_in(x, F.col("context"))))
    return at(c.where("size(given) > 0 and size(given) < size(cube)"), F.array_join("given", " && "))


@rule("RPM430", "context-redundant-condition-part")
def redundant_part(r):
    return _partly(branch_paths(r).where("how = 'if'"), F.col("path"))


@rule("RPM431", "elif-history-simplify")
def repeats_history(r):
    return _partly(branch_paths(r).where("how = 'elif'"), conjoin(F.col("path"), F.col("before")))


@rule("RPM433", "condition-common-disjunct-factor", "allow")
def common_disjunct(r):
    """Clauses in parentheses, joined by and, all of which have an alternative in common."""
    clauses = F.regexp_extract_all("condition", F.lit(r"\(([^()]*)\)"), 1)
    parts = F.transform(clauses, lambda c: F.transform(F.split(c, r"\|\|"), lambda x: F.trim(x)))
    b = r.branches.where(F.col("how").isin("if", "elif") & F.col("condition").rlike(r"^\([^()&]*\|\|[^()&]*\)(?:\s*&&\s*\([^()&]*\|\|[^()&]*\))+$")).withColumn("parts", parts)
    shared = F.aggregate("parts", F.get("parts", F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
    return at(b.withColumn("shared", shared).where("size(shared) > 0"), F.array_join("shared", " || "))


@rule("RPM451", "guarded-item-dominated-by-weaker-guard")
def dominated(r):
    """A dependency under a guard that implies the guard of a copy of it, but isn't implied by that."""
    inside = branch_paths(r).select("spec_id", "depth", "chain", F.col("line_no").alias("from"), F.col("next").alias("to"), conjoin(F.col("path"), conjoin(F.col("before"), F.col("own"))).alias("guard"))
    a = r.atoms.where("depth > 0").join(inside, ["spec_id", "depth", "chain"]).where("line_no > from and line_no < to and size(guard) > 0")
    key = ["spec_id", "pkg", "key", "qualifiers", "atom"]
    first = a.groupBy(*key, "guard").agg(F.min("line_no").alias("line_no"))
    other = first.select(*key, F.col("guard").alias("weaker"))
    pairs = first.join(other, key).where(F.col("guard") != F.col("weaker"))
    hit = pairs.where(implies(F.col("guard"), F.col("weaker")) & ~F.coalesce(implies(F.col("weaker"), F.col("guard")), F.lit(False)))
    return at(hit.groupBy(*key, "line_no").agg(F.count(F.lit(1)).alias("n")), F.col("atom"))
