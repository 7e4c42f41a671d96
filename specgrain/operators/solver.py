"""What a set of packages and requirements needs to be installed together: one package a name, none that conflicts with another, and why what is left can't be met."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evr import compatible_sign, constraint_holds, evr_key
from ..session import stored
from .resolve import DEP, is_rich

PIN = ["pkg_id", "name", "parent", "depth", "path"]
UNMET = [*DEP, "parent", "path", "reason", "blocker"]


def keyed(provided: DataFrame) -> DataFrame:
    """(name, pkg_id, place, p): p orders the provided EVR and is null where there is none."""
    key = F.when(F.col("version").isNotNull(), evr_key(F.coalesce("epoch", F.lit(0)), F.col("version"), F.col("release")))
    return provided.select("name", "pkg_id", "place", key.alias("p")).distinct()


def _holds() -> Column:
    return constraint_holds(F.col("op"), F.when(F.col("p").isNotNull(), compatible_sign(F.col("p"), F.col("d")))) | F.col("name").startswith("/")


def _candidates(deps: DataFrame, n: DataFrame) -> DataFrame:
    """The distinct dependencies with each row of n (name, p, ...) that meets them; a path is met by whoever has it in n."""
    d = deps.select(*DEP).distinct().withColumn("d", evr_key(F.coalesce("epoch", F.lit(0)), F.col("version"), F.col("release")))
    return d.join(n, "name").where(_holds())


def satisfying(deps: DataFrame, n: DataFrame) -> DataFrame:
    """(DEP, pkg_id, place) of all packages that meet each of the distinct dependencies; a path is met by whoever has it in n, the keyed provides."""
    return _candidates(deps, n).select(*DEP, "pkg_id", "place").distinct()


def best_providers(deps: DataFrame, offers: DataFrame, order: DataFrame) -> DataFrame:
    """(DEP, pkg_id): the first by place of those that meet each dependency. offers (name, p, place) has the first place of each EVR, so no package beside is compared; minima combine by hash."""
    least = _candidates(deps, offers).groupBy(*DEP).agg(F.min("place").alias("place"))
    return least.join(order.select("place", "pkg_id"), "place").select(*DEP, "pkg_id")


def _least_parent() -> tuple:
    """Aggregates of the first parent, nobody before anybody; a struct with its path would be sorted."""
    return F.max(F.col("parent").isNull()).alias("_none"), F.min("parent").alias("_least")


def _parent() -> Column:
    return F.when(~F.col("_none"), F.col("_least")).alias("parent")


def _match(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a joined with b by equal dependencies, nulls included; b's own columns follow."""
    other = b.withColumnsRenamed({c: f"_{c}" for c in DEP})
    return a.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in DEP], how).drop(*(f"_{c}" for c in DEP))


def _numbered(caps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conflicts as (pkg_id, dep), and (dep, DEP) of the distinct ones, both stored: rows meet by a number instead of five columns that may be null."""
    rows = stored(caps.where("kind = 'conflicts'").select("pkg_id", *DEP).distinct(), "solve-conflicts")
    deps = stored(rows.select(*DEP).distinct().select(F.monotonically_increasing_id().alias("dep"), *DEP), "solve-conflict-deps")
    return stored(_match(rows, deps.hint("shuffle_hash")).select("pkg_id", "dep"), "solve-conflict-rows"), deps


def _clashes(conflicts: tuple[DataFrame, DataFrame], owners: DataFrame, victims: DataFrame, provided: DataFrame) -> DataFrame:
    """(pkg_id, victim): owners (pkg_id) one of whose Conflicts (_numbered) a victim (pkg_id) meets."""
    rows, deps = conflicts
    c = rows.join(owners.select("pkg_id").distinct(), "pkg_id", "left_semi")
    asked = deps.join(c.select("dep").distinct(), "dep", "left_semi").withColumn("d", evr_key(F.coalesce("epoch", F.lit(0)), F.col("version"), F.col("release")))
    met = asked.join(provided.join(victims.select("pkg_id").distinct(), "pkg_id", "left_semi"), "name").where(_holds()).select("dep", F.col("pkg_id").alias("victim"))
    return c.join(met, "dep").where("pkg_id <> victim").select("pkg_id", "victim").distinct()


def _both_ways(conflicts: tuple[DataFrame, DataFrame], one: DataFrame, other: DataFrame, provided: DataFrame) -> DataFrame:
    """(pkg_id, blocker): packages of `one` that conflict with one of `other`, whichever of the two says so."""
    there = _clashes(conflicts, one, other, provided).select("pkg_id", F.col("victim").alias("blocker"))
    back = _clashes(conflicts, other, one, provided).select(F.col("victim").alias("pkg_id"), F.col("pkg_id").alias("blocker"))
    return there.unionByName(back).distinct()


def independent(wanted: DataFrame, pairs: DataFrame, rounds: int = 1000) -> DataFrame:
    """The wanted packages (pkg_id, name, place; ids and places are unique) that are kept if they come in order of place and each falls to a kept one of its name or in conflict with it.

    pairs (pkg_id, blocker) holds every conflict in both directions. Each round keeps all packages that nothing undecided comes before and drops what they exclude, so a package
    never falls to one that falls itself. The first of those undecided is always kept; rounds grow with the longest chain of exclusions, not with the packages.
    """
    place = lambda df, as_: df.select(F.col("pkg_id").alias(as_), F.col("place").alias(f"{as_}_place"))
    undecided, kept = stored(wanted.select("pkg_id", "name", "place"), "solve-undecided"), []
    for _ in range(rounds):
        first = undecided.groupBy("name").agg(F.min("place").alias("first"))
        behind = pairs.join(place(undecided, "pkg_id"), "pkg_id").join(place(undecided, "blocker"), "blocker").where("blocker_place < pkg_id_place").select("pkg_id").distinct()
        now = stored(undecided.join(first, "name").where("place = first").drop("first").join(behind, "pkg_id", "left_anti"), "solve-kept")
        kept.append(now)
        excluded = pairs.join(now.select(F.col("pkg_id").alias("blocker")), "blocker").select("pkg_id").distinct()
        undecided = stored(undecided.join(now.select("name"), "name", "left_anti").join(excluded, "pkg_id", "left_anti"), "solve-undecided")
        if undecided.isEmpty():
            return reduce(DataFrame.unionByName, kept)
    raise RuntimeError("the choice did not settle")


def solve(
    roots: DataFrame, packages: DataFrame, caps: DataFrame, provided: DataFrame, files: DataFrame | None = None, requirements: DataFrame | None = None, rounds: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """Pins (PIN) and unmet dependencies (UNMET) of installing roots (pkg_id) and whatever meets the requirements (DEP; a build's own, implicit and base ones) together.

    Each round takes the requirements of the packages pinned in the one before, all at once, as joins over distinct dependencies. One that a pinned package meets is met; a path is met
    by any of its owners in files (pkg_id, path), not only by the one that `provided` has. The others ask for their best provider by place. It is left out if another package of its
    name is pinned or it conflicts with a pinned one, in either direction; what remains comes in by `independent`, so only pinned packages ever keep others out.

    Unmet is what pinned packages (parent) or requirements (parent null, no path) ask for and no pinned package meets in the end: reason no_provider, or other_version or conflict if that
    keeps the best provider out; blocker is the pinned package that does. Rich dependencies are set apart (`skipped`). path holds the names that lead from a root to a package.

    Pins and each round's tables are stored, so lost executors cost one round. Roots are all pinned. Repeated rows count once; no roots and requirements give none.
    """
    named = packages.select("pkg_id", "name").distinct()
    none = F.lit(None)
    provided = stored(keyed(provided), "solve-provided")
    conflicts = _numbered(caps)
    order = provided.groupBy("pkg_id").agg(F.min("place").alias("place"))
    order = stored(order, "solve-order")
    offers = stored(provided.groupBy("name", "p").agg(F.min("place").alias("place")), "solve-offers")

    def given(by: DataFrame) -> DataFrame:
        """(name, p): what packages (pkg_id) provide, files among them, once each."""
        rows = provided.join(by.select("pkg_id"), "pkg_id", "left_semi").select("name", "p")
        if files is not None:
            owned = files.join(by.join(order, "pkg_id", "left_semi").select("pkg_id"), "pkg_id", "left_semi")
            rows = rows.unionByName(owned.select(F.col("path").alias("name"), none.cast(provided.schema["p"].dataType).alias("p")))
        return stored(rows.distinct(), "solve-given")

    new = roots.select("pkg_id").distinct().join(named, "pkg_id").select("pkg_id", "name", none.cast("bigint").alias("parent"), F.lit(0).alias("depth"), F.array("name").alias("path"))
    new = pins = stored(new, "solve-pins")
    needs_all = stored(caps.where((F.col("kind") == "requires") & ~is_rich(F.col("name"))).select(F.col("pkg_id").alias("parent"), *DEP).distinct(), "solve-requires")
    have = given(new)
    asked = None
    if requirements is not None:
        asked = requirements.where(~is_rich(F.col("name"))).select(none.cast("bigint").alias("parent"), *DEP, F.array().cast("array<string>").alias("path")).distinct()
    for depth in range(1, rounds):
        needs = needs_all.join(new.select(F.col("pkg_id").alias("parent")), "parent")
        if asked is not None and depth == 1:
            needs = needs.unionByName(asked.drop("path"))
        needs = needs.groupBy(*DEP).agg(*_least_parent()).select(*DEP, _parent())
        needs = stored(needs, "solve-asked")
        open_ = stored(_match(needs, _candidates(needs, have).select(*DEP).distinct(), "left_anti"), "solve-open")
        wanted = _match(open_, best_providers(open_, offers, order)).groupBy("pkg_id").agg(*_least_parent()).select("pkg_id", _parent())
        wanted = wanted.join(named, "pkg_id").join(order, "pkg_id").join(pins.select("name"), "name", "left_anti")
        wanted = wanted.join(new.select(F.col("pkg_id").alias("parent"), "path"), "parent", "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))
        wanted = stored(wanted.select("pkg_id", "name", "place", "parent", "path"), "solve-wanted")
        if wanted.isEmpty():
            break
        free = stored(wanted.join(_both_ways(conflicts, wanted, pins, provided).select("pkg_id"), "pkg_id", "left_anti"), "solve-free")
        if free.isEmpty():
            break
        there = stored(_clashes(conflicts, free, free, provided).select("pkg_id", F.col("victim").alias("blocker")), "solve-pairs")
        pairs = there.unionByName(there.select(F.col("blocker").alias("pkg_id"), F.col("pkg_id").alias("blocker")))
        new = free.join(independent(free, pairs).select("pkg_id"), "pkg_id", "left_semi")
        new = stored(new.select("pkg_id", "name", "parent", F.lit(depth).alias("depth"), F.concat("path", F.array("name")).alias("path")), "solve-pins")
        pins, have = pins.unionByName(new), have.unionByName(given(new))
    else:
        raise RuntimeError("the solution did not settle")

    needs = needs_all.join(pins.select(F.col("pkg_id").alias("parent"), "path"), "parent")
    needs = needs.unionByName(asked) if asked is not None else needs
    distinct = stored(needs.select(*DEP).distinct(), "solve-needs")
    left = stored(_match(distinct, _candidates(distinct, have.distinct()).select(*DEP).distinct(), "left_anti"), "solve-left")
    best = stored(best_providers(left, offers, order), "solve-best")
    out = stored(best.select("pkg_id").distinct().join(named, "pkg_id"), "solve-out")
    by_name = out.join(pins.select("name", F.col("pkg_id").alias("blocker")), "name").select("pkg_id", "blocker", F.lit("other_version").alias("reason"))
    why = by_name.unionByName(_both_ways(conflicts, out, pins, provided).withColumn("reason", F.lit("conflict")))
    why = best.join(why.groupBy("pkg_id").agg(F.min(F.struct("reason", "blocker")).alias("o")), "pkg_id").select(*DEP, "o.reason", "o.blocker")
    told = _match(left, why, "left").select(*DEP, F.coalesce("reason", F.lit("no_provider")).alias("reason"), "blocker")
    unmet = _match(needs, told)
    return pins.select(*PIN), unmet.select(*UNMET)


def unmet_core(unmet: DataFrame) -> DataFrame:
    """Unmet dependencies once each: name, op, epoch, version, release, reason, how many packages ask for it, and the shortest way that leads there."""
    shortest = F.min_by("path", F.struct(F.size("path"), "path"))
    return unmet.groupBy(*DEP, "reason").agg(F.countDistinct("parent").alias("parents"), shortest.alias("path"))


def skipped(pins: DataFrame, caps: DataFrame, requirements: DataFrame | None = None) -> DataFrame:
    """(name) of the rich dependencies of pinned packages and requirements, which are not resolved."""
    rich = caps.where((F.col("kind") == "requires") & is_rich(F.col("name"))).join(pins.select("pkg_id"), "pkg_id", "left_semi").select("name")
    return (rich if requirements is None else rich.unionByName(requirements.where(is_rich(F.col("name"))).select("name"))).distinct()


def chains(pins: DataFrame, unmet: DataFrame) -> DataFrame:
    """(name, reason, path, blocker, blocker_path) of what a pinned package keeps out, once a dependency: the ways that lead to both sides of each clash, shortest first."""
    there = unmet.where("blocker is not null").groupBy(*DEP, "reason", "blocker").agg(F.min_by("path", F.struct(F.size("path"), "path")).alias("path"))
    return there.join(pins.select(F.col("pkg_id").alias("blocker"), F.col("path").alias("blocker_path")), "blocker").select("name", "reason", "path", "blocker", "blocker_path")


def summary(pins: DataFrame, unmet: DataFrame, packages: DataFrame) -> DataFrame:
    """One row: packages, install_size, unmet (distinct dependencies) and satisfiable."""
    size = packages.select("pkg_id", "size_installed").distinct().join(pins.select("pkg_id"), "pkg_id", "left_semi")
    left = unmet.select(*DEP).distinct().agg(F.count(F.lit(1)).alias("unmet"))
    return size.agg(F.count(F.lit(1)).alias("packages"), F.coalesce(F.sum("size_installed"), F.lit(0)).alias("install_size")).join(left).withColumn("satisfiable", F.col("unmet") == 0)
