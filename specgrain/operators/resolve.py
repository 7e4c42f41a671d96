"""Dependency lookup, transitive closure and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evr import compatible_compare, compatible_sign, constraint_holds, evr_key, version_key
from ..session import dealt, stored

DEP = ["name", "op", "epoch", "version", "release"]
#: Words of 64 bits in a row of what packages reach.
_WORDS = 16
#: Packages in one value at most, where a capability's providers or those that conflict with it are put together.
_TOGETHER = 8192


def is_rich(name: Column) -> Column:
    """Boolean dependencies are set apart, not resolved."""
    return name.startswith("(")


def package_order(packages: DataFrame) -> DataFrame:
    """(pkg_id, place): places grow in the order in which packages are preferred, by repository, EVR downwards (strict order), name, order of arrival.

    One sort by ranges over all packages, stored, so that every reader sees the same places; no capability is ever ranked in one task.
    """
    order = ["repo_id", F.desc("epoch"), F.desc("v"), F.desc("r"), "name", "pkg_id"]
    # Many packages are a small file, read by few tasks: they are dealt before their keys are made, and the keys stored, as a sort by ranges goes over its rows twice.
    p = dealt(packages.select("repo_id", "epoch", "version", "release", "name", "pkg_id"), "pkg_id")
    p = stored(p.select("repo_id", "epoch", version_key(F.col("version")).alias("v"), version_key(F.col("release")).alias("r"), "name", "pkg_id"), "package-keys")
    return stored(p.orderBy(*order).select("pkg_id", F.monotonically_increasing_id().alias("place")), "package-order")


def provides(packages: DataFrame, caps: DataFrame) -> DataFrame:
    """(name, pkg_id, epoch, version, release): packages by their own names with their EVR, and by what they provide, whose EVR is null without a version. Rows may be repeated."""
    own = packages.select("name", "pkg_id", *DEP[2:])
    given = caps.where("kind = 'provides'").select("name", "pkg_id", *DEP[2:])
    return own.unionByName(given.join(packages.select("pkg_id"), "pkg_id", "left_semi").select("name", "pkg_id", *DEP[2:]))


def providers(packages: DataFrame, caps: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(name, pkg_id, epoch, version, release, place): what each name is provided with, and the provider's place among all packages (package_order).

    Own names carry the package's EVR; a Provides without a version has a null EVR; a file path has none either, and its owner is the first only. Rows may be repeated.
    """
    evr = ["epoch", "version", "release"]
    order = package_order(packages)
    rows = packages.select("name", "pkg_id", *evr)
    rows = rows.unionByName(caps.where("kind = 'provides'").select("name", "pkg_id", *evr))
    if files is not None:
        p = packages.select("pkg_id", "repo_id")
        # The least number of each repository comes first: numbers combine by hash where structs would be sorted, and repeated rows don't matter.
        least = files.join(p.hint("shuffle_hash"), "pkg_id").groupBy("path", "repo_id").agg(F.min("pkg_id").alias("pkg_id"))
        first = least.groupBy("path").agg(F.min(F.struct("repo_id", "pkg_id")).alias("o"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("epoch", "int"), ("version", "string"), ("release", "string"))]
        rows = rows.unionByName(first.select(F.col("path").alias("name"), F.col("o.pkg_id").alias("pkg_id"), *none))
    return rows.join(order.hint("shuffle_hash"), "pkg_id").select("name", "pkg_id", *evr, "place")


def lookup(deps: DataFrame, provided: DataFrame) -> DataFrame:
    """DEP, outcome (no_provider, satisfied, version_unsatisfied) and pkg_id of the best provider, for the distinct dependencies.

    Dependencies, and the EVRs that each name is provided with, are made distinct and get their keys before the candidate join. Its result
    goes straight into two minima of places, which combine map-side and carry the package along, so that provides are gone through once; no window over candidates.
    A path dependency is satisfied by its owner.
    """
    d = deps.select(*DEP).distinct().where(~is_rich(F.col("name"))).withColumn("d", evr_key(F.coalesce("epoch", F.lit(0)), F.col("version"), F.col("release")))
    n = provided.groupBy("name", *(F.col(c).alias(f"p_{c}") for c in DEP[2:])).agg(F.min("place").alias("place"), F.min_by("pkg_id", "place").alias("pkg_id"))
    n = n.select("name", "place", "pkg_id", F.when(F.col("p_version").isNotNull(), evr_key(F.coalesce("p_epoch", F.lit(0)), F.col("p_version"), F.col("p_release"))).alias("p"))
    holds = constraint_holds(F.col("op"), F.when(F.col("p").isNotNull(), compatible_sign(F.col("p"), F.col("d")))) | F.col("name").startswith("/")
    met = F.when(holds, F.col("place"))
    least = (F.min("place").alias("any"), F.min_by("pkg_id", "place").alias("any_id"), F.min(met).alias("sat"), F.min_by("pkg_id", met).alias("sat_id"))
    best = d.join(n, "name", "left").groupBy(*DEP).agg(*least)
    outcome = F.when(F.col("any").isNull(), "no_provider").when(F.col("sat").isNull(), "version_unsatisfied").otherwise("satisfied")
    return best.select(*DEP, outcome.alias("outcome"), F.coalesce("sat_id", "any_id").alias("pkg_id"))


def needs(caps: DataFrame, found: DataFrame) -> DataFrame:
    """(pkg_id, needs): packages and the best providers of what they require. The distinct dependencies are hashed, so that no row of a package's is sorted by five columns. Rows may be repeated."""
    met = found.where("outcome = 'satisfied'").select(*(F.col(c).alias(f"d_{c}") for c in DEP), F.col("pkg_id").alias("needs"))
    same = [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in DEP]
    return caps.where("kind = 'requires'").select("pkg_id", *DEP).join(met.hint("shuffle_hash"), same).select("pkg_id", "needs")


def edges(caps: DataFrame, found: DataFrame) -> DataFrame:
    """needs, each row once."""
    return needs(caps, found).distinct()


def closure(roots: DataFrame, edges_: DataFrame, rounds: int = 1000) -> DataFrame:
    """(pkg_id, depth) of all packages that roots (pkg_id) need, themselves at depth 0. Each round's new packages are a stored table. Repeated rows count once."""
    e = stored(edges_, "closure-edges")
    seen = new = stored(roots.select("pkg_id", F.lit(0).alias("depth")).distinct(), "closure")
    for depth in range(1, rounds):
        step = new.join(e, "pkg_id").select(F.col("needs").alias("pkg_id")).distinct()
        new = stored(step.join(seen, "pkg_id", "left_anti").select("pkg_id", F.lit(depth).alias("depth")), "closure")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    raise RuntimeError("the closure did not settle")


def shared_closures(roots: DataFrame, edges_: DataFrame, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Closures of many roots (root, pkg_id) at once: members (root, set_id), and (set_id, pkg_id, depth) of all that each set needs, itself at depth 0.

    Roots with the same packages, and there are many such among recipes, share one closure. A root's own packages are one value, what it reaches never is: a row holds a package and, as bits,
    which sets of a run of 64 come to it in a round, so that rows grow with the packages and not with the sets that share them. Each round's new bits are a stored table.
    Null and repeated packages count once or not at all; a root without packages is no member.
    """
    e = stored(edges_, "closures-edges")
    first = roots.where("pkg_id is not null").select("root", "pkg_id").distinct().groupBy("root").agg(F.array_sort(F.collect_list("pkg_id")).alias("first"))
    named = stored(first.select("root", "first", F.sha2(F.array_join(F.col("first").cast("array<string>"), ","), 256).alias("sha")), "closures-members")
    sets = named.select("sha", "first").dropDuplicates(["sha"]).orderBy("sha")
    sets = stored(sets.select("sha", "first", F.monotonically_increasing_id().alias("set_id")), "closures-sets")
    own = sets.select(F.explode("first").alias("pkg_id"), F.expr("set_id div 64").alias("run"), F.expr("shiftleft(1L, int(set_id % 64))").alias("bits"))
    none = F.lit(0).cast("long")
    seen = new = stored(own.groupBy("pkg_id", "run").agg(F.bit_or("bits").alias("bits")).withColumn("depth", F.lit(0)), "closures")
    for depth in range(1, rounds):
        step = new.join(e, "pkg_id").select(F.col("needs").alias("pkg_id"), "run", "bits", none.alias("old"))
        rows = step.unionByName(seen.select("pkg_id", "run", none.alias("bits"), F.col("bits").alias("old")))
        both = rows.groupBy("pkg_id", "run").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not("old"))
        new = stored(both.select("pkg_id", "run", fresh.alias("bits"), F.lit(depth).alias("depth")).where("bits <> 0"), "closures")
        if new.isEmpty():
            bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1))
            closed = seen.select("pkg_id", "depth", "run", bit.alias("bit")).select((F.col("run") * 64 + F.col("bit")).alias("set_id"), "pkg_id", "depth")
            return named.join(sets.select("sha", "set_id"), "sha").select("root", "set_id"), closed
        seen = seen.unionByName(new)
    raise RuntimeError("the closures did not settle")


def closures(roots: DataFrame, edges_: DataFrame) -> DataFrame:
    """(root, pkg_id, depth) of all that each of many roots (root, pkg_id) needs (shared_closures)."""
    members, closed = shared_closures(roots, edges_)
    return members.join(closed, "set_id").select("root", "pkg_id", "depth")


def reached(asked: DataFrame, roots: DataFrame, edges_: DataFrame, rounds: int = 1000) -> DataFrame:
    """Those of the asked pairs (root, pkg_id) whose package is one of the root's own (roots: root, pkg_id) or one that they need, directly or not.

    What is asked for is followed backwards to whoever needs it, not the closure of every root forwards: packages carry which of the asked ones they reach as bits, a row holds those of
    one run of asked packages, and rows combine map-side. So the work grows with the needed packages and the runs, whatever the number of roots. Each round's rows are a stored table.
    """
    roots = stored(roots.where("pkg_id is not null").select("root", "pkg_id").distinct(), "reached-roots")
    asked = stored(asked.select("root", "pkg_id").distinct(), "reached-asked")
    # Nobody comes to a package that no root starts at and nothing needs.
    e = edges_.select("pkg_id", "needs")
    inner = stored(e.select(F.col("needs").alias("pkg_id")).union(roots.select("pkg_id")).distinct(), "reached-inner")
    e = stored(e.join(inner, "pkg_id", "left_semi"), "reached-edges")
    targets = asked.select("pkg_id").distinct().join(inner, "pkg_id", "left_semi").orderBy("pkg_id")
    no = F.monotonically_increasing_id()
    targets = stored(targets.select("pkg_id", no.alias("no")).select("pkg_id", F.expr(f"no div {64 * _WORDS}").alias("run"), (F.col("no") % (64 * _WORDS)).cast("int").alias("bit")), "reached-targets")

    words = range(_WORDS)
    own = F.expr("shiftleft(1L, bit % 64)")
    none = F.lit(0).cast("long")
    first = [F.when(F.expr(f"bit div 64 = {i}"), own).otherwise(none) for i in words]
    # b: what a package reaches; n: what of it is new in this round.
    state = stored(targets.select("pkg_id", "run", *(c.alias(f"{x}{i}") for x in "bn" for i, c in enumerate(first)), F.lit(True).alias("grew")), "reached")
    for _ in range(rounds):
        new = state.where("grew").select(F.col("pkg_id").alias("needs"), "run", *(F.col(f"n{i}").alias(f"b{i}") for i in words))
        if new.isEmpty():
            break
        step = new.join(e, "needs").select("pkg_id", "run", *(f"b{i}" for i in words), *(none.alias(f"a{i}") for i in words))
        rows = state.select("pkg_id", "run", *(f"b{i}" for i in words), *(F.col(f"b{i}").alias(f"a{i}") for i in words)).unionByName(step)
        both = rows.groupBy("pkg_id", "run").agg(*(F.bit_or(f"{x}{i}").alias(f"{x}{i}") for x in "ba" for i in words))
        grew = F.array(*(f"b{i}" for i in words)) != F.array(*(f"a{i}" for i in words))
        fresh = (F.col(f"b{i}").bitwiseXOR(F.col(f"a{i}")).alias(f"n{i}") for i in words)
        state = stored(both.select("pkg_id", "run", *(f"b{i}" for i in words), *fresh, grew.alias("grew")), "reached")
    else:
        raise RuntimeError("what is reached did not settle")
    pairs = roots.withColumnRenamed("pkg_id", "from").join(asked.join(targets, "pkg_id"), "root")
    word = F.element_at(F.array(*(f"b{i}" for i in words)), F.expr("int(bit div 64) + 1"))
    hit = pairs.join(state.withColumnRenamed("pkg_id", "from"), ["from", "run"]).where(word.bitwiseAND(own) != 0)
    return hit.select("root", "pkg_id").distinct()


def _keyed() -> Column:
    return evr_key(F.coalesce("epoch", F.lit(0)), F.col("version"), F.col("release"))


def _conflict_rows(caps: DataFrame) -> DataFrame:
    return caps.where("kind = 'conflicts'").select("pkg_id", *DEP).distinct()


def _conflict_names(c: DataFrame, provided: DataFrame) -> DataFrame:
    """(name, via, asked, given), stored: the names that conflicts have and anything provides, numbered in order, with the rows of each side at most. Numbers aggregate by hash where names would be sorted."""
    n = c.groupBy("name").agg(F.count(F.lit(1)).alias("asked")).join(provided.groupBy("name").agg(F.count(F.lit(1)).alias("given")), "name")
    return stored(n.orderBy("name").select("name", F.monotonically_increasing_id().alias("via"), "asked", "given"), "conflict-names")


def _conflict_pairs(c: DataFrame, provided: DataFrame, names: DataFrame) -> DataFrame:
    """(pkg_id, victim, via), via by number.

    Both sides get their keys before they meet; the pairs that hold combine map-side to one a package and victim.
    """
    c = c.join(names, "name").select("pkg_id", "name", "via", "op", _keyed().alias("d"))
    p = provided.select("name", "pkg_id", "epoch", "version", "release").distinct()
    p = p.select("name", F.col("pkg_id").alias("victim"), F.when(F.col("version").isNotNull(), _keyed()).alias("p"))
    holds = constraint_holds(F.col("op"), F.when(F.col("p").isNotNull(), compatible_sign(F.col("p"), F.col("d"))))
    pairs = c.join(p, "name").where((F.col("pkg_id") != F.col("victim")) & holds)
    return pairs.groupBy("pkg_id", "victim").agg(F.min("via").alias("via"))


def conflicts(caps: DataFrame, provided: DataFrame) -> DataFrame:
    """(pkg_id, victim, via): a package, another one whose name or Provides meets one of its Conflicts, and the first such capability's name."""
    c = _conflict_rows(caps)
    names = _conflict_names(c, provided)
    pairs = _conflict_pairs(c, provided, names)
    return pairs.withColumnRenamed("via", "no").join(names.withColumnRenamed("via", "no"), "no").select("pkg_id", "victim", F.col("name").alias("via"))


def conflict_counts(caps: DataFrame, provided: DataFrame, together: int = _TOGETHER) -> DataFrame:
    """(pkg_id, victims, via): how many other packages one conflicts with, and the first capability's name by which it does.

    No pair is a row: a name's providers are one value, by EVR, from which each distinct Conflicts takes the victims once for all packages that have it; a package's victims are counted where
    its few values meet. Packages that conflict with a name of more than `together` providers go through rows of pairs instead, and those that share a Conflicts are dealt into blocks.
    """
    c = _conflict_rows(caps)
    names = _conflict_names(c, provided)
    wide = names.where(F.col("given") > together)
    counts = None
    if not wide.isEmpty():
        many = c.join(wide.select("name"), "name", "left_semi").select("pkg_id").distinct()
        pairs = _conflict_pairs(c.join(many, "pkg_id", "left_semi"), provided, names)
        counts = pairs.groupBy("pkg_id").agg(F.count("*").alias("victims"), F.min("via").alias("via"))
        c = c.join(many, "pkg_id", "left_anti")
    few = names.where(F.col("given") <= together)

    block = F.pmod(F.xxhash64("pkg_id"), F.expr(f"asked div {together} + 1"))
    d = c.join(few.select("name", "via", "asked"), "name").groupBy(*DEP, "via", block.alias("block")).agg(F.collect_list("pkg_id").alias("asking"))
    d = d.select("name", "via", "op", _keyed().alias("d"), "asking")
    p = provided.join(few.select("name"), "name", "left_semi").groupBy(*(x for x in DEP if x != "op")).agg(F.collect_set("pkg_id").alias("victims"))
    p = p.groupBy("name").agg(F.collect_list(F.struct(F.when(F.col("version").isNotNull(), _keyed()).alias("p"), "victims")).alias("given"))
    holds = lambda g: constraint_holds(F.col("op"), F.when(g["p"].isNotNull(), compatible_sign(g["p"], F.col("d"))))
    met = d.join(p, "name").select("via", "asking", F.flatten(F.transform(F.filter("given", holds), lambda g: g["victims"])).alias("victims")).where(F.size("victims") > 0)
    each = met.select(F.explode("asking").alias("pkg_id"), "via", "victims").withColumn("victims", F.array_remove("victims", F.col("pkg_id"))).where(F.size("victims") > 0)
    each = each.groupBy("pkg_id").agg(F.collect_list("victims").alias("victims"), F.min("via").alias("via"))
    each = each.select("pkg_id", F.size(F.array_distinct(F.flatten("victims"))).cast("long").alias("victims"), "via")
    counts = each if counts is None else counts.unionByName(each)
    return counts.join(names.select("via", "name"), "via").select("pkg_id", "victims", F.col("name").alias("via"))


def conflicts_within(closed: DataFrame, found: DataFrame) -> DataFrame:
    """Conflicts of which both sides are in a closure."""
    return found.join(closed.select("pkg_id"), "pkg_id", "left_semi").join(closed.select(F.col("pkg_id").alias("victim")), "victim", "left_semi")


def upgrades(proposed: DataFrame, published: DataFrame) -> DataFrame:
    """name and verdict (new, upgrade, same, regress, epoch_dropped) of proposed (name, epoch, version, release) against the highest published EVR of that name."""
    order = F.struct("epoch", version_key(F.col("version")).alias("v"), version_key(F.col("release")).alias("r"))
    best = published.groupBy("name").agg(F.max_by(F.struct("epoch", "version", "release"), order).alias("b"))
    j = proposed.join(best, "name", "left")
    sign = compatible_compare((F.col("epoch"), F.col("version"), F.col("release")), (F.col("b.epoch"), F.col("b.version"), F.col("b.release")))
    verdict = (
        F.when(F.col("b").isNull(), "new")
        .when((F.col("epoch") == 0) & (F.col("b.epoch") > 0), "epoch_dropped")
        .when(sign > 0, "upgrade")
        .when(sign == 0, "same")
        .otherwise("regress")
    )
    return j.select("name", "epoch", "version", "release", verdict.alias("verdict"))
