"""Two closures compared by name, by round and by what stays unmet: reports on pairs of labelled closures, all pairs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import DEP

#: Kinds of unmet dependencies, the first that fits.
BUCKETS = ("soname", "path", "versioned", "plain")


def bucket(name: Column, op: Column) -> Column:
    """The kind of a dependency by its form: a library's soname, also as a path; a path; one with a version; any other name."""
    return F.when(name.rlike(r"\.so(?:\.|$)"), BUCKETS[0]).when(name.startswith("/"), BUCKETS[1]).when(op != "NONE", BUCKETS[2]).otherwise(BUCKETS[3])


def evra(*columns: str) -> Column:
    """epoch:version-release.arch as one text."""
    e, v, r, a = columns or ("epoch", "version", "release", "arch")
    return F.concat(F.coalesce(F.col(e), F.lit(0)).cast("string"), F.lit(":"), F.col(v), F.lit("-"), F.col(r), F.lit("."), F.col(a))


def closure_diff(pairs: DataFrame, closed: DataFrame, packages: DataFrame) -> DataFrame:
    """(a, b, name, side, evra_a, evra_b, depth_a, depth_b) for pairs (a, b) of the labels of closures (root, pkg_id, depth).

    side is common (the same versions on both sides), version_only (the name on both, not the same versions), only_a or only_b. evra is a sorted list, as a closure may hold several packages of
    a name; depth is the round that brings the first of them in. Each closure is named once, whatever the number of pairs that it is in. A label without a closure has no names; repeated
    pairs and packages count once.
    """
    named = closed.join(packages.select("pkg_id", "name", evra().alias("evra")).distinct(), "pkg_id")
    named = named.groupBy("root", "name").agg(F.array_sort(F.collect_set("evra")).alias("evra"), F.min("depth").alias("depth"))
    p = pairs.select("a", "b").distinct()
    one, other = (p.join(named.withColumnRenamed("root", s), s).select("a", "b", "name", F.col("evra").alias(f"evra_{s}"), F.col("depth").alias(f"depth_{s}")) for s in ("a", "b"))
    both = one.join(other, ["a", "b", "name"], "full_outer")
    side = F.when(F.col("evra_b").isNull(), "only_a").when(F.col("evra_a").isNull(), "only_b").when(F.col("evra_a") == F.col("evra_b"), "common").otherwise("version_only")
    return both.select("a", "b", "name", side.alias("side"), "evra_a", "evra_b", "depth_a", "depth_b")


def rounds_diff(diff: DataFrame) -> DataFrame:
    """(a, b, depth, common, version_only, only_a, only_b): a diff's names by the first round that brings them in on either side."""
    n = [F.count(F.when(F.col("side") == s, 1)).alias(s) for s in ("common", "version_only", "only_a", "only_b")]
    return diff.groupBy("a", "b", F.least("depth_a", "depth_b").alias("depth")).agg(*n)


def unmet(closed: DataFrame, caps: DataFrame, found: DataFrame) -> DataFrame:
    """(root, DEP, bucket, reason, parents, depth): what packages of each closure require and nothing meets, how many of them ask for it, and the first round that does.

    found has the outcomes of resolve.lookup; a package's unmet dependencies are cut out before closures are joined to them.
    """
    bad = found.where("outcome <> 'satisfied'").select(*(F.col(c).alias(f"_{c}") for c in DEP), F.col("outcome").alias("reason"))
    wants = caps.where("kind = 'requires'").select("pkg_id", *DEP).distinct()
    lost = wants.join(bad, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in DEP]).select("pkg_id", *DEP, "reason")
    g = closed.join(lost, "pkg_id").groupBy("root", *DEP, "reason").agg(F.count("*").alias("parents"), F.min("depth").alias("depth"))
    return g.select("root", *DEP, bucket(F.col("name"), F.col("op")).alias("bucket"), "reason", "parents", "depth")


def unmet_diff(pairs: DataFrame, lost: DataFrame) -> DataFrame:
    """(a, b, bucket, reason, common, only_a, only_b): unmet dependencies of two closures by kind and reason."""
    p = pairs.select("a", "b").distinct()
    sides = None
    for s in ("a", "b"):
        rows = p.join(lost.withColumnRenamed("root", s), s).select("a", "b", *DEP, "bucket", "reason", F.lit(int(s == "a")).alias("x"), F.lit(int(s == "b")).alias("y"))
        sides = rows if sides is None else sides.unionByName(rows)
    each = sides.groupBy("a", "b", *DEP, "bucket", "reason").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    n = [F.count(F.when(test, 1)).alias(name) for name, test in (("common", "x = 1 and y = 1"), ("only_a", "y = 0"), ("only_b", "x = 0")) for test in [F.expr(test)]]
    return each.groupBy("a", "b", "bucket", "reason").agg(*n)


def verdicts(labels: DataFrame, closed: DataFrame, lost: DataFrame) -> DataFrame:
    """(root, verdict, packages, unmet) of labels (root): skipped (nothing is known of it), unsat (something stays unmet) or ok."""
    n = closed.groupBy("root").agg(F.count("*").alias("packages"))
    m = lost.groupBy("root").agg(F.count("*").alias("unmet"))
    j = labels.select("root").distinct().join(n, "root", "left").join(m, "root", "left")
    verdict = F.when(F.col("packages").isNull(), "skipped").when(F.col("unmet").isNull(), "ok").otherwise("unsat")
    return j.select("root", verdict.alias("verdict"), F.coalesce("packages", F.lit(0)).alias("packages"), F.coalesce("unmet", F.lit(0)).alias("unmet"))
