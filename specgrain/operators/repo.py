"""Lookups over repository relations: packages, caps and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evr import like_escaped, version_key

BRIEF = ["pkg_id", "repo_id", "name", "epoch", "version", "release", "arch"]


def package_count(packages: DataFrame) -> DataFrame:
    return packages.groupBy("repo_id").agg(F.count("*").alias("n"))


def by_name(packages: DataFrame, name: str) -> DataFrame:
    return packages.where(F.col("name") == name).select(*BRIEF)


def by_name_newest_first(packages: DataFrame, name: str | None = None) -> DataFrame:
    """The packages of a name, or of each name, with their place. Versions compare as text here, as the listing has it; not in EVR order."""
    w = Window.partitionBy("name").orderBy(F.desc("epoch"), F.desc("version"), F.desc("release"), "pkg_id")
    wanted = packages if name is None else packages.where(F.col("name") == name)
    return wanted.select(*BRIEF, F.row_number().over(w).cast("long").alias("place"))


def newest(packages: DataFrame) -> DataFrame:
    """Each name's package of the highest EVR, in strict order; of equal ones that with the smallest id."""
    order = F.struct("epoch", version_key(F.col("version")).alias("v"), version_key(F.col("release")).alias("r"), (-F.col("pkg_id")).alias("k"))
    return packages.groupBy("name").agg(F.max_by("pkg_id", order).alias("pkg_id"))


def by_ids(packages: DataFrame, ids: DataFrame) -> DataFrame:
    """The packages with ids (pkg_id)."""
    return packages.join(ids.select("pkg_id").distinct(), "pkg_id", "left_semi").select(*BRIEF)


def with_files(packages: DataFrame, files: DataFrame) -> DataFrame:
    """(pkg_id, name, n_files, paths): every package with its paths in order; a package's paths are one value, those of one without files an empty one."""
    listed = files.distinct().groupBy("pkg_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    empty = F.array().cast("array<string>")
    return packages.select("pkg_id", "name").join(listed, "pkg_id", "left").select("pkg_id", "name", F.coalesce(F.size("paths"), F.lit(0)).cast("long").alias("n_files"), F.coalesce("paths", empty).alias("paths"))


def owners(files: DataFrame, packages: DataFrame, archs: list[str] | None = None) -> DataFrame:
    """(path, repo_id, pkg_id, arch): every owner of every path whose architecture is accepted."""
    accepted = packages.where(arch_accepted(F.col("arch"), archs)).select("pkg_id", "repo_id", "arch")
    return files.distinct().join(accepted, "pkg_id").select("path", "repo_id", "pkg_id", "arch")


def by_source(packages: DataFrame, source: str, archs: list[str] | None = None) -> DataFrame:
    return packages.where((F.col("source_name") == source) & arch_accepted(F.col("arch"), archs)).select(*BRIEF).distinct()


def arch_accepted(arch: Column, archs: list[str] | None) -> Column:
    """No list accepts everything."""
    return arch.isin(archs) if archs else F.lit(True)


def providing(packages: DataFrame, caps: DataFrame, name: str) -> DataFrame:
    """Packages with a Provides of that name."""
    wanted = caps.where((F.col("kind") == "provides") & (F.col("name") == name)).select("pkg_id").distinct()
    return packages.join(wanted, "pkg_id", "left_semi").select(*BRIEF)


def providing_like(packages: DataFrame, caps: DataFrame, text: str, limit: int) -> DataFrame:
    """Providers of capabilities that contain text, whatever its case; those named exactly so first. A report of `limit` rows."""
    hit = caps.where((F.col("kind") == "provides") & F.col("name").ilike(f"%{like_escaped(text)}%")).select("pkg_id", F.col("name").alias("capability"))
    pairs = packages.join(hit.distinct(), "pkg_id").select("pkg_id", "name", "capability")
    return pairs.orderBy((F.col("capability") == text).desc(), "capability", "name", "pkg_id").limit(limit)


def largest(packages: DataFrame, limit: int) -> DataFrame:
    return packages.orderBy(F.desc("size_installed"), "pkg_id").limit(limit).select("pkg_id", "name", "size_installed")


def candidates(packages: DataFrame, caps: DataFrame, archs: list[str] | None = None) -> DataFrame:
    """(capability, pkg_id) for own names and Provides, deduplicated."""
    p = packages.where(arch_accepted(F.col("arch"), archs))
    own = p.select(F.col("name").alias("capability"), "repo_id", "pkg_id")
    given = caps.where("kind = 'provides'").select("pkg_id", F.col("name").alias("capability")).distinct()
    return own.unionByName(given.join(p.select("pkg_id", "repo_id"), "pkg_id")).distinct()


def first_owner(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Each path's first owner in order of repository, then package.

    Packages, the smaller side, are hashed, and the least number of each repository and architecture comes first: minima of numbers combine map-side by hash, so files are never sorted.
    """
    owned = files.select("pkg_id", "path").join(packages.select("pkg_id", "repo_id", "arch").hint("shuffle_hash"), "pkg_id")
    least = owned.groupBy("path", "repo_id", "arch").agg(F.min("pkg_id").alias("pkg_id"))
    return least.groupBy("path").agg(F.min(F.struct("repo_id", "pkg_id", "arch")).alias("o")).select("path", "o.repo_id", "o.pkg_id", "o.arch")


def owner_counts(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Distinct owners and architectures of every path."""
    owned = files.distinct().join(packages.select("pkg_id", "arch"), "pkg_id")
    return owned.groupBy("path").agg(F.count("*").alias("owners"), F.countDistinct("arch").alias("archs"))


def shared_paths(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Paths that packages of different names own: what would conflict on install. Owners are counted by name first, by hash; only names are sorted."""
    owned = files.distinct().join(packages.select("pkg_id", "name").hint("shuffle_hash"), "pkg_id")
    named = owned.groupBy("path", "name").agg(F.count("*").alias("n"))
    return named.groupBy("path").agg(F.min("name").alias("least"), F.max("name").alias("most"), F.sum("n").alias("owners")).where("least <> most")


def owners_of(packages: DataFrame, files: DataFrame, path: str) -> DataFrame:
    return packages.join(files.where(F.col("path") == path), "pkg_id", "left_semi").select(*BRIEF)


def reverse_requires(packages: DataFrame, caps: DataFrame) -> DataFrame:
    """How many packages require each capability, no architecture set apart."""
    wanted = caps.where("kind = 'requires'").select("pkg_id", "name").distinct()
    return wanted.join(packages.select("pkg_id"), "pkg_id", "left_semi").groupBy("name").agg(F.count("*").alias("requirers"))


def caps_by_kind(packages: DataFrame, caps: DataFrame) -> DataFrame:
    """Every package with its capabilities of each kind as one sorted, joined list, null without one."""
    text = F.concat_ws(" ", "name", "op", F.coalesce("version", F.lit("-")))
    listed = caps.select("pkg_id", "kind", text.alias("t")).distinct()
    wide = listed.groupBy("pkg_id").pivot("kind", ["provides", "requires", "conflicts"]).agg(F.array_join(F.array_sort(F.collect_list("t")), ","))
    wide = wide.select("pkg_id", *(F.nullif(F.col(k), F.lit("")).alias(k) for k in ("provides", "requires", "conflicts")))
    return packages.select("pkg_id", "name").join(wide, "pkg_id", "left")
