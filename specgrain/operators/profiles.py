"""Profiles and their macros: target sets, listings, lookups across profiles, and checks of recipes over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.macros import expand, references
from ..sources.recipes import ATOM, BUILD_SECTIONS, OTHER_SECTIONS, SCRIPTLETS, Recipes
from .layers import merge_values
from .matrix import for_every
from .projection import Projection

#: Words after a percent sign that aren't macros.
DIRECTIVES = ("global", "define", "undefine", "if", "ifarch", "ifnarch", "ifos", "ifnos", "elif", "elifarch", "elifos", "else", "endif", "include", "dnl", "bcond", "bcond_with", "bcond_without",
              "with", "without", *BUILD_SECTIONS, *OTHER_SECTIONS, *SCRIPTLETS)


def target_members(members: DataFrame) -> DataFrame:
    """(target, profile_id, ord) without repeated members: the first place counts, and places are gapless."""
    first = members.groupBy("target", "profile_id").agg(F.min("ord").alias("ord"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("target").orderBy("ord", "profile_id")) - 1)


def resolve_macros(layers: DataFrame) -> DataFrame:
    """(profile_id, name, value, layer_no) of layered macro definitions: built-in, dump, override and command line, each with its layer number."""
    return merge_values(layers, ["profile_id", "name"])


def list_macros(macros: DataFrame, text: str | None = None, source: str | None = None) -> DataFrame:
    """Macros whose name contains text, whatever its case, and that come from source."""
    m = macros if text is None else macros.where(F.lower("name").contains(text.lower()))
    return m if source is None else m.where(F.col("source") == source)


def macro_table(profiles: DataFrame, macros: DataFrame, name: str) -> DataFrame:
    """One macro in every profile: its value, or none."""
    m = macros.where(F.col("name") == name).select("profile_id", "value")
    return profiles.select("profile_id").join(m, "profile_id", "left")


def explain_macro(profiles: DataFrame, macros: DataFrame, name: str) -> DataFrame:
    """(profile_id, status, value): undefined, literal, expanded or unresolved."""
    m = macros.where(F.col("name") == name).select("profile_id", "kind", F.col("value").alias("body"))
    asked = profiles.select("profile_id").join(m, "profile_id", "left")
    full = expand(asked.where("body is not null").select(F.col("profile_id").alias("key"), "profile_id", "body"), macros)
    j = asked.join(full.select(F.col("key").alias("profile_id"), "value"), "profile_id", "left")
    status = F.when(F.col("body").isNull(), "undefined").when(F.col("kind") == "literal", "literal").when(F.col("value").isNull(), "unresolved").otherwise("expanded")
    return j.select("profile_id", status.alias("status"), F.coalesce("value", "body").alias("value"))


def used_macros(r: Recipes) -> DataFrame:
    """(spec_id, name, local): macros that a recipe refers to, and whether it defines them itself."""
    used = r.lines.where(~F.col("line").rlike(r"^\s*#")).select("spec_id", F.explode(references(F.col("line"))).alias("name")).distinct()
    used = used.where(~F.col("name").isin(*DIRECTIVES))
    own = r.macros.select("spec_id", "name").distinct().withColumn("local", F.lit(True))
    return used.join(own, ["spec_id", "name"], "left").withColumn("local", F.coalesce("local", F.lit(False)))


def license_findings(r: Recipes, licenses: DataFrame) -> DataFrame:
    """(spec_id, profile_id, license) of license names that a profile's list lacks; profiles without a list have no findings."""
    from ..functions.evr import spdx_atoms

    named = r.tags.where("key = 'license'").select("spec_id", F.explode(spdx_atoms(F.col("value"))).alias("license")).where("license not like '%\\%%'").distinct()
    gated = licenses.select("profile_id").distinct()
    pairs = for_every(named, gated)
    return pairs.join(licenses.select("profile_id", F.col("name").alias("license")), ["profile_id", "license"], "left_anti").select("spec_id", "profile_id", "license")


def requirements(r: Recipes, key: str = "buildrequires") -> DataFrame:
    """Dependencies of recipes in the form that resolve.lookup takes: (spec_id, line_no, name, op, epoch, version, release); rich and unexpanded ones apart."""
    return _as_dependencies(r.atoms.where((F.col("key") == key) & ~F.col("rich") & ~F.col("atom").contains("%")), "spec_id", "line_no")


def _as_dependencies(a: DataFrame, *keys: str) -> DataFrame:
    """Atoms (name, op, evr) in the form that resolve.lookup takes, with the keys."""
    op = F.create_map(*(F.lit(x) for kv in (("=", "EQ"), ("<", "LT"), ("<=", "LE"), (">", "GT"), (">=", "GE")) for x in kv))
    epoch, rest = F.regexp_extract("evr", r"^([0-9]+):", 1), F.regexp_replace("evr", r"^[0-9]+:", "")
    bare = F.col("op").isNull()
    return a.select(
        *keys, "name", F.when(bare, "NONE").otherwise(op[F.col("op")]).alias("op"), F.when(~bare, F.coalesce(epoch.try_cast("int"), F.lit(0))).alias("epoch"),
        F.when(~bare, F.regexp_replace(rest, r"-[^-]*$", "")).alias("version"), F.when(~bare, F.regexp_extract(rest, r"-([^-]*)$", 1)).alias("release"),
    )


def projected_requirements(p: Projection, key: str = "buildrequires") -> DataFrame:
    """What each profile sees required, macros filled in: (spec_id, profile_id, line_no, name, op, epoch, version, release). Rich dependencies, and those whose macros can't be told, apart.

    A macro may stand for several dependencies.
    """
    told = p.atoms.where((F.col("key") == key) & F.col("told").isNotNull()).select("spec_id", "profile_id", "line_no", F.explode(F.regexp_extract_all("told", F.lit(ATOM), 0)).alias("atom"))
    atom = F.trim("atom")
    op = F.regexp_extract(atom, r"(<=|>=|=|<|>)", 1)
    evr = F.when(op != "", F.regexp_extract(atom, r"(?:<=|>=|=|<|>)\s*(\S+)$", 1))
    named = told.where(~atom.startswith("(")).select("spec_id", "profile_id", "line_no", F.regexp_extract(atom, r"^([^\s,<>=]+)", 1).alias("name"), F.when(op != "", op).alias("op"), evr.alias("evr"))
    return _as_dependencies(named, "spec_id", "profile_id", "line_no").distinct()


def _unmet(deps: dict[str, DataFrame], provided: DataFrame, *keys: str) -> DataFrame:
    """Findings of dependencies by kind that a universe can't meet."""
    from .resolve import DEP, lookup

    out = None
    for key, none, unmet in (("buildrequires", "RPM-REPO-001", "RPM-REPO-003"), ("requires", "RPM-REPO-002", None)):
        found = lookup(deps[key], provided).select(*(F.col(c).alias(f"_{c}") for c in DEP), "outcome")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in DEP]
        id = F.when(F.col("outcome") == "no_provider", none).when(F.col("outcome") == "version_unsatisfied", unmet)
        rows = deps[key].join(found, same).select(id.alias("lint_id"), *keys, F.concat_ws(" ", "name", "op", "version").alias("detail")).where("lint_id is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


def repository_findings(r: Recipes, provided: DataFrame) -> DataFrame:
    """Findings (lint_id, spec_id, line_no, detail) of dependencies that a universe can't meet: no provider of a build or run-time requirement, or none of a fitting version."""
    return _unmet({k: requirements(r, k) for k in ("buildrequires", "requires")}, provided, "spec_id", "line_no")


def projected_findings(p: Projection, provided: DataFrame) -> DataFrame:
    """repository_findings of what each profile sees, with profile_id: branches that it doesn't take ask for nothing, and macros are filled in."""
    return _unmet({k: projected_requirements(p, k) for k in ("buildrequires", "requires")}, provided, "spec_id", "profile_id", "line_no")


def _own(r: Recipes, key: str) -> DataFrame:
    return r.tags.where((F.col("key") == key) & (F.col("pkg") == "") & (F.col("depth") == 0)).groupBy("spec_id").agg(F.max_by("value", "line_no").alias(key), F.max("line_no").alias("line_no"))


def published_findings(r: Recipes, packages: DataFrame) -> DataFrame:
    """Findings of recipes whose EVR isn't above what is published under their name, or that drop a published epoch. Values with macros can't be told and are left out."""
    from .resolve import upgrades

    v = _own(r, "name").select("spec_id", "name").join(_own(r, "version"), "spec_id").join(_own(r, "release").select("spec_id", "release"), "spec_id")
    v = v.join(_own(r, "epoch").select("spec_id", "epoch"), "spec_id", "left")
    v = v.where("not concat(name, version, release) like '%\\%%'").withColumn("epoch", F.coalesce(F.col("epoch").try_cast("int"), F.lit(0)))
    found = upgrades(v.select("name", "epoch", "version", "release").distinct(), packages)
    id = F.when(F.col("verdict") == "epoch_dropped", "RPM-REPO-031").when(F.col("verdict").isin("same", "regress"), "RPM-REPO-030")
    return v.join(found, ["name", "epoch", "version", "release"]).select(id.alias("lint_id"), "spec_id", "line_no", F.concat_ws(" ", "name", "verdict").alias("detail")).where("lint_id is not null")


def file_findings(r: Recipes, packages: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of listed paths that packages of other sources own already; globs and macros apart."""
    own = _own(r, "name").select("spec_id", "name")
    paths = r.files.where("not is_glob and not is_dir and not is_ghost and path like '/%' and path not like '%\\%%'").select("spec_id", "line_no", "path")
    owned = files.distinct().join(packages.select("pkg_id", F.col("name").alias("owner"), "source_name"), "pkg_id")
    hit = paths.join(owned, "path").join(own, "spec_id").where("owner <> name and not source_name <=> name")
    g = hit.groupBy("spec_id", "line_no", "path").agg(F.min("owner").alias("owner"))
    return g.select(F.lit("RPM-REPO-020").alias("lint_id"), "spec_id", "line_no", F.concat_ws(" ", "path", "owner").alias("detail"))
