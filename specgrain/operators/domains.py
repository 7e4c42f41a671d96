"""Conditions on architectures against the finite set of architectures that a profile may target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.recipes import Recipes
from .matrix import for_every


def arch_lists(r: Recipes) -> DataFrame:
    """(spec_id, line_no, how, archs): the distinct architectures that a branch lists, sorted; lists with macros can't be told and are left out, as are empty ones."""
    b = r.branches.where(F.col("how").isin("ifarch", "ifnarch", "elifarch") & ~F.col("condition").contains("%"))
    archs = F.array_sort(F.array_distinct(F.filter(F.split("condition", r"[\s,]+"), lambda a: a != "")))
    return b.select("spec_id", "line_no", "how", archs.alias("archs")).where(F.size("archs") > 0)


def arch_findings(r: Recipes, universes: DataFrame) -> DataFrame:
    """(lint_id, spec_id, profile_id, line_no, detail) of architecture lists for profiles with a universe (profile_id, arch).

    RPM440: an ifarch or elifarch lists the whole universe, so it always holds. RPM441: an ifnarch lists more of the universe than is left, so that an ifarch of the rest (the detail) is
    shorter. A profile without a universe has no findings; repeated and null architectures don't count.
    """
    sets = universes.where("arch is not null").groupBy("profile_id").agg(F.array_sort(F.collect_set("arch")).alias("universe"))
    b = for_every(arch_lists(r), sets)
    rest, over = F.array_except("universe", "archs"), F.array_except("archs", "universe")
    shorter = (F.col("how") == "ifnarch") & (F.size(over) == 0) & (F.size(rest) > 0) & (F.size(rest) < F.size("archs"))
    id = F.when((F.col("how") != "ifnarch") & (F.size(rest) == 0), "RPM440").when(shorter, "RPM441")
    return b.select(id.alias("lint_id"), "spec_id", "profile_id", "line_no", F.array_join(rest, " ").alias("detail")).where("lint_id is not null")
