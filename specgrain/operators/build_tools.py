"""Programs that build scripts run, their owners in a universe, and whether a recipe's build requirements bring them in."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sources.recipes import BUILD_SECTIONS, Recipes
from .matrix import for_every
from .profiles import projected_requirements
from .projection import Projection, filled, visible
from .repo import first_owner
from .resolve import DEP, edges, lookup, reached

# Commands and paths that every build root has.
SHELL_BUILTINS = """: [ [[ alias break builtin case cd command continue declare do done echo elif else esac eval exec exit export false fi for function getopts hash if in let local
popd printf pushd pwd read readonly return set shift source test then time trap true type ulimit umask unalias unset until wait while""".split()
CORE_COMMANDS = """awk basename cat chgrp chmod chown cmp cp cut date diff dirname du env expr find grep head iconv id install ln ls mkdir mktemp mv od readlink realpath rm rmdir
sed seq sleep sort stat tail tee touch tr uname uniq wc which xargs""".split()
BUILD_COMMANDS = "bash bunzip2 bzip2 gunzip gzip make patch sh tar unxz unzip xz zstd".split()
IMPLICIT_PATHS = [f"{d}/{n}" for d in ("/bin", "/usr/bin") for n in ("bash", "cat", "cp", "install", "ls", "mkdir", "mv", "rm", "sh")] + ["/sbin/ldconfig", "/usr/sbin/ldconfig"]
#: Where a bare command is looked for, in order.
COMMAND_PATH = ("/usr/bin", "/usr/sbin", "/bin", "/sbin")

_COMMAND = r"^[A-Za-z0-9_.+][A-Za-z0-9_.+-]*$"
_PROGRAM = r"^(?:/usr/local|/usr|/opt/[^/]+|)/s?bin/(?:[^/]+/)*(?![^/]*\.so)(?![^/]*\.(?:pc|h)$)[A-Za-z0-9._-]+$"
#: A line of alternatives of a case.
_CASE = r"^[^(]*\)\s*$"


def tool_uses(r: Recipes, p: Projection, profiles: DataFrame, macros: DataFrame) -> DataFrame:
    """(spec_id, profile_id, line_no, tool, path): programs that the build sections a profile sees run by a bare name (path null) or name by an absolute path.

    Paths are words of commands, with their macros filled in; a word whose macros can't be told, what a redirection writes, comments and here-documents aren't uses. Commands that every
    build root has, macros and variables as commands, and the patterns of a case aren't either.
    """
    cmds = stored(r.commands.where(F.col("kind").isin(*BUILD_SECTIONS)).select("spec_id", "line_no", "name", "args"), "tools-commands")
    cases = r.body.where(F.col("kind").isin(*BUILD_SECTIONS) & F.col("line").rlike(_CASE)).select("spec_id", "line_no")
    bare = cmds.join(cases, ["spec_id", "line_no"], "left_anti").where(F.col("name").rlike(_COMMAND) & ~F.col("name").isin(*SHELL_BUILTINS, *CORE_COMMANDS, *BUILD_COMMANDS))
    named = cmds.select("spec_id", "line_no", F.explode(F.concat(F.array("name"), "args")).alias("tool")).where(F.col("tool").rlike("^[/%]"))
    seen = lambda rows: visible(for_every(rows.distinct(), profiles.select("profile_id")), p.branches)
    by_name = seen(bare.select("spec_id", "line_no", F.col("name").alias("tool")))
    by_path = filled(seen(named), "tool", p.definitions, macros).where(F.col("told").rlike(_PROGRAM) & ~F.col("told").isin(*IMPLICIT_PATHS))
    key = ["spec_id", "profile_id", "line_no"]
    none = F.lit(None).cast("string")
    return by_name.select(*key, "tool", none.alias("path")).unionByName(by_path.select(*key, F.col("told").alias("tool"), F.col("told").alias("path"))).distinct()


def tool_owners(tools: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """(tool, pkg_id, owner): the package that owns each of the distinct tools (tool, path) first; a bare command's is that of the first directory that has it. Tools without one are left out.

    Only files with an asked path are looked at for their owners.
    """
    t = tools.select("tool", "path").distinct()
    places = F.array(*(F.struct(F.lit(i).alias("rank"), F.concat(F.lit(f"{d}/"), "tool").alias("at")) for i, d in enumerate(COMMAND_PATH)))
    asked = t.select("tool", F.explode(F.when(F.col("path").isNull(), places).otherwise(F.array(F.struct(F.lit(0).alias("rank"), F.col("path").alias("at"))))).alias("p"))
    asked = asked.select("tool", "p.rank", F.col("p.at").alias("path"))
    owned = first_owner(files.join(asked.select("path").distinct(), "path", "left_semi"), packages)
    best = asked.join(owned, "path").groupBy("tool").agg(F.min(F.struct("rank", "pkg_id")).alias("o")).select("tool", "o.pkg_id")
    return best.join(packages.select("pkg_id", F.col("name").alias("owner")), "pkg_id").select("tool", "pkg_id", "owner")


def declared_names(p: Projection) -> DataFrame:
    """(spec_id, profile_id, name) that build requirements name; of boolean ones all names but those of conditions and of what `without` excludes."""
    told = p.atoms.where("key = 'buildrequires' and told is not null")
    plain = projected_requirements(p).select("spec_id", "profile_id", "name")
    unversioned = F.regexp_replace("told", r"(?:<=|>=|=|<|>)\s*[^\s()]+", " ")
    # A condition stands between if/unless and else or the closing bracket; nested ones go first.
    asked = F.regexp_replace(unversioned, r"\b(?:if|unless|without)\s+(?:[^\s()]+|\([^()]*\))", " ")
    words = F.regexp_extract_all(asked, F.lit(r"[^\s(),]+(?:\([^()\s]*\))*"), F.lit(0))
    rich = told.where(F.col("told").startswith("(")).select("spec_id", "profile_id", F.explode(words).alias("name")).where(~F.col("name").isin("and", "or", "with", "else"))
    return plain.unionByName(rich).distinct()


def missing_tools(r: Recipes, p: Projection, profiles: DataFrame, macros: DataFrame, packages: DataFrame, caps: DataFrame, provided: DataFrame, files: DataFrame) -> DataFrame:
    """(lint_id, spec_id, profile_id, line_no, tool, owner, reached): programs whose owner no build requirement names, by a bare command (RPM-REPO-010) or a path (RPM-REPO-011), once each
    at their first line.

    reached says whether the closure of the recipe's build requirements brings the owner in all the same: then the build works today, by what other packages need. Profiles are a dimension of checked size; macros (profile_id, name, value) hold whole values. No recipes, or no owners, give no rows.
    """
    p = replace(p, atoms=stored(p.atoms.where("key = 'buildrequires'"), "tools-atoms"), branches=stored(p.branches, "tools-branches"))
    used = stored(tool_uses(r, p, profiles, macros), "tools-used")
    owned = used.join(tool_owners(used, packages, files), "tool")
    declared = declared_names(p).withColumnRenamed("name", "owner")
    lost = owned.join(declared, ["spec_id", "profile_id", "owner"], "left_anti")
    id = F.when(F.col("path").isNull(), "RPM-REPO-010").otherwise("RPM-REPO-011")
    lost = lost.groupBy(id.alias("lint_id"), "spec_id", "profile_id", "tool", "owner", "pkg_id").agg(F.min("line_no").alias("line_no"))
    lost = stored(lost, "tools-lost")

    wanted = projected_requirements(p)
    found = stored(lookup(wanted.select(*DEP).unionByName(caps.where("kind = 'requires'").select(*DEP)), provided), "tools-found")
    met = found.where("outcome = 'satisfied'").select(*(F.col(c).alias(f"_{c}") for c in DEP), "pkg_id")
    roots = wanted.join(met, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in DEP]).select(F.struct("spec_id", "profile_id").alias("root"), "pkg_id")
    brought = reached(lost.select(F.struct("spec_id", "profile_id").alias("root"), "pkg_id"), roots, edges(caps, found))
    brought = brought.select("root.spec_id", "root.profile_id", "pkg_id", F.lit(True).alias("reached"))
    out = lost.join(brought, ["spec_id", "profile_id", "pkg_id"], "left")
    return out.select("lint_id", "spec_id", "profile_id", "line_no", "tool", "owner", F.coalesce("reached", F.lit(False)).alias("reached"))
