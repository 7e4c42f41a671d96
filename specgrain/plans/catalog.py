"""The registered queries outside llm, over the adapted test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evr
from ..operators import branch_rules as branch_rules  # registers its rules
from ..operators import parser_rules as parser_rules  # registers its rules
from ..operators import paths as paths  # registers its rules
from ..operators import closure_reports, conditions, layers, matrix, recipe_rules, repo, resolve, rules, solver
from ..session import stored
from ..sources import adapters as A
from ..sources import recipes
from ..sources.adapters import key_sql, with_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Repository relations.


@query(with_sql("packages", query=" SELECT repo_id, count(*) AS n FROM packages GROUP BY repo_id"))
def pkg_count(s, d):
    return repo.package_count(A.packages(s, d))


_BRIEF = "pkg_id, repo_id, name, epoch, version, release, arch"
#: A name, a source, a capability and a path that occur at every size.
NAME, SOURCE, CAP, PATH = "green rod 1", "Brand#11", "cap7", "/usr/bin/f7"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(with_sql("packages", query=f" SELECT {_BRIEF} FROM packages WHERE source_name = {_text(SOURCE)}"))
def pkgs_by_source(s, d):
    return repo.by_source(A.packages(s, d), SOURCE)


@query(
    with_sql(
        "packages",
        query=" SELECT name, pkg_id, CAST(row_number() OVER (PARTITION BY name ORDER BY epoch DESC, version DESC, release DESC, pkg_id) AS BIGINT) AS place FROM packages",
    )
)
def pkgs_by_name_newest(s, d):
    """The listing of every name, newest first as text."""
    return repo.by_name_newest_first(A.packages(s, d)).select("name", "pkg_id", "place")


@query(with_sql("packages", "caps", query=f" SELECT {_BRIEF} FROM packages WHERE pkg_id IN (SELECT pkg_id FROM caps WHERE kind = 'provides' AND name = '{CAP}')"))
def providers_exact(s, d):
    return repo.providing(A.packages(s, d), A.caps(s, d), CAP)


@query(
    with_sql(
        "packages", "caps",
        query=f""" SELECT DISTINCT p.pkg_id, p.name, c.name AS capability FROM packages p JOIN caps c ON c.pkg_id = p.pkg_id
WHERE c.kind = 'provides' AND c.name ILIKE '%CAP1%' ORDER BY (c.name = 'CAP1') DESC, c.name, p.name, p.pkg_id LIMIT 40""",
    )
)
def providers_like(s, d):
    return repo.providing_like(A.packages(s, d), A.caps(s, d), "CAP1", 40)


@query(with_sql("packages", query=" SELECT pkg_id, name, size_installed FROM packages ORDER BY size_installed DESC, pkg_id LIMIT 10"))
def top_by_size(s, d):
    return repo.largest(A.packages(s, d), 10)


@query(
    with_sql(
        "packages", "files",
        query=""" SELECT path, repo_id, pkg_id, arch FROM (SELECT f.path, p.repo_id, p.pkg_id, p.arch, row_number() OVER (PARTITION BY f.path ORDER BY p.repo_id, p.pkg_id) AS r
FROM files f JOIN packages p ON p.pkg_id = f.pkg_id) WHERE r = 1""",
    )
)
def file_owner_first(s, d):
    return repo.first_owner(A.files(s, d), A.packages(s, d))


@query(with_sql("packages", "files", query=" SELECT path, count(DISTINCT p.pkg_id) AS owners, count(DISTINCT arch) AS archs FROM files f JOIN packages p ON p.pkg_id = f.pkg_id GROUP BY path"))
def file_owners_all(s, d):
    return repo.owner_counts(A.files(s, d), A.packages(s, d))


@query(
    with_sql(
        "packages", "files",
        query=" SELECT DISTINCT path, p.repo_id, p.pkg_id, p.arch FROM files f JOIN packages p ON p.pkg_id = f.pkg_id WHERE p.arch IN ('x86_64', 'noarch')",
    )
)
def file_owner_rows(s, d):
    """Every owner of every path that runs on one architecture."""
    return repo.owners(A.files(s, d), A.packages(s, d), ["x86_64", "noarch"])


@query(
    with_sql(
        "packages", "files",
        query=""" SELECT p.pkg_id, p.name, count(f.path) AS n_files, coalesce(string_agg(f.path, ' ' ORDER BY f.path), '') AS paths
FROM packages p LEFT JOIN (SELECT DISTINCT * FROM files) f ON f.pkg_id = p.pkg_id GROUP BY p.pkg_id, p.name""",
    )
)
def pkg_files(s, d):
    return repo.with_files(A.packages(s, d), A.files(s, d)).withColumn("paths", F.array_join("paths", " "))


@query(with_sql("packages", "files", query=f" SELECT {_BRIEF} FROM packages p WHERE EXISTS (SELECT 1 FROM files f WHERE f.pkg_id = p.pkg_id AND f.path = '{PATH}')"))
def owns_file_semi(s, d):
    return repo.owners_of(A.packages(s, d), A.files(s, d), PATH)


@query(
    with_sql(
        "packages", "files",
        query=" SELECT path, min(name) AS least, max(name) AS most, count(*) AS owners FROM (SELECT DISTINCT * FROM files) f JOIN packages p ON p.pkg_id = f.pkg_id GROUP BY path HAVING min(name) <> max(name)",
    )
)
def file_conflicts(s, d):
    return repo.shared_paths(A.files(s, d), A.packages(s, d))


@query(with_sql("packages", "caps", query=" SELECT c.name, count(DISTINCT c.pkg_id) AS requirers FROM caps c JOIN packages p ON p.pkg_id = c.pkg_id WHERE kind = 'requires' GROUP BY c.name"))
def reverse_requires(s, d):
    return repo.reverse_requires(A.packages(s, d), A.caps(s, d))


def _list(kind: str) -> str:
    return f"string_agg(t, ',' ORDER BY t) FILTER (kind = '{kind}') AS {kind}"


@query(
    with_sql(
        "packages", "caps",
        query=f""" SELECT p.pkg_id, p.name, c.provides, c.requires, c.conflicts FROM packages p LEFT JOIN (SELECT pkg_id, {_list('provides')}, {_list('requires')}, {_list('conflicts')}
FROM (SELECT DISTINCT pkg_id, kind, name || ' ' || op || ' ' || coalesce(version, '-') AS t FROM caps) GROUP BY pkg_id) c ON c.pkg_id = p.pkg_id""",
    )
)
def pkg_caps_pivot(s, d):
    return repo.caps_by_kind(A.packages(s, d), A.caps(s, d))


@query(
    with_sql(
        "packages", "caps",
        query=""" SELECT capability, count(*) AS candidates, min(pkg_id) AS least FROM (SELECT name AS capability, pkg_id FROM packages UNION
SELECT c.name, c.pkg_id FROM caps c JOIN packages p ON p.pkg_id = c.pkg_id WHERE kind = 'provides') GROUP BY capability""",
    )
)
def candidate_set(s, d):
    return repo.candidates(A.packages(s, d), A.caps(s, d)).groupBy("capability").agg(F.count("*").alias("candidates"), F.min("pkg_id").alias("least"))


# Versions.


@query(with_sql("packages", query=f" SELECT pkg_id, {key_sql('version')} AS vkey, {key_sql('release')} AS rkey FROM packages"))
def evr_key(s, d):
    return A.packages(s, d).select("pkg_id", evr.version_key(F.col("version")).alias("vkey"), evr.version_key(F.col("release")).alias("rkey"))


@query(
    with_sql(
        "packages",
        query=f""" SELECT name, max_by(pkg_id, (epoch, {key_sql('version')}, {key_sql('release')}, -pkg_id)) AS pkg_id FROM packages GROUP BY name""",
    )
)
def evr_newest(s, d):
    return repo.newest(A.packages(s, d))


@query(
    with_sql(
        "packages",
        query=""" SELECT pkg_id, name || '-' || CASE WHEN epoch > 0 THEN epoch || ':' ELSE '' END || version || '-' || release || '.' || arch AS nevra,
CASE WHEN size_installed >= 1024 THEN 'large' ELSE 'small' END AS size_class FROM packages""",
    )
)
def nevra_text(s, d):
    p = A.packages(s, d)
    text = evr.nevra_text(*(F.col(c) for c in ("name", "epoch", "version", "release", "arch")))
    return p.select("pkg_id", text.alias("nevra"), F.when(F.col("size_installed") >= 1024, "large").otherwise("small").alias("size_class"))


# Resolution.

_COMPARE = f"""CASE WHEN p_version IS NULL THEN NULL WHEN p_version LIKE 'set:%' AND version LIKE 'set:%' THEN 0
  WHEN p_epoch < epoch THEN -1 WHEN p_epoch > epoch THEN 1 WHEN {key_sql('p_version')} < {key_sql('version')} THEN -1 WHEN {key_sql('p_version')} > {key_sql('version')} THEN 1
  WHEN p_release = '' OR release = '' THEN 0 WHEN {key_sql('p_release')} < {key_sql('release')} THEN -1 WHEN {key_sql('p_release')} > {key_sql('release')} THEN 1 ELSE 0 END"""
_HOLDS = "(op = 'NONE' OR coalesce(CASE op WHEN 'EQ' THEN cmp = 0 WHEN 'LT' THEN cmp < 0 WHEN 'LE' THEN cmp <= 0 WHEN 'GT' THEN cmp > 0 WHEN 'GE' THEN cmp >= 0 END, false))"
_LOOKUP = f""",
prov AS (SELECT p.name AS cap, p.pkg_id, p.epoch AS p_epoch, p.version AS p_version, p.release AS p_release FROM packages p
  UNION SELECT c.name, c.pkg_id, c.epoch, c.version, c.release FROM caps c JOIN packages p ON p.pkg_id = c.pkg_id WHERE c.kind = 'provides'),
dep AS (SELECT DISTINCT name, op, epoch, version, release FROM caps WHERE kind = 'requires'),
cand AS (SELECT d.*, v.pkg_id, {_COMPARE} AS cmp FROM dep d JOIN prov v ON v.cap = d.name),
best AS (SELECT c.*, {_HOLDS} AS sat, row_number() OVER (PARTITION BY c.name, op, c.epoch, c.version, c.release
  ORDER BY {_HOLDS} DESC, p.repo_id, p.epoch DESC, {key_sql('p.version')} DESC, {key_sql('p.release')} DESC, p.name, p.pkg_id) AS r
  FROM cand c JOIN packages p ON p.pkg_id = c.pkg_id),
found AS (SELECT d.name, d.op, d.epoch, d.version, d.release, CASE WHEN b.pkg_id IS NULL THEN 'no_provider' WHEN b.sat THEN 'satisfied' ELSE 'version_unsatisfied' END AS outcome, b.pkg_id
  FROM dep d LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.name = d.name AND b.op = d.op AND b.version IS NOT DISTINCT FROM d.version)"""


def _found(s, d):
    p, c = A.packages(s, d), A.caps(s, d)
    return resolve.lookup(c.where("kind = 'requires'"), resolve.providers(p, c))


@query(with_sql("packages", "caps", query=_LOOKUP + " SELECT * FROM found"))
def dependency_lookup(s, d):
    return _found(s, d)


@query(with_sql("packages", "caps", query=_LOOKUP + " SELECT outcome, op, count(*) AS n FROM found GROUP BY outcome, op"))
def lookup_outcome(s, d):
    return _found(s, d).groupBy("outcome", "op").agg(F.count("*").alias("n"))


@query(
    with_sql(
        "packages", "caps",
        query=" SELECT c.pkg_id, c.name FROM (SELECT DISTINCT pkg_id, name FROM caps WHERE kind = 'requires') c WHERE NOT EXISTS"
        " (SELECT 1 FROM caps v JOIN packages p ON p.pkg_id = v.pkg_id WHERE v.kind = 'provides' AND v.name = c.name) AND NOT EXISTS (SELECT 1 FROM packages p WHERE p.name = c.name)",
    )
)
def unresolvable_requires(s, d):
    c = A.caps(s, d)
    given = repo.candidates(A.packages(s, d), c).select(F.col("capability").alias("name")).distinct()
    return rules.without(c.where("kind = 'requires'").select("pkg_id", "name").distinct(), given, ["name"]).select("pkg_id", "name")


_EDGES = _LOOKUP + """,
edge AS (SELECT DISTINCT c.pkg_id, f.pkg_id AS needs FROM caps c JOIN found f ON c.name = f.name AND c.op = f.op AND c.version IS NOT DISTINCT FROM f.version
  WHERE c.kind = 'requires' AND f.outcome = 'satisfied')"""


@query(with_sql("packages", "caps", query=_EDGES + " SELECT pkg_id, count(*) AS needs FROM edge GROUP BY pkg_id"))
def direct_needs(s, d):
    return resolve.edges(A.caps(s, d), _found(s, d)).groupBy("pkg_id").agg(F.count("*").alias("needs"))


@query(
    with_sql(
        "packages", "caps", recursive=True,
        query=_EDGES + ",\nreach AS (SELECT pkg_id FROM packages WHERE arch = 'noarch' UNION SELECT e.needs FROM reach r JOIN edge e ON e.pkg_id = r.pkg_id) SELECT pkg_id FROM reach",
    )
)
def closure_of_noarch(s, d):
    """All that the architecture-independent packages need, directly or not."""
    p, c = A.packages(s, d), A.caps(s, d)
    return resolve.closure(p.where("arch = 'noarch'"), resolve.needs(c, _found(s, d))).select("pkg_id")


@query(
    with_sql(
        "packages", "caps",
        query=f""",
prov AS (SELECT name AS cap, pkg_id AS victim, epoch AS p_epoch, version AS p_version, release AS p_release FROM packages
  UNION SELECT c.name, c.pkg_id, c.epoch, c.version, c.release FROM caps c JOIN packages p ON p.pkg_id = c.pkg_id WHERE c.kind = 'provides'),
pair AS (SELECT c.pkg_id, c.name, c.op, v.victim, {_COMPARE} AS cmp FROM (SELECT DISTINCT * FROM caps WHERE kind = 'conflicts') c JOIN prov v ON v.cap = c.name WHERE c.pkg_id <> v.victim)
SELECT pkg_id, count(*) AS victims, min(via) AS via FROM (SELECT pkg_id, victim, min(name) AS via FROM pair WHERE {_HOLDS} GROUP BY pkg_id, victim) GROUP BY pkg_id""",
    )
)
def conflict_pairs(s, d):
    p, c = A.packages(s, d), A.caps(s, d)
    return resolve.conflict_counts(c, resolve.provides(p, c))


@query(
    with_sql(
        "packages",
        query=f""",
pub AS (SELECT name, max_by((epoch, version, release), (epoch, {key_sql('version')}, {key_sql('release')})) AS b FROM packages WHERE repo_id = 'r0' GROUP BY name),
x AS (SELECT p.*, b[1] AS p_epoch, b[2] AS p_version, b[3] AS p_release, b IS NULL AS fresh FROM packages p LEFT JOIN pub ON pub.name = p.name WHERE repo_id = 'r1'),
y AS (SELECT *, {_COMPARE.replace('p_version', 'q_version').replace('p_epoch', 'q_epoch').replace('p_release', 'q_release').replace(' epoch', ' p_epoch')} AS cmp FROM
  (SELECT name, pkg_id, fresh, epoch AS q_epoch, version AS q_version, release AS q_release, p_epoch, p_version AS version, p_release AS release FROM x))
SELECT name, q_epoch AS epoch, q_version AS version, q_release AS release, CASE WHEN fresh THEN 'new' WHEN q_epoch = 0 AND p_epoch > 0 THEN 'epoch_dropped'
  WHEN cmp > 0 THEN 'upgrade' WHEN cmp = 0 THEN 'same' ELSE 'regress' END AS verdict FROM y""",
    )
)
def upgrade_sim(s, d):
    p = A.packages(s, d)
    return resolve.upgrades(p.where("repo_id = 'r1'").select("name", "epoch", "version", "release"), p.where("repo_id = 'r0'"))

#: Every part also requires the program of another line of its orders, so that some requirements are paths with many owners.
_ROOTS = f""",
allcaps AS (SELECT DISTINCT pkg_id, kind, name, op, epoch, version, release FROM caps
  UNION SELECT l_partkey, 'requires', '/usr/bin/f' || ((l_orderkey + l_partkey) % 500), 'NONE', NULL, NULL, NULL FROM lineitem WHERE l_quantity > 49),
place AS (SELECT *, row_number() OVER (ORDER BY repo_id, epoch DESC, {key_sql('version')} DESC, {key_sql('release')} DESC, name, pkg_id) AS place FROM packages),
owner AS (SELECT DISTINCT f.path, p.pkg_id, p.repo_id FROM files f JOIN packages p ON p.pkg_id = f.pkg_id),
firsts AS (SELECT path, arg_min(pkg_id, (repo_id, pkg_id)) AS pkg_id FROM owner GROUP BY path),
prov AS (SELECT name AS cap, pkg_id, epoch AS p_epoch, version AS p_version, release AS p_release FROM packages
  UNION SELECT c.name, c.pkg_id, c.epoch, c.version, c.release FROM caps c JOIN packages p ON p.pkg_id = c.pkg_id WHERE c.kind = 'provides'
  UNION SELECT path, pkg_id, NULL, NULL, NULL FROM firsts),
dep AS (SELECT *, row_number() OVER () AS dep_id FROM (SELECT DISTINCT name, op, epoch, version, release FROM allcaps WHERE kind <> 'provides')),
sat AS MATERIALIZED (SELECT DISTINCT dep_id, pkg_id FROM (SELECT d.*, v.pkg_id, {_COMPARE} AS cmp FROM dep d JOIN prov v ON v.cap = d.name) WHERE {_HOLDS}),
meet AS MATERIALIZED (SELECT * FROM sat UNION SELECT d.dep_id, o.pkg_id FROM dep d JOIN owner o ON o.path = d.name),
best AS MATERIALIZED (SELECT s.dep_id, arg_min(p.pkg_id, p.place) AS pkg_id FROM sat s JOIN place p ON p.pkg_id = s.pkg_id GROUP BY s.dep_id),
need AS MATERIALIZED (SELECT c.pkg_id AS parent, d.dep_id FROM allcaps c JOIN dep d ON d.name = c.name AND d.op = c.op AND d.version IS NOT DISTINCT FROM c.version WHERE c.kind = 'requires'),
asked AS MATERIALIZED (SELECT DISTINCT n.dep_id FROM need n JOIN packages p ON p.pkg_id = n.parent WHERE p.arch = 'noarch'),
says AS (SELECT DISTINCT c.pkg_id AS a, s.pkg_id AS b FROM allcaps c JOIN dep d ON d.name = c.name AND d.op = c.op AND d.version IS NOT DISTINCT FROM c.version JOIN sat s ON s.dep_id = d.dep_id
  WHERE c.kind = 'conflicts' AND c.pkg_id <> s.pkg_id),
excludes AS MATERIALIZED (SELECT a, b FROM says UNION SELECT b, a FROM says UNION SELECT x.pkg_id, y.pkg_id FROM packages x JOIN packages y ON x.name = y.name AND x.pkg_id <> y.pkg_id),
solved AS (
  SELECT DISTINCT b.pkg_id, p.place, 1 AS depth, 1 AS round, false AS pinned FROM asked a JOIN best b ON b.dep_id = a.dep_id JOIN place p ON p.pkg_id = b.pkg_id
  UNION ALL (
  WITH pin AS (SELECT * FROM solved WHERE pinned),
  alive AS (SELECT * FROM solved s WHERE NOT pinned AND NOT EXISTS (SELECT 1 FROM excludes e JOIN pin ON pin.pkg_id = e.b WHERE e.a = s.pkg_id)),
  kept AS (SELECT * FROM alive s WHERE NOT EXISTS (SELECT 1 FROM excludes e JOIN alive x ON x.pkg_id = e.b WHERE e.a = s.pkg_id AND x.place < s.place)),
  open_deps AS (SELECT DISTINCT n.dep_id, pin.depth FROM pin JOIN need n ON n.parent = pin.pkg_id WHERE pin.depth = pin.round AND NOT EXISTS (SELECT 1 FROM meet m JOIN pin q ON q.pkg_id = m.pkg_id WHERE m.dep_id = n.dep_id)),
  fresh AS (SELECT DISTINCT b.pkg_id, p.place, o.depth + 1 AS depth FROM open_deps o JOIN best b ON b.dep_id = o.dep_id JOIN place p ON p.pkg_id = b.pkg_id
    WHERE NOT EXISTS (SELECT 1 FROM solved WHERE NOT pinned))
  SELECT pkg_id, place, depth, round, true FROM kept
  UNION ALL SELECT pkg_id, place, depth, round, false FROM alive WHERE pkg_id NOT IN (SELECT pkg_id FROM kept)
  UNION ALL SELECT pkg_id, place, depth, round, true FROM pin WHERE EXISTS (SELECT 1 FROM solved WHERE NOT pinned)
  UNION ALL SELECT pkg_id, place, depth, round + 1, true FROM pin WHERE EXISTS (SELECT 1 FROM fresh)
  UNION ALL SELECT pkg_id, place, depth, depth, false FROM fresh)),
pins AS MATERIALIZED (SELECT DISTINCT pkg_id, depth FROM solved WHERE pinned),
wants AS (SELECT CAST(NULL AS BIGINT) AS parent, dep_id FROM asked UNION SELECT n.parent, n.dep_id FROM need n JOIN pins p ON p.pkg_id = n.parent),
lost AS (SELECT dep_id, count(DISTINCT parent) AS parents FROM wants w WHERE NOT EXISTS (SELECT 1 FROM meet m JOIN pins p ON p.pkg_id = m.pkg_id WHERE m.dep_id = w.dep_id) GROUP BY dep_id),
blocks AS (SELECT b.dep_id, min((CASE WHEN says.a IS NOT NULL THEN 'conflict' ELSE 'other_version' END, e.b)) AS why FROM best b JOIN excludes e ON e.a = b.pkg_id JOIN pins p ON p.pkg_id = e.b
  LEFT JOIN (SELECT a, b FROM says UNION SELECT b, a FROM says) says ON says.a = e.a AND says.b = e.b WHERE b.dep_id IN (SELECT dep_id FROM lost) GROUP BY b.dep_id)"""


def _solved(s, d):
    """A build root that asks for all that the architecture-independent packages require, paths included."""
    p, c, f = A.packages(s, d), A.caps(s, d), A.files(s, d)
    line = A.table(s, d, "lineitem").where("l_quantity > 49")
    path = F.concat(F.lit("/usr/bin/f"), ((F.col("l_orderkey") + F.col("l_partkey")) % 500).cast("string"))
    none = F.lit(None)
    c = c.unionByName(line.select(F.col("l_partkey").alias("pkg_id"), F.lit("requires").alias("kind"), path.alias("name"), F.lit("NONE").alias("op"),
                                  none.cast("int").alias("epoch"), none.cast("string").alias("version"), none.cast("string").alias("release")))
    asked = c.where("kind = 'requires'").join(p.where("arch = 'noarch'").select("pkg_id"), "pkg_id", "left_semi").select(*resolve.DEP).distinct()
    return solver.solve(p.where("false"), p, c, resolve.providers(p, c, f), f, asked)


@query(with_sql("packages", "caps", "files", recursive=True, query=_ROOTS + """
SELECT 'pin' AS kind, pkg_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS version, depth, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS blocker, CAST(NULL AS BIGINT) AS parents FROM pins
UNION ALL SELECT 'unmet', NULL, d.name, d.op, d.version, NULL, coalesce(why[1], 'no_provider'), why[2], parents FROM lost l JOIN dep d ON d.dep_id = l.dep_id LEFT JOIN blocks b ON b.dep_id = l.dep_id"""))
def buildroot(s, d):
    """Which packages make up a build root, at which distance, and which requirements can't be met in it and why."""
    pins, unmet = _solved(s, d)
    none = F.lit(None)
    one = pins.select(F.lit("pin").alias("kind"), "pkg_id", none.cast("string").alias("name"), none.cast("string").alias("op"), none.cast("string").alias("version"), "depth",
                      none.cast("string").alias("reason"), none.cast("long").alias("blocker"), none.cast("long").alias("parents"))
    left = unmet.groupBy(*resolve.DEP, "reason", "blocker").agg(F.countDistinct("parent").alias("parents"))
    return one.unionByName(left.select(F.lit("unmet").alias("kind"), none.cast("long").alias("pkg_id"), "name", "op", "version", none.cast("int").alias("depth"), "reason", "blocker", "parents"))


# Closures of every brand, compared with those of the next brand.

#: Names without their number, so that a name has several versions; some parts also require programs by path or libraries by soname.
_BRANDS = (
    A.SQL["packages"].replace("p_name AS name", "regexp_replace(p_name, ' [0-9]+$', '') AS name")
    + ",\n" + A.SQL["caps"].replace("\ncaps AS", "\nplain AS")
    + """,
caps AS (SELECT DISTINCT pkg_id, kind, name, op, epoch, version, release FROM plain
  UNION SELECT l_partkey, 'requires', '/usr/bin/f' || (l_orderkey % 700), 'NONE', NULL, NULL, NULL FROM lineitem WHERE l_quantity > 49
  UNION SELECT l_partkey, 'requires', 'lib' || (l_orderkey % 90) || '.so.' || (l_partkey % 3), 'NONE', NULL, NULL, NULL FROM lineitem WHERE l_quantity < 2)"""
    + _EDGES.replace('edge AS (', 'edge AS MATERIALIZED (')
    + """,
reach AS (SELECT DISTINCT source_name AS root, pkg_id, 0 AS depth, 0 AS round FROM packages
  UNION ALL SELECT root, pkg_id, min(depth), max(round) + 1 FROM (SELECT * FROM reach
    UNION ALL SELECT root, needs, depth + 1, round FROM reach r JOIN edge e ON e.pkg_id = r.pkg_id WHERE depth = round) WHERE EXISTS (SELECT 1 FROM reach WHERE depth = round) GROUP BY root, pkg_id),
closed AS MATERIALIZED (SELECT root, pkg_id, min(depth) AS depth FROM reach GROUP BY root, pkg_id),
pairs AS (SELECT x.p_brand AS a, y.p_brand AS b FROM (SELECT DISTINCT p_brand FROM part) x, (SELECT DISTINCT p_brand FROM part) y
  WHERE CAST(split_part(x.p_brand, '#', 2) AS INTEGER) + 1 = CAST(split_part(y.p_brand, '#', 2) AS INTEGER)),
named AS (SELECT root, name, list_sort(list(DISTINCT epoch || ':' || version || '-' || release || '.' || arch)) AS evra, min(depth) AS depth FROM closed c JOIN packages p ON p.pkg_id = c.pkg_id GROUP BY root, name),
diff AS (SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(x.name, y.name) AS name,
    CASE WHEN y.evra IS NULL THEN 'only_b' WHEN x.evra IS NULL THEN 'only_a' WHEN x.evra = y.evra THEN 'common' ELSE 'version_only' END AS side, y.evra AS evra_a, x.evra AS evra_b, y.depth AS depth_a, x.depth AS depth_b
  FROM (SELECT a, b, n.* FROM pairs JOIN named n ON n.root = b) x FULL JOIN (SELECT a, b, n.* FROM pairs JOIN named n ON n.root = a) y ON x.a = y.a AND x.b = y.b AND x.name = y.name),
lost AS (SELECT root, f.name, f.op, f.version, f.outcome AS reason, count(*) AS parents, min(depth) AS depth,
    CASE WHEN regexp_matches(f.name, '[.]so([.]|$)') THEN 'soname' WHEN f.name LIKE '/%' THEN 'path' WHEN f.op <> 'NONE' THEN 'versioned' ELSE 'plain' END AS bucket
  FROM closed c JOIN (SELECT DISTINCT pkg_id, name, op, version FROM caps WHERE kind = 'requires') r ON r.pkg_id = c.pkg_id
  JOIN found f ON f.name = r.name AND f.op = r.op AND f.version IS NOT DISTINCT FROM r.version WHERE f.outcome <> 'satisfied' GROUP BY ALL)"""
)


def _brands(s, d):
    """Packages, capabilities, pairs of brands, closures of all brands and outcomes."""
    p = A.packages(s, d).withColumn("name", F.regexp_replace("name", " [0-9]+$", ""))
    c, line = A.caps(s, d), A.table(s, d, "lineitem")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("epoch", "int"), ("version", "string"), ("release", "string"))]
    more = lambda when, name: line.where(when).select(F.col("l_partkey").alias("pkg_id"), F.lit("requires").alias("kind"), name.alias("name"), F.lit("NONE").alias("op"), *none)
    text = lambda c, n: (F.col(c) % n).cast("string")
    c = c.unionByName(more("l_quantity > 49", F.concat(F.lit("/usr/bin/f"), text("l_orderkey", 700))))
    c = stored(c.unionByName(more("l_quantity < 2", F.concat(F.lit("lib"), text("l_orderkey", 90), F.lit(".so."), text("l_partkey", 3)))), "brand-caps")
    found = stored(resolve.lookup(c.where("kind = 'requires'"), resolve.providers(p, c)), "brand-found")
    closed = resolve.closures(p.select(F.col("source_name").alias("root"), "pkg_id"), resolve.edges(c, found))
    brand = p.select("source_name").distinct()
    number = F.substring_index("source_name", "#", -1).cast("int")
    one = brand.select(F.col("source_name").alias("a"), (number + 1).alias("k"))
    pairs = one.join(brand.select(F.col("source_name").alias("b"), number.alias("k")), "k").select("a", "b")
    return p, c, pairs, closed, found


def _brand_sql(query: str) -> str:
    return "WITH RECURSIVE " + _BRANDS + query


@query(_brand_sql(" SELECT a, b, name, side, array_to_string(evra_a, ',') AS evra_a, array_to_string(evra_b, ',') AS evra_b, depth_a, depth_b FROM diff"))
def closure_diff(s, d):
    """What each brand's closure holds that the next one's doesn't, in which versions, and how far from the brand."""
    p, _, pairs, closed, _ = _brands(s, d)
    diff = closure_reports.closure_diff(pairs, closed, p)
    return diff.withColumns({c: F.array_join(c, ",") for c in ("evra_a", "evra_b")})


@query(_brand_sql(""" SELECT a, b, least(depth_a, depth_b) AS depth, count(*) FILTER (side = 'common') AS common, count(*) FILTER (side = 'version_only') AS version_only,
count(*) FILTER (side = 'only_a') AS only_a, count(*) FILTER (side = 'only_b') AS only_b FROM diff GROUP BY a, b, least(depth_a, depth_b)"""))
def closure_diff_rounds(s, d):
    p, _, pairs, closed, _ = _brands(s, d)
    return closure_reports.rounds_diff(closure_reports.closure_diff(pairs, closed, p))


@query(_brand_sql(" SELECT root, name, op, version, bucket, reason, parents, depth FROM lost"))
def closure_unmet(s, d):
    """What the packages of each brand's closure require and nothing meets, by kind."""
    _, c, _, closed, found = _brands(s, d)
    return closure_reports.unmet(closed, c, found).drop("epoch", "release")


@query(_brand_sql(""", sides AS (SELECT a, b, name, op, version, bucket, reason, bool_or(root = a) AS x, bool_or(root = b) AS y FROM pairs JOIN lost ON root = a OR root = b GROUP BY ALL)
SELECT a, b, bucket, reason, count(*) FILTER (x AND y) AS common, count(*) FILTER (NOT y) AS only_a, count(*) FILTER (NOT x) AS only_b FROM sides GROUP BY a, b, bucket, reason"""))
def closure_unmet_diff(s, d):
    _, c, pairs, closed, found = _brands(s, d)
    return closure_reports.unmet_diff(pairs, closure_reports.unmet(closed, c, found))


# Across profiles and revisions.


@query(
    with_sql(
        "diagnostic",
        query=""" SELECT lint_id, start, message, min(diag_id) AS first_id, count(*) AS findings, string_agg(DISTINCT lpad(CAST(profile_id AS VARCHAR), 3, '0'), ',' ORDER BY lpad(CAST(profile_id AS VARCHAR), 3, '0')) AS profiles
FROM diagnostic GROUP BY lint_id, start, message""",
    )
)
def signature_aggregate(s, d):
    return matrix.aggregate_findings(A.diagnostics(s, d))


@query(
    with_sql(
        "diagnostic",
        query=""" SELECT lint_id, start, message, count(DISTINCT profile_id) AS affected FROM diagnostic n WHERE profile_id >= 6 AND NOT EXISTS
(SELECT 1 FROM diagnostic b WHERE b.profile_id < 6 AND b.lint_id = n.lint_id AND b.start = n.start AND b.message = n.message) GROUP BY lint_id, start, message""",
    )
)
def baseline_new(s, d):
    """Findings of the later profiles that the earlier ones, as a baseline, lack."""
    g = A.diagnostics(s, d)
    return matrix.new_findings(g.where("profile_id >= 6"), g.where("profile_id < 6"))


@query(
    with_sql(
        "profile_macro",
        query=""" SELECT items, min(profile_id) AS representative, count(*) AS size, string_agg(lpad(CAST(profile_id AS VARCHAR), 12, '0'), ',' ORDER BY lpad(CAST(profile_id AS VARCHAR), 12, '0')) AS members
FROM (SELECT profile_id, string_agg(name, ',' ORDER BY name) AS items FROM profile_macro GROUP BY profile_id) GROUP BY items""",
    )
)
def equivalence_classes(s, d):
    return matrix.equivalence_classes(A.profile_macros(s, d), "profile_id", "name")


def _profiles(s, d):
    return A.table(s, d, "nation").select(F.col("n_nationkey").alias("profile_id"))


@query(
    with_sql(
        "profile_macro",
        query=""" SELECT n.name, coalesce(m.k, 0) AS defined_in, t.total - coalesce(m.k, 0) AS missing_in,
CASE WHEN coalesce(m.k, 0) = t.total THEN 'portable' WHEN coalesce(m.k, 0) = 0 THEN 'missing' ELSE 'partial' END AS status
FROM (SELECT 'm' || s_suppkey AS name FROM supplier) n CROSS JOIN (SELECT count(*) AS total FROM nation) t LEFT JOIN (SELECT name, count(DISTINCT profile_id) AS k FROM profile_macro GROUP BY name) m ON m.name = n.name""",
    )
)
def macro_portability(s, d):
    names = A.table(s, d, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("name"))
    return matrix.portability(names, _profiles(s, d), A.profile_macros(s, d))


_COMMON = " SELECT name, count(DISTINCT value) AS values, min(value) AS value FROM profile_macro GROUP BY name HAVING count(DISTINCT profile_id) = (SELECT count(*) FROM nation)"


@query(with_sql("profile_macro", query=_COMMON))
def macro_common_existence(s, d):
    return matrix.common_macros(_profiles(s, d), A.profile_macros(s, d), equal_value=False)


@query(with_sql("profile_macro", query=_COMMON + " AND count(DISTINCT value) = 1"))
def macro_common_value(s, d):
    return matrix.common_macros(_profiles(s, d), A.profile_macros(s, d), equal_value=True)


@query(
    with_sql(
        "profile_macro",
        query=""" SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'only_b' WHEN b.name IS NULL THEN 'only_a' ELSE 'common' END AS side
FROM (SELECT name FROM profile_macro WHERE profile_id = 3) a FULL JOIN (SELECT name FROM profile_macro WHERE profile_id = 8) b ON a.name = b.name""",
    )
)
def set_diff(s, d):
    m = A.profile_macros(s, d)
    return matrix.set_diff(m.where("profile_id = 3"), m.where("profile_id = 8"), ["name"])


_CUT = "1995-01-01"


@query(
    f"""WITH n AS (SELECT o_custkey, o_orderpriority, count(*) FILTER (o_orderdate < TIMESTAMP '{_CUT}') AS x, count(*) FILTER (o_orderdate >= TIMESTAMP '{_CUT}') AS y FROM orders GROUP BY 1, 2)
SELECT o_custkey, CAST(sum(greatest(y - x, 0)) AS BIGINT) AS added, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS removed, CAST(sum(least(x, y)) AS BIGINT) AS unchanged FROM n GROUP BY o_custkey"""
)
def impact_counts(s, d):
    """Orders before and after a date as two revisions of each customer's bag of priorities."""
    o = A.table(s, d, "orders")
    before = F.col("o_orderdate") < F.lit(_CUT).cast("timestamp")
    return matrix.multiset_changes(o.where(before), o.where(~before), ["o_custkey"], "o_orderpriority")


@query(
    with_sql(
        "profile_macro",
        query=""" SELECT n_nationkey AS profile_id, 'm' || s_suppkey AS name, 'missing' AS violation FROM nation, supplier WHERE NOT EXISTS
(SELECT 1 FROM profile_macro m WHERE m.profile_id = n_nationkey AND m.name = 'm' || s_suppkey)
UNION ALL SELECT profile_id, name, 'forbidden' FROM profile_macro WHERE value = 4""",
    )
)
def contract_check(s, d):
    """Every macro is required in every profile; those of value 4 are forbidden. The dimension of profiles has its size checked and comes as an array, so no join multiplies rows."""
    macros = A.profile_macros(s, d)
    every = A.table(s, d, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("name"))
    required = matrix.for_every(every, _profiles(s, d))
    return matrix.contract(required, macros.where("value = 4"), macros.select("profile_id", "name"))


# Conditions.


def _branches(s, d):
    """Order lines as branches of a chain per order: returned lines are true, open ones unknown."""
    line = A.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f"))
    truth = F.when(F.col("f") == "A", True).when(F.col("f") == "R", False)
    return line.select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("branch"), truth.alias("truth"))


_BRANCH = """WITH b AS (SELECT l_orderkey AS chain, l_linenumber AS branch, CASE max(l_returnflag) WHEN 'A' THEN true WHEN 'R' THEN false END AS truth FROM lineitem GROUP BY 1, 2)"""


@query(
    _BRANCH
    + """, w AS (SELECT *, coalesce(max(CASE WHEN truth THEN 1 END) OVER p, 0) AS taken, coalesce(max(CASE WHEN truth IS NULL THEN 1 END) OVER p, 0) AS unknown FROM b
WINDOW p AS (PARTITION BY chain ORDER BY branch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT chain, branch, truth, taken = 0 AND unknown = 0 AND coalesce(truth, false) AS selected FROM w"""
)
def branch_first_match(s, d):
    return conditions.select_branches(_branches(s, d), ["chain"])


@query(
    _BRANCH
    + """, n AS (SELECT branch, count(*) FILTER (truth) AS active, count(*) FILTER (NOT truth) AS inactive, count(*) FILTER (truth IS NULL) AS indeterminate FROM b GROUP BY branch)
SELECT *, CASE WHEN active = 0 AND indeterminate = 0 THEN 'dead' WHEN inactive = 0 AND indeterminate = 0 THEN 'always' WHEN indeterminate = 0 THEN 'conditional'
 WHEN active = 0 AND inactive = 0 THEN 'indeterminate' ELSE 'mixed' END AS class FROM n"""
)
def coverage_class(s, d):
    return conditions.coverage(_branches(s, d), ["branch"])


@query(
    """WITH b AS (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN '>' ELSE '<=' END AS op, CAST(o_orderkey % 1000 AS BIGINT) AS n FROM orders)
SELECT o_custkey, max(CASE WHEN op = '>' THEN n + 1 END) AS low, min(CASE WHEN op = '<=' THEN n END) AS high FROM b GROUP BY o_custkey HAVING max(CASE WHEN op = '>' THEN n + 1 END) > min(CASE WHEN op = '<=' THEN n END)"""
)
def interval_contradiction(s, d):
    o = A.table(s, d, "orders")
    bounds = o.select("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, ">").otherwise("<=").alias("op"), (F.col("o_orderkey") % 1000).cast("long").alias("n"))
    return conditions.interval_conflicts(bounds, ["o_custkey"])


# Layers.


@query(
    """SELECT l_partkey AS item, arg_max(l_suppkey, (l_linenumber, l_suppkey)) AS value, CAST(max(l_linenumber) AS INTEGER) AS layer_no FROM lineitem GROUP BY l_partkey"""
)
def layered_merge(s, d):
    rows = A.table(s, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("layer_no"), F.col("l_suppkey").alias("value"))
    return layers.merge_values(rows, ["item"])


@query(
    """WITH l AS (SELECT l_partkey AS list, l_linenumber AS layer_no, CASE WHEN l_returnflag = 'A' THEN 'replace' ELSE 'extend' END AS mode, l_suppkey AS item FROM lineitem),
r AS (SELECT list, max(layer_no) AS last FROM l WHERE mode = 'replace' GROUP BY list)
SELECT DISTINCT l.list, item FROM l LEFT JOIN r ON r.list = l.list WHERE last IS NULL OR layer_no >= last"""
)
def list_layers(s, d):
    mode = F.when(F.col("l_returnflag") == "A", "replace").otherwise("extend")
    rows = A.table(s, d, "lineitem").select(
        F.col("l_partkey").alias("list"), F.col("l_linenumber").alias("layer_no"), mode.alias("mode"), F.col("l_suppkey").alias("item")
    )
    return layers.merge_lists(rows, ["list"])


# Rule archetypes.


@query(with_sql("spec_line", query=" SELECT spec_id, line_no, length(line) AS chars FROM spec_line WHERE length(line) > 80"))
def long_line(s, d):
    return rules.long_lines(A.spec_lines(s, d))


@query(with_sql("spec_line", query=" SELECT spec_id, min(line_no) AS first_line, count(*) AS times FROM spec_line WHERE trim(line) <> '' GROUP BY spec_id, line HAVING count(*) > 1"))
def repeated_line(s, d):
    return rules.repeated_lines(A.spec_lines(s, d))


@query(with_sql("spec_line", query=" SELECT spec_id, line_no FROM spec_line WHERE regexp_matches(line, '^[a-z0-9]')"))
def lower_start_line(s, d):
    return rules.lines_not_starting_upper(A.spec_lines(s, d))


@query(
    with_sql(
        "spec_line",
        query=""", r AS (SELECT spec_id, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM spec_line WINDOW w AS (PARTITION BY spec_id ORDER BY line_no))
SELECT md5(a || chr(10) || b || chr(10) || c) AS shingle, count(DISTINCT spec_id) AS recipes FROM r WHERE c IS NOT NULL GROUP BY 1 HAVING count(DISTINCT spec_id) > 1""",
    )
)
def shingle_dup(s, d):
    return rules.shared_shingles(A.spec_lines(s, d))


@query(
    """WITH n AS (SELECT user_id, event_type, row_number() OVER w AS k, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(CASE WHEN b IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY k) AS run FROM n)
SELECT user_id, event_type, CAST(min(k) AS INTEGER) AS start, count(*) AS length FROM g GROUP BY user_id, run, event_type"""
)
def adjacent_runs(s, d):
    return rules.runs(A.table(s, d, "events"), ["user_id"], ["event_id"], "event_type")


@query(
    """SELECT conv_id, turn, chars, before FROM (SELECT conv_id, turn, length(text) AS chars, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE chars < before"""
)
def order_violation(s, d):
    items = A.table(s, d, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("chars"))
    return rules.order_violations(items, ["conv_id"], ["turn"], "chars")


@query("SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_key(s, d):
    return rules.duplicate_keys(A.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def missing_section(s, d):
    parts = A.table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return rules.without(A.table(s, d, "customer").select("c_custkey", "c_name"), parts, ["c_custkey"])


# Recipes: documents as texts of recipes.

_PARTS = {"RPM001": "%changelog", "RPM016": "%prep", "RPM017": "%build", "RPM018": "%install"}
_TAGS = {"RPM010": "name", "RPM011": "version", "RPM012": "release", "RPM013": "license", "RPM014": "summary", "RPM015": "url"}
_MISSING = " UNION ALL ".join(
    f"SELECT '{id}' AS lint_id, count(*) AS n FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spec_line l WHERE l.spec_id = d.doc_id AND regexp_matches(l.line, '{pattern}'))"
    for id, pattern in [*((i, f"^{p}(\\s|$)") for i, p in _PARTS.items()), *((i, f"^(?i:{t})[0-9]*(\\([^)]*\\))?\\s*:") for i, t in _TAGS.items())]
)


@query(with_sql("spec_line", query=f" SELECT lint_id, n FROM ({_MISSING}) WHERE n > 0"))
def recipe_missing_parts(s, d):
    """How many texts lack each required tag or section."""
    texts = A.table(s, d, "documents").select(F.col("doc_id").alias("spec_id"), "text")
    return recipe_rules.lint(recipes.parse(texts, keep=True), [*_PARTS, *_TAGS]).groupBy("lint_id").agg(F.count("*").alias("n"))
