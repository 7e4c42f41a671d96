"""Rule queries over recipes that are written from the part table, a recipe a part, and SQL that finds the same in the recipes' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import build_tools, projection, recipe_rules, resolve
from ..session import dealt
from ..sources import adapters as A
from ..sources import recipes
from ..sources.adapters import SQL
from .catalog import _EDGES, query

#: (when, line): lines of a recipe in order, as SQL that both engines read; a line is written where its condition on the part holds. k is the key, z the size, t the type, b the brand.
_LINES: list[tuple[str, str]] = [
    ("z % 11 <> 0", "'Name: ' || replace(n, ' ', '-')"), ("z % 23 = 0", "'Name: again'"), ("z % 7 <> 0", "'Version: ' || z || '.' || (k % 10)"), ("z % 13 <> 0", "'Release: 1' || CASE WHEN k % 9 = 0 THEN ' beta' ELSE '' END"),
    ("z % 5 <> 0", "'Summary: ' || CASE k % 5 WHEN 0 THEN 'tool for ' || b WHEN 1 THEN 'A ' || n || '.' WHEN 2 THEN 'The ' || replace(n, ' ', '-') || ' of ' || t WHEN 3 THEN repeat('Long text ', 1 + k % 12) || b ELSE 'Etc...' END"),
    ("z % 6 <> 0", "'License: MIT'"), ("k % 8 <> 0", "'URL: https://' || lower(t) || '.example'"), ("k % 14 = 0", "'Epoch: ' || (k % 3)"),
    ("k % 4 <> 1", "'Source0: ' || CASE k % 3 WHEN 0 THEN n || '.tar.gz' WHEN 1 THEN 'https://x.example/' || z || '.' || (k % 7) || '/a-' || z || '.' || (k % 7) || '.tar.gz' ELSE '%{url}/a.zip' END"),
    ("z % 17 = 0", "'Packager: ' || b"), ("z % 19 = 0", "'BuildRoot: /tmp/x'"), ("k % 33 = 0", "'# why'"), ("k % 11 = 0", "'AutoReq: no'"), ("k % 16 = 0", "'AutoReqProv: 0'"), ("z % 29 = 0", "'Vendor: x'"),
    ("k % 10 = 0", "'%global tool ' || lower(t)"), ("k % 20 = 0", "'%global tool other'"), ("k % 15 = 0", "'%define with_docs 1'"), ("k % 18 = 0", "'%global gnome common-value'"), ("k % 36 = 0", "'%global gtk common-value'"),
    ("k % 21 = 0", "'%bcond_with tests'"), ("k % 22 = 0", "'%bcond docs 1'"), ("k % 26 = 0", "'%include %{SOURCE1}'"), ("k % 12 = 0", "'# uses %{name} twice'"), ("k % 25 = 0", "'#Patch3: old.patch'"), ("k % 27 = 0", "'#=========='"),
    ("k % 28 = 0", "'%{?scl:}'"), ("k % 9 = 1", "'%global dir %{_bindir}'"),
    ("k % 6 = 0", "CASE k % 5 WHEN 0 THEN '%if 1' WHEN 1 THEN '%if (%{with tests})' WHEN 2 THEN '%if ! %{with docs}' WHEN 3 THEN '%if !(0%{?rhel} > 8)' ELSE '%if 0%{?_with_x}' END"),
    ("k % 6 = 0", "CASE WHEN z % 2 = 0 THEN 'Name: inner' ELSE 'BuildArch: noarch' END"), ("k % 18 = 6", "'%elif 0%{?suse_version}'"), ("k % 6 = 0", "'%endif'"),
    ("k % 13 = 0", "CASE k % 4 WHEN 0 THEN '%ifarch' WHEN 1 THEN '%ifarch x86_64 noarch' WHEN 2 THEN '%ifnarch arm arm' ELSE '%if \"%{_target_cpu}\" == \"ppc\"' END"), ("k % 13 = 0", "'Requires: lib' || z"), ("k % 13 = 0", "'%endif'"),
    ("k % 17 = 0", "'%if !!%{foo}'"), ("k % 17 = 0", "'%if %{bar} == %{bar}'"), ("k % 17 = 0", "'%if a \\'"), ("k % 17 = 0", "'%endif'"), ("k % 17 = 0", "'%endif'"), ("k % 17 = 0", "'%endif'"),
    ("z % 3 = 0", "'%package devel'"), ("z % 3 = 0", "'Summary: Headers'"), ("z % 24 = 0", "'%package devel'"), ("z % 6 = 0", "'%description devel'"), ("z % 6 = 0", "'Headers of ' || n"),
    ("z % 10 <> 0", "'%description'"), ("k % 31 <> 0", "CASE WHEN k % 7 = 0 THEN 'This package is ' || n ELSE 'It makes ' || n || ' and more of them for ' || b || ' and all its users' END"),
    ("k % 23 = 0", "'%changelog'"), ("k % 23 = 0", "'* Mon Jan 06 2020 A <a@b> - 1'"), ("k % 46 = 0", "'- first'"),
    ("z % 9 <> 0", "'%prep'"), ("z % 9 <> 0", "CASE k % 3 WHEN 0 THEN '%setup -n %{name}-%{version}' WHEN 1 THEN '%setup -q' ELSE '%autosetup' END"), ("k % 34 = 0", "'cp $RPM_SOURCE_DIR/x .'"), ("k % 38 = 0", "'tar xf %{SOURCE0}'"),
    ("z % 8 <> 0", "'%build'"), ("k % 2 = 0", "'./configure --prefix=/opt'"), ("k % 5 = 0", "'export CFLAGS=-O3'"), ("k % 35 = 0", "'make -j 1 all'"), ("k % 39 = 0", "'gcc -Werror a.c'"), ("k % 44 < 2", "CASE k % 3 WHEN 0 THEN 'pip3 download z' WHEN 1 THEN 'pip3 install --no-index z' ELSE 'test -d x || git clone y' END"),
    ("k % 47 < 2", "CASE k % 3 WHEN 0 THEN 'cmake ..' WHEN 1 THEN 'echo \"cmake\" # cmake' ELSE 'cd b && meson compile' END"), ("k % 53 = 0", "'cat > x <<E'"), ("k % 53 = 0", "'wget in a document'"), ("k % 53 = 0", "'E'"), ("z % 12 = 0", "'%build'"), ("k % 37 = 0", "'    ' || chr(9) || 'x  '"),
    ("z % 4 <> 0", "'%install'"), ("k % 3 = 0", "'rm -rf $RPM_BUILD_ROOT'"), ("k % 7 = 1", "'python3 setup.py install'"), ("k % 7 = 2", "'chown root x'"), ("k % 48 < 2", "CASE k % 3 WHEN 0 THEN 'cp -m 0644 x \"/etc/' || b || '\"' WHEN 1 THEN 'cp x %{buildroot}/etc/y' ELSE 'ls; tee /boot/' || z END"), ("k % 41 = 0", "'%makeinstall'"), ("k % 19 = 0", "'%check'"), ("k % 38 = 0", "'python3 setup.py test'"), ("k % 57 = 0", "'  # none'"),
    ("z % 21 = 0", "'%clean'"), ("k % 8 = 3", "'%post'"), ("k % 8 = 3", "CASE k % 3 WHEN 0 THEN '/sbin/ldconfig' WHEN 1 THEN 'systemctl enable x.service' ELSE 'if [ $1 -eq 2 ]; then touch /tmp/x; fi' END"), ("k % 16 = 3", "CASE k % 3 WHEN 0 THEN 'useradd x' WHEN 1 THEN 'getent passwd x || useradd x' ELSE 'groupmod \\' || chr(10) || ' x' END"), ("k % 32 = 3", "'adduser z'"),
    ("z % 14 <> 0", "'%files'"), ("k % 3 = 0", "'/etc/' || lower(t) || '.conf'"), ("k % 3 = 1", "'%config(noreplace) /etc/x.conf'"), ("k % 6 = 1", "'%config %{_datadir}/x'"), ("k % 9 = 2", "'%{_includedir}/a.h'"), ("k % 10 = 3", "'%{_bindir}/*'"),
    ("k % 10 = 4", "'/var/run/x'"), ("k % 10 = 5", "'%{_datadir}/locale/de/LC_MESSAGES/x.mo'"), ("k % 10 = 6", "'%lang(de) %{_datadir}/locale/de/LC_MESSAGES/x.mo'"), ("k % 10 = 7", "'%dir %{_sysconfdir}'"), ("k % 12 = 5", "'/usr/lib/debug/x'"), ("k % 12 = 7", "'/etc/systemd/system/x.timer'"), ("k % 12 = 8", "'%doc COPYING.LIB'"), ("k % 12 = 9", "'%doc README'"),
    ("z % 6 = 0", "'%files devel'"), ("z % 6 = 0", "'%{_includedir}/b.h'"),
    ("k % 5 <> 0", "'%changelog'"), ("k % 5 <> 0", "'* Tue Jan 07 2020 A <a@b> - 2'"), ("k % 5 > 1", "'- second'"), ("k % 45 = 1", "'%changelog'"),
]
_COLUMNS = {"k": "p_partkey", "z": "p_size", "t": "p_type", "b": "p_brand", "n": "p_name"}
_TEXT = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN {when} THEN {line} END" for when, line in _LINES) + ")"


def written(spark, sf_dir):
    """(spec_id, text): the recipe of every part."""
    part = A.table(spark, sf_dir, "part").select(*(F.col(c).alias(x) for x, c in _COLUMNS.items()))
    return dealt(part, "k").select(F.col("k").alias("spec_id"), F.expr(_TEXT.replace("\\", "\\\\")).alias("text"))


_SECTIONS = "prep|generate_buildrequires|conf|build|install|check|clean|pre|post|preun|postun|pretrans|posttrans|package|description|files|changelog|sourcelist|patchlist"
_SQL = f"""WITH recipe AS (SELECT k AS spec_id, {_TEXT} AS text FROM (SELECT {', '.join(f'{c} AS {x}' for x, c in _COLUMNS.items())} FROM part)),
cut AS (SELECT spec_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT spec_id, string_split(text, chr(10)) AS l FROM recipe)),
marked AS (SELECT *, regexp_extract(line, '^%({_SECTIONS})(\\s|$)', 1) AS head, regexp_matches(line, '^\\s*%(if|ifarch|ifnarch|ifos|ifnos)\\b') AS opens, regexp_matches(line, '^\\s*%endif\\b') AS closes,
  regexp_matches(line, '^\\s*%(elif|elifarch|elifos|else)\\b') AS turns FROM cut),
x AS (SELECT *, coalesce(last_value(nullif(head, '') IGNORE NULLS) OVER w, 'preamble') AS kind, coalesce(last_value(CASE WHEN head <> '' THEN line END IGNORE NULLS) OVER w, '') AS title, sum(CASE WHEN head <> '' THEN 1 ELSE 0 END) OVER w AS sec,
  greatest(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w - coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY spec_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS depth
  FROM marked WINDOW w AS (PARTITION BY spec_id ORDER BY line_no)),
body AS (SELECT * FROM x WHERE head = ''),
plain AS (SELECT * FROM body WHERE NOT (opens OR closes OR turns)),
heads AS (SELECT *, CASE WHEN trim(regexp_replace(line, '^%\\w+', '')) = '' THEN '' ELSE '%{{name}}-' || trim(regexp_replace(line, '^%\\w+', '')) END AS pkg FROM x WHERE head <> ''),
tag AS (SELECT *, lower(regexp_extract(line, '^([A-Za-z]+?)[0-9]*\\s*:', 1)) AS key, trim(regexp_extract(line, '^[A-Za-z]+?[0-9]*\\s*:(.*)$', 1)) AS value, CASE WHEN kind = 'preamble' THEN '' ELSE 'sub' END AS pkg
  FROM plain WHERE kind IN ('preamble', 'package') AND regexp_matches(line, '^[A-Za-z]+?[0-9]*\\s*:')),
comment AS (SELECT *, trim(line) AS note FROM body WHERE regexp_matches(line, '^\\s*#')),
shell AS (SELECT * FROM body WHERE kind IN ('prep', 'build', 'install', 'check', 'clean', 'pre', 'post', 'preun', 'postun') AND NOT regexp_matches(line, '^\\s*#')),
branch AS (SELECT *, regexp_extract(line, '%(\\w+)', 1) AS how, regexp_replace(trim(regexp_replace(line, '^\\s*%\\w+', '')), '\\s+', ' ', 'g') AS cond FROM body WHERE opens OR turns),
macro AS (SELECT *, regexp_extract(line, '^%(?:global|define)\\s+(\\w+)', 1) AS name, regexp_extract(line, '^%(?:global|define)\\s+\\w+\\s+(.*?)\\s*$', 1) AS value FROM plain WHERE regexp_matches(line, '^%(global|define)\\s+\\w+\\s')),
entry AS (SELECT *, regexp_extract(trim(regexp_replace(trim(line), '%(?:lang|attr|config)\\s*\\([^)]*\\)|%(?:config|doc|license|dir|ghost)\\b', ' ', 'g')), '^(\\S+)', 1) AS path, line LIKE '\\%config%' ESCAPE '\\' AS is_config FROM plain WHERE kind = 'files' AND trim(line) <> '' AND NOT regexp_matches(line, '^\\s*#')),
specs AS (SELECT DISTINCT spec_id FROM cut)
"""


def _first(test: str, source: str = "cut") -> str:
    return f"SELECT spec_id, line_no FROM {source} WHERE {test}"


def _lacks(found: str) -> str:
    return f"SELECT spec_id, 1 AS line_no FROM specs s WHERE NOT EXISTS (SELECT 1 FROM {found} AND f.spec_id = s.spec_id)"


def _again(source: str, keys: str) -> str:
    return f"SELECT spec_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY spec_id, {keys} ORDER BY line_no) AS r FROM {source}) WHERE r > 1"


_USES = "SELECT spec_id, unnest(regexp_extract_all(line, '%\\{\\??with(?:out)?\\s+(\\w+)\\}', 1)) AS name, line_no FROM cut"
_BCONDS = "SELECT spec_id, line_no, regexp_extract(line, '^\\s*%bcond(?:_with|_without)?\\s+(\\w+)', 1) AS name FROM cut WHERE regexp_matches(line, '^\\s*%bcond(_with|_without)?\\s+\\w')"
_DESCRIBED = "(SELECT h.spec_id, h.line_no, h.pkg, trim(coalesce(string_agg(b.line, chr(10) ORDER BY b.line_no), '')) AS said FROM heads h LEFT JOIN body b ON b.spec_id = h.spec_id AND b.sec = h.sec WHERE h.head = 'description' GROUP BY ALL)"

#: family -> rule -> SQL of (spec_id, line_no).
FAMILIES: dict[str, dict[str, str]] = {
    "tags": {
        **{f"RPM{i}": _lacks(f"tag f WHERE pkg = '' AND key = '{k}'") for i, k in (("010", "name"), ("011", "version"), ("012", "release"), ("013", "license"), ("014", "summary"), ("015", "url"))},
        "RPM020": _first("key IN ('copyright', 'serial', 'prereq', 'buildprereq', 'buildroot', 'packager', 'vendor')", "tag"),
        "RPM055": _first("key = 'summary' AND value LIKE '%.' AND value NOT LIKE '%..'", "tag"),
        "RPM056": _first("key = 'summary' AND regexp_matches(value, '^[a-z]')", "tag"),
        "RPM057": _first("key = 'summary' AND length(value) > 80", "tag"),
        "RPM058": "SELECT s.spec_id, s.line_no FROM tag s JOIN tag n ON n.spec_id = s.spec_id AND n.key = 'name' AND n.pkg = '' WHERE s.key = 'summary' AND s.pkg = '' AND list_contains(string_split_regex(lower(s.value), '[^a-z0-9_+.-]+'), lower(n.value))",
        "RPM106": _first("key = 'buildarch' AND depth > 0", "tag"),
        "RPM107": _first("key = 'name' AND depth > 0", "tag"),
        "RPM125": _first("key = 'source' AND NOT regexp_matches(value, '^(https?|ftp)://|^%\\{(url|source\\d*)\\}')", "tag"),
        "RPM300": _again("(SELECT * FROM tag WHERE depth = 0 AND key IN ('name', 'version', 'release', 'license', 'url', 'summary', 'epoch', 'buildarch', 'autoreq', 'autoprov', 'autoreqprov'))", "CASE WHEN pkg = '' THEN 0 ELSE 1 END, key"),
        "RPM302": _first("(key = 'epoch' AND value = '0') OR (key IN ('version', 'release') AND regexp_matches(value, '[^A-Za-z0-9._+~^]')) OR (key = 'name' AND regexp_matches(value, '[^A-Za-z0-9._+-]'))", "tag"),
        "RPM304": "SELECT s.spec_id, s.line_no FROM (SELECT *, regexp_extract(value, '[-_/v]([0-9]+(?:\\.[0-9]+)+)(?:\\.tar|\\.zip|\\.tgz|/)', 1) AS found FROM tag WHERE key = 'source') s JOIN tag v ON v.spec_id = s.spec_id AND v.key = 'version' AND v.pkg = '' WHERE found <> '' AND found <> v.value",
        "RPM308": "SELECT spec_id, line_no FROM tag t WHERE key IN ('autoreq', 'autoprov', 'autoreqprov') AND lower(value) IN ('no', '0') AND NOT EXISTS (SELECT 1 FROM comment c WHERE c.spec_id = t.spec_id AND abs(c.line_no - t.line_no) = 1)",
    },
    "sections": {
        **{f"RPM{i}": _lacks(f"heads f WHERE head = '{k}'") for i, k in (("001", "changelog"), ("016", "prep"), ("017", "build"), ("018", "install"))},
        "RPM002": f"SELECT spec_id, line_no FROM {_DESCRIBED} WHERE said = ''",
        "RPM021": _first("head = 'clean'", "heads"),
        "RPM022": _again("(SELECT * FROM heads WHERE head = 'changelog' AND depth = 0)", "head"),
        "RPM023": _again("(SELECT * FROM heads WHERE head IN ('prep', 'generate_buildrequires', 'conf', 'build', 'install', 'check', 'clean'))", "head"),
        "RPM037": "SELECT spec_id, line_no FROM (SELECT *, lead(trim(line)) OVER (PARTITION BY spec_id, sec ORDER BY line_no) AS after FROM plain WHERE kind = 'changelog' AND trim(line) <> '') WHERE line LIKE '*%' AND (after IS NULL OR after LIKE '*%')",
        "RPM123": "SELECT spec_id, line_no FROM heads p WHERE head = 'package' AND NOT EXISTS (SELECT 1 FROM heads d WHERE d.spec_id = p.spec_id AND d.head = 'description' AND d.pkg = p.pkg)",
        "RPM124": "SELECT spec_id, line_no FROM heads p WHERE head = 'package' AND NOT EXISTS (SELECT 1 FROM heads d WHERE d.spec_id = p.spec_id AND d.head = 'files' AND d.pkg = p.pkg)",
        "RPM126": f"SELECT spec_id, line_no FROM {_DESCRIBED} WHERE regexp_matches(said, '^(?i:this package|the \\S+ package)\\b')",
        "RPM301": _again("(SELECT * FROM heads WHERE head = 'package' AND depth = 0)", "pkg"),
        "RPM389": "SELECT spec_id, line_no FROM heads h WHERE head = 'check' AND NOT EXISTS (SELECT 1 FROM body b WHERE b.spec_id = h.spec_id AND b.sec = h.sec AND NOT regexp_matches(line, '^\\s*(#.*|%dnl.*|:|true|exit 0)?\\s*$'))",
        "RPM573": "SELECT spec_id, line_no FROM (SELECT *, max(p) OVER (PARTITION BY spec_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM (SELECT *, list_position(['description', 'prep', 'build', 'install', 'check', 'files', 'changelog'], head) AS p FROM heads WHERE depth = 0) WHERE p > 0) WHERE p < most",
    },
    "macros": {
        "RPM032": _again("(SELECT * FROM macro WHERE depth = 0)", "name"),
        "RPM036": _first("regexp_matches(note, '(^|[^%])%(\\{|\\(|[A-Za-z_])')", "comment"),
        "RPM051": _first("regexp_matches(line, '^ *\\t')"),
        "RPM052": _first("regexp_matches(line, '[ \\t]+$')"),
        "RPM118": "SELECT spec_id, line_no FROM macro m WHERE line LIKE '\\%global%' ESCAPE '\\' AND NOT EXISTS (SELECT 1 FROM cut c WHERE c.spec_id = m.spec_id AND c.line_no <> m.line_no AND list_contains(regexp_extract_all(c.line, '%\\{?[!?]*([A-Za-z_]\\w*)', 1), m.name))",
        "RPM400": _first("regexp_matches(line, '^\\s*%bcond_with(out)?\\s')"),
        "RPM401": f"SELECT spec_id, line_no FROM ({_BCONDS}) b WHERE NOT EXISTS (SELECT 1 FROM ({_USES}) u WHERE u.spec_id = b.spec_id AND u.name = b.name)",
        "RPM402": f"SELECT spec_id, line_no FROM ({_USES}) u WHERE NOT EXISTS (SELECT 1 FROM ({_BCONDS}) b WHERE u.spec_id = b.spec_id AND u.name = b.name)",
        "RPM406": _first("regexp_matches(line, '^\\s*%include\\s')"),
        "RPM493": _first("value IN ('%{_bindir}', '%{name}', '%{_datadir}') AND name NOT LIKE '\\_\\_%' ESCAPE '\\'", "macro"),
        "RPM494": _first("regexp_matches(line, '%\\{!?\\?\\w+:\\}')"),
        "RPM497": _again("(SELECT * FROM macro WHERE length(value) >= 3)", "value"),
        "RPM499": _first("regexp_matches(name, '^with(out)?_\\w+')", "macro"),
        "RPM571": _first("regexp_matches(note, '^#+\\s*(Source|Patch)[0-9]*\\s*:')", "comment"),
        "RPM572": _first("regexp_matches(note, '^#[#=\\-*_ ]{7,}$')", "comment"),
    },
    "scripts": {
        "RPM053": _first("regexp_matches(line, '\\$\\{?RPM_BUILD_ROOT\\b')", "shell"),
        "RPM054": _first("regexp_matches(line, '\\$\\{?RPM_SOURCE_DIR\\b')", "shell"),
        "RPM060": _first("regexp_matches(line, 'setup\\.py\\s+test\\b')", "shell"),
        "RPM061": _first("regexp_matches(line, 'setup\\.py\\s+install\\b')", "shell"),
        "RPM063": _first("kind = 'prep' AND line LIKE '\\%setup%' ESCAPE '\\' AND NOT regexp_matches(line, '\\s-\\w*q')", "shell"),
        "RPM122": _first("kind = 'build' AND line LIKE './configure %'", "shell"),
        "RPM341": _first("kind = 'post' AND line LIKE '%$1 -eq 2%'", "shell"),
        "RPM342": _first("kind = 'post' AND line LIKE 'systemctl enable %'", "shell"),
        "RPM346": _first("kind = 'post' AND line = '/sbin/ldconfig'", "shell"),
        "RPM349": _first("kind = 'post' AND line LIKE '% /tmp/%'", "shell"),
        "RPM382": _first("kind = 'install' AND line = '%makeinstall'", "shell"),
        "RPM384": _first("kind = 'install' AND line LIKE 'chown %'", "shell"),
        "RPM385": _first("kind = 'build' AND line LIKE '% CFLAGS=%'", "shell"),
        "RPM386": _first("kind = 'build' AND line LIKE '% -Werror %'", "shell"),
        "RPM387": _first("kind IN ('build', 'install', 'check') AND line LIKE 'make -j 1 %'", "shell"),
        "RPM472": _first("kind = 'prep' AND line LIKE '\\%setup -n \\%{name}-\\%{version}' ESCAPE '\\'", "shell"),
        "RPM473": _first("kind = 'prep' AND line LIKE 'tar %{SOURCE0}'", "shell"),
    },
    "commands": {
        "RPM050": _first("kind NOT IN ('description', 'changelog', 'post') AND NOT regexp_matches(line, '^\\s*#') AND regexp_matches(replace(line, '%{buildroot}/', ' '), '(/usr/(lib64|libexec|include|share|bin|sbin|lib)|/var/(log|lib)|/etc)([^A-Za-z0-9_.-]|$)') AND NOT EXISTS (SELECT 1 FROM tag t WHERE t.spec_id = body.spec_id AND t.line_no = body.line_no AND key IN ('source', 'url', 'summary'))", "body"),
        "RPM348": "SELECT spec_id, min(line_no) AS line_no FROM shell WHERE kind = 'post' AND regexp_matches(line, '^(useradd|groupmod|adduser) ') GROUP BY spec_id, sec",
        "RPM380": _first("kind = 'install' AND regexp_matches(line, '(^cp -m 0644 x \"/etc/|; tee /boot/)')", "shell"),
        "RPM388": "SELECT spec_id, min(line_no) AS line_no FROM shell WHERE kind IN ('prep', 'build', 'install', 'check') AND regexp_matches(line, '^pip3 download |\\|\\| git clone ') GROUP BY spec_id, sec",
        "RPM390": "SELECT spec_id, min(line_no) AS line_no FROM shell WHERE kind IN ('build', 'install') AND regexp_matches(line, '^cmake |&& meson compile|^python3 setup.py install') GROUP BY spec_id, sec, split_part(line, ' ', 1)",
    },
    "files": {
        "RPM360": _first("NOT is_config AND line NOT LIKE '\\%dir%' ESCAPE '\\' AND (path LIKE '/etc/%' OR path LIKE '\\%{_sysconfdir}/%' ESCAPE '\\')", "entry"),
        "RPM361": _first("is_config AND (path LIKE '/usr%' OR path LIKE '\\%{_datadir}%' ESCAPE '\\')", "entry"),
        "RPM363": _first("line LIKE '\\%doc%' ESCAPE '\\' AND regexp_matches(path, '^(?i:licen[sc]e|copying|notice)')", "entry"),
        "RPM364": _first("path LIKE '%.h' AND title NOT LIKE '%devel%'", "entry"),
        "RPM365": _first("path LIKE '%/locale/%.mo' AND line NOT LIKE '\\%lang(%' ESCAPE '\\'", "entry"),
        "RPM367": _first("path IN ('%{_bindir}', '%{_sysconfdir}', '/usr', '/etc', '/var')", "entry"),
        "RPM368": _first("path = '%{_bindir}/*'", "entry"),
        "RPM369": _first("path LIKE '/var/run/%' OR path LIKE '/run/%'", "entry"),
        "RPM371": _first("path LIKE '/usr/lib/debug%'", "entry"),
        "RPM344": _first("regexp_matches(path, '\\.(service|timer)$') AND (is_config OR path LIKE '/etc/systemd/system%')", "entry"),
    },
    "branches": {
        "RPM070": _first("depth > 4 AND opens", "branch"),
        "RPM072": _first("how IN ('if', 'elif') AND regexp_matches(cond, '^[0-9]+$')", "branch"),
        "RPM077": _first("how IN ('ifarch', 'ifnarch') AND cond = ''", "branch"),
        "RPM087": _first("regexp_matches(cond, '!\\s*!')", "branch"),
        "RPM088": _first("regexp_extract(cond, '^(\\S+) == (\\S+)$', 1) <> '' AND regexp_extract(cond, '^(\\S+) == (\\S+)$', 1) = regexp_extract(cond, '^(\\S+) == (\\S+)$', 2)", "branch"),
        "RPM090": _first("how LIKE '%arch%' AND list_contains(string_split(cond, ' '), 'noarch')", "branch"),
        "RPM091": _first("how LIKE '%arch' AND len(string_split(cond, ' ')) > len(list_distinct(string_split(cond, ' ')))", "branch"),
        "RPM093": "SELECT spec_id, min(line_no) AS line_no FROM branch WHERE how = 'if' AND cond <> '' GROUP BY spec_id, cond HAVING count(*) >= 5",
        "RPM094": _first("cond LIKE '%\\'", "branch"),
        "RPM095": _first("regexp_matches(cond, '%\\{\\?_?with(out)?_\\w+\\}')", "branch"),
        "RPM434": _first("regexp_matches(cond, '!\\s*\\(\\s*[^()&|]+(?:==|!=|<=|>=|<|>)[^()&|]+\\)')", "branch"),
        "RPM435": _first("regexp_matches(cond, '^\\([^()]*\\)$|\\(\\s*\\(|\\(\\s*[^\\s()&|<>=!]+\\s*\\)')", "branch"),
        "RPM436": _first("regexp_matches(cond, '!\\s*%\\{with(out)? \\w+\\}')", "branch"),
        "RPM439": _first("cond LIKE '%{_target_cpu}%' AND cond LIKE '%==%'", "branch"),
    },
}


def _family_query(family: str):
    rules = FAMILIES[family]

    def run(s, d):
        found = recipe_rules.lint(recipes.parse(written(s, d), keep=True), list(rules))
        return found.select("lint_id", "spec_id", "line_no")

    run.__name__ = f"part_recipes_{family}"
    query(_SQL + " UNION ALL ".join(f"SELECT '{i}' AS lint_id, spec_id, line_no FROM ({sql})" for i, sql in rules.items()))(run)


for _family in FAMILIES:
    _family_query(_family)


# What profiles see: a recipe a supplier, a profile a nation.

#: As _LINES; s is the supplier's key, c its nation.
_BRANCHED: list[tuple[str, str]] = [
    ("true", "'Name: pkg' || s"), ("true", "'Version: ' || (s % 40)"), ("true", "'Release: 1'"), ("s % 2 = 0", "'%global level ' || (s % 6)"), ("true", "'%{!?level:%global level 9}'"),
    ("s % 3 = 0", "'%global soname lib%{name}-%{version}'"), ("s % 11 = 0", "'%define vague %(uname)'"), ("true", "'%if 0%{?rhel} >= ' || (s % 10)"), ("true", "'%global flavour %{level}'"),
    ("true", "'BuildRequires: base-%{rhel}'"), ("true", "'%elif 0%{?suse} > ' || (c % 5)"), ("true", "'%global flavour 7'"), ("true", "'%else'"), ("true", "'%global level 4'"), ("true", "'%endif'"),
    ("true", "'%if 0%{?flavour} > 3'"), ("true", "'Requires: %{soname}'"), ("true", "'%ifarch x86_64 noarch'"), ("true", "'BuildRequires: gcc-%{level}'"), ("true", "'%else'"), ("true", "'%global level 5'"),
    ("true", "'%endif'"), ("true", "'%endif'"), ("s % 7 = 0", "'%if %{unheard} == 1'"), ("s % 7 = 0", "'Requires: odd'"), ("s % 7 = 0", "'%else'"), ("s % 7 = 0", "'Requires: even'"), ("s % 7 = 0", "'%endif'"),
    ("s % 11 = 0", "'%if 0%{?vague} == 0'"), ("s % 11 = 0", "'Requires: vague'"), ("s % 11 = 0", "'%endif'"), ("true", "'%if 0%{?level} == 5'"), ("true", "'Requires: five-%{flavour}'"), ("true", "'%endif'"),
    ("true", "'%files'"), ("true", "'/opt/%{name}/%{level}'"), ("true", "'%if 0%{?suse}'"), ("true", "'/usr/%{missing}/x'"), ("true", "'%endif'"),
]
_BRANCHED_TEXT = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN {when} THEN {line} END" for when, line in _BRANCHED) + ")"
_ARCH = "CASE {k} % 3 WHEN 0 THEN 'x86_64' WHEN 1 THEN 'aarch64' ELSE 'noarch' END"

#: A plain reading line by line, as one would by hand: the recipe's macros so far, and for each open block whether its branch is taken and whether the chain is done.
_PROJECTED = rf"""WITH RECURSIVE recipe AS (SELECT s AS spec_id, string_split({_BRANCHED_TEXT}, chr(10)) AS l FROM (SELECT s_suppkey AS s, s_nationkey AS c FROM supplier)),
profile AS (SELECT n_nationkey AS profile_id, {_ARCH.format(k="n_nationkey")} AS arch,
  map_from_entries(list_filter([('rhel', CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey % 10 AS VARCHAR) END), ('suse', CASE WHEN n_nationkey % 5 = 1 THEN CAST(n_nationkey % 7 AS VARCHAR) END), ('soname', CASE WHEN n_nationkey % 8 = 0 THEN 'own' END)], lambda e: e[2] IS NOT NULL)) AS own FROM nation),
step AS (
  SELECT spec_id, profile_id, arch, own, l, 0 AS line_no, MAP([]::VARCHAR[], []::VARCHAR[]) AS mine, []::BOOLEAN[] AS taken, []::BOOLEAN[] AS done, '' AS line, false AS shown, NULL::VARCHAR AS filled FROM recipe, profile
  UNION ALL
  SELECT spec_id, profile_id, arch, own, l, line_no + 1,
    CASE WHEN defines <> '' AND shown AND NOT (line LIKE '%{{!?%' AND (list_contains(map_keys(own), defines) OR list_contains(map_keys(mine), defines))) THEN map_concat(mine, MAP([defines], [filled])) ELSE mine END,
    CASE WHEN opens THEN list_append(taken, coalesce(t, false)) WHEN turns THEN list_append(taken[:-2], NOT done[-1] AND coalesce(t, false)) WHEN line = '%endif' THEN taken[:-2] ELSE taken END,
    CASE WHEN opens THEN list_append(done, coalesce(t, true)) WHEN turns THEN list_append(done[:-2], done[-1] OR coalesce(t, true)) WHEN line = '%endif' THEN done[:-2] ELSE done END,
    line, shown AND NOT (opens OR turns OR line = '%endif'), filled
  FROM (
    SELECT *, CASE WHEN line = '%else' THEN true
      WHEN line LIKE '%ifarch %' THEN list_contains(string_split(line, ' ')[2:], arch)
      WHEN name = '' THEN NULL WHEN broken THEN NULL WHEN value IS NULL AND line NOT LIKE '%{{?%' THEN NULL
      ELSE CASE op WHEN '>=' THEN number >= bound WHEN '>' THEN number > bound WHEN '==' THEN number = bound ELSE number <> 0 END END AS t
    FROM (
      SELECT *, name <> '' AND list_contains(map_keys(mine), name) AND NOT list_contains(map_keys(own), name) AND mine[name] IS NULL AS broken, CAST('0' || coalesce(value, '') AS BIGINT) AS number,
        CASE WHEN refs IS NOT NULL THEN list_reduce(list_prepend(body, refs), lambda acc, ref: replace(acc, '%{{' || ref || '}}', coalesce(own[ref], mine[ref]))) END AS filled
      FROM (
        SELECT *, coalesce(own[name], mine[name]) AS value, CASE WHEN body LIKE '%\%(%' ESCAPE '\' THEN NULL ELSE regexp_extract_all(body, '%\{{(\w+)\}}', 1) END AS refs FROM (
          SELECT s.* EXCLUDE (line, shown, filled), l[line_no + 1] AS line, regexp_matches(l[line_no + 1], '^%if') AS opens, regexp_matches(l[line_no + 1], '^%(elif|else)') AS turns, NOT list_contains(taken, false) AS shown,
            regexp_extract(l[line_no + 1], '%(?:global|define) (\w+) ', 1) AS defines,
            CASE WHEN l[line_no + 1] LIKE 'Name: %' OR l[line_no + 1] LIKE 'Version: %' THEN regexp_extract(l[line_no + 1], ': (.*)$', 1)
              WHEN regexp_matches(l[line_no + 1], '%(global|define) ') THEN rtrim(regexp_extract(l[line_no + 1], '%(?:global|define) \w+ (.*)$', 1), CASE WHEN l[line_no + 1] LIKE '%{{!?%' THEN '}}' ELSE '' END)
              ELSE regexp_extract(l[line_no + 1], '^(?:[A-Za-z]+: )?(.*)$', 1) END AS body,
            CASE WHEN regexp_matches(l[line_no + 1], '^%(if|elif) ') THEN regexp_extract(l[line_no + 1], '%\{{\??(\w+)\}}', 1) ELSE '' END AS name,
            regexp_extract(l[line_no + 1], ' (>=|>|==) [0-9]+$', 1) AS op, CAST('0' || regexp_extract(l[line_no + 1], ' ([0-9]+)$', 1) AS BIGINT) AS bound
          FROM (SELECT * REPLACE (CASE WHEN line LIKE 'Name: %' THEN map_concat(mine, MAP(['name'], [filled])) WHEN line LIKE 'Version: %' THEN map_concat(mine, MAP(['version'], [filled])) ELSE mine END AS mine) FROM step) s
          WHERE line_no < len(l))))))
SELECT spec_id, profile_id, line_no, CASE WHEN line LIKE '/%' THEN 'file' ELSE lower(regexp_extract(line, '^(\w+): ', 1)) END AS what, filled AS told FROM step
WHERE shown AND (line LIKE '/%' OR line LIKE 'Requires: %' OR line LIKE 'BuildRequires: %')"""


@query(_PROJECTED)
def projected_items(s, d):
    """The dependencies and files of every supplier's recipe that each nation's profile sees, macros filled in."""
    t = A.table(s, d, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("c"))
    texts = dealt(t, "s").select(F.col("s").alias("spec_id"), F.expr(_BRANCHED_TEXT).alias("text"))
    k = F.col("n_nationkey")
    nation = A.table(s, d, "nation")
    profiles = nation.select(k.alias("profile_id"), F.expr(_ARCH.format(k="n_nationkey")).alias("arch"), F.lit("linux").alias("os"))
    macro = lambda name, when, value: nation.where(when).select(k.alias("profile_id"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    macros = macro("rhel", k % 2 == 0, k % 10).unionByName(macro("suse", k % 5 == 1, k % 7)).unionByName(macro("soname", k % 8 == 0, F.lit("own")))
    p = projection.project(recipes.parse(texts, keep=True), profiles, macros)
    atoms = p.atoms.select("spec_id", "profile_id", "line_no", F.col("key").alias("what"), "told")
    return atoms.unionByName(p.files.select("spec_id", "profile_id", "line_no", F.lit("file").alias("what"), "told"))


# Programs that build scripts run: a recipe a supplier, a profile a region.

#: As _BRANCHED; s is the supplier's key and n the name of the part of that key.
_TOOLED: list[tuple[str, str]] = [
    ("true", "'Name: pkg' || s"), ("s % 2 = 0", "'BuildRequires: ' || n"), ("s % 6 = 1", "'BuildRequires: (' || n || ' or other)'"), ("s % 6 = 3", "'BuildRequires: (other if ' || n || ')'"), ("true", "'BuildRequires: cap' || (s % 40) || ' >= ' || (s % 3)"),
    ("s % 4 = 0", "'%global tooldir /usr/bin'"), ("true", "'%if 0%{?level} >= 3'"), ("true", "'BuildRequires: cap' || ((s + 1) % 40)"), ("true", "'%endif'"), ("true", "'%build'"),
    ("true", "'t' || s || ' --quick'"), ("true", "'# t1 isn''t run'"), ("true", "'cat a | f' || (s % 500) || ' -q && make'"), ("true", "'%if 0%{?level} >= 3'"), ("true", "'/usr/bin/f' || (s * 7 % 500) || ' x'"), ("true", "'%else'"),
    ("true", "'t2 ; %{tooldir}/f' || (s * 11 % 500)"), ("true", "'%endif'"), ("s % 5 = 0", "'i386 | t3)'"), ("true", "'%install'"), ("true", "'t' || s"), ("s % 7 = 0", "'cp /usr/bin/f1 /usr/bin/cat /usr/share/f2 b'"), ("true", "'%post'"), ("true", "'t4'"),
]
_TOOLED_TEXT = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN {when} THEN {line} END" for when, line in _TOOLED) + ")"
_TOOLED_ROWS = "SELECT s_suppkey AS s, replace(p_name, ' ', '-') AS n FROM supplier JOIN part ON p_partkey = s_suppkey"

#: Lines with their section and arm, tools cut from them, owners by the whole file list, and a closure of every recipe and state of the condition for itself.
_MISSING_TOOLS = (
    "WITH RECURSIVE "
    + SQL["packages"].replace("p_name AS name", "replace(p_name, ' ', '-') AS name")
    + ", " + SQL["caps"].replace("\ncaps AS", "\ngiven AS")
    + rf""", files AS (SELECT l_partkey AS pkg_id, '/usr/bin/f' || (l_orderkey % 500) AS path FROM lineitem UNION SELECT p_partkey, '/usr/bin/t' || (p_partkey % 5000) FROM part),
recipe AS (SELECT s AS spec_id, string_split({_TOOLED_TEXT}, chr(10)) AS l FROM ({_TOOLED_ROWS})),
line AS (SELECT spec_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS line FROM recipe),
placed AS (SELECT *, last_value(nullif(regexp_extract(line, '^%(build|install|post)$', 1), '') IGNORE NULLS) OVER w AS kind, sum(CASE WHEN line LIKE '\%if %' ESCAPE '\' THEN 1 WHEN line = '%endif' THEN -1 ELSE 0 END) OVER w AS inside,
    last_value(CASE WHEN line LIKE '\%if %' ESCAPE '\' THEN true WHEN line = '%else' THEN false END IGNORE NULLS) OVER w AS arm FROM line WINDOW w AS (PARTITION BY spec_id ORDER BY line_no)),
shown AS (SELECT p.*, h.hi FROM placed p, (VALUES (true), (false)) h(hi) WHERE (inside = 0 OR arm = hi) AND NOT regexp_matches(line, '^(%(if|else|endif)|#)')),
uses AS (SELECT spec_id, hi, line_no, unnest(list_transform(string_split_regex(line, '\s*(&&|[|;])\s*'), lambda x: string_split(x, ' ')[1])) AS tool, true AS bare FROM shown WHERE kind IN ('build', 'install') AND line NOT LIKE '%)'
  UNION ALL SELECT spec_id, hi, line_no, unnest(string_split(CASE WHEN spec_id % 4 = 0 THEN replace(line, '%{{tooldir}}', '/usr/bin') ELSE line END, ' ')), false FROM shown WHERE kind IN ('build', 'install')),
tools AS (SELECT * FROM uses WHERE CASE WHEN bare THEN regexp_matches(tool, '^[a-z0-9]+$') AND tool NOT IN ('cat', 'make', 'cp') ELSE tool LIKE '/usr/bin/%' AND tool <> '/usr/bin/cat' END),
owned AS (SELECT path, arg_min(p.pkg_id, (repo_id, p.pkg_id)) AS pkg_id FROM files f JOIN packages p ON p.pkg_id = f.pkg_id GROUP BY path),
declared AS (SELECT s.spec_id, s.hi, x[1] AS name, nullif(x[2], '') AS op, x[3] AS version FROM (SELECT *, regexp_extract(line, '^BuildRequires: \(?([^ ]+)(?: (>=) ([0-9]+))?', ['name', 'op', 'v']) AS m FROM shown WHERE line LIKE 'BuildRequires: %') s, LATERAL (SELECT [m.name, m.op, m.v]) y(x)),
asks AS (SELECT *, -(spec_id * 2 + CAST(hi AS INTEGER)) - 1 AS root FROM (SELECT d.* FROM declared d JOIN line l ON l.spec_id = d.spec_id AND l.line LIKE 'BuildRequires: ' || d.name || '%')),
caps AS (SELECT * FROM given UNION ALL SELECT DISTINCT root, 'requires', name, CASE WHEN op IS NULL THEN 'NONE' ELSE 'GE' END, CASE WHEN op IS NOT NULL THEN 0 END, CASE WHEN op IS NOT NULL THEN version END, CASE WHEN op IS NOT NULL THEN '' END FROM asks)"""
    + _EDGES
    + """,
reach AS (SELECT pkg_id AS root, needs FROM edge WHERE pkg_id < 0 UNION SELECT r.root, e.needs FROM reach r JOIN edge e ON e.pkg_id = r.needs)
SELECT CASE WHEN bare THEN 'RPM-REPO-010' ELSE 'RPM-REPO-011' END AS lint_id, t.spec_id, CAST(r_regionkey AS BIGINT) AS profile_id, min(line_no) AS line_no, tool, p.name AS owner, bool_or(x.root IS NOT NULL) AS reached
FROM tools t JOIN owned o ON o.path = CASE WHEN bare THEN '/usr/bin/' || tool ELSE tool END JOIN packages p ON p.pkg_id = o.pkg_id JOIN region ON (r_regionkey >= 3) = t.hi
LEFT JOIN reach x ON x.root = -(t.spec_id * 2 + CAST(t.hi AS INTEGER)) - 1 AND x.needs = o.pkg_id
WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.spec_id = t.spec_id AND d.hi = t.hi AND d.name = p.name) GROUP BY ALL"""
)


@query(_MISSING_TOOLS)
def missing_build_tools(s, d):
    """Programs that the suppliers' recipes run without requiring their owners, by region, and whether the closure of what they do require brings those in."""
    texts = A.table(s, d, "supplier").join(A.table(s, d, "part"), F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("s"), F.translate("p_name", " ", "-").alias("n"))
    r = recipes.parse(texts.select(F.col("s").alias("spec_id"), F.expr(_TOOLED_TEXT).alias("text")), keep=True)
    region = A.table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("profile_id"))
    profiles = region.select("profile_id", F.lit("x86_64").alias("arch"), F.lit("linux").alias("os"))
    macros = region.select("profile_id", F.lit("level").alias("name"), F.col("profile_id").cast("string").alias("value"))
    p, c = A.packages(s, d).withColumn("name", F.translate("name", " ", "-")), A.caps(s, d)
    own = p.select("pkg_id", F.concat(F.lit("/usr/bin/t"), (F.col("pkg_id") % 5000).cast("string")).alias("path"))
    files = A.files(s, d).unionByName(own)
    return build_tools.missing_tools(r, projection.project(r, profiles, macros), profiles, macros, p, c, resolve.providers(p, c), files)
