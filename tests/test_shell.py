"""Shell bodies: tokens, commands, and the rules on them."""

import pytest
from pyspark.sql import functions as F

from specgrain.operators.recipe_rules import RULES, lint
from specgrain.sources.recipes import parse

BODY = r"""Name: x
%install
make install DESTDIR=%{buildroot} \
  PREFIX="/usr local" # done
cat > a <<EOF
useradd inside
cp a /etc/x
EOF
cat <<-'end of it' | sort
if [ -f 'a b' ]; then cp -m 0755 x /etc/y; fi
CFLAGS="-O2 -g" ./configure --with=$(uname -m) || exit 1
echo "multi
line" && echo a#b '#no' # yes
FOO=1
%{__rm} -rf ${X Y}/z 2>/dev/null
echo \"q\" it\'s
%if 1
true
%endif
# all comment
echo "unclosed
"""


def test_commands(spark):
    rows = parse(spark.createDataFrame([("k", BODY), ("none", None), ("empty", "%build\n"), ("long", "%build\n" + "w" * 200_000 + " " + "'a b' " * 50_000)], "spec_id string, text string")).commands.collect()
    got = [(r["line_no"], r["nth"], r["lead"], r["name"], r["args"]) for r in sorted(rows, key=lambda r: r["cmd"]) if r["spec_id"] == "k"]
    assert got == [
        (3, 1, True, "make", ["install", "DESTDIR=%{buildroot}", "PREFIX=/usr local"]),
        (5, 1, True, "cat", []),
        (9, 1, True, "cat", []),
        (9, 2, True, "sort", []),
        (10, 1, False, "[", ["-f", "a b", "]"]),
        (10, 2, False, "cp", ["-m", "0755", "x", "/etc/y"]),
        (10, 3, True, "fi", []),
        (11, 1, False, "./configure", ["--with=$"]),
        (11, 2, True, "uname", ["-m"]),
        (11, 3, True, "exit", ["1"]),
        (12, 1, True, "echo", ["multi\nline"]),
        (12, 2, True, "echo", ["a#b", "#no"]),
        (15, 1, True, "%{__rm}", ["-rf", "${X Y}/z"]),
        (16, 1, True, "echo", ['"q"', "it's"]),
        (18, 1, True, "true", []),
        (21, 1, True, "echo", ["unclosed"]),
    ]
    long = [r for r in rows if r["spec_id"] == "long"]
    assert len(long) == 1 and len(long[0]["name"]) == 200_000 and long[0]["args"] == ["a b"] * 50_000
    assert not [r for r in rows if r["spec_id"] in ("none", "empty")]


#: rule -> (section, lines that break it, lines that don't).
CASES = {
    "RPM348": ("pre", ["useradd -r x", "groupmod x", "adduser x || :", "cp a b\naddgroup y"], ["getent passwd x >/dev/null || useradd x", "id x || usermod x", "echo useradd", "# useradd x", "cat <<E\nuseradd x\nE"]),
    "RPM380": (
        "install", ["cp a /etc/b", "cp /usr/share/a b", "tee /boot/x", "install -m 0755 x '/opt/y z'", "mkdir -p %{buildroot}/a /var/b", "true && touch /lib64/x"],
        ["cp a %{buildroot}/etc/b", "cp a $RPM_BUILD_ROOT/usr/x", "install -t /etc a", "ls /etc/x", "cp a etc/b", "echo cp a /etc/b", "cp a b # /etc/c", "cp a /srv/b"],
    ),
    "RPM388": (
        "build", ["wget x", "aria2c x", "git -q clone y", "pip3 download z", "npm ci", "yarn install", "go mod download", "gem install x", "cargo update"],
        ["git apply x", "pip install --no-index x", "npm ci --offline", "go build", "echo curl", "cargo build", "curlew x"],
    ),
    "RPM390": ("build", ["cmake .", "cmake --build x", "meson setup b", "python3 setup.py build", "python3 -m build", "go install ./x", "cargo build"], ["meson test", "ninja", "qmake", "%cmake", "python3 x.py", "cargo test", "echo cmake"]),
}
OTHERS = {
    "RPM363": (
        ["%files\n%doc LICENSE", "%files\n%doc COPYING.LIB", "%files\n%doc AUTHORS", "%files\n%doc a/GPL-2", "%files\n%doc legal"],
        ["%files\n%license LICENSE", "%files\n%doc LICENSEFAKE", "%files\nLICENSE", "%files\n%doc README.md", "%files\n%doc glpl"],
    ),
    "RPM050": (
        ["%build\nls /usr/bin/x", "%install\nls /etc", "%build\nls /var/lib/x", "%files\n/usr/share/y", "Prefix: /usr/lib64", "%build\nls %{buildroot}/a/etc/b"],
        ["Requires: /usr/bin/x", "%post\nls /usr/bin", "%build\ncat /etc/passwd", "%install\nls %{buildroot}/etc/x", "%build\n # /usr/bin", "%build\nls /etcetera", "URL: file:///etc/x", "%description\n/usr/bin"],
    ),
}


@pytest.fixture(scope="module")
def broken(spark):
    rows = [(f"{i}|{good}|{n}", f"Name: x\n%{section}\n{line}\n") for i, (section, bad, fine) in CASES.items() for good, lines in ((0, bad), (1, fine)) for n, line in enumerate(lines)]
    rows += [(f"{i}|{good}|{n}", f"Name: x\n{text}\n") for i, (bad, fine) in OTHERS.items() for good, texts in ((0, bad), (1, fine)) for n, text in enumerate(texts)]
    found = lint(parse(spark.createDataFrame(rows, "spec_id string, text string")), [*CASES, *OTHERS]).collect()
    return {r["spec_id"] for r in found if r["spec_id"].split("|")[0] == r["lint_id"]}


@pytest.mark.parametrize("id", [*CASES, *OTHERS])
def test_rules(broken, id):
    bad, fine = (CASES.get(id) or (None, *OTHERS[id]))[1:]
    assert [n for n in range(len(bad)) if f"{id}|0|{n}" not in broken] == [] and [n for n in range(len(fine)) if f"{id}|1|{n}" in broken] == []


def test_rules_are_told_once_a_section_and_by_profile(spark):
    r = parse(spark.createDataFrame([("k", "Name: x\nRelease: 1\n%build\ncmake .\ncmake ..\ncmake --build .\ncurl a\nwget b\n")], "spec_id string, text string"))
    assert sorted((x["lint_id"], x["line_no"], x["detail"]) for x in lint(r, ["RPM388", "RPM390"]).collect()) == [("RPM388", 7, "curl a"), ("RPM390", 4, "cmake"), ("RPM390", 6, "cmake_build")]
    has = spark.createDataFrame([("cmake_build",)], "name string")
    assert [x["detail"] for x in lint(r, ["RPM390"], macros=has).collect()] == ["cmake_build"] and lint(r, ["RPM390"], macros=has.where(F.lit(False))).count() == 0
    assert RULES["RPM303"].families == ("fedora", "rhel") and lint(r, ["RPM303"]).count() == 1
    with pytest.raises(ValueError, match="family"):
        lint(r, ["RPM303", "RPM388"], "other")
