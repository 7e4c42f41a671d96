"""A clean recipe, and for each rule the change to it that breaks the rule: what the rules' documentation, queries and tests show."""

from __future__ import annotations

CLEAN = """Name:           hello
Version:        1.2
Release:        3%{?dist}
Summary:        Friendly greeter
License:        MIT
URL:            https://example.org/hello
Source0:        https://example.org/hello-%{version}.tar.gz
BuildRequires:  gcc

%description
A program that greets whoever runs it, in many of the world's languages.

%prep
%autosetup

%build
%configure
%make_build

%install
%make_install

%files
%license COPYING
%{_bindir}/hello

%changelog
* Mon Jan 06 2020 Ann Other <ann@example.org> - 1.2-3
- Start
"""

#: rule -> lines put into the clean recipe: after which line (its beginning), or None for a recipe of its own.
CASES = {
    "RPM001": ("drop", "%changelog", "* Mon", "- Start"),
    "RPM010": ("drop", "Name:"),
    "RPM015": ("drop", "URL:"),
    "RPM016": ("drop", "%prep", "%autosetup"),
    "RPM020": ("after", "URL:", "Copyright: MIT"),
    "RPM021": ("after", "%make_install", "\n%clean\nrm -rf x"),
    "RPM022": ("after", "- Start", "\n%changelog\n* Mon Jan 06 2020 B - 1\n- x"),
    "RPM023": ("after", "%make_build", "\n%build\n:"),
    "RPM031": ("after", "BuildRequires:", "Requires: foo = 1.2-3"),
    "RPM032": ("after", "URL:", "%global x 1\n%global x 2"),
    "RPM033": ("after", "BuildRequires:", "Obsoletes: hello < 1"),
    "RPM034": ("after", "BuildRequires:", "Obsoletes: old"),
    "RPM035": ("after", "BuildRequires:", "Provides: hello"),
    "RPM036": ("after", "%make_build", "# see %{name}"),
    "RPM037": ("after", "- Start", "* Sun Jan 05 2020 B <b@x> - 1.1-1"),
    "RPM038": ("after", "%changelog", "* Fri Jan 01 2999 B - 9\n- x"),
    "RPM039": ("after", "- Start", "* Mon Feb 31 2019 B - 1\n- x"),
    "RPM040": ("after", "BuildRequires:", "Conflicts: %{name}"),
    "RPM050": ("after", "%make_build", "cp a /usr/bin/b"),
    "RPM051": ("after", "%make_build", "\tls"),
    "RPM052": ("after", "%make_build", "ls  "),
    "RPM053": ("after", "%make_build", "ls $RPM_BUILD_ROOT"),
    "RPM055": ("swap", "Summary:", "Summary: Friendly greeter."),
    "RPM056": ("swap", "Summary:", "Summary: friendly greeter"),
    "RPM057": ("swap", "Summary:", "Summary: " + "Very " * 20 + "long"),
    "RPM058": ("swap", "Summary:", "Summary: The hello program"),
    "RPM062": ("after", "%make_build", "cat x | egrep y"),
    "RPM064": ("swap", "%autosetup", "%setup -q"),
    "RPM070": ("after", "%make_build", "%if 0%{?a}\n" * 5 + "x\n" + "%endif\n" * 5),
    "RPM071": ("after", "%make_build", "%if 0%{?a}\nx\n%elif 0%{?a}\ny\n%endif"),
    "RPM072": ("after", "%make_build", "%if 0\nx\n%endif"),
    "RPM073": ("after", "%make_build", "%if 0%{?a}\n%endif"),
    "RPM074": ("after", "%make_build", "%if 0%{?a}\nx\n%else\nx\n%endif"),
    "RPM076": ("after", "%make_build", "%if 0%{?a}\nx\n%endif\n\n%if 0%{?a}\ny\n%endif"),
    "RPM077": ("after", "%make_build", "%ifarch\nx\n%endif"),
    "RPM081": ("after", "%make_build", "%if 0%{?a}\nx\n%else\n%endif"),
    "RPM086": ("after", "%make_build", "%if 0%{?a} && 0%{?a}\nx\n%endif"),
    "RPM087": ("after", "%make_build", "%if !!0%{?a}\nx\n%endif"),
    "RPM088": ("after", "%make_build", "%if 0%{?a} == 0%{?a}\nx\n%endif"),
    "RPM089": ("after", "%make_build", "%if 0%{?a}\n# later\n%endif"),
    "RPM090": ("after", "%make_build", "%ifarch noarch\nx\n%endif"),
    "RPM091": ("after", "%make_build", "%ifarch x86_64 x86_64\nx\n%endif"),
    "RPM075": ("after", "%make_build", "%if 0%{?a}\ny\n%if 0%{?a}\nx\n%endif\n%endif"),
    "RPM080": ("after", "%make_build", "%if 0%{?a}\n%if 0%{?b}\nx\n%endif\n%endif"),
    "RPM082": ("after", "%make_build", "%ifarch x86_64\n%else\nx\n%endif"),
    "RPM083": ("after", "%make_build", "%if 0%{?a}\nx\n%elif 1\ny\n%endif"),
    "RPM084": ("after", "%make_build", "%ifarch x86_64\nx\n%endif\n\n%ifnarch x86_64\ny\n%endif"),
    "RPM085": ("after", "%make_build", "%if 0%{?a} || 1\nx\n%endif"),
    "RPM096": ("after", "BuildRequires:", "%if 0%{?a}\nBuildRequires: x\n%endif"),
    "RPM097": ("after", "%make_build", "%if 0%{?a}\nx\ny\n%else\nx\nz\n%endif"),
    "RPM098": ("after", "%make_build", "%if 0%{?a}\ny\nx\n%else\nz\nx\n%endif"),
    "RPM100": ("after", "%make_build", "%if 0%{?a}\nx\n%else\n%if 0%{?b}\ny\n%endif\n%endif"),
    "RPM102": ("after", "%make_build", "%if 0%{?a} > 5 && 0%{?a} > 3\nx\n%endif"),
    "RPM104": ("after", "%make_build", '%if "%{a}" == "x" || "%{a}" == "x"\nx\n%endif'),
    "RPM105": ("after", "%make_build", "%if !0%{?a}\nx\n%else\ny\n%endif"),
    "RPM117": ("after", "URL:", "%global flag 1\n%if %{flag}\nBuildRequires: x\n%endif"),
    "RPM127": ("swap", "License:", "License: GPLv2+"),
    "RPM309": ("after", "URL:", "%global d %(date)\nBuildArch: noarch"),
    "RPM324": ("after", "%make_build", "libtoolize --copy"),
    "RPM328": ("after", "%make_install", "\n%pre\ngetent passwd x || useradd x || :"),
    "RPM340": ("after", "%make_install", "\n%post\ncp a b"),
    "RPM432": ("after", "%make_build", "%if (%{a} && %{b}) || (%{a} && %{c})\nx\n%endif"),
    "RPM437": ("after", "%make_build", "x%{?a:1}%{!?a:0}"),
    "RPM438": ("after", "%make_build", "x%{?a:y}%{!?a:}"),
    "RPM442": ("after", "%make_build", "%ifarch x86_64\ny\n%ifarch x86_64 aarch64\nx\n%endif\n%endif"),
    "RPM443": ("after", "%make_build", "%if 0%{?a} == 7 || 0%{?a} == 8 || 0%{?a} == 9\nx\n%endif"),
    "RPM444": ("after", "%make_build", "%if 0%{?a}\nx\n%endif\n%if !0%{?a}\ny\n%endif"),
    "RPM445": ("after", "%make_build", "%if 0%{?a}\nx\n%endif\n%if 0%{?b}\nx\n%endif"),
    "RPM446": ("after", "%make_build", "%ifarch x86_64\nx\n%endif\n%ifarch aarch64\nx\n%endif"),
    "RPM452": ("after", "BuildRequires:", "%if 0%{?a}\nRequires: x\n%else\nRequires: x\n%endif"),
    "RPM454": ("after", "BuildRequires:", "%if 0%{?a}\nRequires: x\n%endif\nRequires: z\n%if 0%{?a}\nRequires: y\n%endif"),
    "RPM456": ("after", "%make_build", "%if 0%{?a}\nx\n%else\nx\ny\n%endif"),
    "RPM471": ("swap", "%autosetup", "%setup -q\n%patch -P 1 -p1\n%patch -P 2 -p1"),
    "RPM475": ("swap", "%autosetup", "%setup -q\ncd %{name}-%{version}"),
    "RPM495": ("after", "URL:", "%define m(ab:) echo %{-a}"),
    "RPM496": ("after", "URL:", "%define m(a) echo %{-a} %1\n%m same\n%m same"),
    "RPM514": ("after", "%license", "%{_datadir}/x/*.txt\n%{_datadir}/x/a.txt"),
    "RPM516": ("after", "%license", "/usr/share/x/a\n/usr/share/x/b\n/usr/share/x/c\n/usr/share/x/d"),
    "RPM517": ("after", "%{_bindir}", "%doc README"),
    "RPM530": ("after", "%make_install", "mkdir -p %{buildroot}/x\ninstall -m644 a %{buildroot}/x/a"),
    "RPM531": ("after", "%make_install", "mkdir -p %{buildroot}/x\ninstall -D -m644 a %{buildroot}/x/a"),
    "RPM533": ("after", "%make_install", "cp a %{buildroot}/a\nchmod 644 %{buildroot}/a"),
    "RPM536": ("after", "%make_install", "ln -s a x\nln -s b x\nln -s c x"),
    "RPM551": ("after", "BuildRequires:", "\n%package sub\nSummary: S\n%description -n hello-sub\nText."),
    "RPM575": ("after", "%make_build", "# why\n%if 0%{?a}\nx\n%endif\ny\n# why\n%if 0%{?a}\nz\n%endif"),
    "RPM592": ("after", "BuildRequires:", "Requires: (a or (a and b))"),
    "RPM593": ("after", "BuildRequires:", "Requires: ((a and b) or (a and c))"),
    "RPM595": ("after", "BuildRequires:", "Requires: (a and (b and c))"),
    "RPM101": ("after", "%make_build", "%if %{a} || (%{a} && %{b})\nx\n%endif"),
    "RPM113": ("after", "%make_build", "%if %{a}\ny\n%if !%{a}\nx\n%endif\n%endif"),
    "RPM114": ("after", "%make_build", "%if %{a} && %{b}\ny\n%if %{a}\nx\n%endif\n%endif"),
    "RPM115": ("after", "%make_build", "%if %{a}\nx\n%elif %{a} && %{b}\ny\n%endif"),
    "RPM116": ("after", "%make_build", "%if %{a}\nx\n%elif !%{a}\ny\n%endif"),
    "RPM119": ("after", "%make_build", "%if %{a}\nx\n%else\n%if %{b}\nx\ny\n%else\nx\nz\n%endif\n%endif"),
    "RPM103": ("after", "%make_build", "%if 0%{?a} > 5 && 0%{?a} < 3\nx\n%endif"),
    "RPM110": ("after", "%make_build", "%if %{a} || (%{a} && %{b})\nx\n%endif"),
    "RPM111": ("after", "%make_build", "%if %{a} || !%{a}\nx\n%endif"),
    "RPM112": ("after", "%make_build", "%if %{a} && !%{a}\nx\n%endif"),
    "RPM106": ("after", "BuildRequires:", "%if 0%{?a}\nBuildArch: noarch\n%endif"),
    "RPM120": ("after", "%make_build", "make all"),
    "RPM123": ("after", "BuildRequires:", "\n%package sub\nSummary: Sub"),
    "RPM125": ("swap", "Source0:", "Source0: hello.tar.gz"),
    "RPM126": ("swap", "A program", "This package greets whoever runs it, in many languages."),
    "RPM300": ("after", "URL:", "License: GPL"),
    "RPM302": ("after", "URL:", "Epoch: 0"),
    "RPM303": ("swap", "Release:", "Release: 3.fc40"),
    "RPM304": ("swap", "Source0:", "Source0: https://example.org/hello-1.1.tar.gz"),
    "RPM306": ("swap", "%autosetup", "%setup -q\n%patch -P 1\n%patch1"),
    "RPM308": ("after", "URL:", "AutoReq: no"),
    "RPM310": ("after", "URL:", "BuildArch: noarch\nExclusiveArch: x86_64"),
    "RPM311": ("swap", "* Mon", "* Tue Jan 06 2020 Ann - 1.2-3"),
    "RPM320": ("after", "BuildRequires:", "Requires: foo, foo"),
    "RPM321": ("after", "BuildRequires:", "Requires: foo\nRecommends: foo"),
    "RPM322": ("after", "BuildRequires:", "Suggests: hello"),
    "RPM323": ("after", "BuildRequires:", "Requires: foo-devel"),
    "RPM327": ("after", "BuildRequires:", "Requires(meta,post): foo"),
    "RPM341": ("after", "%make_install", "\n%post\nif [ $1 -eq 2 ]; then :; fi"),
    "RPM342": ("after", "%make_install", "\n%post\nsystemctl enable x"),
    "RPM348": ("after", "%make_install", "\n%pre\nuseradd x"),
    "RPM360": ("after", "%license", "/etc/hello.conf"),
    "RPM361": ("after", "%license", "%config(noreplace) /usr/share/x"),
    "RPM362": ("after", "%license", "%config /etc/hello.conf"),
    "RPM363": ("after", "%license", "%doc LICENSE"),
    "RPM364": ("after", "%license", "%{_includedir}/x.h"),
    "RPM366": ("after", "%license", "%{_bindir}/hello"),
    "RPM367": ("after", "%license", "%{_bindir}"),
    "RPM368": ("after", "%license", "%{_datadir}/*"),
    "RPM369": ("after", "%license", "/run/hello"),
    "RPM370": ("after", "%license", "%attr(0777,root,root) /opt/x"),
    "RPM371": ("after", "%license", "/usr/lib/debug/x"),
    "RPM383": ("after", "%make_install", "make install"),
    "RPM386": ("after", "%make_build", "gcc -Werror x.c"),
    "RPM388": ("after", "%make_build", "curl http://x"),
    "RPM389": ("after", "%make_install", "\n%check\n# off\n"),
    "RPM400": ("after", "URL:", "%bcond_with foo"),
    "RPM401": ("after", "URL:", "%bcond foo 1"),
    "RPM402": ("after", "%make_build", "%{with bar}"),
    "RPM404": ("swap", "Version:", "Version: %(date)"),
    "RPM450": ("after", "BuildRequires:", "%if 0%{?a}\nBuildRequires:  gcc\n%endif"),
    "RPM470": ("swap", "%autosetup", "%setup -q\n%autopatch"),
    "RPM497": ("after", "URL:", "%global aa 12345678\n%global bb 12345678"),
    "RPM510": ("after", "%license", "%doc A\n%doc B"),
    "RPM512": ("after", "%files", "%defattr(-,root,root,-)"),
    "RPM555": ("swap", "A program", "Friendly greeter"),
    "RPM570": ("after", "%make_build", "#%build\n#%install\n#BuildRequires: x"),
    "RPM571": ("after", "URL:", "#Patch1: x.patch"),
    "RPM572": ("after", "%make_build", "##########"),
    "RPM590": ("after", "BuildRequires:", "Requires: (foo)"),
    "RPM591": ("after", "BuildRequires:", "Requires: (foo and foo)"),
    "RPM594": ("after", "BuildRequires:", "Requires: (foo if bar else foo)"),
    "RPM596": ("after", "BuildRequires:", "Requires: foo\nRequires: foo >= 2"),
    "RPM002": ("drop", "A program"),
    "RPM011": ("drop", "Version:"),
    "RPM012": ("drop", "Release:"),
    "RPM013": ("drop", "License:"),
    "RPM014": ("drop", "Summary:"),
    "RPM017": ("drop", "%build", "%configure", "%make_build"),
    "RPM018": ("drop", "%install", "%make_install"),
    "RPM054": ("after", "%make_build", "ls $RPM_SOURCE_DIR"),
    "RPM059": ("swap", "A program", "Greets."),
    "RPM060": ("after", "%make_build", "python3 setup.py test"),
    "RPM061": ("after", "%make_build", "python3 setup.py install"),
    "RPM063": ("swap", "%autosetup", "%setup -n x"),
    "RPM092": ("after", "URL:", "%if 0%{?a}\n%global x%{?a} 1\n%endif\n" * 16),
    "RPM093": ("after", "%make_build", "%if 0%{?a}\nx\n%endif\ny\n" * 5),
    "RPM094": ("after", "%make_build", "%if 0%{?a} || \\\n0%{?b}\nx\n%endif"),
    "RPM095": ("after", "%make_build", "%if 0%{?_with_foo}\nx\n%endif"),
    "RPM099": ("after", "%make_build", "%if 0%{?a}\nx\n%elif 0%{?b}\nx\n%endif"),
    "RPM107": ("swap", "Name:", "%if 0%{?a}\nName: hello\n%endif"),
    "RPM118": ("after", "URL:", "%global unused 12"),
    "RPM121": ("after", "%make_install", "make DESTDIR=%{buildroot} install"),
    "RPM122": ("after", "%configure", "./configure --x"),
    "RPM124": ("after", "BuildRequires:", "\n%package x\nSummary: X\n\n%description x\nMore of the greeter for those who like it."),
    "RPM301": ("after", "BuildRequires:", "\n%package x\nSummary: X\n\n%package x\nSummary: X\n"),
    "RPM305": ("after", "BuildRequires:", "\n%sourcelist\na.tar.gz\n"),
    "RPM325": ("after", "%license", "%{_libdir}/pkgconfig/x.pc"),
    "RPM343": ("after", "%license", "%{_unitdir}/x.service"),
    "RPM344": ("after", "%license", "%config(noreplace) /etc/systemd/system/x.service"),
    "RPM346": ("after", "%make_install", "\n%post\n/sbin/ldconfig"),
    "RPM347": ("after", "%license", "%{_tmpfilesdir}/x.conf"),
    "RPM349": ("after", "%make_install", "\n%post\ntouch /tmp/state || :"),
    "RPM365": ("after", "%license", "%{_datadir}/locale/de/LC_MESSAGES/hello.mo"),
    "RPM380": ("after", "%make_install", "cp a /etc/b"),
    "RPM381": ("after", "%install", "rm -rf %{buildroot}"),
    "RPM382": ("swap", "%make_install", "%makeinstall"),
    "RPM384": ("after", "%make_install", "chown root x"),
    "RPM385": ("after", "%configure", "CFLAGS=-O0 true"),
    "RPM387": ("after", "%make_build", "%make_build -j1 && make -j 1"),
    "RPM390": ("after", "%make_build", "cmake ."),
    "RPM406": ("after", "URL:", "%include more.inc"),
    "RPM434": ("after", "%make_build", "%if !(0%{?a} == 1)\nx\n%endif"),
    "RPM435": ("after", "%make_build", "%if (0%{?a} || 0%{?b})\nx\n%endif"),
    "RPM436": ("after", "%make_build", "%if !%{with foo}\nx\n%endif"),
    "RPM439": ("after", "%make_build", '%if "%{_target_cpu}" == "x86_64"\nx\n%endif'),
    "RPM472": ("swap", "%autosetup", "%autosetup -n %{name}-%{version}"),
    "RPM473": ("after", "%autosetup", "tar xf %{SOURCE0}"),
    "RPM474": ("after", "%autosetup", "patch -p1 < %{PATCH1}"),
    "RPM476": ("after", "%autosetup", "tar xf %{SOURCE1}"),
    "RPM477": ("after", "URL:", "\n".join(f"Patch{i}: p{i}.patch" for i in range(1, 6))),
    "RPM490": ("after", "%license", "%{_prefix}/share/hello"),
    "RPM492": ("after", "URL:", "%global once 12\n%global twice %{once}"),
    "RPM493": ("after", "URL:", "%global mybin %{_bindir}"),
    "RPM494": ("after", "%make_build", "ls %{?foo:}"),
    "RPM498": ("after", "Source0:", "".join(f"Source{i}: https://downloads.example.org/projects/x{i}.tar.gz\n" for i in (1, 2, 3)).rstrip()),
    "RPM499": ("after", "URL:", "%global with_foo 1"),
    "RPM511": ("after", "%license", "%license NOTICE"),
    "RPM513": ("after", "%license", "%{_datadir}/hello/\n%{_datadir}/hello/x"),
    "RPM532": ("after", "%make_install", "install -d a\ninstall -d b"),
    "RPM534": ("after", "%make_install", "rm -f a\nrm -f b"),
    "RPM535": ("after", "%make_install", "one\ntwo\nthree\n\n%check\none\ntwo\nthree"),
    "RPM550": ("after", "BuildRequires:", "\n%package -n hello-x\nSummary: X\n"),
    "RPM552": ("after", "BuildRequires:", "\n%package x\nVersion: %{version}\nSummary: X\n"),
    "RPM553": ("after", "BuildRequires:", "".join(f"\n%package {x}\nSummary: X\nGroup: A\nLicense: MIT\nBuildArch: noarch\n" for x in "ab")),
    "RPM554": ("after", "BuildRequires:", "\n%package x\nSummary: X\n\n%description x\nA program that greets whoever runs it, in many of the world's languages.\n"),
    "RPM573": ("after", "%make_install", "\n%build\n:"),
    "RPM574": ("after", "BuildRequires:", "Epoch: 1"),
    "RPM597": ("after", "BuildRequires:", "Requires: foo >= 2\n%if 0%{?a}\nRequires: foo\n%endif"),
    "RPM128": ("after", "BuildRequires:", "\n%package x\nSummary: X\nGroup: A\n"),
    "RPM129": ("after", "URL:", "%bcond_without tests"),
    "RPM307": ("after", "Source0:", "Patch1: x.patch\n# PATCH-FIX-UPSTREAM y\nPatch2: y.patch"),
    "parse/E0002": ("after", "%make_build", "%if 0%{?a}\nx"),
    "parse/W0001": ("swap", "A program", "A program that is 100 % fun for all of us in many languages."),
    "parse/W0002": ("after", "URL:", "this is no tag"),
    "parse/W0004": ("swap", "Version:", "Version: %{major"),
    "parse/W0005": ("after", "%make_build", "%if 0%{?a}\nx\n%else\ny\n%else\nz\n%endif"),
    "parse/W0023": ("after", "- Start", "* Someday 2020 B - 1\n- x"),
}


def changed(how: str, *args: str) -> str:
    """The clean recipe without the lines that begin so (drop), with a text after such lines (after) or in their place (swap)."""
    if how == "drop":
        return "\n".join(x for x in CLEAN.split("\n") if not x.startswith(args))
    mark, text = args
    out = []
    for x in CLEAN.split("\n"):
        hit = x.startswith(mark)
        out += ([text] if how == "swap" else [x, text]) if hit else [x]
    return "\n".join(out)


def example(id: str) -> str:
    """The recipe that breaks a rule."""
    text = changed(*CASES[id])
    if id == "RPM064":
        return text.replace("Source0:", "Patch1: x.patch\nSource0:")
    if id == "RPM471":
        return text.replace("Source0:", "Patch1: x.patch\nPatch2: y.patch\nSource0:")
    return text


#: Rules that are asked together, each over the examples of all.
GROUPS = {
    "parts": [i for i in CASES if "RPM001" <= i <= "RPM064"],
    "conditionals": [i for i in CASES if "RPM070" <= i <= "RPM105"],
    "boolean": [i for i in CASES if "RPM106" <= i <= "RPM127"],
    "tags": [i for i in CASES if "RPM300" <= i <= "RPM328" and i != "RPM307"],
    "scripts": [i for i in CASES if "RPM340" <= i <= "RPM390"],
    "macros": [i for i in CASES if "RPM400" <= i <= "RPM477"],
    "idioms": [i for i in CASES if "RPM490" <= i <= "RPM597"],
    "parser": [i for i in CASES if i.startswith("parse/")],
    "opensuse": ["RPM128", "RPM129", "RPM307"],
}

#: What else of its group an example breaks: a long summary is longer than the description, a script's last command may fail, and so on.
ALSO = {
    "RPM057": ["RPM059"], "RPM070": ["RPM075", "RPM080", "RPM093"], "RPM074": ["RPM097", "RPM098"], "RPM083": ["RPM072"], "RPM104": ["RPM086"], "RPM092": ["RPM076", "RPM093"],
    "RPM123": ["RPM124"], "RPM301": ["RPM300"], "RPM341": ["RPM340"], "RPM342": ["RPM340"], "RPM348": ["RPM340"], "RPM344": ["RPM343"], "RPM400": ["RPM401"], "RPM436": ["RPM402"],
    "RPM551": ["RPM550"], "RPM129": ["RPM128"], "RPM307": ["RPM128"],
}
#: What the clean recipe breaks: one family asks for a tag that the others don't.
CLEAN_BREAKS = {"opensuse": ["RPM128"]}
