"""Architecture lists against all small universes."""

from itertools import combinations

from specgrain.operators.domains import arch_findings
from specgrain.sources.recipes import parse

ARCHS = ("aarch64", "ppc64le", "riscv64", "x86_64")
SETS = [c for n in range(1, 5) for c in combinations(ARCHS, n)]


def test_arch_findings_over_all_small_domains(spark):
    texts = [(f"{how}|{' '.join(c)}", f"Name: x\n{'%ifarch s390x' + chr(10) if how == 'elifarch' else ''}%{how} {' '.join(reversed(c))} {c[0]}\nRequires: y\n%endif\n") for how in ("ifarch", "ifnarch", "elifarch") for c in SETS]
    r = parse(spark.createDataFrame([*texts, ("macro|", "%ifarch %{all} x86_64\n%endif\n"), ("none|", None), ("bare|", "%ifarch\n%endif\n")], "spec_id string, text string"))
    universes = spark.createDataFrame([(n, a) for n, u in enumerate(SETS) for a in (*u, u[0], None)], "profile_id int, arch string")
    want = set()
    for how in ("ifarch", "ifnarch", "elifarch"):
        for c in SETS:
            for n, u in enumerate(SETS):
                rest = sorted(set(u) - set(c))
                if how != "ifnarch" and not rest:
                    want.add(("RPM440", f"{how}|{' '.join(c)}", n, ""))
                if how == "ifnarch" and set(c) <= set(u) and 0 < len(rest) < len(c):
                    want.add(("RPM441", f"{how}|{' '.join(c)}", n, " ".join(rest)))
    # The list of one that opens each elifarch chain lies outside all universes.
    got = [(x["lint_id"], x["spec_id"], x["profile_id"], x["detail"]) for x in arch_findings(r, universes).collect()]
    assert set(got) == want and len(got) == len(want)
    assert arch_findings(r, universes.where("false")).count() == 0
