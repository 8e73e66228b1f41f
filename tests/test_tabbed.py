"""Tabbed files by column roles: regions against a plain reading of the lines, and filters that reach the scan."""

from __future__ import annotations

import random

import pytest

from crestline.sources.tabbed import PRESETS, Roles, in_region, in_regions, read_tabbed


@pytest.fixture
def lines():
    rng = random.Random(7)
    return [(rng.choice(("c1", "c2", "c10")), rng.randint(0, 900), rng.randint(1, 60), k) for k in range(300)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAYOUTS = {
    "bed": lambda c, s, n, k: f"{c}\t{s}\t{s + n}\tx{k}\t\"quoted",
    "gff": lambda c, s, n, k: f"{c}\tsrc\texon\t{s + 1}\t{s + n}\tx{k}",
    "vcf": lambda c, s, n, k: f"{c}\t{s + 1}\tx{k}\t{'A' * n}\tC",
    "sam": lambda c, s, n, k: f"x{k}\t0\t{c}\t{s + 1}\t9\t{n}M\t*",
}


@pytest.mark.parametrize("preset", list(LAYOUTS))
def test_rows_of_a_region(spark, tmp_path, lines, preset):
    roles = PRESETS[preset]
    path = tmp_path / "x.txt"
    path.write_text("\n".join([f"{roles.comment}head\tline", *(LAYOUTS[preset](*x) for x in lines)]) + "\n")
    rows = read_tabbed(spark, str(path), roles, 6)
    name = {"bed": "c4", "gff": "c6", "vcf": "c3", "sam": "c1"}[preset]
    for contig, a, b in (("c1", 100, 300), ("c2", None, 50), ("c10", 890, None), ("c3", 0, 10), ("c1", None, None), ("c1", 300, 300)):
        got = in_region(rows, roles, contig, a, b)
        expected = {(f"x{k}", s, s + n) for c, s, n, k in lines if c == contig and s < (b if b is not None else 10**9) and s + n > (a or 0)}
        assert {(r[name], r.start, r.stop) for r in got.collect()} == expected
    text = plan(in_region(rows, roles, "c1", 100, 300))
    pushed = text[text.index("PushedFilters") :].split("]")[0]
    assert f"EqualTo({'c3' if preset == 'sam' else 'c1'},c1)" in pushed and "LessThan" in pushed
    several = in_regions(rows, roles, [("c1", 100, 200), ("c1", 150, 300), ("c2", 0, 20)])
    expected = {f"x{k}" for c, s, n, k in lines if (c == "c1" and s < 300 and s + n > 100) or (c == "c2" and s < 20)}
    found = [r[name] for r in several.collect()]
    assert set(found) == expected and len(found) == len(expected)


def test_own_roles_header_line_and_short_rows(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text("name\tat\tchrom\nx\t5\tc1\ny\t7\tc1\nz\n%note\tline\n\nw\tnone\tc1\n")
    roles = Roles(3, 2, comment="%", skip_first=True)
    assert {(r.c1, r.start, r.stop) for r in in_region(read_tabbed(spark, str(path), roles), roles, "c1", 0, 6).collect()} == {("x", 4, 5)}
