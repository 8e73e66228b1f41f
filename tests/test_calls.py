"""Merging of call sets row by row, allele removal, headers, interval subtraction, on cases checked by plain loops."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crestline.operators import call_sets, reads
from crestline.operators import genes as gn
from crestline.sources import vcf_header
from crestline.sources.text import parse_vcf


def one_by_one(records, policy):
    """Merged rows of single records (input, site) in order, one row at a time."""
    left, rows = list(range(len(records))), []
    while left:
        first = min(records[k][0] for k in left)
        t = next(k for k in left if records[k][0] == first)
        row = {first: t}
        for k in left:
            i = records[k][0]
            if i > first and i not in row and call_sets.matches(policy, records[t][1], records[k][1]):
                row[i] = k
        rows.append(sorted((i, records[k][1]) for i, k in row.items()))
        left = [k for k in left if k not in row.values()]
    return rows


site = st.tuples(st.sampled_from(["A", "AC"]), st.lists(st.sampled_from("CGT"), max_size=2, unique=True).map(tuple), st.integers(0, 3))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), site, st.integers(1, 3)), max_size=9), st.sampled_from(sorted(call_sets.POLICIES)))
def test_copies_in_one_go_equal_rows_one_by_one(given_sites, policy):
    distinct = {}
    for i, s, n in given_sites:
        distinct[i, s[0], s[1]] = (i, s, n)
    sites = sorted(distinct.values())
    records = [(i, s) for i, s, n in sites for _ in range(n)]
    got = []
    for first, many, chosen in call_sets.in_step(sites, policy):
        assert first == len(got)
        got += [sorted((i, sites[j][1]) for i, j, _ in chosen)] * many
    assert sorted(got) == sorted(one_by_one(records, policy))


@pytest.mark.parametrize("policy", sorted(call_sets.POLICIES))
def test_merge_of_three_call_sets(spark, policy):
    rng = random.Random(policy)
    inputs = []
    for k in range(3):
        rows = [("c", rng.randint(1, 6), rng.choice(["A", "AC"]), rng.sample(["C", "G", "T", "ACT", "A"], rng.randint(0, 2)), 10 * k + j) for j in range(25)]
        rows += [("c", 3, "A", ["C"], 100 + j) for j in range(20 * k)]  # one hot site
        inputs.append(rows)
    form = "chrom string, pos long, ref string, alts array<string>, vid int"
    frames = [spark.createDataFrame(rows, form) for rows in inputs]
    got = call_sets.merge_call_sets(frames, policy, ["vid"]).collect()
    for k, rows in enumerate(inputs, 1):  # every record once, with its own alleles
        there = sorted((r["pos"], r[f"ref_{k}"], ",".join(r[f"alts_{k}"]), r[f"vid_{k}"]) for r in got if r[f"vid_{k}"] is not None)
        assert there == sorted((p, ref, ",".join(a), v) for _, p, ref, a, v in rows)
    bits = {(r.ref, r.a): r.b for r in frames[0].union(frames[1]).union(frames[2]).select("ref", F.array_join("alts", ",").alias("a"), call_sets.type_bits(F.col("ref"), F.col("alts")).alias("b")).distinct().collect()}
    for pos in range(1, 7):
        records = sorted((k, (ref, tuple(a), bits[ref, ",".join(a)])) for k, rows in enumerate(inputs, 1) for _, p, ref, a, _ in rows if p == pos)
        records.sort(key=lambda x: (x[0], x[1][0], ",".join(x[1][1])))
        rows = [sorted((k, (r[f"ref_{k}"], tuple(r[f"alts_{k}"]), bits[r[f"ref_{k}"], ",".join(r[f"alts_{k}"])])) for k in (1, 2, 3) if r[f"ref_{k}"] is not None) for r in got if r.pos == pos]
        assert sorted(rows) == sorted(one_by_one(records, policy))


def test_alleles_are_taken_out_of_every_list(spark):
    """Ploidy 1 and 2, all alleles used, none used, missing genotypes, lists of a wrong length."""
    pairs = lambda n: [10 * b + a for b in range(n) for a in range(b + 1)]
    rows = [(1, ["T", "G", "C"], [[0, 2], [2, -1], [2]], [1, 2, 3], [0, 1, 2, 3], pairs(4), [pairs(4), pairs(4), [0, 1, 2, 3]]), (2, ["T"], [[-1, -1]], [7], [5, 6], pairs(2), [[1, 2, 3, 4]]), (3, ["T"], [[0, 1]], [7], [5, 6], pairs(2), [pairs(2)]), (4, [], [[0, 0]], [], [5], [9], [[9]])]
    df = spark.createDataFrame(rows, "id int, alts array<string>, gt array<array<int>>, a array<int>, r array<int>, g array<int>, pl array<array<int>>")
    got = {x.id: x for x in call_sets.trim_alleles(df, a=["a"], r=["r"], g=["g"], sample_g=["pl"]).collect()}
    assert (got[1].alts, got[1].gt, got[1].a, got[1].r, got[1].g, got[1].pl, got[1].n_removed) == (["G"], [[0, 1], [1, -1], [1]], [2], [0, 2], [0, 20, 22], [[0, 20, 22], [0, 20, 22], [0, 2]], 2)
    assert (got[2].alts, got[2].gt, got[2].a, got[2].g, got[2].pl, got[2].n_removed) == ([], [[-1, -1]], [], [0], [None], 1)
    assert (got[3].alts, got[3].pl, got[3].n_removed) == (["T"], [pairs(2)], 0)
    assert (got[4].alts, got[4].g, got[4].n_removed) == ([], [9], 0)
    chosen = call_sets.remove_alleles(df.where("id = 1"), F.array(F.lit(0), F.lit(3)), a=["a"], g=["g"]).first()
    assert (chosen.alts, chosen.gt, chosen.a, chosen.g) == (["C"], [[0, -1], [-1, -1], [-1]], [3], [0, 30, 33])


HEAD = """##fileformat=VCFv4.2
##INFO=<ID=X,Number=.,Type=Integer,Description="a, b=<c>">
##INFO=<ID=F,Number=0,Type=Flag,Description="f">
##INFO=<Number=1,ID=Y,Type=Float,Description="says \\"hi\\"">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="p">
##contig=<ID=c>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB
c\t5\t.\tA\tC\t.\tPASS\tX=1,.,3;F;Y=.\tPL:GT\t1,2,3:0/1\t.
c\t6\t.\tA\tC\t.\tPASS\tY=2.5;Z=4\tGT\t1\t0/0""".split("\n")


def test_columns_get_the_types_of_their_header(spark):
    lines = spark.createDataFrame([(x,) for x in HEAD], "value string").coalesce(1)
    header = vcf_header.read_header(lines, at_once=2)
    assert header.info == [("X", ".", "Integer"), ("F", "0", "Flag"), ("Y", "1", "Float")] and header.samples == ["A", "B"] and header.contigs == ["c"]
    rows = vcf_header.typed_samples(vcf_header.typed_info(parse_vcf(lines), header), header).orderBy("pos").collect()
    assert rows[0].info.asDict() == {"X": [1, None, 3], "F": True, "Y": None} and rows[1].info.asDict() == {"X": None, "F": False, "Y": 2.5}
    assert [s.asDict() for s in rows[0].samples] == [{"GT": "0/1", "PL": [1, 2, 3]}, {"GT": None, "PL": None}]
    assert [s.asDict() for s in rows[1].samples] == [{"GT": "1", "PL": None}, {"GT": "0/0", "PL": None}]
    some, own = vcf_header.subset_samples(parse_vcf(lines), header, ["B"])
    assert own.samples == ["B"] and {tuple(r.genotypes) for r in some.collect()} == {("PL:GT", "."), ("GT", "0/0")}
    with pytest.raises(ValueError, match="nobody"):
        vcf_header.subset_samples(parse_vcf(lines), header, ["nobody"])
    described = {r.id: r.description for r in vcf_header.header_entries(lines).collect()}
    assert described["X"] == "a, b=<c>" and described["GT"] == "g"


def test_typed_file(spark, tmp_path):
    path = tmp_path / "x.vcf"
    path.write_text("\n".join(HEAD) + "\n")
    rows = vcf_header.read_typed_vcf(spark, str(path), ["B"]).orderBy("pos").collect()
    assert [len(r.samples) for r in rows] == [1, 1] and rows[1].info.Y == 2.5


def test_headers_merge_in_order_of_first_mention(spark):
    rows = [(0, 1, "INFO", "B", "1", "Integer"), (0, 2, "FORMAT", "A", "1", "Integer"), (0, 3, "contig", "c2", None, None), (200, 1, "contig", "c1", None, None), (200, 2, "INFO", "C", "1", "Float"), (200, 3, "INFO", "B", "A", "Integer"), (200, 4, "INFO", "A", "1", "Float"), (300, 1, "FORMAT", "A", "1", "String"), (300, 2, "FILTER", "B", None, None)]
    entries = spark.createDataFrame(rows, "file int, at long, kind string, id string, number string, type string")
    merged = vcf_header.merge_headers(entries)
    got = {(r.kind, r.id): (r.number_in, r.number, r.type, r.other_length, r.other_type) for r in merged.collect()}
    assert got[("INFO", "B")] == (0, "1", "Integer", True, False) and got[("FORMAT", "A")] == (1, "1", "Integer", False, True)
    assert got[("INFO", "A")] == (1, "1", "Float", False, False) and got[("FILTER", "B")][0] == 0 and got[("INFO", "C")][0] == 2
    assert got[("contig", "c2")][0] == 0 and got[("contig", "c1")][0] == 1
    moves = {(r.file, r.id): (r.own, r.number_in) for r in vcf_header.translations(entries, merged).where("space = 'ID'").collect()}
    assert moves[200, "C"] == (0, 2) and moves[200, "B"] == (1, 0) and moves[300, "A"] == (0, 1) and moves[0, "A"] == (1, 1)


def test_subtraction_and_untranslated_regions(spark):
    rng = random.Random(3)
    form = "gene long, chrom string, strand int, start long, stop long"
    a, b = ([(g, "c", g % 2, s, s + rng.randint(0, 30)) for g in range(6) for s in rng.choices(range(0, 70_000, 11), k=20) + [100, 131, 65_530]] for _ in range(2))
    bases = lambda rows: {(g, p) for g, _, _, s, e in rows for p in range(s, e + 1)}
    got = gn.subtract(spark.createDataFrame(a, form), spark.createDataFrame(b, form), ["gene", "chrom", "strand"]).collect()
    assert {(r.gene, p) for r in got for p in range(r.start, r.stop + 1)} == bases(a) - bases(b)
    assert not {(r.gene, r.stop + 1) for r in got} & {(r.gene, r.start) for r in got}  # joined as far as they go
    exons = [(1, "c", 0, 100, 199), (1, "c", 0, 300, 399), (2, "c", 1, 100, 199), (2, "c", 1, 300, 399), (3, "c", 0, 10, 20), (4, "c", 1, 10, 20)]
    cds = [(1, "c", 0, 150, 199), (1, "c", 0, 300, 320), (2, "c", 1, 150, 199), (2, "c", 1, 300, 320), (3, "c", 0, 12, 15)]
    codons = [(1, "c", 0, 321, 323), (2, "c", 1, 147, 149)]
    frames = [spark.createDataFrame(x, form) for x in (exons, cds, codons)]
    got = sorted((r.gene, r.type, r.start, r.stop) for r in gn.untranslated(*frames).collect())
    assert got == [(1, "UTR3", 324, 399), (1, "UTR5", 100, 149), (2, "UTR3", 100, 146), (2, "UTR5", 321, 399), (3, "UTR5", 10, 20), (4, "UTR3", 10, 20)]


@pytest.mark.parametrize("limit", [100_000, 5])
def test_untranslated_regions_shuffle_exons_once(spark, monkeypatch, limit):
    """Exons of usual genes are joined where one shuffle brings them, genes with very many by the sweep, to the same regions."""
    monkeypatch.setattr(reads, "LONG_READ", limit)
    rng, form = random.Random(4), "gene long, chrom string, strand int, start long, stop long"
    exons = [(g, "c", g % 2, s, s + rng.randint(0, 40)) for g in range(8) for s in rng.choices(range(65_000, 66_500, 7), k=3 + 4 * (g % 3))]
    exons += [(1, "c", 1, 65_530, 65_536), (1, "c", 1, 65_537, 65_540), (0, "c", 0, 90, 80), (None, "c", 0, 1, 9)]
    cds = [(g, "c", g % 2, 65_400, 65_600) for g in range(6)]
    codons = [(g, "c", g % 2, *((65_700, 65_702) if g % 2 == 0 else (65_300, 65_302))) for g in range(4)] + [(6, "c", 0, 65_200, 65_199)]
    frames = [spark.createDataFrame(x, form) for x in (exons, cds, codons)]
    spans = {0: (65_400, 65_702), 2: (65_400, 65_702), 1: (65_300, 65_600), 3: (65_300, 65_600), 6: (65_200, 65_199)}
    expected = set()
    for g in range(8):
        low, high = spans.get(g, (1, 0))
        bases = {p for h, _, _, s, e in exons if h == g for p in range(s, e + 1)} - set(range(low, high + 1))
        for p in (p for p in bases if p - 1 not in bases):
            stop = next(q for q in range(p, p + 10_000) if q + 1 not in bases)
            expected.add((g, "UTR5" if (g not in spans or p < low) == (g % 2 == 0) else "UTR3", p, stop))
    got = [(r.gene, r.type, r.start, r.stop) for r in gn.untranslated(*frames).collect()]
    assert set(got) == expected and len(got) == len(expected)
    if limit > 5:
        plan = gn.merge_exons(frames[0])._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
