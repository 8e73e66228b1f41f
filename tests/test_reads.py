import random

import pytest
from pyspark.sql import functions as F

from crestline import catalog
from crestline.functions import cigar as cg
from crestline.functions.flags import flag_text, text_flag
from crestline.operators import em, scoring
from crestline.operators.model import anchor_tags
from crestline.operators.reads import read_counts, tag_tracks, zip_mates
from crestline.operators.tags import cap_duplicates, downsample, number_copies
from crestline.operators.variants import genotype_class, variant_type
from crestline.sources import sam, text


def test_em_small_case(spark):
    """Four regions, two reads with three alignments each, against a plain loop."""
    unique, length = [4, 3, 3, 3], [2, 2, 2, 2]
    reads = {0: [0, 1, 2], 1: [1, 2, 3]}
    weights = {r: [unique[p] / length[p] for p in ps] for r, ps in reads.items()}
    weights = {r: [w / sum(ws) for w in ws] for r, ws in weights.items()}
    rows = [("T", r, p, 0) for r, ps in reads.items() for p in ps]
    classes = em.read_classes(spark.createDataFrame(rows, "sample string, read_id long, pid long, frag_start long"))
    peaks = spark.createDataFrame(list(zip(range(4), length, unique)), "pid long, len long, u long")
    got = em.start_weights(classes.members, peaks)
    for _ in range(3):
        prime = list(map(float, unique))
        for r, ps in reads.items():
            for p, w in zip(ps, weights[r]):
                prime[p] += w
        weights = {r: [prime[p] / length[p] for p in ps] for r, ps in reads.items()}
        weights = {r: [w / sum(ws) for w in ws] for r, ws in weights.items()}
        got = em.em_step(got, peaks)
    final = {(r.class_id, r.pid): r.w for r in got.collect()}
    for r, ps in reads.items():
        for p, w in zip(ps, weights[r]):
            assert abs(final[r, p] - w) < 1e-12


def test_em_zero_rates_spread_evenly(spark):
    rows = [("T", 9, 1, 0), ("T", 9, 2, 0), ("T", 10, 1, 5), ("T", 10, 2, 5)]
    classes = em.read_classes(spark.createDataFrame(rows, "sample string, read_id long, pid long, frag_start long"))
    members = classes.members.collect()
    assert {(m.class_id, m.pid, m.m, m.n) for m in members} == {(9, 1, 1, 2), (9, 2, 1, 2)}
    peaks = spark.createDataFrame([(1, 10, 0), (2, 10, 0)], "pid long, len long, u long")
    assert {r.w for r in em.estimate(classes.members, peaks, 5).collect()} == {0.5}


def test_tracks_count_unique_and_multi(spark):
    rows = [("T", 1, "c", 0, 5), ("T", 2, "c", 0, 5), ("T", 3, "c", 0, 5), ("T", 3, "d", 1, 9), ("T", 4, "d", 1, 9)]
    reads = spark.createDataFrame(rows, "sample string, read_id long, chrom string, strand int, pos long")
    for contigs in (None, ["c", "d"]):
        got = {(r.chrom, r.pos): (r.n_unique, r.n_multi) for r in tag_tracks(reads if contigs is None else reads.where(reads.chrom.isin(contigs)), read_counts(reads)).collect()}
        assert got == {("c", 5): (2, 1), ("d", 9): (1, 1)}


def test_cap_and_downsample(spark):
    piled = spark.createDataFrame([("T", "c", 0, p, 3) for p in range(50)], "sample string, chrom string, strand int, pos long, n long")
    assert {r.n for r in cap_duplicates(piled, {"T": 2}).collect()} == {2}
    copies = number_copies(piled, ["sample", "chrom", "strand", "pos"], chunk=2)
    assert sorted(r.copy for r in copies.where("pos = 7").collect()) == [1, 2, 3]
    first = downsample(copies, 0.5, 3)
    assert first.count() == 75
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, downsample(copies.repartition(3), 0.5, 3).collect()))


def test_mate_zip_keeps_leftovers(spark):
    rows = [("r", 1, "c", 10, 0), ("r", 2, "c", 30, 1), ("r", 2, "c", 70000, 1)]
    mates = spark.createDataFrame(rows, "name string, mate int, chrom string, pos long, strand int")
    got = sorted((r.pos_1 or -1, r.pos_2) for r in zip_mates(mates, ["name"], ["chrom", "pos"], ["chrom", "pos", "strand"]).collect())
    assert got == [(-1, 70000), (10, 30)]


def test_greedy_windows_over_tiles(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    for strand in (0, 1):
        pos = sorted(rng.sample(range(3000), 250))
        first = None
        for p in pos:
            if first is None or p - first + 1 > 60:
                first = p
            expected[strand, p] = first
            rows.append(("c", strand, p, 1))
    tags = spark.createDataFrame(rows, "chrom string, strand int, pos long, n long")
    for bits in (5, 7, 20):
        got = {(r.strand, r.pos): r.anchor for r in anchor_tags(tags, ["chrom", "strand"], 60, bits).collect()}
        assert got == expected


def test_cigar_arithmetic(spark):
    cases = [("10M", 10, 10), ("5S10M", 15, 10), ("10M2D5M", 15, 17), ("3H10M2I5M4S", 21, 15), ("4=1X2N3P5M", 10, 12), ("*", 0, 0)]
    df = spark.createDataFrame([(c[0],) for c in cases], "c string").select("c", cg.parse_cigar(F.col("c")).alias("g"))
    rows = df.select("c", cg.query_length(F.col("g")).alias("q"), cg.reference_length(F.col("g")).alias("r"), cg.cigar_text(F.col("g")).alias("t"))
    assert [(r.c, r.q, r.r) for r in rows.collect()] == cases
    assert all(r.c == r.t for r in rows.collect())


def test_flags(spark):
    df = spark.createDataFrame([(99,), (0,), (1540,)], "f int").select("f", flag_text(F.col("f")).alias("t"))
    rows = df.select("f", "t", text_flag(F.col("t")).alias("b")).collect()
    assert [r.t for r in rows] == ["PAIRED,PROPER_PAIR,MREVERSE,READ1", "", "UNMAP,QCFAIL,DUP"]
    assert all(r.f == r.b for r in rows)


def test_sam_text(spark, tmp_path):
    lines = [
        "@HD\tVN:1.4\tSO:unsorted",
        "@SQ\tSN:xx\tLN:20",
        "@SQ\tSN:yy\tLN:30",
        "a1\t16\txx\t4\t1\t10M\t*\t0\t0\tAAAAAAAAAA\t**********\tNM:i:-3\tXZ:Z:a:b\tBB:B:i,1,2",
        "a2\t0\t*\t0\t0\t*\t*\t0\t0\tACGT\t*",
        "a3\t0\txx\t7\t9\t*\t*\t0\t0\t*\t*",
    ]
    path = tmp_path / "in.sam"
    path.write_text("\n".join(lines) + "\n")
    contigs, records = sam.read_sam(spark, str(path))
    assert sorted(map(tuple, contigs.collect())) == [("xx", 20), ("yy", 30)]
    got = {r.qname: r for r in records.collect()}
    assert (got["a1"].pos, got["a1"].flag, got["a2"].flag, got["a3"].flag) == (3, 16, 4, 4)
    row = records.where("qname = 'a1'").select(
        sam.tag_int(F.col("tags"), "NM").alias("nm"), sam.tag_text(F.col("tags"), "XZ").alias("xz"), sam.tag_array(F.col("tags"), "BB").alias("bb")
    ).first()
    assert (row.nm, row.xz, row.bb) == (-3, "a:b", [1.0, 2.0])
    out = str(tmp_path / "out")
    sam.write_sam(records, [("xx", 20), ("yy", 30)], out)
    again, back = sam.read_sam(spark, out)
    assert sorted(map(tuple, again.collect())) == [("xx", 20), ("yy", 30)]
    assert {r.qname: r.asDict() for r in back.collect()} == {q: r.asDict() for q, r in got.items()}


def test_variant_types_and_genotypes(spark):
    cases = [("A", "C", "SNP", 1), ("A", "A", "REF", 0), ("A", ".", "REF", 0), ("A", "ACG", "INDEL", 2), ("ACG", "A", "INDEL", -2), ("AC", "GT", "MNP", 2), ("CAT", "CGT", "SNP", 1), ("A", "<DEL>", "OTHER", 0), ("A", "<X>", "REF", 0), ("CAG", "TTAG", "OTHER", 1), ("GA", "TTGA", "INDEL", 2)]
    df = spark.createDataFrame([c[:2] for c in cases], "r string, a string").select(variant_type(F.col("r"), F.col("a")).alias("t"))
    got = [tuple(r.t) for r in df.collect()]
    # a longer insertion in front is set apart from a plain one by its last base
    assert got[:9] == [c[2:] for c in cases[:9]]
    assert got[9][0] == "OTHER" and got[10][0] == "INDEL"
    gts = [([0, 0], "HOM_RR"), ([0, 1], "HET_RA"), ([1, 1], "HOM_AA"), ([1, 2], "HET_AA"), ([-1, -1], "UNKN"), ([0], "HAPL_R"), ([2], "HAPL_A")]
    rows = spark.createDataFrame([(g[0],) for g in gts], "g array<int>").select(genotype_class(F.col("g")).alias("c")).collect()
    assert [r.c for r in rows] == [g[1] for g in gts]


def test_text_sources(spark, tmp_path):
    lines = lambda rows: spark.createDataFrame([(r,) for r in rows], "value string")
    assert [tuple(r) for r in text.parse_bed(lines(["track name=x", "#c", "1\t99\t200\tp"])).collect()] == [("1", 99, 199, "p")]
    assert [tuple(r) for r in text.parse_tab(lines(["1\t100\t200", "1\t7"])).collect()] == [("1", 99, 199), ("1", 6, 6)]
    gtf = 'c\tsrc\texon\t5\t9\t.\t-\t.\tgene_id "g1"; transcript_id "t1";'
    other = "c\tsrc\tCDS\t5\t9\t.\t+\t.\tID=x;gene_id=g2;"
    assert [tuple(r) for r in text.parse_gtf(lines([gtf, other, "c\ts\tgene\t1\t2\t.\t+\t.\tx"])).collect()] == [("g1", "c", 1, "exon", 5, 9), ("g2", "c", 0, "CDS", 5, 9)]
    fasta = tmp_path / "x.fa"
    fasta.write_text(">one first\nACGT\nACG\n>two\nTTTT\n")
    chunks = text.read_fasta(spark, str(fasta))
    assert sorted((r.name, r.length) for r in text.sequence_lengths(chunks).collect()) == [("one", 7), ("two", 4)]
    want = spark.createDataFrame([("one", 2, 6)], "name string, beg long, stop long")
    assert text.fetch_sequence(chunks, want).first().seq == "GTAC"


def test_first_weights_by_read_are_those_of_the_classes(spark, monkeypatch):
    """Each read's own sums give the weights its class would get; the query forms no classes."""
    rng = random.Random(8)
    rows = [("T", r, rng.randrange(6), rng.randrange(50)) for r in range(60) for _ in range(rng.randint(1, 7))] + [("T", 99, 4, 1), ("T", 99, 5, 2), ("T", 99, 5, 3)]
    alignments = spark.createDataFrame(rows, "sample string, read_id long, pid long, frag_start long")
    peaks = spark.createDataFrame([(0, 10, 4), (1, 7, 9), (2, 300, 1), (3, 11, 2), (4, 9, 0), (5, 9, 0)], "pid long, len long, u long")
    classes = em.read_classes(alignments)
    by_class = {(r.class_id, r.pid): (r.m, r.w) for r in em.start_weights(classes.members, peaks).collect()}
    class_of = {r.read_id: r.class_id for r in classes.of_read.collect()}
    expected = {(r, p): by_class[class_of[r], p] for _, r, p, _ in rows}
    got = em.start_by_read(alignments, peaks).collect()
    assert {(r.read_id, r.pid): (r.m, r.w) for r in got} == expected and len(got) == len(expected)
    assert expected[99, 4] == (1, 1 / 3)  # all rates zero: spread evenly
    catalog.reset()
    monkeypatch.setattr(em, "read_classes", lambda _: pytest.fail("classes are not needed"))
    assert catalog.queries()["d15_start_weights"](spark, "/root/testdata/sf0.001").count() > 0
    catalog.reset()


def test_pairs_are_scored_in_many_tasks(spark):
    """Few bytes of distinct pairs are still dealt to as many tasks as the session shuffles to."""
    signal = spark.range(200).selectExpr("'c' AS chrom", "id AS start", "id + 1 AS stop", "CAST(id % 40 AS DOUBLE) AS treat", "id % 7 + 0.5D AS ctrl")
    scored = scoring.score_lengths(signal)
    placed = scored.groupBy(F.spark_partition_id().alias("part")).agg(F.count("pscore").alias("n")).collect()
    assert len(placed) > 1 and sum(r.n for r in placed) == 200
