import random

from pyspark.sql import functions as F

from crestline.functions.regions import parse_region, region_bin
from crestline.operators.overlap import assign_first, containing, count_overlaps, first_cover, not_overlapping, overlap_join, overlapping


def frame(spark, rows, names="chrom string, start long, stop long, id long"):
    return spark.createDataFrame(rows, names)


def test_interval_query_returns_all_hits(spark):
    intervals = [(1, 100, 300), (2, 10, 100), (3, 1000, 3000), (4, 500, 800), (5, 200, 700)]
    right = frame(spark, [("c", s, e, g) for g, s, e in intervals]).withColumnsRenamed({"start": "r_start", "stop": "r_stop"})
    left = frame(spark, [("c", 20, 600, 0)]).withColumnsRenamed({"start": "l_start", "stop": "l_stop", "id": "q"})
    assert sorted(r.id for r in overlap_join(left, right).collect()) == [1, 2, 4, 5]


def random_intervals(rng, n):
    return [(rng.choice(["a", "b"]), s, s + rng.choice([0, 5, 40, 300]), i) for i, s in enumerate(rng.choices(range(600), k=n))]


def test_joins_match_brute_force(spark):
    rng = random.Random(8)
    qs, ts = random_intervals(rng, 60), random_intervals(rng, 60)
    hits = [(q[3], t[3]) for q in qs for t in ts if q[0] == t[0] and q[2] >= t[1] and q[1] <= t[2]]
    left = frame(spark, qs).withColumnsRenamed({"start": "l_start", "stop": "l_stop", "id": "q"})
    right = frame(spark, ts).withColumnsRenamed({"start": "r_start", "stop": "r_stop", "id": "t"})
    got = sorted((r.q, r.t) for r in overlap_join(left, right, bits=5).collect())
    assert got == sorted(hits)
    counts = {r.id: r.n_overlap for r in count_overlaps(frame(spark, qs), frame(spark, ts)).collect()}
    assert counts == {q[3]: sum(1 for h in hits if h[0] == q[3]) for q in qs}
    some = {h[0] for h in hits}
    assert {r.id for r in overlapping(frame(spark, qs), frame(spark, ts)).collect()} == some
    assert {r.id for r in not_overlapping(frame(spark, qs), frame(spark, ts)).collect()} == {q[3] for q in qs} - some


def test_region_index_cases(spark):
    regions = frame(spark, [("1", 10000000, 10000000, 1), ("1", 20000000, 20000001, 2), ("1", 20000002, 20000002, 3), ("1", 30000000, 30000000, 4)])
    asked = [(9999999, 9999999, 0), (10000000, 10000000, 1), (20000000, 20000002, 2), (20000003, 29999999, 0), (1, 30000000, 4)]
    queries = frame(spark, [("1", s, e, i) for i, (s, e, _) in enumerate(asked)])
    got = {r.id: r.n_overlap for r in count_overlaps(queries, regions).collect()}
    assert got == {i: n for i, (_, _, n) in enumerate(asked)}


def test_first_candidate_has_the_smallest_id(spark):
    tags = spark.createDataFrame([("c", 1, 90, 120), ("c", 2, 500, 510)], "chrom string, t int, l_start long, l_stop long")
    peaks = spark.createDataFrame([("c", 0, 100, 7), ("c", 110, 200, 3)], "chrom string, start long, stop long, pid long")
    assert [(r.t, r.pid) for r in assign_first(tags, peaks, ["t"]).collect()] == [(1, 3)]


def test_containing_keeps_outer_with_a_whole_inner(spark):
    outer = frame(spark, [("c", 0, 100, 1), ("c", 200, 300, 2), ("c", 400, 500, 3)])
    inner = frame(spark, [("c", 10, 20, 0), ("c", 30, 100, 0), ("c", 290, 310, 0), ("c", 400, 500, 0)])
    assert sorted(r.id for r in containing(outer, inner).collect()) == [1, 3]


def test_region_text_and_bins(spark):
    texts = [("chr1", "chr1", 0, 2147483647), ("chr1:1,001-2,000", "chr1", 1000, 2000), ("chr1:501", "chr1", 500, 2147483647), ("chr1:7-", "chr1", 6, 2147483647)]
    df = spark.createDataFrame([(t[0],) for t in texts], "s string").select(parse_region(F.col("s")).alias("r"))
    assert [tuple(r.r) for r in df.collect()] == [t[1:] for t in texts]
    bins = spark.createDataFrame([(0, 1), (16384, 16385), (0, 16385), (0, 1 << 29)], "b long, e long")
    assert [r.x for r in bins.select(region_bin(F.col("b"), F.col("e")).alias("x")).collect()] == [4681, 4682, 585, 0]


def test_first_of_dense_candidates_forms_no_pairs(spark):
    rng = random.Random(3)
    peaks = [("c", s, s + rng.choice([0, 1, 7, 90, 900, 70000]), i) for i, s in enumerate(rng.choices(range(66000), k=250))]
    peaks += [("d", 10, 12, 5), ("d", 13, 20, 5), ("d", 22, 30, 4)]
    asked = [("c", s, s + rng.choice([0, 30, 300]), i) for i, s in enumerate(rng.choices(range(66000), k=150))] + [("d", 21, 21, 900), ("d", 20, 22, 901)]
    covers = first_cover(frame(spark, peaks, "chrom string, start long, stop long, pid long")).collect()
    bases = {(r.chrom, r.start): r for r in covers}
    assert len(bases) == len(covers) and sorted((r.start, r.stop, r.pid) for r in covers if r.chrom == "d") == [(10, 20, 5), (22, 30, 4)]
    for r in covers:  # stretches hold the smallest id at either end, and none of them covers a base twice
        for at in (r.start, r.stop):
            assert r.pid == min(p[3] for p in peaks if p[0] == r.chrom and p[1] <= at <= p[2])
    tags = frame(spark, asked).withColumnsRenamed({"start": "l_start", "stop": "l_stop", "id": "t"})
    got = {r.t: r.pid for r in assign_first(tags, frame(spark, peaks, "chrom string, start long, stop long, pid long"), ["t"]).collect()}
    hits = {t: [p[3] for p in peaks if p[0] == c and p[2] >= s and p[1] <= e] for c, s, e, t in asked}
    assert got == {t: min(h) for t, h in hits.items() if h}
