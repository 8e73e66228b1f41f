"""Tiled scans against plain loops, on random inputs with tiny tiles."""

import random

from pyspark.sql import functions as F

from crestline.operators.islands import label_islands, middle_rows, summit_rows
from crestline.operators.running import Run, position_in_group, running, tile_of
from crestline.operators.sweep import coalesce_equal, combine_steps, step_events, sweep


def plain_steps(spans, length):
    """Step function of [start, stop) spans: {breakpoint: depth before it}."""
    delta = {}
    for start, stop, n in spans:
        for p, d in ((start, n), (stop, -n)):
            p = min(max(p, 0), length)
            delta[p] = delta.get(p, 0) + d
    depth, out = 0, {}
    for i, p in enumerate(sorted(delta)):
        if p > 0 and (delta[p] != 0 or i == 0):
            out[p] = depth
        depth += delta[p]
    return out


def plain_joint(sides, length):
    steps = [plain_steps(s, length) for s in sides]
    if not all(steps):
        return []
    limit = min(max(s) for s in steps)
    rows, prev = [], 0
    for p in sorted(set().union(*steps)):
        if p <= limit:
            rows.append((prev, p, *[s[min(q for q in s if q >= p)] for s in steps]))
            prev = p
    return rows


def test_joint_sweep_matches_separate_step_functions(spark):
    rng = random.Random(3)
    rows, expected = [], []
    for case in range(40):
        sides = [[], []]
        for _ in range(rng.randint(1, 12)):
            side, start = rng.randint(0, 1), rng.randint(-5, 70)
            span = (start, start + rng.choice([0, 3, 10, 25]), rng.randint(1, 3))
            sides[side].append(span)
            rows.append((f"k{case}", side, *span))
        expected += [(f"k{case}", *r) for r in plain_joint(sides, 60)]
    df = spark.createDataFrame(rows, "chrom string, side int, a long, b long, n long")
    spans = {f"s{i}": (F.col("a"), F.col("b"), F.when(F.col("side") == i, F.col("n"))) for i in (0, 1)}
    for bits in (2, 4, 16):
        got = sweep(step_events(df, ["chrom"], spans, 60), ["chrom"], ["s0", "s1"], tile_bits=bits)
        assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_pileup_of_six_tags(spark):
    # plus starts 11,12,13 to 12,13,14 and minus 12,13,14 to 13,14,15
    rows = [("c", s, s + 1, 1) for s in (11, 12, 13, 12, 13, 14)]
    df = spark.createDataFrame(rows, "chrom string, a long, b long, n long")
    events = step_events(df, ["chrom"], {"d": (F.col("a"), F.col("b"), F.col("n"))}, 100)
    got = sorted(tuple(r)[1:] for r in sweep(events, ["chrom"], ["d"], tile_bits=1).collect())
    assert got == [(0, 11, 0), (11, 12, 1), (12, 14, 2), (14, 15, 1)]


def test_hot_position_is_one_row_before_the_scan(spark):
    df = spark.range(0, 20000).select(F.lit("c").alias("chrom"), F.lit(50).alias("a"), F.lit(60).alias("b"), F.lit(1).alias("n"))
    events = step_events(df, ["chrom"], {"d": (F.col("a"), F.col("b"), F.col("n"))}, 100)
    assert sorted(tuple(r)[1:] for r in sweep(events, ["chrom"], ["d"]).collect()) == [(0, 50, 0), (50, 60, 20000)]


def test_running_levels_match_a_loop(spark):
    rng = random.Random(5)
    rows = [(k, p, rng.choice([None, *range(9)])) for k in "ab" for p in rng.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "k string, p long, v long").withColumn("l1", tile_of("p", 7)).withColumn("l2", tile_of("p", 4))
    runs = [
        Run("s", "sum", "v"),
        Run("si", "sum", "v", True),
        Run("m", "min", "v", True),
        Run("x", "max", "v"),
        Run("last", "last", "v", True),
    ]
    for descending in (False, True):
        got = {(r.k, r.p): (r.s, r.si, r.m, r.x, r["last"]) for r in running(df, ["k"], ["l1", "l2"], ["p"], runs, descending).collect()}
        for key in "ab":
            mine = sorted(((p, v) for k, p, v in rows if k == key), reverse=descending)
            for i, (p, v) in enumerate(mine):
                before = [x for _, x in mine[:i] if x is not None]
                upto = before + ([v] if v is not None else [])
                assert got[key, p] == (
                    sum(before),
                    sum(upto),
                    min(upto, default=None),
                    max(before, default=None),
                    upto[-1] if upto else None,
                )


def test_position_in_group(spark):
    rows = [("a", x) for x in random.Random(1).sample(range(300), 50)]
    df = spark.createDataFrame(rows, "k string, p long").withColumn("t", tile_of("p", 3))
    got = sorted((r.p, r.rn) for r in position_in_group(df, ["k"], ["p"], ["t"]).collect())
    assert [rn for _, rn in got] == list(range(1, 51))


def test_islands_across_tiles(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for key in ("a", "b"):
        at, island = 0, None
        for _ in range(80):
            gap = rng.choice([0, 1, 3, 9, 40])
            start = at + gap
            stop = start + rng.randint(1, 6)
            if island is None or gap > 5:
                island = start
            expected[key, stop] = island
            rows.append((key, start, stop))
            at = stop
    df = spark.createDataFrame(rows, "chrom string, start long, stop long")
    for bits in (2, 4, 16):
        got = {(r.chrom, r.stop): r.island for r in label_islands(df, ["chrom"], 5, tile_bits=bits).collect()}
        assert got == expected


def test_summit_is_the_middle_tie(spark):
    rows = [("c", 0, i * 10, i * 10 + 10, float(t)) for i, t in enumerate([1, 5, 5, 2, 5, 5, 1])]
    df = spark.createDataFrame(rows, "chrom string, island long, start long, stop long, treat double")
    assert [r.start for r in summit_rows(df, ["chrom", "island"]).collect()] == [20]
    assert [r.start for r in middle_rows(df, ["chrom", "island"]).collect()] == [30]


def test_combine_and_coalesce(spark):
    a = spark.createDataFrame([("c", 10, 1.0), ("c", 30, 3.0)], "chrom string, stop long, value double")
    b = spark.createDataFrame([("c", 20, 7.0), ("c", 40, 8.0)], "chrom string, stop long, value double")
    got = sorted(tuple(r) for r in combine_steps({"a": a, "b": b}, ["chrom"], tile_bits=3).collect())
    assert got == [("c", 0, 10, 1.0, 7.0), ("c", 10, 20, 3.0, 7.0), ("c", 20, 30, 3.0, 8.0)]
    steps = spark.createDataFrame(
        [("c", 0, 5, 1.0), ("c", 5, 9, 1.0), ("c", 9, 12, 2.0), ("c", 12, 70000, 2.0), ("c", 70000, 80000, 2.0)],
        "chrom string, start long, stop long, value double",
    )
    assert sorted(tuple(r) for r in coalesce_equal(steps, ["chrom"], "value").collect()) == [("c", 0, 9, 1.0), ("c", 9, 80000, 2.0)]
