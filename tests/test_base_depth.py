import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crestline.functions.cigar import parse_cigar
from crestline.operators import reads
from crestline.operators.base_depth import block_events, mate_overlap


def test_classes_come_from_one_pass(spark):
    rows = spark.createDataFrame([("c", 10, "3M2D4M"), ("c", 12, "2M5N1M")], "chrom string, pos long, cigar string")
    events = block_events(rows.withColumn("cigar", parse_cigar(F.col("cigar"))), ["chrom"])
    got = sorted((r.pos, r.n_base or 0, r.n_del or 0, r.n_skip or 0) for r in events.collect())
    one = lambda i, s, e: [(s, *[d if k == i else 0 for k in range(3)]) for s, d in ((s, 1),)] + [(e, *[-1 if k == i else 0 for k in range(3)])]
    want = one(0, 10, 13) + one(1, 13, 15) + one(0, 15, 19) + one(0, 12, 14) + one(2, 14, 19) + one(0, 19, 20)
    assert got == sorted(want)
    assert "Union" not in events._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [100_000, 20])
def test_templates_are_scanned_where_they_lie(spark, monkeypatch, limit):
    """Usual templates are shuffled once; those with many alignments give the same by the tiled sweep."""
    monkeypatch.setattr(reads, "LONG_READ", limit)
    rng, rows, cover = random.Random(8), [], defaultdict(lambda: (set(), set()))
    for name, n in (("x", 60), ("y", 4), ("z", 9), ("one", 1)):
        for _ in range(n):
            chrom, mate, start, span = rng.choice("ab"), rng.randint(1, 2), rng.randint(65_300, 65_700), rng.randint(1, 60)
            rows.append((name, chrom, mate, start, start + span - 1))
            cover[name, chrom][mate - 1].update(range(start, start + span))
    expected = {(*k, len(a & b)) for k, (a, b) in cover.items() if a & b}
    rows += [(None, "a", 1, 5, 9), (None, "a", 2, 5, 9)]
    mates = spark.createDataFrame(rows, "qname string, chrom string, mate int, start long, stop long")
    got = [tuple(r) for r in mate_overlap(mates).collect()]
    assert set(got) == expected and len(got) == len(expected) > 1
    if limit > 20:
        plan = mate_overlap(mates)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
