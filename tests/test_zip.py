import random

from crestline.operators import reads
from crestline.operators.reads import zip_mates

KEYS, ORDER = ["name"], ["chrom", "pos", "strand"]


def _rows():
    rng = random.Random(4)
    sizes = [(0, 3), (2, 0), (1, 1), (4, 2), (40, 55)]
    rows = [(f"r{i}", m + 1, rng.choice("ab"), rng.randrange(200_000), rng.randrange(2)) for i, n in enumerate(sizes) for m in (0, 1) for _ in range(n[m])]
    return list(dict.fromkeys(rows)) + [(None, 1, "a", 5, 0), (None, 2, "a", 9, 1)]


def _expected(rows):
    want = []
    for name in sorted({r[0] for r in rows if r[0]}):
        one, two = (sorted(r[2:] for r in rows if r[:2] == (name, m)) for m in (1, 2))
        for k in range(max(len(one), len(two))):
            want.append((name, k + 1, *(one[k] if k < len(one) else (None,) * 3), *(two[k] if k < len(two) else (None,) * 3)))
    return want + [(None, 1, "a", 5, 0, None, None, None), (None, 1, None, None, None, "a", 9, 1)]


def test_reads_are_zipped_alike_whole_or_levelled(spark, monkeypatch):
    rows = _rows()
    mates = spark.createDataFrame(rows, "name string, mate int, chrom string, pos long, strand int")
    names = ["name", "rn", *[f"{c}_{k}" for k in (1, 2) for c in ORDER]]
    for limit in (100_000, 50, 3):
        monkeypatch.setattr(reads, "LONG_READ", limit)
        got = [tuple(r) for r in zip_mates(mates, KEYS, ORDER, ORDER).select(*names).collect()]
        assert sorted(got, key=str) == sorted(_expected(rows), key=str)


def test_usual_reads_are_shuffled_once(spark):
    mates = spark.createDataFrame(_rows(), "name string, mate int, chrom string, pos long, strand int")
    plan = zip_mates(mates, KEYS, ORDER, ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
