import math
import random

import pytest
from pyspark.sql import functions as F

from crestline.functions import stats as st
from crestline.operators import scoring


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def direct_upper(k, lam):
    top = max(k, int(lam)) + 60 + int(12 * math.sqrt(lam + k))
    return sum(math.exp(i * math.log(lam) - lam - math.lgamma(i + 1)) for i in range(k + 1, top))


def test_poisson_upper_tail(spark):
    cases = [(0, 0.3), (5, 1.2), (30, 4.5), (3, 40.0), (100, 100.0), (80, 100.0), (900, 800.0), (700, 800.0)]
    df = spark.createDataFrame(cases, "k int, lam double")
    for r in df.select("k", "lam", st.poisson_log10_upper(F.col("k"), F.col("lam")).alias("p")).collect():
        assert r.p == pytest.approx(math.log10(direct_upper(r.k, r.lam)), abs=1e-8)
    assert -value(spark, st.poisson_log10_upper(F.lit(5), F.lit(1.2))) == pytest.approx(2.823844, abs=1e-6)
    assert -value(spark, st.poisson_log10_upper(F.lit(30), F.lit(4.5))) == pytest.approx(15.554287, abs=1e-6)


def test_poisson_far_tail_does_not_underflow(spark):
    p = -value(spark, st.poisson_log10_upper(F.lit(5000), F.lit(10.0)))
    assert math.isfinite(p) and p > 10000


def test_lgamma_erf_gamma(spark):
    for x in (1.0, 1.5, 2.0, 10.0, 1234.5):
        assert value(spark, st.lgamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-9)
    for x in (-1.2, 0.0, 0.1, 0.9, 3.0):
        assert value(spark, st.erf(F.lit(x))) == pytest.approx(math.erf(x), abs=1e-9)
    assert value(spark, st.chi2_k1_cdf(F.lit(3.841459))) == pytest.approx(0.95, abs=1e-6)


def test_fisher_exact(spark):
    f = value(spark, st.fisher_exact(*[F.lit(x) for x in (3, 1, 1, 3)]))
    assert f.left_p == pytest.approx(69 / 70)
    assert f.right_p == pytest.approx(17 / 70)
    assert f.two_tail_p == pytest.approx(34 / 70)


def test_round_top(spark):
    assert value(spark, st.round_top(F.lit(-0.5), 0)) == 0
    assert value(spark, st.round_top(F.lit(2.345675), 5)) == 2.34568


def test_driver_scalars():
    assert st.max_duplicates(1_000_000, 30_000) == 2
    assert st.max_duplicates(2.7e9, 10_000_000) == 1
    assert st.poisson_cdf(2, 1.0) == pytest.approx(5 / (2 * math.e))
    rate = st.poisson_rate_for(10, 0.05)
    assert st.poisson_cdf(10, rate) == pytest.approx(0.05, abs=1e-9)


def test_q_table_matches_a_loop(spark):
    rng = random.Random(2)
    hist = [(int(p * 10**10), rng.randint(1, 500)) for p in {round(rng.expovariate(0.3), 4) for _ in range(300)}]
    got = {r.pkey: r.qscore for r in scoring.q_table(spark.createDataFrame(hist, "pkey long, bp long")).collect()}
    total, rank, low = sum(b for _, b in hist), 1, math.inf
    for key, bp in sorted(hist, reverse=True):
        low = min(low, key / 1e10 + math.log10(rank) - math.log10(total))
        assert got[key] == pytest.approx(max(low, 0.0), abs=1e-9)
        rank += bp
