"""Statistics as column expressions, and the few scalars a run needs up front."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline.functions.let import let

LN10 = math.log(10.0)


def round_top(x: Column, digits: int) -> Column:
    """Round half up: ``floor(x * 10^digits + 0.5) / 10^digits``."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def lgamma(x: Column) -> Column:
    """Log-gamma for x >= 1 by the Stirling series, shifted up by eight."""
    x = x.cast("double")
    shifted = x
    for i in range(1, 8):
        shifted = shifted * (x + i)
    z = x + 8
    series = (
        F.lit(1 / 12) / z
        - F.lit(1 / 360) / F.pow(z, F.lit(3))
        + F.lit(1 / 1260) / F.pow(z, F.lit(5))
        - F.lit(1 / 1680) / F.pow(z, F.lit(7))
        + F.lit(1 / 1188) / F.pow(z, F.lit(9))
    )
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(shifted)


def _poisson_log_mass(k: Column, lam: Column) -> Column:
    return k * F.log(lam) - lam - lgamma(k + 1)


def _terms(lam: Column, m: Column) -> Column:
    """Terms after which a falling tail of masses is below double precision."""
    return (F.ceil(F.sqrt(F.greatest(lam, m)) * 7) + 25).cast("int")


def _log_upper(k: Column, lam: Column) -> Column:
    """ln P(X > k), summed from k + 1 upwards; for k + 1 >= lam.

    The sum of mass ratios is nested as 1 + r1 (1 + r2 (1 + ...)) and folded from
    its innermost term, so the fold carries one number.
    """
    m = k + 1
    down = F.sequence(_terms(lam, m), F.lit(1), F.lit(-1))
    ratios = F.aggregate(down, F.lit(1.0), lambda acc, i: acc * lam / (m + i) + 1.0)
    return _poisson_log_mass(m, lam) + F.log(ratios)


def _log_lower(k: Column, lam: Column) -> Column:
    """ln P(X <= k), summed from k downwards; for k + 1 < lam."""
    # at most k ratios: the one after the last would be zero
    down = F.sequence(F.least(_terms(lam, k), k.cast("int") + 1), F.lit(1), F.lit(-1))
    ratios = F.aggregate(down, F.lit(1.0), lambda acc, i: acc * (k + 1.0 - i) / lam + 1.0)
    return _poisson_log_mass(k, lam) + F.log(ratios)


def _log1m_exp(x: Column) -> Column:
    """ln(1 - e^x) for x < 0."""
    return F.log1p(-F.exp(x))


def poisson_log10_upper(k: Column, lam: Column) -> Column:
    """log10 P(X > k) for X ~ Poisson(lam), lam > 0.

    Sums the side of the distribution that falls off; for k below the mean the
    upper tail is one minus the lower one.  The number of terms is of the order
    of sqrt(lam).
    """
    k, lam = k.cast("double"), lam.cast("double")
    return F.when(k + 1 >= lam, _log_upper(k, lam)).otherwise(_log1m_exp(_log_lower(k, lam))) / LN10


def poisson_log10_lower(k: Column, lam: Column) -> Column:
    """log10 P(X <= k)."""
    k, lam = k.cast("double"), lam.cast("double")
    return F.when(k + 1 >= lam, _log1m_exp(_log_upper(k, lam))).otherwise(_log_lower(k, lam)) / LN10


def pscore(treat: Column, ctrl: Column) -> Column:
    """-log10 P(X > int(treat)) under the control rate rounded to 5 digits."""
    return -poisson_log10_upper(treat.cast("int"), round_top(ctrl, 5))


def fold_enrichment(treat: Column, ctrl: Column, pseudo: float = 1.0) -> Column:
    return (treat + pseudo) / (ctrl + pseudo)


def chi2_upper(x: Column, dof: int) -> Column:
    """Upper tail of the chi-square distribution for 1, 2 or 4 degrees of freedom."""
    if dof == 1:
        return erfc(F.sqrt(x / 2))
    if dof == 2:
        return F.exp(-x / 2)
    if dof == 4:
        return F.exp(-x / 2) * (1 + x / 2)
    raise ValueError("1, 2 and 4 degrees of freedom only")


def chi2_log10_upper(x: Column, dof: int) -> Column:
    if dof == 2:
        return -x / 2 / LN10
    if dof == 4:
        return (-x / 2 + F.log1p(x / 2)) / LN10
    raise ValueError("closed form for 2 and 4 degrees of freedom only")


def _fraction_terms(*sizes: Column) -> Column:
    """Steps after which a series or continued fraction around ``sizes`` has settled; grows with the square root."""
    return (F.ceil(F.sqrt(F.greatest(F.lit(1.0), *sizes)) * 10) + 60).cast("int")


def _lentz(steps: Column, first: Column, item) -> Column:
    """Continued fraction 1 / (b0 + a1 / (b1 + ...)): ``first`` is b0, ``item(i)`` gives (ai, bi)."""
    tiny = 1e-300

    def away(x: Column) -> Column:
        return let(x, lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v))

    def step(acc: Column, i: Column) -> Column:
        an, bn = item(i)
        both = lambda a, b: F.struct((1.0 / away(a * acc["d"] + b)).alias("d"), away(b + a / acc["c"]).alias("c"))
        moved = lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (acc["h"] * v["d"] * v["c"]).alias("h"))
        return let(an, lambda a: let(both(a, bn), moved))

    begin = F.struct(F.lit(1 / tiny).alias("c"), (1.0 / first).alias("d"), (1.0 / first).alias("h"))
    return F.aggregate(F.sequence(F.lit(1), steps), begin, step, lambda acc: acc["h"])


def _gamma_front(a: Column, x: Column) -> Column:
    """x^a e^-x / gamma(a + 1)."""
    return F.exp(a * F.log(x) - x - lgamma(a + 1))


def _gamma_series(a: Column, x: Column) -> Column:
    """Lower incomplete gamma by its power series, for x < a + 1."""
    zero = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] * x / (a + i)
        return F.struct((acc["s"] + t).alias("s"), t.alias("t"))

    series = F.aggregate(F.sequence(F.lit(1), _fraction_terms(a)), zero, step, lambda acc: acc["s"])
    return _gamma_front(a, x) * series


def _gamma_fraction(a: Column, x: Column) -> Column:
    """Upper incomplete gamma by its continued fraction, for x >= a + 1."""
    fraction = _lentz(_fraction_terms(a), x + 1 - a, lambda i: (i * (a - i), x + 1 - a + i * 2.0))
    return _gamma_front(a, x) * a * fraction


def gamma_p(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma, for a > 0."""
    a, x = a.cast("double"), x.cast("double")
    return F.when(x <= 0, F.lit(0.0)).when(x < a + 1, _gamma_series(a, x)).otherwise(1.0 - _gamma_fraction(a, x))


def gamma_q(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma, without cancellation far out."""
    a, x = a.cast("double"), x.cast("double")
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1.0 - _gamma_series(a, x)).otherwise(_gamma_fraction(a, x))


def beta_i(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta, for a, b > 0 and x in [0, 1]."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    front = F.exp(lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + a * F.log(x) + b * F.log1p(-x))

    def side(p: Column, q: Column, y: Column) -> Column:
        def item(i: Column) -> tuple[Column, Column]:
            m = F.floor(i / 2).cast("double")
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            return F.when(F.pmod(i, F.lit(2)) == 0, even).otherwise(odd), F.lit(1.0)

        # gamma(a + b) / (gamma(a) gamma(b)) / p, from the shifted log-gammas
        return front * p * q / (p + q) / p * _lentz(steps, F.lit(1.0), item)

    steps = 2 * (F.ceil(F.sqrt(F.greatest(a, b)) * 4) + 20).cast("int")
    low = x < (a + 1) / (a + b + 2)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(low, side(a, b, x)).otherwise(1.0 - side(b, a, 1.0 - x))


def erf(x: Column) -> Column:
    """Error function through the incomplete gamma at one half."""
    return F.signum(x) * gamma_p(F.lit(0.5), x * x)


def erfc(x: Column) -> Column:
    """Complementary error function, exact in the far tail."""
    upper = gamma_q(F.lit(0.5), x * x)
    return F.when(x >= 0, upper).otherwise(2.0 - upper)


def chi2_k1_cdf(x: Column) -> Column:
    return erf(F.sqrt(x / 2))


def log_choose(n: Column, k: Column) -> Column:
    n, k = n.cast("double"), k.cast("double")
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def fisher_exact(n11: Column, n12: Column, n21: Column, n22: Column) -> Column:
    """Fisher's exact test of a 2x2 table: struct(left, right, two_tail).

    Tails are summed outward from a cell as falling ratios of masses, so the work
    follows the spread of the distribution, not the number of cells.  Tables at
    least as unlikely as the observed one count for the two-tailed value; a
    relative slack of 1e-8 absorbs rounding of equal masses.
    """
    n11, n12, n21, n22 = (c.cast("long") for c in (n11, n12, n21, n22))
    row1, col1 = n11 + n12, n11 + n21
    total = row1 + n21 + n22
    size = F.greatest(total, F.lit(2)).cast("double")
    spread = F.sqrt(row1 / size * col1 / size * (total - row1) * (total - col1) / (size - 1))
    table = F.struct(
        n11.alias("n"),
        row1.alias("r"),
        col1.alias("c"),
        (total - row1 - col1).alias("d"),
        F.greatest(F.lit(0), row1 + col1 - total).alias("low"),
        F.least(row1, col1).alias("high"),
        F.floor((row1 + 1.0) * (col1 + 1.0) / (total + 2.0)).cast("long").alias("mode"),
        (F.ceil(spread * 10) + 60).cast("long").alias("terms"),
        (log_choose(total, col1) * -1 + lgamma(row1 + 1) + lgamma(total - row1 + 1)).alias("k"),
    )

    def log_mass(t: Column, i: Column) -> Column:
        return t["k"] - lgamma(i + 1) - lgamma(t["r"] - i + 1) - lgamma(t["c"] - i + 1) - lgamma(t["d"] + i + 1)

    def outward(t: Column, i: Column, up: bool) -> Column:
        """Mass from cell ``i`` to the end of its side, ``i`` lying on that side of the mode."""
        room = t["high"] - i if up else i - t["low"]
        steps = F.sequence(F.lit(1).cast("long"), F.least(room, t["terms"]))

        def step(acc: Column, k: Column) -> Column:
            j = i + k if up else i - k  # the cell that is added
            top = (t["r"] - j + 1.0) * (t["c"] - j + 1.0) if up else (j + 1.0) * (t["d"] + j + 1.0)
            ratio = acc["t"] * top / (j * (t["d"] + j * 1.0) if up else (t["r"] - j * 1.0) * (t["c"] - j))
            return F.struct((acc["s"] + ratio).alias("s"), ratio.alias("t"))

        one = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t"))
        ratios = F.when(room > 0, F.aggregate(steps, one, step, lambda acc: acc["s"])).otherwise(F.lit(1.0))
        return F.when((i < t["low"]) | (i > t["high"]), F.lit(0.0)).otherwise(F.exp(log_mass(t, i)) * ratios)

    def mirror(t: Column, up: bool) -> Column:
        """First cell of the other side that is no likelier than the observed one, by bisection."""
        limit = log_mass(t, t["n"]) + 1e-8
        if up:
            begin = F.struct(F.greatest(t["mode"], t["n"] + 1).alias("in"), (t["high"] + 1).alias("out"))
        else:
            begin = F.struct(F.least(t["mode"], t["n"] - 1).alias("in"), (t["low"] - 1).alias("out"))

        def halve(acc: Column, _: Column) -> Column:
            # "out" is rare enough or past the end; whether "in" is, is still open
            mid = F.floor((acc["in"] + acc["out"]) / 2).cast("long") if up else F.ceil((acc["in"] + acc["out"]) / 2).cast("long")
            apart = (acc["out"] > acc["in"]) if up else (acc["out"] < acc["in"])
            rare = log_mass(t, mid) <= limit
            inner = F.when(apart & ~rare, mid + 1 if up else mid - 1).otherwise(acc["in"])
            return F.struct(inner.alias("in"), F.when(apart & rare, mid).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), begin, halve, lambda acc: acc["out"])

    def sums(t: Column) -> Column:
        seen = F.exp(log_mass(t, t["n"]))
        above = t["n"] >= t["mode"]
        own = F.when(above, outward(t, t["n"], True)).otherwise(outward(t, t["n"], False))
        rest = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - own + seen))
        other = F.when(above, let(mirror(t, False), lambda i: outward(t, i, False))).otherwise(let(mirror(t, True), lambda i: outward(t, i, True)))
        return let(
            F.struct(F.least(own, F.lit(1.0)).alias("own"), rest.alias("rest"), F.least(own + other, F.lit(1.0)).alias("both")),
            lambda v: F.struct(
                F.when(above, v["rest"]).otherwise(v["own"]).alias("left_p"),
                F.when(above, v["own"]).otherwise(v["rest"]).alias("right_p"),
                v["both"].alias("two_tail_p"),
            ),
        )

    return let(table, sums)


# --- scalars computed once per run -------------------------------------------------


def binomial_quantile(p: float, trials: int, rate: float) -> int:
    """Smallest i with CDF(i) > p for Binomial(trials, rate)."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie in [0, 1]")
    log_odds = math.log(rate) - math.log1p(-rate)
    log_mass = trials * math.log1p(-rate)
    total, i = math.exp(log_mass), 0
    while total <= p and i < trials:
        log_mass += math.log((trials - i) / (i + 1)) + log_odds
        total += math.exp(log_mass)
        i += 1
    return i


def max_duplicates(genome_size: float, total: int) -> int:
    """Copies per position that chance alone explains at the 1e-5 level."""
    return binomial_quantile(1 - 1e-5, total, 1.0 / genome_size)


def max_duplicates_of(genome_size: float, total: Column) -> Column:
    """``max_duplicates`` of a column of totals, from the running binomial masses."""
    rate = 1.0 / genome_size
    odds, trials = rate / (1 - rate), total.cast("double")
    steps = F.sequence(F.lit(0), (F.ceil(trials * rate + 10 * F.sqrt(trials * rate)) + 60).cast("int"))
    begin = F.struct((trials * math.log1p(-rate)).alias("m"), F.lit(0.0).alias("sum"), F.lit(-1).alias("i"))

    def step(acc: Column, i: Column) -> Column:
        sum_ = acc["sum"] + F.exp(acc["m"])
        following = acc["m"] + F.log((trials - i) / (i + 1)) + math.log(odds)
        found = F.when((acc["i"] < 0) & ((sum_ > 1 - 1e-5) | (trials <= i)), i).otherwise(acc["i"])
        return F.struct(F.coalesce(following, F.lit(float("-inf"))).alias("m"), sum_.alias("sum"), found.alias("i"))

    return F.aggregate(steps, begin, step, lambda acc: acc["i"])


def poisson_cdf(n: int, lam: float, lower: bool = True) -> float:
    log_mass, total = -lam, 0.0
    for i in range(n + 1):
        total += math.exp(log_mass)
        log_mass += math.log(lam) - math.log(i + 1)
    return total if lower else max(0.0, 1.0 - total)


def poisson_rate_for(k: int, prob: float) -> float:
    """Rate whose Poisson CDF at k equals ``prob``, by bisection; the upper end grows until it brackets."""
    low, high = 1e-12, max(1.0, 2.0 * k)
    while poisson_cdf(k, high) > prob:
        low, high = high, 2 * high
    for _ in range(200):
        mid = (low + high) / 2
        if poisson_cdf(k, mid) > prob:
            low = mid
        else:
            high = mid
    return (low + high) / 2
