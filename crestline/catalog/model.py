"""Fragment-length model: windows, summits, centres, lines, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.catalog.common import OPTIONS, TOTALS, experiment, q4, r4
from crestline.operators import model as ops
from crestline.plans.model import bounds_of, treatment_tags
from crestline.session import stage

SIZE = 2 * OPTIONS.bandwidth
HALF = SIZE + 5
LAST = 2 * SIZE + 10


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy windows of both strands: first tag, tag count, last tag."""
    tags = treatment_tags(experiment(spark, sf))
    found = ops.anchor_tags(tags, ["chrom", "strand"], SIZE)
    return found.groupBy("chrom", "strand", "anchor").agg(F.sum("n").alias("n_tags"), F.max("pos").alias("last_pos"))


def _staged(spark: SparkSession, sf: str) -> DataFrame:
    ex = experiment(spark, sf)
    if not hasattr(ex, "model_peaks"):
        ex.model_peaks = stage(ops.strand_peaks(treatment_tags(ex), bounds_of(ex)), "model_peaks")
    return ex.model_peaks


def strand_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return _staged(spark, sf).select("chrom", "strand", "anchor", "summit", "n_tags")


def centres(spark: SparkSession, sf: str) -> DataFrame:
    return ops.paired_centres(_staged(spark, sf), bounds_of(experiment(spark, sf)))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    ex = experiment(spark, sf)
    return ops.model_lines(treatment_tags(ex), centres(spark, sf), bounds_of(ex))


def correlation(spark: SparkSession, sf: str) -> DataFrame:
    scored = ops.cross_correlation(lines(spark, sf), bounds_of(experiment(spark, sf)))
    # rounding goes through a long integer, which has no NaN
    rounded = lambda c: F.when(F.isnan(c), F.col(c)).otherwise(r4(F.col(c) * 1000.0)).alias(c)
    return scored.select("lag", rounded("corr"), rounded("smooth"))


QUERIES = {
    "w9_greedy_windows": anchors,
    "w10_strand_peaks": strand_peaks,
    "j9_pair_centres": centres,
    "j10_model_lines": lines,
    "w12_cross_correlation": correlation,
}

_WALK = """WITH RECURSIVE {parts},
tags AS MATERIALIZED (SELECT chrom, strand, pos, n FROM capped WHERE sample = 'T'),
walk AS (
  SELECT chrom, strand, min(pos) AS anchor FROM tags GROUP BY ALL
  UNION ALL
  SELECT w.chrom, w.strand, min(t.pos) FROM walk w JOIN tags t ON t.chrom = w.chrom AND t.strand = w.strand AND t.pos >= w.anchor + {size} GROUP BY w.chrom, w.strand, w.anchor
),
windows AS MATERIALIZED (SELECT w.chrom, w.strand, w.anchor, t.pos, t.n FROM walk w JOIN tags t
  ON t.chrom = w.chrom AND t.strand = w.strand AND t.pos >= w.anchor AND t.pos < w.anchor + {size}),
kept AS MATERIALIZED (SELECT chrom, strand, anchor, CAST(sum(n) AS BIGINT) AS n_tags FROM windows GROUP BY ALL
  HAVING sum(n) BETWEEN (SELECT floor(k * {size}e0 / {genome!r} / 2e0 * {low}e0 + 0.5e0) FROM totals WHERE sample = 'T')
  AND (SELECT floor(k * {size}e0 / {genome!r} / 2e0 * {high}e0 + 0.5e0) FROM totals WHERE sample = 'T')),
bases AS (SELECT chrom, strand, anchor, unnest(range(pos - 5, pos + 5)) AS p, n FROM windows),
depth AS (SELECT chrom, strand, anchor, p, sum(n) AS d FROM bases SEMI JOIN kept USING (chrom, strand, anchor) GROUP BY ALL),
tops AS (SELECT *, max(d) OVER (PARTITION BY chrom, strand, anchor) AS top FROM depth),
ranked AS (SELECT chrom, strand, anchor, p, row_number() OVER w AS rn, count(*) OVER (PARTITION BY chrom, strand, anchor) AS c
  FROM tops WHERE d = top WINDOW w AS (PARTITION BY chrom, strand, anchor ORDER BY p)),
peaks AS MATERIALIZED (SELECT chrom, strand, anchor, p AS summit, n_tags FROM ranked JOIN kept USING (chrom, strand, anchor) WHERE rn = c // 2 + 1),
centres AS MATERIALIZED (SELECT a.chrom, a.summit AS plus, b.summit AS minus, (a.summit + b.summit) // 2 AS centre FROM peaks a JOIN peaks b
  ON a.chrom = b.chrom AND a.strand = 0 AND b.strand = 1 AND a.summit < b.summit AND b.summit <= a.summit + {size}
  AND a.n_tags / b.n_tags::DOUBLE > 0.5e0 AND a.n_tags / b.n_tags::DOUBLE < 2e0),
marks AS (SELECT t.strand, greatest(t.pos - 5 - centre + {half}, 0) AS s, least(t.pos + 5 - centre + {half}, {last}) AS e, t.n FROM tags t JOIN centres c
  ON t.chrom = c.chrom AND t.pos BETWEEN centre - {half} AND centre + {half}),
deltas AS (SELECT strand, i, sum(d) AS d FROM (SELECT strand, s AS i, n AS d FROM marks UNION ALL SELECT strand, e, -n FROM marks) GROUP BY ALL),
lines AS MATERIALIZED (SELECT strand, i, CAST(sum(coalesce(d, 0)) OVER (PARTITION BY strand ORDER BY i) AS BIGINT) AS depth
  FROM (SELECT CAST(s.s AS INT) AS strand, g.i FROM range(0, 2) s(s), range(0, {last} + 1) g(i)) LEFT JOIN deltas USING (strand, i)),
norm AS MATERIALIZED (SELECT strand, i, (depth - avg(depth) OVER w) / (stddev_pop(depth) OVER w * ({last} + 1)) AS v FROM lines WINDOW w AS (PARTITION BY strand)),
corr AS MATERIALIZED (SELECT m.i - p.i AS lag, sum(m.v * p.v) AS corr FROM norm p JOIN norm m ON p.strand = 0 AND m.strand = 1 AND m.i - p.i BETWEEN -{size} AND {size} - 1 GROUP BY ALL),
smooth AS (SELECT lag, corr, avg(corr) OVER (ORDER BY lag ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS smooth FROM corr)
"""
_PARTS = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in TOTALS)
WALK = _WALK.format(
    parts=_PARTS, size=SIZE, genome=OPTIONS.genome_size, low=OPTIONS.lower_fold, high=OPTIONS.upper_fold, half=HALF, last=LAST
)

ORACLE = {
    "w9_greedy_windows": WALK
    + "SELECT chrom, strand, anchor, CAST(sum(n) AS BIGINT) AS n_tags, max(pos) AS last_pos FROM windows GROUP BY ALL",
    "w10_strand_peaks": WALK + "SELECT * FROM peaks",
    "j9_pair_centres": WALK + "SELECT * FROM centres",
    "j10_model_lines": WALK + "SELECT * FROM lines",
    "w12_cross_correlation": WALK + f"SELECT lag, {q4('corr * 1000e0')} AS corr, {q4('smooth * 1000e0')} AS smooth FROM smooth",
}
