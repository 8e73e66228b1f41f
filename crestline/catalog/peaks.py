"""Islands, narrow, candidate and broad peaks, and the sink layouts."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.catalog.common import D, OPTIONS, SIGNAL, experiment, islands_sql, q4, r4, rounded, steps_sql, with_parts, TOTALS
from crestline.operators import scoring
from crestline.operators.islands import above_cutoffs
from crestline.plans.broad import broad_levels, call_broad
from crestline.plans.multi import candidate_regions
from crestline.plans.narrow import call_narrow, close_peaks, islands_above, passing_pairs
from crestline.session import stage
from crestline.sources import sinks

GAP = OPTIONS.tag_size


def islands(spark: SparkSession, sf: str) -> DataFrame:
    """Every island of segments above the q cutoff, short ones too."""
    ex = experiment(spark, sf)
    pairs = passing_pairs(ex.scored, "q", OPTIONS.cutoff, ex.q_table)
    rows = islands_above(ex.signal, pairs, GAP)
    return rows.groupBy("chrom", F.col("island").alias("start")).agg(
        F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n_segments")
    )


def two_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    """Segments where p or fold passes its own cutoff."""
    ex = experiment(spark, sf)
    rows = scoring.scored_signal(ex.signal, ex.scored)
    rows = rows.withColumn("fold", (F.col("treat") + 1.0) / (F.col("ctrl") + 1.0))
    kept = above_cutoffs(rows, {"pscore": 8.0, "fold": 3.0})
    return kept.select("chrom", "start", "stop", r4("pscore").alias("pscore"), r4("fold").alias("fold"))


def narrow(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(call_narrow(experiment(spark, sf)), "pileup", "pscore", "fold", "qscore")


def _called(spark: SparkSession, sf: str) -> DataFrame:
    """The narrow peaks as a table, shared by the queries on them."""
    ex = experiment(spark, sf)
    if not hasattr(ex, "narrow_peaks"):
        ex.narrow_peaks = stage(call_narrow(ex), "narrow")
    return ex.narrow_peaks


def narrow_by_p(spark: SparkSession, sf: str) -> DataFrame:
    ex = experiment(spark, sf)
    pairs = passing_pairs(ex.scored, "p", 5.0, None)
    peaks = close_peaks(islands_above(ex.signal, pairs, GAP), ex.q_table, OPTIONS)
    return rounded(peaks, "pileup", "pscore", "fold", "qscore")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(candidate_regions(experiment(spark, sf)), "pileup", "fold")


def broad_weak(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(broad_levels(experiment(spark, sf))[1], "pileup", "pscore", "fold")


def broad(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(call_broad(experiment(spark, sf)), "pileup", "pscore", "fold")


def fold_range(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks with fold in [3, 5)."""
    return rounded(_called(spark, sf), "fold").where("fold >= 3 AND fold < 5").select("chrom", "start", "stop", "fold")


def peak_count(spark: SparkSession, sf: str) -> DataFrame:
    return _called(spark, sf).groupBy("chrom").agg(F.count(F.lit(1)).alias("n_peaks"))


def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sinks.peak_table(_called(spark, sf)), "pileup", "pscore", "fold", "qscore")


def narrow_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sinks.narrow_peak_rows(_called(spark, sf)), "fold", "pscore", "qscore")


def bed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sinks.bed_rows(_called(spark, sf)), "score")


QUERIES = {
    "w3_islands": islands,
    "p12_two_cutoffs": two_cutoffs,
    "w4_narrow_peaks": narrow,
    "w4_narrow_by_p": narrow_by_p,
    "w5_candidates": candidates,
    "w6_broad_regions": broad_weak,
    "j11_broad_peaks": broad,
    "p15_fold_range": fold_range,
    "g18_peak_count": peak_count,
    "k1_peak_table": table_rows,
    "k2_narrow_rows": narrow_rows,
    "k4_bed_rows": bed_rows,
}


def above_sql(score: str, cutoff: float, name: str = "above") -> list[tuple[str, str]]:
    return [
        (
            name,
            "SELECT chrom, start, stop, treat, ctrl, pscore, pkey, qscore FROM rated JOIN scored USING (k, lam)"
            f" JOIN qtable USING (pkey) WHERE {score} > {cutoff!r}",
        )
    ]


def peaks_sql(score: str, cutoff: float) -> list[tuple[str, str]]:
    return [
        *SIGNAL,
        *above_sql(score, cutoff),
        *islands_sql("above", GAP),
        (
            "ties",
            "SELECT *, max(treat) OVER (PARTITION BY chrom, island) AS top, min(start) OVER (PARTITION BY chrom, island) AS p_start,"
            " max(stop) OVER (PARTITION BY chrom, island) AS p_stop FROM islands",
        ),
        (
            "placed",
            "SELECT *, row_number() OVER (PARTITION BY chrom, island ORDER BY stop) AS rn, count(*) OVER (PARTITION BY chrom, island) AS n"
            f" FROM ties WHERE treat = top AND p_stop - p_start >= {D}",
        ),
        (
            "peaks",
            "SELECT chrom, p_start AS start, p_stop AS stop, (start + stop) // 2 AS summit, treat AS pileup, pscore,"
            " (treat + 1e0) / (ctrl + 1e0) AS fold, qscore,"
            " concat('NONAME_peak', CAST(dense_rank() OVER (ORDER BY chrom, p_stop) AS VARCHAR)) AS name"
            " FROM placed WHERE rn = (n + 1) // 2",
        ),
    ]


NARROW = peaks_sql("qscore", OPTIONS.cutoff)
_ROUND = ", ".join(f"{q4(c)} AS {c}" for c in ("pileup", "pscore", "fold", "qscore"))

CANDIDATES = [
    *TOTALS,
    ("tags", "SELECT sample, chrom, strand, pos, sum(n)::BIGINT AS n FROM (SELECT * FROM capped UNION ALL SELECT * FROM multi) GROUP BY ALL"),
    *steps_sql("tags"),
    *above_sql("pscore", 5.0),
    *islands_sql("above", GAP),
    (
        "placed",
        "SELECT *, row_number() OVER (PARTITION BY chrom, island ORDER BY stop) AS rn, count(*) OVER (PARTITION BY chrom, island) AS n,"
        " min(start) OVER (PARTITION BY chrom, island) AS p_start, max(stop) OVER (PARTITION BY chrom, island) AS p_stop FROM islands",
    ),
    (
        "candidates",
        "SELECT chrom, p_start AS start, p_stop AS stop, treat AS pileup, (treat + 1e0) / (ctrl + 1e0) AS fold,"
        f" row_number() OVER (ORDER BY chrom, p_stop) AS pid FROM placed WHERE rn = (n + 1) // 2 AND p_stop - p_start >= {D}",
    ),
]


def _regions_sql(cutoff: float, gap: int, name: str) -> list[tuple[str, str]]:
    mean = "sum({0} * (stop - start)) / sum(stop - start)"
    return [
        *above_sql("qscore", cutoff, f"{name}_rows"),
        *islands_sql(f"{name}_rows", gap, f"{name}_islands"),
        (
            name,
            "SELECT chrom, min(start) AS start, max(stop) AS stop, "
            + f"{mean.format('treat')} AS pileup, {mean.format('pscore')} AS pscore, {mean.format('((treat + 1e0) / (ctrl + 1e0))')} AS fold"
            + f" FROM {name}_islands GROUP BY chrom, island HAVING max(stop) - min(start) >= {D}",
        ),
    ]


_BROAD = [
    *SIGNAL,
    *_regions_sql(OPTIONS.cutoff, GAP, "strong"),
    *_regions_sql(OPTIONS.broad_log_cutoff, 4 * D, "weak"),
]
_BROAD_COLUMNS = f"chrom, start, stop, {q4('pileup')} AS pileup, {q4('pscore')} AS pscore, {q4('fold')} AS fold"

ORACLE = {
    "w3_islands": with_parts(
        [*SIGNAL, *above_sql("qscore", OPTIONS.cutoff), *islands_sql("above", GAP)],
        "SELECT chrom, min(start) AS start, max(stop) AS stop, count(*) AS n_segments FROM islands GROUP BY chrom, island",
    ),
    "p12_two_cutoffs": with_parts(
        SIGNAL,
        f"SELECT chrom, start, stop, {q4('pscore')} AS pscore, {q4('fold')} AS fold FROM (SELECT *, (treat + 1e0) / (ctrl + 1e0) AS fold"
        " FROM rated JOIN scored USING (k, lam)) WHERE pscore > 8e0 OR fold > 3e0",
    ),
    "w4_narrow_peaks": with_parts(NARROW, f"SELECT chrom, start, stop, summit, {_ROUND}, name FROM peaks"),
    "w4_narrow_by_p": with_parts(peaks_sql("pscore", 5.0), f"SELECT chrom, start, stop, summit, {_ROUND} FROM peaks"),
    "w5_candidates": with_parts(
        CANDIDATES, f"SELECT chrom, start, stop, {q4('pileup')} AS pileup, {q4('fold')} AS fold, pid FROM candidates"
    ),
    "w6_broad_regions": with_parts(_BROAD, f"SELECT {_BROAD_COLUMNS} FROM weak"),
    "j11_broad_peaks": with_parts(
        _BROAD,
        f"SELECT {_BROAD_COLUMNS} FROM weak w WHERE EXISTS (SELECT 1 FROM strong s WHERE s.chrom = w.chrom"
        " AND w.start <= s.start AND s.stop <= w.stop)",
    ),
    "p15_fold_range": with_parts(
        NARROW, f"SELECT chrom, start, stop, fold FROM (SELECT chrom, start, stop, {q4('fold')} AS fold FROM peaks) WHERE fold >= 3 AND fold < 5"
    ),
    "g18_peak_count": with_parts(NARROW, "SELECT chrom, count(*) AS n_peaks FROM peaks GROUP BY ALL"),
    "k1_peak_table": with_parts(
        NARROW,
        f"SELECT chrom AS chr, start + 1 AS start, stop AS \"end\", stop - start + 1 AS length, summit + 1 AS abs_summit, {_ROUND}, name FROM peaks",
    ),
    "k2_narrow_rows": with_parts(
        NARROW,
        f"SELECT chrom, start, stop, name, CAST(floor(10e0 * qscore) AS INT) AS score, {q4('fold')} AS fold, {q4('pscore')} AS pscore,"
        f" {q4('qscore')} AS qscore, summit - start AS summit_offset FROM peaks",
    ),
    "k4_bed_rows": with_parts(NARROW, f"SELECT chrom, start, stop, name, {q4('qscore')} AS score FROM peaks"),
}
