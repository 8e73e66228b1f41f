"""Scores of the paired signal: p-score, genome-wide q table, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.stats import pscore, round_top
from crestline.operators.joins import lookup
from crestline.operators.running import Run, running
from crestline.session import stage

P_UNITS = 10**10  # p-scores are compared as integers of 1e-10


def p_key(p: Column) -> Column:
    """Exact integer key of a p-score rounded half up to ten digits."""
    return F.floor(p * float(P_UNITS) + 0.5).cast("long")


def rate_columns(signal: DataFrame) -> DataFrame:
    """Add the two numbers a p-score depends on: count ``k`` and rate ``lam``."""
    return signal.withColumn("k", F.col("treat").cast("int")).withColumn("lam", round_top(F.col("ctrl"), 5))


def score_lengths(signal: DataFrame) -> DataFrame:
    """Base pairs per distinct (k, lam), with the p-score computed once for each.

    A genome has few distinct pairs next to its segments, so the costly tail sum
    runs on the aggregate and not on every segment.
    """
    pairs = rate_columns(signal).groupBy("k", "lam").agg(F.sum(F.col("stop") - F.col("start")).alias("bp"))
    # few bytes but much arithmetic per row: keep the tasks that coalescing by size would merge; by a hash of the pair, as a
    # repartition by the columns of the aggregate itself is planned away
    pairs = pairs.repartition(int(signal.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("k", "lam"))
    return pairs.withColumn("pscore", pscore(F.col("k"), F.col("lam")))


def staged_scores(signal: DataFrame, label: str = "scored") -> DataFrame:
    """Scored pairs as a table, with the integer key of the p-score.

    Staging also keeps the optimizer from moving a filter on the score below the
    aggregate, where the tail sum would run on every segment.
    """
    return stage(score_lengths(signal), label).withColumn("pkey", p_key(F.col("pscore")))


def p_histogram(scored: DataFrame) -> DataFrame:
    """Base pairs per distinct p-score."""
    return scored.groupBy("pkey").agg(F.sum("bp").alias("bp"))


def q_table(hist: DataFrame) -> DataFrame:
    """Genome-wide p to q table, ``(pkey, bp, qscore)``.

    q = p + log10(rank) - log10(N), with the rank counted in base pairs from the
    top; a running minimum makes q fall with p, and it is floored at zero.  The
    scan runs over two levels of score slices: at most a thousand fine slices
    per coarse one, and at most a million distinct keys in a fine one.
    """
    levels = hist.withColumn("_coarse", F.floor(F.col("pkey") / 1e9)).withColumn("_fine", F.floor(F.col("pkey") / 1e6))
    ranked = running(levels, [], ["_coarse", "_fine"], ["pkey"], [Run("_above", "sum", "bp")], descending=True)
    total = hist.agg(F.sum("bp")).scalar()
    raw = ranked.withColumn(
        "_raw", F.col("pkey") / float(P_UNITS) + F.log10(F.col("_above") + 1) - F.log10(total)
    )
    # staged because a scan reads its rows twice
    raw = stage(raw.select("pkey", "bp", "_raw", "_coarse", "_fine"), "ranked")
    lowered = running(raw, [], ["_coarse", "_fine"], ["pkey"], [Run("_min", "min", "_raw", True)], descending=True)
    return lowered.select("pkey", "bp", F.greatest(F.col("_min"), F.lit(0.0)).alias("qscore"))


def scored_signal(signal: DataFrame, scored: DataFrame) -> DataFrame:
    """Attach the p-score to every segment.

    One (k, lam) pair, the empty background, covers much of a genome: adaptive
    execution splits its segments.
    """
    return lookup(rate_columns(signal), scored.select("k", "lam", "pscore", "pkey"), ["k", "lam"])


def q_lookup(scored: DataFrame, table: DataFrame) -> DataFrame:
    """Attach q by exact equality of the rounded p-score."""
    return lookup(scored, table.select("pkey", "qscore"), ["pkey"])
