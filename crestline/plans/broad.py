"""Broad regions: weak regions that hold at least one strong region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.stats import fold_enrichment
from crestline.operators.overlap import containing
from crestline.plans.narrow import Experiment, islands_above, passing_pairs
from crestline.session import stage


def weighted_mean(value: str) -> Column:
    """Mean of a segment value weighted by segment length; 1 for no segments."""
    length = F.col("stop") - F.col("start")
    return F.coalesce(F.sum(F.col(value) * length) / F.sum(length), F.lit(1.0))


def broad_regions(rows: DataFrame, min_length: int) -> DataFrame:
    """One row per island with length-weighted means over its segments."""
    scored = rows.withColumn("fold", fold_enrichment(F.col("treat"), F.col("ctrl")))
    regions = scored.groupBy("chrom", "island").agg(
        F.max("stop").alias("region_stop"),
        weighted_mean("treat").alias("pileup"),
        weighted_mean("pscore").alias("pscore"),
        weighted_mean("fold").alias("fold"),
    )
    kept = regions.where(F.col("region_stop") - F.col("island") >= min_length)
    return kept.select(
        "chrom", F.col("island").alias("start"), F.col("region_stop").alias("stop"), "pileup", "pscore", "fold"
    )


def broad_levels(experiment: Experiment) -> tuple[DataFrame, DataFrame]:
    """Strong regions (run cutoff, gap of a tag) and weak ones (broad cutoff, gap 4d)."""
    o = experiment.options
    levels = []
    for cutoff, gap in ((o.cutoff, o.tag_size), (o.broad_log_cutoff, 4 * o.fragment)):
        pairs = passing_pairs(experiment.scored, o.score_kind, cutoff, experiment.q_table)
        rows = islands_above(experiment.signal, pairs, gap)
        levels.append(stage(broad_regions(rows, o.fragment), "broad"))
    return levels[0], levels[1]


def call_broad(experiment: Experiment) -> DataFrame:
    strong, weak = broad_levels(experiment)
    return containing(weak, strong)
