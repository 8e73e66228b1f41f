"""Regions of neighbouring segments, their summits and their linking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.operators.running import TILE_BITS, Run, label_runs, position_in_group, running, tile_of


def above_cutoffs(df: DataFrame, cutoffs: dict[str, float]) -> DataFrame:
    """Rows where any of the scores is strictly above its cutoff."""
    tests: list[Column] = [F.col(score) > value for score, value in cutoffs.items()]
    return df.where(reduce(lambda a, b: a | b, tests))


def label_islands(
    rows: DataFrame, keys: Sequence[str], max_gap: int, tile_bits: int = TILE_BITS, out: str = "island"
) -> DataFrame:
    """Name each run of rows whose gaps are at most ``max_gap`` by its start."""
    return label_runs(
        rows, keys, ["start", "stop"], lambda before, now: now["start"] - before["stop"] > max_gap, tile_bits, out
    )


def middle_rows(rows: DataFrame, keys: Sequence[str], order: str = "stop") -> DataFrame:
    """The row at position ``(n + 1) div 2`` of each group."""
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    tiled = rows.withColumn("_tile", tile_of(order))
    ranked = position_in_group(tiled, keys, [order], ["_tile"], "_rn")
    middle = ranked.join(sizes, keys).where(F.col("_rn") == F.floor((F.col("_n") + 1) / 2))
    return middle.select(*rows.columns)


def summit_rows(rows: DataFrame, keys: Sequence[str], value: str = "treat") -> DataFrame:
    """The middle one of the rows that reach the group's highest value."""
    keys = list(keys)
    tops = rows.groupBy(*keys).agg(F.max(value).alias("_top"))
    ties = rows.join(tops, keys).where(F.col(value) == F.col("_top")).drop("_top")
    return middle_rows(ties, keys)


def region_bounds(rows: DataFrame, keys: Sequence[str], min_length: int) -> DataFrame:
    """Start and stop of each island that is at least ``min_length`` long."""
    bounds = rows.groupBy(*keys, "island").agg(F.max("stop").alias("region_stop"))
    return bounds.where(F.col("region_stop") - F.col("island") >= min_length)


def number_peaks(peaks: DataFrame, prefix: str, order_tile_bits: int = TILE_BITS) -> DataFrame:
    """Name peaks by chromosome and end; peaks that share an end share a number."""
    ends = peaks.groupBy("chrom", "stop").agg(F.count(F.lit(1)).alias("_c"))
    ends = ends.withColumn("_tile", tile_of("stop", order_tile_bits)).withColumn("_one", F.lit(1))
    # chromosomes and tiles are both levels of one genome-wide order
    numbered = running(ends, [], ["chrom", "_tile"], ["stop"], [Run("_no", "sum", "_one", True)])
    numbered = numbered.select("chrom", "stop", F.concat(F.lit(prefix), F.col("_no").cast("string")).alias("name"))
    return peaks.join(numbered, ["chrom", "stop"])
