"""Tag tracks: 5' ends with their multiplicity, duplicate caps, totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.stats import max_duplicates
from crestline.operators.running import position_in_group


def pile_tags(reads: DataFrame, keys: Sequence[str] = ("sample", "chrom", "strand", "pos")) -> DataFrame:
    """One row per distinct tag with its count ``n``; combined map-side."""
    return reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def cap_duplicates(piled: DataFrame, cap: int | Mapping[str, int] | None) -> DataFrame:
    """Keep at most ``cap`` copies per tag; a mapping gives one cap per sample."""
    if cap is None:
        return piled
    if isinstance(cap, int):
        return piled.withColumn("n", F.least(F.col("n"), F.lit(cap).cast("long")))
    limit: Column = F.lit(None).cast("long")
    for sample, value in cap.items():
        limit = F.when(F.col("sample") == sample, F.lit(value).cast("long")).otherwise(limit)
    return piled.withColumn("n", F.least(F.col("n"), limit))


def redundancy_rate(before: int, after: int) -> float:
    return (before - after) / before if before else 0.0


@dataclass(frozen=True)
class LibraryTotals:
    """Read totals of one sample; a multi-mapped read counts once."""

    unique: int
    multi: int
    unique_kept: int

    @property
    def redundancy(self) -> float:
        return redundancy_rate(self.unique, self.unique_kept)

    @property
    def total(self) -> int:
        """Reads left after the duplicate cap; multi reads shrink alike."""
        return self.unique_kept + int(self.multi * (1.0 - self.redundancy))


def auto_caps(genome_size: float, totals: Mapping[str, int]) -> dict[str, int]:
    """Cap per sample that chance explains; never below one copy."""
    return {sample: max(1, max_duplicates(genome_size, total)) for sample, total in totals.items()}


def number_copies(piled: DataFrame, keys: Sequence[str], chunk: int = 4096) -> DataFrame:
    """One row per copy of a tag, numbered from 1.

    A pile is cut into chunks of numbers that are spread over tasks before they
    are listed, so a very high pile is not unrolled by one task.
    """
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk)))
    cut = piled.where("n > 0").select(*keys, "n", parts.alias("_part"))
    spread = cut.repartition(*keys, "_part")
    first = F.col("_part") * chunk + 1
    return spread.select(*keys, F.explode(F.sequence(first, F.least(first + chunk - 1, F.col("n")))).alias("copy"))


def downsample(reads: DataFrame, fraction: float, seed: int, keys: Sequence[str] = ("sample", "chrom", "strand")) -> DataFrame:
    """Keep ``floor(count * fraction)`` reads per key, chosen by a seeded hash.

    The hash of the whole row gives the order, so the choice does not depend on
    how rows are placed; equal rows are interchangeable.
    """
    rows = reads.withColumn("_h", F.xxhash64(F.lit(seed), *reads.columns))
    # 4,096 ordered slices of the hash range are the levels of the ranking
    rows = rows.withColumn("_slice", F.shiftright("_h", 52))
    ranked = position_in_group(rows, keys, ["_h"], ["_slice"], "_rn")
    sizes = reads.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) * fraction).alias("_take"))
    return ranked.join(sizes, list(keys)).where("_rn <= _take").select(*reads.columns)


def downsample_to(reads: DataFrame, target: int, seed: int, keys: Sequence[str] = ("sample", "chrom", "strand")) -> DataFrame:
    """Down-sample to about ``target`` reads, by the fraction of the total."""
    total = reads.count()
    return reads if target >= total else downsample(reads, target / total, seed, keys)
