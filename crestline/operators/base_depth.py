"""Base-level depth: what covers each reference position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.functions.cigar import ALIGNED_OPS, blocks_of
from crestline.operators.reads import long_groups
from crestline.operators.running import position_in_group
from crestline.operators.sweep import sweep

DEPTH_CAP = 8000
_CLASSES = {"n_base": ALIGNED_OPS, "n_del": ["D"], "n_skip": ["N"]}


def block_events(alignments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Start and end events of aligned, deleted and skipped stretches.

    Two events per stretch, however long, in place of a row per base.
    """
    mark = lambda name: lambda b: F.struct(F.lit(name).alias("side"), b["start"].alias("start"), (b["stop"] + 1).alias("stop"))
    # all classes from one pass over the alignments
    stretches = F.concat(*[F.transform(blocks_of(F.col("pos"), F.col("cigar"), ops), mark(name)) for name, ops in _CLASSES.items()])
    blocks = alignments.select(*keys, F.explode(stretches).alias("b"))
    ends = F.explode(
        F.array(
            F.struct(F.col("b.start").alias("pos"), F.lit(1).cast("long").alias("d")),
            F.struct(F.col("b.stop").alias("pos"), F.lit(-1).cast("long").alias("d")),
        )
    )
    rows = blocks.select(*keys, "b.side", ends.alias("e"))
    return rows.select(*keys, "e.pos", *[F.when(F.col("side") == n, F.col("e.d")).alias(n) for n in _CLASSES])


def depth_segments(alignments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Depth per stretch ``[start, stop)`` of equal coverage, zero depth left out."""
    segments = sweep(block_events(alignments, keys), keys, list(_CLASSES), common=False)
    return segments.where("n_base + n_del + n_skip > 0")


def base_depth(alignments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per covered position.  Rows are bounded by the genome."""
    segments = depth_segments(alignments, keys)
    return segments.select(*keys, F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"), *_CLASSES)


def cap_starts(alignments: DataFrame, keys: Sequence[str], order: Sequence[str], cap: int = DEPTH_CAP) -> DataFrame:
    """At most ``cap`` alignments per start position, in the given order.

    Ranked in levels over a hash of the order, so one deep position is not one task.
    """
    sliced = alignments.withColumn("_h", F.xxhash64(*order)).withColumn("_slice", F.shiftright("_h", 56))
    ranked = position_in_group(sliced, list(keys), ["_h"], ["_slice"], "_rn")
    return ranked.where(F.col("_rn") <= cap).drop("_h", "_slice", "_rn")


def mate_overlap(mates: DataFrame) -> DataFrame:
    """Bases covered by both mates of a template, from one scan per template.

    ``mates`` has qname, chrom, mate (1 or 2) and the closed block start, stop.
    No alignment of mate 1 is paired with each one of mate 2.  Templates are shuffled
    once and scanned where they lie; those with very many alignments by the tiled sweep.
    """
    keys = ["qname", "chrom"]
    named = mates.select(*keys, "mate", "start", "stop").dropna(subset=keys)
    long = long_groups(named, keys)
    if long is None:
        return _overlap_whole(named, keys)
    usual, rest = named.join(long, keys, "left_anti"), named.join(long, keys, "left_semi")
    return _overlap_whole(usual, keys).unionByName(_overlap_tiled(rest, keys))


def _mate_events(mates: DataFrame, keys: list[str]) -> DataFrame:
    ends = F.explode(
        F.array(
            F.struct(F.col("start").alias("pos"), F.lit(1).cast("long").alias("d")),
            F.struct((F.col("stop") + 1).alias("pos"), F.lit(-1).cast("long").alias("d")),
        )
    )
    rows = mates.select(*keys, "mate", ends.alias("e"))
    sides = [F.when(F.col("mate") == i, F.col("e.d")).alias(f"m{i}") for i in (1, 2)]
    return rows.select(*keys, "e.pos", *sides)


def _overlap_whole(mates: DataFrame, keys: list[str]) -> DataFrame:
    at = _mate_events(mates.repartition(*keys), keys).groupBy(*keys, "pos").agg(F.sum("m1").alias("m1"), F.sum("m2").alias("m2"))
    order = Window.partitionBy(*keys).orderBy("pos")
    depths = at.select(*keys, F.sum("m1").over(order).alias("m1"), F.sum("m2").over(order).alias("m2"), (F.lead("pos").over(order) - F.col("pos")).alias("_n"))
    return depths.where("m1 > 0 AND m2 > 0").groupBy(*keys).agg(F.sum("_n").alias("overlap_bp"))


def _overlap_tiled(mates: DataFrame, keys: list[str]) -> DataFrame:
    shared = sweep(_mate_events(mates, keys), keys, ["m1", "m2"]).where("m1 > 0 AND m2 > 0")
    return shared.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias("overlap_bp"))
