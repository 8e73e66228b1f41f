"""Interval joins on closed intervals, by bins, and overlap tests by counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.operators.joins import lookup
from crestline.operators.running import Run, label_runs, running, tile_of

BIN_BITS = 14


def bins_of(start: Column, stop: Column, bits: int = BIN_BITS) -> Column:
    return F.sequence(F.shiftright(start, bits), F.shiftright(stop, bits))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = ("chrom",),
    bits: int = BIN_BITS,
) -> DataFrame:
    """All overlapping pairs of ``left`` (l_start, l_stop) and ``right`` (r_start, r_stop).

    Both sides are cut into bins and joined on them; a pair that shares several
    bins is kept in the first one only, so no distinct is needed.  A hot bin of
    the left side is split by adaptive execution.
    """
    keys = list(keys)
    binned = left.withColumn("_bin", F.explode(bins_of(F.col("l_start"), F.col("l_stop"), bits)))
    targets = right.withColumn("_bin", F.explode(bins_of(F.col("r_start"), F.col("r_stop"), bits)))
    pairs = lookup(binned, targets, [*keys, "_bin"])
    first_shared = F.shiftright(F.greatest("l_start", "r_start"), bits)
    hit = (F.col("l_stop") >= F.col("r_start")) & (F.col("l_start") <= F.col("r_stop"))
    return pairs.where(hit & (F.col("_bin") == first_shared)).drop("_bin")


def first_cover(candidates: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Disjoint stretches with the smallest ``pid`` of the candidates that cover them, however densely these lie.

    A candidate is cut into aligned stretches of 2^level bases, two of a level at most, and the smallest id of each
    stretch is kept.  Between two neighbouring ends nothing changes, so the id there is the smallest of the stretches, one
    a level, that the first base lies in.  Rows grow as the candidates times the levels; no pair of candidates is formed.
    """
    keys = list(keys)
    cut = """filter(flatten(transform(sequence(0, 31), k -> transform(
        array(struct(k, (start + shiftleft(1L, k) - 1) div shiftleft(1L, k) AS low, (stop + 1) div shiftleft(1L, k) AS high)),
        x -> array(
            if(x.low < x.high AND x.low % 2 = 1, struct(k AS level, x.low AS at), NULL),
            if(x.low < x.high AND x.high % 2 = 1, struct(k AS level, x.high - 1 AS at), NULL)))[0])), y -> y IS NOT NULL)"""
    single = candidates.groupBy(*keys, "start", "stop").agg(F.min("pid").alias("pid"))
    pieces = single.select(*keys, "pid", F.explode(F.expr(cut)).alias("c")).groupBy(*keys, "c.level", "c.at").agg(F.min("pid").alias("pid"))
    ends = single.select(*keys, F.explode(F.array("start", F.col("stop") + 1)).alias("pos")).distinct()
    asked = ends.select(*keys, "pos", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("level"))
    asked = asked.withColumn("at", F.expr("shiftright(pos, level)"))
    found = lookup(asked, pieces, [*keys, "level", "at"], "left").groupBy(*keys, "pos").agg(F.min("pid").alias("pid"))
    # one row an end, the stretch up to the next end; the last end of a key covers nothing
    tiled = found.withColumn("_tile", tile_of("pos"))
    steps = running(tiled, keys, ["_tile"], ["pos"], [Run("_next", "min", "pos")], descending=True)
    steps = steps.where("pid IS NOT NULL").select(*keys, F.col("pos").alias("start"), (F.col("_next") - 1).alias("stop"), "pid")
    apart = lambda before, now: (now["pid"] != before["pid"]) | (now["start"] != before["stop"] + 1)
    named = label_runs(steps, keys, ["start", "stop", "pid"], apart)
    merged = named.groupBy(*keys, "run").agg(F.max("stop").alias("stop"), F.min("pid").alias("pid"))
    return merged.select(*keys, F.col("run").alias("start"), "stop", "pid")


def assign_first(tags: DataFrame, candidates: DataFrame, keys: Sequence[str], disjoint: bool = False) -> DataFrame:
    """Smallest candidate id that each distinct tag block overlaps.

    ``tags`` holds distinct ``keys`` with l_start/l_stop; tags that overlap no
    candidate are left out.  Candidates that may overlap, as any but ``disjoint``
    ones, are first reduced to the smallest id at every base.
    """
    covers = candidates if disjoint else first_cover(candidates)
    pairs = overlap_join(tags, covers.selectExpr("chrom", "start AS r_start", "stop AS r_stop", "pid"))
    return pairs.groupBy(*keys).agg(F.min("pid").alias("pid"))


def moved_blocks(blocks: Column, strand: Column, by: int) -> Column:
    """Blocks moved ``by`` bases in the direction of the strand, not before 0."""
    step = F.when(strand == 0, F.lit(by)).otherwise(F.lit(-by))
    edge = lambda x: F.greatest(x + step, F.lit(0))
    return F.transform(blocks, lambda b: F.struct(edge(b["start"]).alias("start"), edge(b["stop"]).alias("stop")))


def assign_first_block(tags: DataFrame, candidates: DataFrame, keys: Sequence[str], disjoint: bool = False) -> DataFrame:
    """Smallest candidate id that any of a tag's ``blocks`` overlaps; what lies in the gaps between them is no hit.

    ``tags`` holds distinct ``keys``, among them chrom, with an array of closed intervals.
    """
    block = F.explode("blocks").alias("b")
    single = tags.select(*keys, block).select(*keys, F.col("b.start").alias("l_start"), F.col("b.stop").alias("l_stop"))
    return assign_first(single, candidates, keys, disjoint)


def count_overlaps(queries: DataFrame, targets: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Add ``n_overlap``: how many target intervals each query interval overlaps.

    The count is (targets that start at or before the query's stop) less
    (targets that stop before its start).  Both are running sums over positions,
    so no pair is ever formed, however dense the targets are.
    """
    keys = list(keys)
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    starts = targets.select(*keys, F.col("start").alias("pos"), one.alias("s"), zero.alias("e"))
    # a target that stops at x is behind every query start > x
    stops = targets.select(*keys, (F.col("stop") + 1).alias("pos"), zero.alias("s"), one.alias("e"))
    asked = queries.select(*keys, F.explode(F.array("start", "stop")).alias("pos"))
    asked = asked.select(*keys, "pos", zero.alias("s"), zero.alias("e"))
    at = starts.unionByName(stops).unionByName(asked).groupBy(*keys, "pos").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    at = at.withColumn("_tile", tile_of("pos"))
    seen = running(at, keys, ["_tile"], ["pos"], [Run("started", "sum", "s", True), Run("ended", "sum", "e", True)])
    by_stop = seen.select(*keys, F.col("pos").alias("stop"), "started")
    by_start = seen.select(*keys, F.col("pos").alias("start"), "ended")
    joined = queries.join(by_stop, [*keys, "stop"]).join(by_start, [*keys, "start"])
    return joined.select(*queries.columns, (F.col("started") - F.col("ended")).alias("n_overlap"))


def overlapping(queries: DataFrame, targets: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Queries that overlap at least one target (semi join)."""
    return count_overlaps(queries, targets, keys).where("n_overlap > 0").drop("n_overlap")


def not_overlapping(queries: DataFrame, targets: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Queries that overlap no target (anti join, the region complement)."""
    return count_overlaps(queries, targets, keys).where("n_overlap = 0").drop("n_overlap")


def containing(outer: DataFrame, inner: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Outer intervals that hold at least one whole inner interval.

    Meant for peaks, whose intervals do not overlap within a side: each inner
    one is looked up at the last outer one that starts at or before it.
    """
    keys = list(keys)
    null = F.lit(None).cast("long")
    a = outer.select(*keys, F.col("start").alias("pos"), F.lit(0).alias("rank"), F.col("start").alias("o"), null.alias("stop"))
    b = inner.select(*keys, F.col("start").alias("pos"), F.lit(1).alias("rank"), null.alias("o"), F.col("stop"))
    both = a.unionByName(b).withColumn("_tile", tile_of("pos"))
    placed = running(both, keys, ["_tile"], ["pos", "rank"], [Run("start", "max", "o", True)]).where("rank = 1")
    reach = placed.groupBy(*keys, "start").agg(F.min("stop").alias("_inner_stop"))
    found = outer.join(reach, [*keys, "start"]).where("_inner_stop <= stop")
    return found.select(*outer.columns)
