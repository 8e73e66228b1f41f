"""Redistribution of multi-mapped reads by EM over classes of reads.

Reads that touch the same multiset of regions have the same weights for ever, so
the state is one row per (class, region) and not one per alignment.  A hot
region or a pile of copies therefore adds to a count, not to the row number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.operators.joins import lookup
from crestline.session import discard, stage, staged_as

_SIGNATURE = ["n_in", "h1", "h2", "h3", "h4"]


@dataclass(frozen=True)
class ReadClasses:
    members: DataFrame  # sample, class_id, pid, m alignments per read, n reads
    of_read: DataFrame  # sample, read_id, class_id


def read_classes(alignments: DataFrame) -> ReadClasses:
    """Classes of reads by the multiset of their regions.

    The multiset is named by its size and four sums of 31-bit hash pieces (124
    bits), which combine map-side; no list of a read's alignments is built.  A
    class is numbered by its smallest read id, and that read shows its members.
    """
    mask = F.lit(0x7FFFFFFF)
    a, b = F.xxhash64("pid"), F.xxhash64("pid", F.lit("second"))
    per_read = alignments.groupBy("sample", "read_id").agg(
        F.count(F.lit(1)).alias("n_in"),
        F.sum(a.bitwiseAND(mask)).alias("h1"),
        F.sum(F.shiftrightunsigned(a, 33)).alias("h2"),
        F.sum(b.bitwiseAND(mask)).alias("h3"),
        F.sum(F.shiftrightunsigned(b, 33)).alias("h4"),
    )
    keys = ["sample", *_SIGNATURE]
    groups = per_read.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("read_id").alias("class_id"))
    groups = stage(groups, "classes")
    of_read = lookup(per_read, groups, keys).select("sample", "read_id", "class_id")
    chosen = groups.select("sample", F.col("class_id").alias("read_id"), "n")
    members = (
        alignments.join(chosen, ["sample", "read_id"])
        .groupBy("sample", F.col("read_id").alias("class_id"), "pid", "n")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    return ReadClasses(stage(members, "members"), of_read)


def exact_sum(x: Column) -> Column:
    """Sum in fixed point: the same whatever the order of tasks, and a double again."""
    return F.sum(x.cast("decimal(38,15)")).cast("double")


def _normalised(members: DataFrame, rates: DataFrame) -> DataFrame:
    """Weight of one alignment: its region's rate over the sum of its read's.

    Reads whose regions all have rate zero spread evenly.
    """
    rated = lookup(members, rates, ["pid"])
    sums = rated.groupBy("sample", "class_id").agg(
        exact_sum(F.col("m") * F.col("rate")).alias("_sum"), F.sum("m").alias("_size")
    )
    joined = lookup(rated, sums, ["sample", "class_id"])
    weight = F.when(F.col("_sum") > 0, F.col("rate") / F.col("_sum")).otherwise(F.lit(1.0) / F.col("_size"))
    return joined.select(*members.columns, weight.alias("w"))


def start_weights(members: DataFrame, peaks: DataFrame) -> DataFrame:
    """First weights, from the unique reads alone; ``peaks`` is (pid, len, u)."""
    return _normalised(members, peaks.select("pid", (F.col("u") / F.col("len")).alias("rate")))


def start_by_read(alignments: DataFrame, peaks: DataFrame) -> DataFrame:
    """First weight of each (read, region) with its ``m`` alignments; it needs no classes, only the read's own sums.

    Alignments are shuffled once, by read; a read's rows are its regions by then.
    """
    rates = stage(peaks.select("pid", (F.col("u") / F.col("len")).alias("rate")), "start_rates")
    pairs = alignments.repartition("sample", "read_id").groupBy("sample", "read_id", "pid").agg(F.count(F.lit(1)).alias("m"))
    own = Window.partitionBy("sample", "read_id")
    total = F.sum((F.col("m") * F.col("rate")).cast("decimal(38,15)")).over(own).cast("double")
    rated = lookup(pairs, rates, ["pid"]).select("*", total.alias("_sum"), F.sum("m").over(own).alias("_size"))
    weight = F.when(F.col("_sum") > 0, F.col("rate") / F.col("_sum")).otherwise(F.lit(1.0) / F.col("_size"))
    return rated.select("sample", "read_id", "pid", "m", weight.alias("w"))


def equal_weights(members: DataFrame) -> DataFrame:
    sums = members.groupBy("sample", "class_id").agg(F.sum("m").alias("_size"))
    joined = lookup(members, sums, ["sample", "class_id"])
    return joined.select(*members.columns, (F.lit(1.0) / F.col("_size")).alias("w"))


def equal_by_read(alignments: DataFrame) -> DataFrame:
    """Equal weight of each (read, region) with its ``m`` alignments; it needs no classes, only the read's own size."""
    pairs = alignments.groupBy("sample", "read_id", "pid").agg(F.count(F.lit(1)).alias("m"))
    sizes = alignments.groupBy("sample", "read_id").agg(F.count(F.lit(1)).alias("_size"))
    return lookup(pairs, sizes, ["sample", "read_id"]).select("sample", "read_id", "pid", "m", (F.lit(1.0) / F.col("_size")).alias("w"))


def peak_totals(weights: DataFrame, peaks: DataFrame) -> DataFrame:
    """Reads per region: unique ones plus the weights of multi-mapped ones."""
    added = weights.groupBy("pid").agg(exact_sum(F.col("w") * F.col("m") * F.col("n")).alias("_w"))
    joined = peaks.join(added, "pid", "left")
    return joined.select("pid", "len", "u", (F.col("u") + F.coalesce("_w", F.lit(0.0))).alias("prime"))


def em_step(weights: DataFrame, peaks: DataFrame) -> DataFrame:
    """One round: region totals from weights, then weights from region rates."""
    rates = peak_totals(weights, peaks).select("pid", (F.col("prime") / F.col("len")).alias("rate"))
    return _normalised(weights.drop("w"), rates)


def fixed_rounds(members: DataFrame, peaks: DataFrame, rounds: int) -> DataFrame:
    """Weights after exactly ``rounds`` rounds, each written as a table."""
    peaks = stage(peaks, "em_peaks")
    state = stage(start_weights(members, peaks), "em")
    for _ in range(rounds):
        before, state = state, stage(em_step(state, peaks), "em")
        discard(before)
    return state


def estimate(
    members: DataFrame,
    peaks: DataFrame,
    max_steps: int,
    tolerance: float = 0.01,
    floor: float = 0.01,
) -> DataFrame:
    """Weights after EM: until no weight above ``floor`` moves by more than
    ``tolerance`` of itself, or ``max_steps`` rounds.

    Each round writes its state as a table in the shared folder: the plan stays
    one step long and a lost executor costs one round at most.  The table before
    the last is removed.
    """
    peaks = stage(peaks, "em_peaks")
    state = stage(start_weights(members, peaks), "em")
    for _ in range(max_steps):
        after = em_step(state, peaks).withColumnRenamed("w", "w_new")
        keys = ["sample", "class_id", "pid"]
        both = stage(after.join(state.select(*keys, "w"), keys), "em")
        discard(state)
        moved = both.where(
            (F.col("w_new") > floor) & (F.abs(F.col("w") - F.col("w_new")) / F.col("w_new") > tolerance)
        )
        state = staged_as(both.drop("w").withColumnRenamed("w_new", "w"), both)
        if moved.isEmpty():
            break
    return state


def weighted_positions(alignments: DataFrame, classes: ReadClasses, weights: DataFrame, min_weight: float) -> DataFrame:
    """Alignments per (region, fragment start, weight), light ones left out."""
    tagged = alignments.join(classes.of_read, ["sample", "read_id"])
    counted = tagged.groupBy("sample", "class_id", "pid", "frag_start").agg(F.count(F.lit(1)).alias("n"))
    kept = weights.where(F.col("w") >= min_weight).select("sample", "class_id", "pid", "w")
    joined = lookup(counted, kept, ["sample", "class_id", "pid"])
    return joined.select("sample", "pid", "frag_start", "w", "n")
