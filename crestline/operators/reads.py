"""Grouping of alignments by read: unique or multi, tracks, totals, mates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.operators.running import position_in_group, tile_of
from crestline.session import stage

LONG_READ = 100_000  # alignments of one read that a single task ranks
HASHES = 1 << 16


def read_counts(reads: DataFrame) -> DataFrame:
    """One row per read: its number of alignments and its first alignment.

    The lone alignment of a unique read comes out of the same partial aggregate
    as the count, so unique tags need no join back to the alignments.
    """
    first = F.min(F.struct("chrom", "strand", "pos")).alias("tag")
    return reads.groupBy("sample", "read_id").agg(F.count(F.lit(1)).alias("n_align"), first)


def library_counts(per_read: DataFrame) -> DataFrame:
    """Unique and multi-mapped reads per sample; a multi read counts once."""
    unique = F.col("n_align") == 1
    return per_read.groupBy("sample").agg(
        F.count(F.when(unique, 1)).alias("n_unique"), F.count(F.when(~unique, 1)).alias("n_multi")
    )


def tag_tracks(reads: DataFrame, per_read: DataFrame) -> DataFrame:
    """Tags per position: ``n_unique``, ``n_multi`` and ``multi_reads``.

    The multi count is the count of all alignments less that of unique reads.
    ``multi_reads`` counts each multi-mapped read at its first alignment only, so
    that its sum is the number of such reads.
    """
    keys = ["sample", "chrom", "strand", "pos"]
    zero, one = F.lit(0), F.lit(1)
    lone = F.when(F.col("n_align") == 1, one).otherwise(zero)
    every = reads.select(*keys, one.alias("a"), zero.alias("u"), zero.alias("m"))
    grouped = per_read.select(
        "sample", "tag.chrom", "tag.strand", "tag.pos", zero.alias("a"), lone.alias("u"), (1 - lone).alias("m")
    )
    both = every.unionByName(grouped).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in "aum"])
    return both.select(
        *keys, F.col("u").alias("n_unique"), (F.col("a") - F.col("u")).alias("n_multi"), F.col("m").alias("multi_reads")
    )


def fragment_tracks(fragments: DataFrame) -> DataFrame:
    """Paired-end counterpart of ``tag_tracks``, per distinct fragment.

    ``fragments`` has sample, read_id, chrom, pos and span.
    """
    keys = ["sample", "chrom", "pos", "span"]
    per_read = fragments.groupBy("sample", "read_id").agg(
        F.count(F.lit(1)).alias("n_align"), F.min(F.struct("chrom", "pos", "span")).alias("tag")
    )
    zero, one = F.lit(0), F.lit(1)
    lone = F.when(F.col("n_align") == 1, one).otherwise(zero)
    every = fragments.select(*keys, one.alias("a"), zero.alias("u"), zero.alias("m"))
    grouped = per_read.select("sample", "tag.chrom", "tag.pos", "tag.span", zero.alias("a"), lone.alias("u"), (1 - lone).alias("m"))
    both = every.unionByName(grouped).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in "aum"])
    return both.select(
        *keys, F.col("u").alias("n_unique"), (F.col("a") - F.col("u")).alias("n_multi"), F.col("m").alias("multi_reads")
    )


def multi_weights(reads: DataFrame) -> DataFrame:
    """Weight 1/n of every alignment of a read with n alignments.

    An equi-join to the counts, not a window: adaptive execution can split the
    alignments of a hot read over tasks, a window would sort them in one.
    """
    counts = reads.groupBy("sample", "read_id").agg(F.count(F.lit(1)).alias("n_align"))
    joined = reads.join(counts, ["sample", "read_id"])
    return joined.withColumn("weight", F.lit(1.0) / F.col("n_align"))


def normal_name(qname: Column) -> Column:
    """Read name without its mate suffix: cut at the first slash, else drop .1/.2."""
    return F.when(F.instr(qname, "/") > 0, F.substring_index(qname, "/", 1)).otherwise(
        F.regexp_replace(qname, r"\.[12]$", "")
    )


def long_groups(rows: DataFrame, keys: Sequence[str], odd: Column | None = None) -> DataFrame | None:
    """Keys with more rows than a single task should take, or with an ``odd`` row; none if there are none.

    Rows are counted by hash first, which sums up before the shuffle; keys are counted only where a hash has that many.
    """
    odd = F.lit(False) if odd is None else odd
    hashed = rows.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(HASHES)).alias("_hash"), odd.alias("_odd"))
    sizes = [F.count(F.lit(1)).alias("_n"), F.max("_odd").alias("_odd")]
    taken = (F.col("_n") > LONG_READ) | F.col("_odd")
    full = stage(hashed.groupBy("_hash").agg(*sizes).where(taken).select("_hash"), "full_hashes")
    if full.isEmpty():
        return None
    long = stage(hashed.join(full, "_hash", "left_semi").groupBy(*keys).agg(*sizes).where(taken).select(*keys), "long_groups")
    return None if long.isEmpty() else long


def zip_mates(
    mates: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], counted: DataFrame | None = None
) -> DataFrame:
    """Pair the k-th alignment of mate 1 with the k-th of mate 2.

    ``mates`` has ``mate`` (1 or 2); leftovers of either mate stay with nulls on
    the other side.  Rows are shuffled once, by read, and ranked and paired where
    they lie.  Reads with very many alignments are ranked by the levelled scan
    over (chrom, tile), so that many tasks do them.  ``counted`` may give the same
    reads in a cheaper form to find these.
    """
    keys, order, carry = list(keys), list(order), list(carry)
    sizes = (mates if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    long = stage(sizes.where(F.col("_n") > LONG_READ).select(*keys), "long_reads")
    if long.isEmpty():
        return _zip_whole(mates, keys, order, carry)
    usual, rest = mates.join(long, keys, "left_anti"), mates.join(long, keys, "left_semi")
    return _zip_whole(usual, keys, order, carry).unionByName(_zip_levelled(rest, keys, order, carry))


def _zip_whole(mates: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    ranks = F.row_number().over(Window.partitionBy(*keys, "mate").orderBy(*order)).cast("long")
    ranked = mates.repartition(*keys).withColumn("rn", ranks)
    # without a name two mates are no pair
    unnamed = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    sides = [F.max(F.when(F.col("mate") == i, F.col(c))).alias(f"{c}_{i}") for i in (1, 2) for c in carry]
    return ranked.where("mate IN (1, 2)").groupBy(*keys, F.when(unnamed, F.col("mate")).alias("_alone"), "rn").agg(*sides).drop("_alone")


def _zip_levelled(mates: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    levelled = mates.withColumn("_chrom", F.col(order[0])).withColumn("_tile", tile_of(order[1]))
    ranked = position_in_group(levelled, [*keys, "mate"], order, ["_chrom", "_tile"], "rn")
    first = ranked.where("mate = 1").select(*keys, "rn", *[F.col(c).alias(f"{c}_1") for c in carry])
    second = ranked.where("mate = 2").select(*keys, "rn", *[F.col(c).alias(f"{c}_2") for c in carry])
    return first.join(second, [*keys, "rn"], "full_outer")


def proper_pairs(pairs: DataFrame) -> DataFrame:
    """Mates on one chromosome and on opposite strands."""
    return pairs.where("chrom_1 = chrom_2 AND strand_1 <> strand_2")
