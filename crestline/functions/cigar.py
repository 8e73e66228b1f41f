"""CIGAR strings as arrays of (op, len) and what they imply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operations that move along the query and along the reference.
QUERY_OPS = ["M", "I", "S", "=", "X"]
REFERENCE_OPS = ["M", "D", "N", "=", "X"]
ALIGNED_OPS = ["M", "=", "X"]
_PATTERN = r"\d+[MIDNSHP=XB]"


def parse_cigar(text: Column) -> Column:
    """``*`` gives an empty array."""
    steps = F.regexp_extract_all(text, F.lit(_PATTERN), F.lit(0))
    return F.transform(steps, lambda s: F.struct(F.substring(s, -1, 1).alias("op"), F.substring(s, F.lit(1), F.length(s) - 1).cast("int").alias("len")))


def cigar_text(cigar: Column) -> Column:
    joined = F.array_join(F.transform(cigar, lambda c: F.concat(c["len"].cast("string"), c["op"])), "")
    return F.when(F.size(cigar) == 0, F.lit("*")).otherwise(joined)


def _length(cigar: Column, ops: list[str]) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda acc, c: acc + F.when(c["op"].isin(ops), c["len"]).otherwise(F.lit(0)))


def query_length(cigar: Column) -> Column:
    return _length(cigar, QUERY_OPS)


def reference_length(cigar: Column) -> Column:
    return _length(cigar, REFERENCE_OPS)


def end_position(flag: Column, pos: Column, cigar: Column) -> Column:
    """First position after the alignment; one base for unmapped records."""
    placed = (flag.bitwiseAND(F.lit(4)) == 0) & (F.size(cigar) > 0)
    return F.when(placed, pos + reference_length(cigar)).otherwise(pos + 1)


def five_prime(flag: Column, pos: Column, cigar: Column) -> Column:
    """Cutting end: leftmost position, or the right end on the reverse strand."""
    return F.when(flag.bitwiseAND(F.lit(16)) == 0, pos).otherwise(pos + reference_length(cigar))


def soft_clip_right_end(pos: Column, cigar: Column) -> Column:
    """Right end by the older rule that walks over clips and ignores = and X."""
    step = F.aggregate(
        cigar,
        F.lit(0),
        lambda acc, c: acc
        + F.when(c["op"] == "M", c["len"] - 1).when(c["op"].isin("D", "N", "S"), c["len"]).otherwise(F.lit(0)),
    )
    return pos + 1 + step


def blocks_of(pos: Column, cigar: Column, ops: list[str]) -> Column:
    """Closed intervals of the given operations, as an array of structs."""
    start = F.struct(pos.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("out"))

    def walk(acc: Column, c: Column) -> Column:
        here, n = acc["at"], c["len"]
        block = F.array(F.struct(here.alias("start"), (here + n - 1).alias("stop")))
        moved = F.when(c["op"].isin(REFERENCE_OPS), here + n).otherwise(here)
        return F.struct(moved.alias("at"), F.when(c["op"].isin(ops), F.concat(acc["out"], block)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cigar, start, walk, lambda acc: acc["out"])


def aligned_blocks(pos: Column, cigar: Column) -> Column:
    return blocks_of(pos, cigar, ALIGNED_OPS)
