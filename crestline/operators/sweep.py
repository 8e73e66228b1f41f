"""Coverage step functions by a tiled sweep line.

A step function is a table ``(keys..., start, stop, value...)``: the value holds
on ``(start, stop]``.  All libraries and window widths are swept together: their
events are summed per position, so the breakpoints of the union, the depth of
every side and the pairing of treatment with control come out of one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.operators.running import TILE_BITS, Run, label_runs, running, tile_of


def directed_ends(strand: Column, pos: Column, reach: int, shift: int = 0) -> tuple[Column, Column]:
    """Fragment of length ``reach`` laid in the direction of the strand."""
    plus = strand == 0
    return (
        F.when(plus, pos + shift).otherwise(pos - shift - reach),
        F.when(plus, pos + shift + reach).otherwise(pos - shift),
    )


def centred_ends(pos: Column, width: int) -> tuple[Column, Column]:
    half = width // 2
    return pos - half, pos + width - half


def clamp(pos: Column, length: Column | int) -> Column:
    limit = length if isinstance(length, Column) else F.lit(length)
    return F.least(F.greatest(pos, F.lit(0)), limit)


def step_events(
    df: DataFrame,
    keys: Sequence[str],
    spans: Mapping[str, tuple[Column, Column, Column]],
    length: Column | int,
) -> DataFrame:
    """Start and end events; ``spans`` maps a side to (start, end, weight).

    A side's weight may be null for rows that do not belong to it.
    """
    events = [
        F.struct(F.lit(i).alias("side"), clamp(pos, length).cast("long").alias("pos"), delta.cast("long").alias("d"))
        for i, (start, end, weight) in enumerate(spans.values())
        for pos, delta in ((start, weight), (end, -weight))
    ]
    rows = df.select(*keys, F.explode(F.array(*events)).alias("ev")).where("ev.d IS NOT NULL")
    sides = [F.when(F.col("ev.side") == i, F.col("ev.d")).alias(name) for i, name in enumerate(spans)]
    return rows.select(*keys, "ev.pos", *sides)


def sweep(
    events: DataFrame,
    keys: Sequence[str],
    sides: Sequence[str],
    tile_bits: int = TILE_BITS,
    common: bool = True,
) -> DataFrame:
    """Depth of every side on each segment between kept breakpoints.

    A position is kept when the net change of some side is not zero, or when it
    is the first event of a side; position 0 is never kept.  With ``common`` the
    segments stop at the last breakpoint of the side that ends first, and a key
    that lacks a side gives nothing; otherwise they run to the last breakpoint
    of all.  Depths are exact integers, so they do not depend on row order.
    """
    keys = list(keys)
    # Combined per position before any ordering: a pile of copies is one row.
    at = events.groupBy(*keys, "pos").agg(*[F.sum(s).alias(s) for s in sides])
    at = at.withColumn("tile", tile_of("pos", tile_bits))
    changed = {s: F.coalesce(F.col(s), F.lit(0)) != 0 for s in sides}
    totals = at.groupBy(*keys, "tile").agg(
        *[F.coalesce(F.sum(s), F.lit(0)).alias(f"t_{s}") for s in sides],
        *[F.min(F.when(F.col(s).isNotNull(), F.col("pos"))).alias(f"f_{s}") for s in sides],
        *[F.max(F.when(changed[s], F.col("pos"))).alias(f"l_{s}") for s in sides],
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys,
        "tile",
        *[F.coalesce(F.sum(f"t_{s}").over(before), F.lit(0)).alias(f"base_{s}") for s in sides],
        *[F.min(f"f_{s}").over(whole).alias(f"first_{s}") for s in sides],
        *[F.max(f"l_{s}").over(whole).alias(f"end_{s}") for s in sides],
        *[F.col(f"l_{s}").alias(f"l_{s}") for s in sides],
    )
    # first breakpoints also count as kept positions of their tile
    for s in sides:
        first_here = F.when((tile_of(f"first_{s}", tile_bits) == F.col("tile")) & (F.col(f"first_{s}") > 0), F.col(f"first_{s}"))
        totals = totals.withColumn(f"k_{s}", F.greatest(F.when(F.col(f"l_{s}") > 0, F.col(f"l_{s}")), first_here))
    kept_last = F.greatest(*[F.col(f"k_{s}") for s in sides]) if len(sides) > 1 else F.col(f"k_{sides[0]}")
    totals = totals.withColumn("_kept", kept_last)
    side_end = {s: F.greatest(F.col(f"end_{s}"), F.col(f"first_{s}")) for s in sides}
    if common:
        have_all = reduce(lambda a, b: a & b, [F.col(f"first_{s}").isNotNull() for s in sides])
        limit = F.when(have_all, F.least(*side_end.values()) if len(sides) > 1 else side_end[sides[0]])
    else:
        limit = F.greatest(*side_end.values()) if len(sides) > 1 else side_end[sides[0]]
    totals = totals.select(
        *keys,
        "tile",
        *[f"base_{s}" for s in sides],
        *[f"first_{s}" for s in sides],
        F.coalesce(F.max("_kept").over(before), F.lit(0)).alias("prev_kept"),
        limit.alias("limit"),
    )

    # the windows below need the same partitioning, so this join adds no shuffle of its own
    rows = at.join(totals.hint("shuffle_hash"), [*keys, "tile"])
    keep = reduce(
        lambda a, b: a | b,
        [changed[s] | (F.col(s).isNotNull() & (F.col("pos") == F.col(f"first_{s}"))) for s in sides],
    ) & (F.col("pos") > 0)
    earlier = Window.partitionBy(*keys, "tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_keep", keep)
    rows = rows.select(
        *keys,
        "_keep",
        "limit",
        F.coalesce(F.max(F.when(F.col("_keep"), F.col("pos"))).over(earlier), F.col("prev_kept")).alias("start"),
        F.col("pos").alias("stop"),
        *[(F.col(f"base_{s}") + F.coalesce(F.sum(s).over(earlier), F.lit(0))).alias(s) for s in sides],
    )
    return rows.where(F.col("_keep") & (F.col("stop") <= F.col("limit"))).select(*keys, "start", "stop", *sides)


def combine_steps(
    parts: Mapping[str, DataFrame],
    keys: Sequence[str],
    value: str = "value",
    tile_bits: int = TILE_BITS,
) -> DataFrame:
    """Merge step functions of any values on the union of their breakpoints.

    Each part has ``(keys..., stop, value)``.  The result has one value column
    per part and stops at the earliest last breakpoint.  The value of a part at
    a breakpoint is its value at its next own breakpoint, found by a scan in
    descending order.
    """
    keys, names = list(keys), list(parts)
    union = None
    for name, df in parts.items():
        columns = [F.col(value).alias(n) if n == name else F.lit(None).cast("double").alias(n) for n in names]
        piece = df.select(*keys, "stop", *columns)
        union = piece if union is None else union.unionByName(piece)
    at = union.groupBy(*keys, "stop").agg(*[F.max(n).alias(n) for n in names])
    at = at.withColumn("tile", tile_of("stop", tile_bits))
    filled = running(at, keys, ["tile"], ["stop"], [Run(f"v_{n}", "last", n, True) for n in names], descending=True)
    complete = reduce(lambda a, b: a & b, [F.col(f"v_{n}").isNotNull() for n in names])
    # beyond the last breakpoint of a part it has no next value, so it is null there
    filled = filled.where(complete).select(*keys, "stop", "tile", *[F.col(f"v_{n}").alias(n) for n in names])
    return with_start(filled, keys)


def with_start(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``start``, the previous breakpoint of the key (0 for the first)."""
    if "tile" not in steps.columns:
        steps = steps.withColumn("tile", tile_of("stop"))
    out = running(steps, keys, ["tile"], ["stop"], [Run("_prev", "max", "stop")])
    rest = [c for c in steps.columns if c not in (*keys, "stop", "tile")]
    return out.select(*keys, F.coalesce("_prev", F.lit(0)).alias("start"), "stop", *rest)


def max_steps(parts: Mapping[str, DataFrame], keys: Sequence[str], value: str = "value") -> DataFrame:
    """Pointwise maximum of step functions."""
    merged = combine_steps(parts, keys, value)
    return merged.select(*keys, "start", "stop", F.greatest(*[F.col(n) for n in parts]).alias(value))


def coalesce_equal(steps: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-5) -> DataFrame:
    """Join neighbouring segments whose values differ by at most ``tolerance``.

    Each segment is compared with the one before it.
    """
    keys = list(keys)
    named = label_runs(
        steps.select(*keys, "start", "stop", value),
        keys,
        ["start", value],
        lambda before, now: F.abs(now[value] - before[value]) > tolerance,
    )
    merged = named.groupBy(*keys, "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by(value, "stop").alias(value)
    )
    return merged.select(*keys, "start", "stop", value)
