"""Running aggregates that never put a whole key in one task.

A window partitioned by chromosome alone has two dozen tasks and one of them may
hold a third of the data.  Here every key is cut into ordered levels (tiles).
Rows are scanned inside the finest level; small per-level totals carry the state
from one level to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE_BITS = 16  # 65,536 positions per tile, at most 32,768 tiles on a 31-bit axis


def tile_of(pos: str | Column, bits: int = TILE_BITS) -> Column:
    return F.shiftright(F.col(pos) if isinstance(pos, str) else pos, bits)


@dataclass(frozen=True)
class Run:
    """One running aggregate: ``fn`` is sum, min, max or last (non-null)."""

    out: str
    fn: str
    value: str
    inclusive: bool = False


def _total(run: Run, value: str, order: Column) -> Column:
    v = F.col(value)
    if run.fn == "last":
        return F.max_by(v, F.when(v.isNotNull(), order))
    return {"sum": F.sum, "min": F.min, "max": F.max}[run.fn](v)


def _over(run: Run, value: str, window) -> Column:
    v = F.col(value)
    if run.fn == "last":
        return F.last(v, ignorenulls=True).over(window)
    return {"sum": F.sum, "min": F.min, "max": F.max}[run.fn](v).over(window)


def _merge(run: Run, earlier: Column, later: Column) -> Column:
    """State after ``earlier`` rows followed by ``later`` rows."""
    if run.fn == "sum":
        return F.coalesce(earlier, F.lit(0)) + F.coalesce(later, F.lit(0))
    if run.fn == "last":
        return F.coalesce(later, earlier)
    return (F.least if run.fn == "min" else F.greatest)(earlier, later)


def _before(inclusive: bool) -> int:
    return Window.currentRow if inclusive else -1


def running(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    order: Sequence[str],
    runs: Sequence[Run],
    descending: bool = False,
) -> DataFrame:
    """Add running aggregates over ``keys`` in ``order``.

    ``levels`` names columns from coarse to fine; each must be monotone in
    ``order``.  ``min``, ``max`` and ``last`` give null before the first value,
    ``sum`` gives 0.
    """
    direction = F.desc if descending else F.asc
    keys, levels = list(keys), list(levels)
    # Rank that grows along the scan, for picking the last value of a level.
    sign = -1 if descending else 1

    fine = [*keys, *levels]
    order_key = F.struct(*[F.col(c) * sign for c in order]) if descending else F.struct(*order)
    totals = df.groupBy(*fine).agg(*[_total(r, r.value, order_key).alias(f"_t_{r.out}") for r in runs])

    carried = None
    for depth in range(len(levels), 0, -1):
        upper, level = [*keys, *levels[: depth - 1]], levels[depth - 1]
        window = Window.partitionBy(*upper).orderBy(direction(level)).rowsBetween(Window.unboundedPreceding, -1)
        step = totals.select(
            *upper, level, *[_over(r, f"_t_{r.out}", window).alias(f"_c{depth}_{r.out}") for r in runs]
        )
        carried = step if carried is None else carried.join(step, [*upper, level])
        if depth > 1:
            rank = F.col(level) * sign
            totals = totals.groupBy(*upper).agg(*[_total(r, f"_t_{r.out}", rank).alias(f"_t_{r.out}") for r in runs])
    if len(levels) > 1:
        merged = []
        for r in runs:
            state = F.col(f"_c1_{r.out}")
            for depth in range(2, len(levels) + 1):
                state = _merge(r, state, F.col(f"_c{depth}_{r.out}"))
            merged.append(state.alias(f"_c_{r.out}"))
        carried = carried.select(*fine, *merged)
    else:
        carried = carried.select(*fine, *[F.col(f"_c1_{r.out}").alias(f"_c_{r.out}") for r in runs])

    scanned = df
    base = Window.partitionBy(*fine).orderBy(*[direction(c) for c in order])
    for r in runs:
        frame = base.rowsBetween(Window.unboundedPreceding, _before(r.inclusive))
        scanned = scanned.withColumn(f"_w_{r.out}", _over(r, r.value, frame))
    # built side by side on the partitioning of the scan; a broadcast could pick the scan itself
    joined = scanned.join(carried.hint("shuffle_hash"), fine, "left")
    return joined.select(
        *df.columns, *[_merge(r, F.col(f"_c_{r.out}"), F.col(f"_w_{r.out}")).alias(r.out) for r in runs]
    )


def position_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], levels: Sequence[str], out: str = "rn"
) -> DataFrame:
    """1-based position of each row inside its key, without one task per key."""
    counted = running(df.withColumn("_one", F.lit(1)), keys, levels, order, [Run(out, "sum", "_one", True)])
    return counted.drop("_one")


def label_runs(
    rows: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    breaks: Callable[[dict[str, Column], dict[str, Column]], Column],
    tile_bits: int = TILE_BITS,
    out: str = "run",
) -> DataFrame:
    """Name each run of neighbouring rows by the ``start`` of its first row.

    Rows are ``start, stop`` segments in order of ``stop`` that do not overlap.
    ``breaks(before, now)`` says from the named columns of two neighbours whether
    a new run opens.  Inside a tile the neighbour is seen by ``lag``; only a
    tile's first row needs another tile, and one summary row per tile carries
    what it needs.
    """
    keys, columns = list(keys), list(columns)
    tiled = rows.withColumn("_tile", tile_of("stop", tile_bits))
    in_tile = Window.partitionBy(*keys, "_tile").orderBy("stop")
    now = {c: F.col(c) for c in columns}
    before = {c: F.lag(c).over(in_tile) for c in columns}
    marked = tiled.withColumn("_open", F.when(breaks(before, now), F.col("start")))

    summary = marked.groupBy(*keys, "_tile").agg(
        F.min("start").alias("_start"),
        F.min_by(F.struct(*columns), "stop").alias("_first"),
        F.max_by(F.struct(*columns), "stop").alias("_last"),
        F.max("_open").alias("_last_open"),
    )
    tiles = Window.partitionBy(*keys).orderBy("_tile")
    summary = summary.withColumn("_prior", F.lag("_last").over(tiles))
    edge = breaks({c: F.col(f"_prior.{c}") for c in columns}, {c: F.col(f"_first.{c}") for c in columns})
    summary = summary.withColumn("_fresh", F.when(F.col("_prior").isNull() | edge, F.col("_start")))
    carried = F.last(F.coalesce("_last_open", "_fresh"), ignorenulls=True).over(
        tiles.rowsBetween(Window.unboundedPreceding, -1)
    )
    heads = summary.select(*keys, "_tile", F.coalesce(F.col("_fresh"), carried).alias("_head"))

    inner = F.last("_open", ignorenulls=True).over(in_tile.rowsBetween(Window.unboundedPreceding, 0))
    named = marked.withColumn("_inner", inner).join(heads.hint("shuffle_hash"), [*keys, "_tile"])
    return named.select(*rows.columns, F.coalesce("_inner", "_head").alias(out))
