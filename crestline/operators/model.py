"""Fragment-length model: strand peaks, paired centres, cross-correlation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.operators.overlap import overlap_join
from crestline.operators.sweep import sweep

TAG_WIDTH = 10  # a tag is widened to ten bases around its cutting end
MODEL_TILE_BITS = 20
SMOOTH = 11


@dataclass(frozen=True)
class ModelBounds:
    peak_size: int
    min_tags: int
    max_tags: int


def model_bounds(total_unique: int, lower: int, upper: int, bandwidth: int, genome_size: float) -> ModelBounds:
    """Tag counts per strand that make a cluster usable for the model."""
    size = 2 * bandwidth
    expected = total_unique * size / genome_size / 2
    return ModelBounds(size, int(np.floor(expected * lower + 0.5)), int(np.floor(expected * upper + 0.5)))


def anchor_tags(tags: DataFrame, keys: list[str], size: int, tile_bits: int = MODEL_TILE_BITS) -> DataFrame:
    """Add ``anchor``: the first tag of the greedy window each tag falls in.

    A window opens at the first tag not in the window before it and takes every
    tag less than ``size`` bases further on.  Each window depends on the last, so
    this is a scan of state over tiles.  First every tile finds where it would
    hand over for each way it can be entered: only its first ``size`` bases, and
    the first tag behind them, can open a window there.  Then the hand-overs, at
    most size + 1 small rows per tile, are followed along each key.  Last every
    tile walks its tags once from its known entry.  A tile holds at most
    2^tile_bits distinct positions.
    """
    tiled = tags.withColumn("tile", F.shiftright("pos", tile_bits))
    names = [*keys, "tile"]
    key_schema = ", ".join(f"{c} {tiled.schema[c].dataType.simpleString()}" for c in names)
    width = 1 << tile_bits

    def windows(pos: np.ndarray, first: int) -> list[int]:
        anchors, i = [], first
        while i < len(pos):
            anchors.append(i)
            i = int(np.searchsorted(pos, pos[i] + size, side="left"))
        return anchors

    def hand_over(pdf: pd.DataFrame) -> pd.DataFrame:
        pos = np.sort(pdf["pos"].to_numpy())
        base = int(pdf["tile"].iloc[0]) * width
        entries = int(np.searchsorted(pos, base + size, side="left"))
        after: dict[int, int] = {}  # index of a window's first tag -> last window's first tag
        rows = []
        for e in range(min(entries + 1, len(pos)) - 1, -1, -1):
            chain, i = [], e
            while i < len(pos) and i not in after:
                chain.append(i)
                i = int(np.searchsorted(pos, pos[i] + size, side="left"))
            last = after[i] if i < len(pos) else chain[-1]
            for c in chain:
                after[c] = last
            rows.append((int(pos[e]), int(pos[last])))
        out = pd.DataFrame(rows, columns=["entry", "last_anchor"])
        for c in names:
            out[c] = pdf[c].iloc[0]
        return out[[*names, "entry", "last_anchor"]]

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, reach, open_anchor = [], -1, -1
        for tile, group in pdf.sort_values(["tile", "entry"]).groupby("tile", sort=True):
            entry = group["entry"].to_numpy()
            at = int(np.searchsorted(entry, reach, side="left"))
            if at < len(entry):
                rows.append((tile, open_anchor, int(entry[at])))
                open_anchor = int(group["last_anchor"].iloc[at])
                reach = open_anchor + size
            else:  # every tag of this tile still belongs to the open window
                rows.append((tile, open_anchor, np.iinfo(np.int64).max))
        out = pd.DataFrame(rows, columns=["tile", "open_anchor", "entry"])
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*names, "open_anchor", "entry"]]

    def assign(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("pos")
        pos = left["pos"].to_numpy()
        entry = int(right["entry"].iloc[0])
        anchor = np.full(len(pos), int(right["open_anchor"].iloc[0]), dtype=np.int64)
        starts = windows(pos, int(np.searchsorted(pos, entry, side="left")))
        for i, s in enumerate(starts):
            anchor[s : starts[i + 1] if i + 1 < len(starts) else len(pos)] = pos[s]
        return left.assign(anchor=anchor)

    table = tiled.groupBy(*names).applyInPandas(hand_over, f"{key_schema}, entry long, last_anchor long")
    known = table.groupBy(*keys).applyInPandas(follow, f"{key_schema}, open_anchor long, entry long")
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiled.schema.fields)
    joined = tiled.groupBy(*names).cogroup(known.groupBy(*names)).applyInPandas(assign, f"{out_schema}, anchor long")
    return joined.drop("tile")


def strand_peaks(tags: DataFrame, bounds: ModelBounds) -> DataFrame:
    """Summit and size of each greedy window whose tag count is in bounds.

    ``tags`` has chrom, strand, pos and copies n.  The summit is the middle one
    of the positions with the highest depth of ten-base tags.
    """
    keys = ["chrom", "strand"]
    anchored = anchor_tags(tags.select(*keys, "pos", "n"), keys, bounds.peak_size)
    group = [*keys, "anchor"]
    sizes = anchored.groupBy(*group).agg(F.sum("n").alias("n_tags"))
    sizes = sizes.where(F.col("n_tags").between(bounds.min_tags, bounds.max_tags))
    kept = anchored.join(sizes.select(*group), group, "left_semi")
    half = TAG_WIDTH // 2
    # shifted by the half width so that no event falls below zero
    ends = F.explode(
        F.array(
            F.struct(F.col("pos").alias("pos"), F.col("n").cast("long").alias("depth")),
            F.struct((F.col("pos") + TAG_WIDTH).alias("pos"), (-F.col("n")).cast("long").alias("depth")),
        )
    )
    depths = sweep(kept.select(*group, ends.alias("e")).select(*group, "e.pos", "e.depth"), group, ["depth"])
    tops = depths.groupBy(*group).agg(F.max("depth").alias("top"))
    high = depths.join(tops, group).where("depth = top")
    # a window spans at most peak_size positions, so its segments are few
    ordered = Window.partitionBy(*group).orderBy("stop")
    length = F.col("stop") - F.col("start")
    ranked = high.withColumn("_before", F.coalesce(F.sum(length).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("_middle", F.floor(F.sum(length).over(Window.partitionBy(*group)) / 2))
    chosen = ranked.where((F.col("_before") <= F.col("_middle")) & (F.col("_middle") < F.col("_before") + length))
    summit = F.col("start") + F.col("_middle") - F.col("_before") - half
    return chosen.select(*group, summit.alias("summit")).join(sizes, group)


def paired_centres(peaks: DataFrame, bounds: ModelBounds) -> DataFrame:
    """Midpoints of a plus peak and a later minus peak of comparable size."""
    plus = peaks.where("strand = 0").select(
        "chrom", F.col("summit").alias("l_start"), (F.col("summit") + bounds.peak_size).alias("l_stop"), F.col("n_tags").alias("plus_n")
    )
    minus = peaks.where("strand = 1").select(
        "chrom", F.col("summit").alias("r_start"), F.col("summit").alias("r_stop"), F.col("n_tags").alias("minus_n")
    )
    pairs = overlap_join(plus, minus)
    ratio = F.col("plus_n") / F.col("minus_n")
    kept = pairs.where((F.col("l_start") < F.col("r_start")) & (ratio > 0.5) & (ratio < 2))
    return kept.select(
        "chrom", F.col("l_start").alias("plus"), F.col("r_start").alias("minus"), F.floor((F.col("l_start") + F.col("r_start")) / 2).alias("centre")
    )


def model_lines(tags: DataFrame, centres: DataFrame, bounds: ModelBounds) -> DataFrame:
    """Depth of ten-base tags by offset around all centres, per strand.

    The result is a fixed 2 * peak_size + 11 offsets long for each strand.
    """
    half = bounds.peak_size + TAG_WIDTH // 2
    last = 2 * bounds.peak_size + TAG_WIDTH
    # centres that coincide are one row with a count
    counted = centres.groupBy("chrom", "centre").agg(F.count(F.lit(1)).alias("c"))
    near = overlap_join(
        tags.select("chrom", "strand", "n", F.col("pos").alias("l_start"), F.col("pos").alias("l_stop")),
        counted.select("chrom", "c", "centre", (F.col("centre") - half).alias("r_start"), (F.col("centre") + half).alias("r_stop")),
    )
    at = F.col("l_start") - F.col("centre") + half
    weight = F.col("n") * F.col("c")
    ends = F.explode(
        F.array(
            F.struct(F.greatest(at - TAG_WIDTH // 2, F.lit(0)).alias("i"), weight.alias("d")),
            F.struct(F.least(at + TAG_WIDTH // 2, F.lit(last)).alias("i"), (-weight).alias("d")),
        )
    )
    events = near.select("strand", ends.alias("e")).groupBy("strand", "e.i").agg(F.sum("e.d").alias("d"))
    grid = tags.sparkSession.range(0, 2 * (last + 1)).select(
        (F.col("id") % 2).cast("int").alias("strand"), F.floor(F.col("id") / 2).alias("i")
    )
    filled = grid.join(events, ["strand", "i"], "left")
    depth = F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy("strand").orderBy("i"))
    return filled.select("strand", "i", depth.alias("depth"))


def cross_correlation(lines: DataFrame, bounds: ModelBounds) -> DataFrame:
    """Correlation of the minus line against the plus line for each lag, smoothed.

    Works on two vectors of fixed length, held as arrays in one row.  A line without any spread, as where no centre was
    found, correlates with nothing: NaN.
    """
    size = 2 * bounds.peak_size + TAG_WIDTH + 1
    vector = lambda s: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("strand") == s, F.struct("i", "depth")))), lambda x: x["depth"].cast("double")
    )
    rows = lines.groupBy().agg(vector(0).alias("p"), vector(1).alias("m"))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / float(size)
    rows = rows.withColumns({"pm": mean(F.col("p")), "mm": mean(F.col("m"))})
    spread = lambda v, mu: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mu) * (x - mu)) / float(size))
    rows = rows.withColumns({"ps": spread(F.col("p"), F.col("pm")), "ms": spread(F.col("m"), F.col("mm"))})
    scale = lambda s: F.when(F.col(s) > 0, F.col(s) * float(size)).otherwise(F.lit(float("nan")))
    rows = rows.withColumns(
        {
            "p": F.transform("p", lambda x: (x - F.col("pm")) / scale("ps")),
            "m": F.transform("m", lambda x: (x - F.col("mm")) / scale("ms")),
        }
    )
    reach = bounds.peak_size
    rows = rows.select("p", "m", F.explode(F.sequence(F.lit(-reach), F.lit(reach - 1))).alias("lag"))
    inside = F.sequence(F.greatest(F.lit(0), -F.col("lag")), F.lit(size - 1) - F.greatest(F.col("lag"), F.lit(0)))
    total = F.aggregate(inside, F.lit(0.0), lambda a, i: a + F.get("m", (i + F.col("lag")).cast("int")) * F.get("p", i))
    # spread the fixed number of lags over tasks before the sums
    scored = rows.repartition(8, "lag").select("lag", total.alias("corr"))
    around = Window.orderBy("lag").rowsBetween(-(SMOOTH // 2), SMOOTH // 2)
    return scored.withColumn("smooth", F.avg("corr").over(around))


def best_lags(correlation: DataFrame) -> DataFrame:
    """Local maxima at positive lags, best first: the fragment length and others."""
    w = Window.orderBy("lag")
    marked = correlation.withColumns({"_l": F.lag("smooth").over(w), "_r": F.lead("smooth").over(w)})
    peaks = marked.where("smooth > _l AND smooth > _r AND lag > 0")
    return peaks.select("lag", "smooth").orderBy(F.desc("smooth"), "lag")
