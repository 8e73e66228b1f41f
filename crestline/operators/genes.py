"""Gene models from exons: merged exons, introns, flanks, percentiles, annotation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from crestline.operators.overlap import bins_of
from crestline.operators.reads import long_groups
from crestline.operators.running import Run, running, tile_of
from crestline.operators.sweep import coalesce_equal, sweep
from crestline.session import stage

# Feature types in order of preference.
FEATURE_TYPES = {"CDS": 1, "UTR5": 2, "UTR3": 3, "INTRON": 4, "ITGUP1K": 5, "ITGDN1K": 6}
LAST_EXONIC = FEATURE_TYPES["UTR3"]
FLANK = 1000
_KEYS = ["gene", "chrom", "strand"]
ANNOTATION_BITS = 14  # a tile has 16,384 starts of blocks
TARGETS_PER_PLACE = 50_000  # features of a tile that are held at once
TARGETS_PER_TASK = 200_000
CELLS = 1 << 18  # pairs of gene and block that are worked out at once


def _coverage(exons: DataFrame) -> DataFrame:
    """Half-open stretches ``(start, stop]`` of exon depth per gene."""
    ends = F.explode(
        F.array(
            F.struct(F.col("start").alias("pos"), F.lit(1).cast("long").alias("depth")),
            F.struct((F.col("stop") + 1).alias("pos"), F.lit(-1).cast("long").alias("depth")),
        )
    )
    events = exons.select(*_KEYS, ends.alias("e")).select(*_KEYS, "e.pos", "e.depth")
    covered = sweep(events, _KEYS, ["depth"])
    return covered.withColumn("inside", (F.col("depth") > 0).cast("double"))


def merge_exons(exons: DataFrame) -> DataFrame:
    """Exons of a gene with overlaps joined, as closed intervals.

    Exons are shuffled once, by gene, and joined where they lie; genes with very many by the tiled sweep.
    """
    rows = exons.select(*_KEYS, "start", "stop").dropna(subset=_KEYS).where("start <= stop")
    long = long_groups(rows, _KEYS)
    if long is None:
        return _merged_whole(rows)
    return _merged_whole(rows.join(long, _KEYS, "left_anti")).unionByName(_merged_tiled(rows.join(long, _KEYS, "left_semi")))


def _merged_whole(exons: DataFrame) -> DataFrame:
    order = Window.partitionBy(*_KEYS).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = exons.repartition(*_KEYS).withColumn("_reach", reach)
    opened = seen.withColumn("_open", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + 1), F.col("start")))
    named = opened.withColumn("_first", F.max("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(*_KEYS, "_first").agg(F.max("stop").alias("stop")).select(*_KEYS, F.col("_first").alias("start"), "stop")


def _merged_tiled(exons: DataFrame) -> DataFrame:
    merged = coalesce_equal(_coverage(exons).select(*_KEYS, "start", "stop", "inside"), _KEYS, "inside")
    return merged.where("inside > 0").select(*_KEYS, "start", (F.col("stop") - 1).alias("stop"))


def subtract(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stretches of ``left`` that no interval of ``right`` covers, per key, as closed intervals.

    Both are layers of one sweep; a stretch counts where the first layer is there and the second is not.
    """
    keys = list(keys)

    def ends(rows: DataFrame, layer: str) -> DataFrame:
        parts = [F.struct(F.col("start").alias("pos"), F.lit(1).cast("long").alias("d")), F.struct((F.col("stop") + 1).alias("pos"), F.lit(-1).cast("long").alias("d"))]
        e = rows.select(*keys, F.explode(F.array(*parts)).alias("e"))
        return e.select(*keys, "e.pos", *[(F.col("e.d") if c == layer else F.lit(None).cast("long")).alias(c) for c in ("a", "b")])

    layers = sweep(ends(left, "a").unionByName(ends(right, "b")), keys, ["a", "b"], common=False)
    inside = layers.withColumn("inside", ((F.col("a") > 0) & (F.col("b") == 0)).cast("double"))
    joined = coalesce_equal(inside.select(*keys, "start", "stop", "inside"), keys, "inside")
    return joined.where("inside > 0").select(*keys, "start", (F.col("stop") - 1).alias("stop"))


def untranslated(exons: DataFrame, cds: DataFrame, stop_codons: DataFrame) -> DataFrame:
    """UTR5 and UTR3 of each gene: its exons outside the coding span, named by side and strand.

    The span goes from the first coding base to the end of the stop codon in the gene's direction.  A gene without a
    stop codon is not translated: its exons are UTR5 on the plus strand and UTR3 on the minus strand.
    """
    coding = cds.groupBy(*_KEYS).agg(F.min("start").alias("c_start"), F.max("stop").alias("c_stop"))
    ends = stop_codons.groupBy(*_KEYS).agg(F.min("start").alias("s_start"), F.max("stop").alias("s_stop"))
    plus = F.col("strand") == 0
    start = F.when(plus, F.coalesce("c_start", "s_start")).otherwise(F.col("s_start"))
    stop = F.when(plus, F.col("s_stop")).otherwise(F.coalesce("c_stop", "s_stop"))
    spans = ends.join(coding, _KEYS, "left").select(*_KEYS, start.alias("start"), stop.alias("stop"))
    spans = spans.select("*", F.least("start", F.col("stop") + 1).alias("_low"), F.greatest(F.col("start") - 1, "stop").alias("_high"))
    joined = merge_exons(exons).join(spans.withColumnsRenamed({"start": "from", "stop": "to"}), _KEYS, "left")
    none = F.col("_low").isNull() | (F.col("_low") > F.col("_high"))  # no span, or one without a base
    left = F.struct("start", F.when(none, F.col("stop")).otherwise(F.least("stop", F.col("_low") - 1)).alias("stop"))
    right = F.struct(F.when(~none, F.greatest("start", F.col("_high") + 1)).alias("start"), "stop")
    outside = joined.select(*_KEYS, "from", F.explode(F.array(left, right)).alias("o")).select(*_KEYS, "from", "o.*").where("start <= stop")
    before = F.coalesce(F.col("start") < F.col("from"), F.lit(True))
    return outside.select(*_KEYS, F.when(before == plus, "UTR5").otherwise("UTR3").alias("type"), "start", "stop")


def introns(exons: DataFrame) -> DataFrame:
    """Gaps between a gene's exons, as closed intervals.

    Exons are shuffled once, by gene, and scanned where they lie.  Genes with very many go by the tiled sweep, and so do
    those with an exon that is not an interval of positions from 1 on.
    """
    rows = exons.select(*_KEYS, "start", "stop").dropna(subset=_KEYS)
    usual = F.coalesce(F.expr("start >= 1 AND start <= stop"), F.expr("start IS NULL AND stop IS NULL"))
    swept = long_groups(rows, _KEYS, ~usual)
    if swept is None:
        return _gaps_whole(rows)
    return _gaps_whole(rows.join(swept, _KEYS, "left_anti")).unionByName(_gaps_tiled(rows.join(swept, _KEYS, "left_semi")))


def _gaps_whole(exons: DataFrame) -> DataFrame:
    order = Window.partitionBy(*_KEYS).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = exons.repartition(*_KEYS).withColumn("_reach", reach).where("start > _reach + 1")
    return seen.select(*_KEYS, (F.col("_reach") + 1).alias("start"), (F.col("start") - 1).alias("stop"))


def _gaps_tiled(exons: DataFrame) -> DataFrame:
    bounds = exons.groupBy(*_KEYS).agg(F.min("start").alias("gene_start"))
    gaps = _coverage(exons).where("depth = 0").join(bounds, _KEYS).where("start >= gene_start")
    return gaps.select(*_KEYS, "start", (F.col("stop") - 1).alias("stop"))


def flanks(exons: DataFrame) -> DataFrame:
    """The kilobase before and after a gene, named by its strand."""
    span = exons.groupBy(*_KEYS).agg(F.min("start").alias("a"), F.max("stop").alias("b"))
    left = F.struct(F.greatest(F.col("a") - FLANK, F.lit(0)).alias("start"), F.greatest(F.col("a") - 1, F.lit(0)).alias("stop"))
    right = F.struct((F.col("b") + 1).alias("start"), (F.col("b") + FLANK).alias("stop"))
    plus = F.col("strand") == 0
    up = F.when(plus, left).otherwise(right)
    down = F.when(plus, right).otherwise(left)
    sides = F.explode(F.array(F.struct(F.lit("ITGUP1K").alias("type"), up.alias("i")), F.struct(F.lit("ITGDN1K").alias("type"), down.alias("i"))))
    return span.select(*_KEYS, sides.alias("f")).select(*_KEYS, "f.type", "f.i.start", "f.i.stop")


def percentile_positions(exons: DataFrame) -> DataFrame:
    """Positions of 0..100 percent of a gene's exonic bases, from its start.

    Linear interpolation between neighbouring bases, rounded half up, in exact
    integers.  Each merged exon works out which percents fall into it from the
    running sum of lengths, so bases are never listed.  On the minus strand the
    order is reversed.
    """
    merged = stage(merge_exons(exons), "exons").withColumn("n", F.col("stop") - F.col("start") + 1).withColumn("_tile", tile_of("stop"))
    placed = running(merged, _KEYS, ["_tile"], ["stop"], [Run("before", "sum", "n")])
    placed = running(placed, _KEYS, ["_tile"], ["stop"], [Run("next_start", "last", "start")], descending=True)
    sizes = merged.groupBy(*_KEYS).agg(F.sum("n").alias("bases"), F.min("start").alias("gene_start"))
    rows = placed.join(sizes, _KEYS)
    steps = F.col("bases") - 1
    low = F.when(steps == 0, 0).otherwise(F.ceil(F.col("before") * 100 / steps))
    high = F.when(steps == 0, 100).otherwise(F.least(F.ceil((F.col("before") + F.col("n")) * 100 / steps) - 1, F.lit(100)))
    rows = rows.withColumn("_low", low.cast("int")).withColumn("_high", high.cast("int")).where("_low <= _high")
    rows = rows.withColumn("pct", F.explode(F.sequence("_low", "_high")))
    scaled = steps * F.col("pct")
    index = F.floor(scaled / 100)
    rest = F.pmod(scaled, F.lit(100))
    here = F.col("start") + index - F.col("before")
    after = F.when(here < F.col("stop"), here + 1).otherwise(F.coalesce("next_start", here))
    value = F.floor(((here - F.col("gene_start")) * (100 - rest) + (after - F.col("gene_start")) * rest + 50) / 100)
    order = F.when(F.col("strand") == 0, F.col("pct")).otherwise(100 - F.col("pct"))
    return rows.select(*_KEYS, order.alias("pct"), value.alias("offset"))


def annotate(blocks: DataFrame, features: DataFrame) -> DataFrame:
    """Best genes of each block: most exonic overlap, else the best other type.

    ``blocks`` holds distinct chrom, strand, l_start, l_stop; ``features`` has
    gene, chrom, strand, type, start, stop.

    A block lies in the tile of its start, a feature in every tile whose blocks may reach it, so all hits of a block meet
    in one place.  Genes of a tile with very many features are dealt to parts and each part gets the tile's blocks.  No
    pair of block and feature is formed: a part works out the overlap of a gene from running sums over its exons' ends and
    passes on its best genes only; the best over all parts are found among those.
    """
    numbers = F.create_map(*[x for name, i in FEATURE_TYPES.items() for x in (F.lit(name), F.lit(i))])
    targets = stage(
        features.select("chrom", "strand", "gene", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"), numbers[F.col("type")].alias("kind")),
        "features",
    )
    sites = stage(blocks, "blocks")
    key = ["chrom", "strand", "l_start", "l_stop"]
    n_sites, reach = sites.agg(F.count(F.lit(1)), F.greatest(F.max(F.col("l_stop") - F.col("l_start")), F.lit(0))).first()
    tasks = max(1, (n_sites + targets.count()) // TARGETS_PER_TASK)
    tile = ["chrom", "strand", "_tile"]
    left = sites.dropna(subset=key).withColumn("_tile", F.shiftright("l_start", ANNOTATION_BITS))
    right = targets.dropna(subset=["chrom", "strand", "r_start", "r_stop"])
    right = right.withColumn("_tile", F.explode(bins_of(F.col("r_start") - reach, F.col("r_stop"), ANNOTATION_BITS)))
    sizes = right.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / TARGETS_PER_PLACE).cast("int").alias("_parts"))
    hot = stage(sizes.where("_parts > 1"), "hot_tiles")
    if hot.isEmpty():
        left, right = (side.withColumn("_part", F.lit(0)) for side in (left, right))
    else:
        left = left.join(hot, tile, "left").withColumn("_part", F.explode(F.expr("sequence(0, coalesce(_parts, 1) - 1)"))).drop("_parts")
        right = right.join(hot, tile, "left").withColumn("_part", F.pmod(F.hash("gene"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    place = [*tile, "_part"]
    near = left.repartition(tasks, *place).groupBy(*place).cogroup(right.repartition(tasks, *place).groupBy(*place))
    form = StructType([*sites.select(*key).schema, targets.schema["gene"], StructField("overlap", LongType()), StructField("kind", IntegerType())])
    leading = stage(near.applyInArrow(_best_here(key), form), "leading")
    best = leading.groupBy(*key).agg(F.max("overlap").alias("best"))
    kept = leading.join(best, key).where("best IS NULL OR overlap = best")
    return kept.select(*key, "gene", F.coalesce("overlap", F.lit(0)).alias("overlap"), "kind")


def _best_here(key: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of the blocks and the features of one place that gives the best genes of each block among these.

    The overlap of a gene with a block is the number of its exons' bases up to the block's stop less that of those before
    its start; a base of several exons counts for each.  Blocks and genes are a table of ``CELLS`` cells at most, or of one
    gene.  Features that end before they start are rare and are paired with the blocks they lie in.
    """
    cells, exonic, unknown = CELLS, LAST_EXONIC, 127

    def best_here(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = lambda t, c: t.column(c).to_numpy().astype(np.int64)
        start, stop = numbers(left, "l_start"), numbers(left, "l_stop")
        at = np.lexsort((stop, start))
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(start[at]) != 0) | (np.diff(stop[at]) != 0)
        copies = np.diff(np.append(np.flatnonzero(first), len(at)))
        at = at[first]
        start, stop = start[at], stop[at]
        n = len(at)
        reach = int((stop - start).max(initial=0))

        names = right.column("gene").combine_chunks().dictionary_encode("encode")
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        gene, low, high = names.indices.to_numpy(), numbers(right, "r_start"), numbers(right, "r_stop")
        kind = right.column("kind").fill_null(unknown).to_numpy().astype(np.int64)
        # genes in the order of their first base
        begin = np.full(len(names.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(begin, gene, low)
        rank = np.empty(len(begin), np.int64)
        rank[np.argsort(begin, kind="stable")] = np.arange(len(begin))
        order = np.argsort(rank[gene], kind="stable")
        gene, low, high, kind = gene[order], low[order], high[order], kind[order]

        def spread(counts: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Pieces of (item, one of the ``counts`` numbers from the item's ``begins`` on)."""
            ends = np.cumsum(counts)
            i = 0
            while i < len(counts):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - counts[i] + cells, "right")))
                own = counts[i:j]
                yield np.repeat(np.arange(i, j), own), np.arange(own.sum()) + np.repeat(begins[i:j] - np.cumsum(own) + own, own)
                i = j

        def hits(f: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Pieces of the pairs of features ``f`` and blocks ``b`` (ascending) that meet."""
            begins = np.searchsorted(start[b], low[f] - reach, "left")
            ends = np.searchsorted(start[b], high[f], "right")
            for x, y in spread(np.maximum(ends - begins, 0), begins):
                x, y = f[x], b[y]
                met = stop[y] >= low[x]
                yield x[met], y[met]

        most = np.full(n, -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # gene, block, overlap
        bare = stop < start
        exons = np.flatnonzero((kind <= exonic) & (high >= start[0]) & (low <= stop.max())) if n else np.empty(0, np.int64)
        firsts = np.flatnonzero(np.diff(gene[exons], prepend=-1)) if len(exons) else np.empty(0, np.int64)
        if len(exons):
            from_block = np.searchsorted(start, np.minimum.reduceat(low[exons], firsts) - reach, "left").tolist()
            to_block = np.searchsorted(start, np.maximum.reduceat(high[exons], firsts), "right").tolist()
        edges = [*firsts.tolist(), len(exons)]
        g = 0
        while g < len(firsts):
            b0, b1, h = from_block[g], to_block[g], g + 1
            while h < len(firsts) and (h + 1 - g) * (max(b1, to_block[h]) - min(b0, from_block[h])) <= cells:
                b0, b1, h = min(b0, from_block[h]), max(b1, to_block[h]), h + 1
            own, n_genes = exons[edges[g] : edges[h]], h - g
            row = np.repeat(np.arange(n_genes), np.diff(edges[g : h + 1]))
            g = h
            if b0 >= b1:
                continue
            base = start[b0] - 1
            ys, back = np.unique(np.concatenate([start[b0:b1] - 1, stop[b0:b1]]), return_inverse=True)
            ys = ys - base
            plain = low[own] <= high[own]
            # what lies outside the blocks does not count, and small numbers have exact sums
            a = np.clip(low[own][plain] - base, ys[0] + 1, ys[-1] + 1)
            z = np.clip(high[own][plain] - base, ys[0], ys[-1])
            cell = row[plain] * (len(ys) + 1)
            cell = np.concatenate([cell + np.searchsorted(ys, a), cell + np.searchsorted(ys, z)])

            def summed(opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
                table = np.bincount(cell, np.concatenate([opens, closes]), n_genes * (len(ys) + 1))
                return table.reshape(n_genes, -1)[:, :-1].cumsum(axis=1, dtype=np.float64)

            # bases up to y of an exon a..z: (y - a + 1 from a on) - (y - z from z on)
            upto = summed(np.ones(len(a)), -np.ones(len(z))) * ys + summed(1.0 - a, z)
            shared = upto.take(back[b1 - b0 :], axis=1) - upto.take(back[: b1 - b0], axis=1)
            if bare[b0:b1].any() or not plain.all():
                met = shared > 0
                shared[:, bare[b0:b1]], met[:, bare[b0:b1]] = 0, False
                every = np.arange(b0, b1)
                for f, b in ((own, every[bare[b0:b1]]), (own[~plain], every[~bare[b0:b1]])):
                    for x, y in hits(f, b):
                        i = row[np.searchsorted(own, x)]
                        np.add.at(shared, (i, y - b0), np.minimum(stop[y], high[x]) - np.maximum(start[y], low[x]) + 1)
                        met[i, y - b0] = True
                shared[~met] = -np.inf
                here = shared.max(axis=0)
            else:
                here = shared.max(axis=0)
                here[here <= 0] = -np.inf
            most[b0:b1] = np.maximum(most[b0:b1], here)
            column = np.flatnonzero((here == most[b0:b1]) & (here > -np.inf))
            i, c = np.nonzero(shared[:, column] == here[column])
            found.append((gene[own[np.searchsorted(row, i)]], column[c] + b0, here[column[c]]))

        whose, block, value = (np.concatenate([p[k] for p in found]) if found else np.empty(0, np.int64) for k in range(3))
        top = value == most[block]
        whose, block, value = whose[top], block[top], value[top]
        # the best type of a leading gene is among its exons
        place = np.full((2, len(names.dictionary)), 0)
        place[0, gene[exons[firsts]]], place[1, gene[exons[firsts]]] = firsts, np.diff(edges) if len(firsts) else 0
        best_kind = np.full(len(block), unknown)
        for i, x in spread(place[1, whose], place[0, whose]):
            x = exons[x]
            own_kind = np.where((stop[block[i]] >= low[x]) & (start[block[i]] <= high[x]), kind[x], unknown)
            cuts = np.flatnonzero(np.diff(i, prepend=-1))
            best_kind[i[cuts]] = np.minimum.reduceat(own_kind, cuts)

        # blocks without an exon have all genes that hit them
        ids, kinds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x, y in hits(np.flatnonzero(kind > exonic), np.flatnonzero(most == -np.inf)):
            pair = gene[x] * n + y
            by = np.lexsort((kind[x], pair))
            kept = by[np.diff(pair[by], prepend=-1) != 0]
            ids.append(pair[kept])
            kinds.append(kind[x][kept])
        pair, other_kind = np.concatenate(ids), np.concatenate(kinds)
        by = np.lexsort((other_kind, pair))
        by = by[np.diff(pair[by], prepend=-1) != 0]
        pair, other_kind = pair[by], other_kind[by]

        whose, block = np.concatenate([whose, pair // max(n, 1)]), np.concatenate([block, pair % max(n, 1)])
        best_kind = np.concatenate([best_kind, other_kind])
        n_exonic = len(value)
        value = np.concatenate([(value * copies[block[:n_exonic]]).astype(np.int64), np.zeros(len(pair), np.int64)])
        rows = left.select(key).take(pa.array(at[block]))
        rows = rows.append_column("gene", names.dictionary.take(pa.array(whose)))
        rows = rows.append_column("overlap", pa.array(value, pa.int64(), mask=np.arange(len(value)) >= n_exonic))
        return rows.append_column("kind", pa.array(best_kind, pa.int32(), mask=best_kind == unknown))

    return best_here
