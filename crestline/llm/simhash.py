"""Near-duplicates by 64-bit SimHash, linked exactly through a vantage-point tree over the fingerprints.

Defined cases: a null or empty text has fingerprint 0 and links like any other; repeated rows each get a row; a null
id takes part with its text but never names a component; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import components, lookup, read, whole_text
from crestline.session import stage

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints that one leaf of the shared tree should hold; larger leaves are cut into blocks of this size.
LEAF = 8192
#: Bound of the sample from which the shared tree is built; every fingerprint is then put through the tree.
SAMPLE = 1 << 16
#: Below this size a node of the tree inside a shard is compared directly.
SMALL = 256

_LANES = (np.arange(8) * 256).astype(np.intp)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of one text over its three-word shingles, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        digests = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size + 1) - 1
        start = (stop - size)[: len(words) - SHINGLE + 1].tolist()
        digest = xxhash.xxh64_intdigest
        digests = [digest(line[a:b], SEED) for a, b in zip(start, stop[SHINGLE - 1 :].tolist())]
    lanes = np.array(digests, np.uint64).view(np.uint8).reshape(-1, 8)
    seen = np.bincount((lanes + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * seen.ravel() > len(digests)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        marks = np.fromiter(map(fingerprint, batch["text"]), np.int64, len(batch))
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": marks})


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _cut(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """Vantage point and radius: of several points and middle radii, the ones with least mass at the border."""
    best = None
    for vantage in points[:: max(1, len(points) // 8)][:8]:
        mass = np.bincount(distance(points, vantage), minlength=65)
        inside = np.cumsum(mass)
        for radius in range(64):
            if min(inside[radius], len(points) - inside[radius]) * 4 < len(points):
                continue
            border = inside[min(64, radius + RADIUS)] - (inside[radius - RADIUS] if radius >= RADIUS else 0)
            if best is None or border < best[0]:
                best = (border, vantage, radius)
    return best and (best[1], best[2])


@dataclass
class Tree:
    """Shared vantage-point tree: inner nodes have (vantage, radius, inside, outside), leaves are negative numbers."""

    nodes: list[tuple[np.uint64, int, int, int]] = field(default_factory=list)
    leaves: int = 0

    @classmethod
    def build(cls, points: np.ndarray, capacity: int) -> Tree:
        tree = cls()
        tree._grow(points, max(16, capacity))
        return tree

    def _grow(self, points: np.ndarray, capacity: int) -> int:
        cut = _cut(points) if len(points) > capacity else None
        if cut is None:
            self.leaves += 1
            return -self.leaves
        here = len(self.nodes)
        self.nodes.append((cut[0], cut[1], 0, 0))
        near = distance(points, cut[0]) <= cut[1]
        inside = self._grow(points[near], capacity)
        self.nodes[here] = (*cut, inside, self._grow(points[~near], capacity))
        return here

    def visits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, leaf, home): the home leaf of each point and the later leaves that its ball reaches.

        Of two linked points the one with the earlier home visits the other's, so each link is found once.
        """
        out: list[tuple[np.ndarray, int, np.ndarray]] = []

        def walk(node: int, which: np.ndarray, home: np.ndarray) -> None:
            if not len(which):
                return
            if node < 0:
                out.append((which, -node, home))
                return
            vantage, radius, inside, outside = self.nodes[node]
            away = distance(points[which], vantage).astype(np.int64)
            near = away <= radius
            # leaves inside come first: a home point never looks back there; a visitor follows both triangle bounds
            first = np.where(home, near, away - RADIUS <= radius)
            then = np.where(home & ~near, True, away + RADIUS > radius)
            walk(inside, which[first], home[first])
            walk(outside, which[then], (home & ~near)[then])

        walk(0 if self.nodes else -1, np.arange(len(points)), np.ones(len(points), bool))
        return (
            np.concatenate([w for w, _, _ in out]) if out else np.zeros(0, np.int64),
            np.concatenate([np.full(len(w), leaf, np.int64) for w, leaf, _ in out]) if out else np.zeros(0, np.int64),
            np.concatenate([h for _, _, h in out]) if out else np.zeros(0, bool),
        )


def local_links(points: np.ndarray, home: np.ndarray) -> np.ndarray:
    """For every point the index of the smallest point it is joined to, by links of a home point to any point."""
    label = np.arange(len(points))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        a, b = label[a], label[b]
        differ = a != b
        if not differ.any():
            return
        for low, high in np.unique(np.sort(np.stack([a[differ], b[differ]], 1), 1), axis=0).tolist():
            while label[low] != low:
                low = label[low]
            while label[high] != high:
                high = label[high]
            if low != high:
                label[max(low, high)] = min(low, high)
        while not np.array_equal(label, up := label[label]):
            label = up

    def search(members: np.ndarray, queries: np.ndarray) -> None:
        if not len(members) or not len(queries):
            return
        cut = _cut(points[members]) if len(members) > SMALL else None
        if cut is None:
            for i in range(0, len(queries), SMALL):
                for j in range(0, len(members), SMALL):
                    q, m = queries[i : i + SMALL], members[j : j + SMALL]
                    a, b = np.nonzero(distance(points[q][:, None], points[m][None, :]) <= RADIUS)
                    join(q[a], m[b])
            return
        vantage, radius = cut
        dm, dq = distance(points[members], vantage).astype(int), distance(points[queries], vantage).astype(int)
        search(members[dm <= radius], queries[dq - RADIUS <= radius])
        search(members[dm > radius], queries[dq + RADIUS > radius])

    search(np.nonzero(home)[0], np.arange(len(points)))
    return label


def links(distinct: DataFrame, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``distinct`` (column fp) within ``RADIUS`` bits.

    Not every pair is listed: inside one task the links of a group are reduced to one row per fingerprint.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    rate = min(1.0, sample / max(1, total))
    taken = distinct.where(F.pmod(F.xxhash64("fp", F.lit("vp")), F.lit(1_000_000)) < int(rate * 1_000_000)).select("fp")
    points = np.sort(taken.toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)
    points = np.random.default_rng(SEED).permutation(points)
    tree = Tree.build(points, int(leaf * len(points) / max(1, total)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, leaves, home = tree.visits(batch["fp"].to_numpy(np.int64).view(np.uint64))
            yield pd.DataFrame({"leaf": leaves, "home": home.astype(np.int64), "away": 1 - home.astype(np.int64)}).groupby("leaf", as_index=False).sum()

    sizes = distinct.select("fp").mapInPandas(count, "leaf long, home long, away long").groupBy("leaf").agg(F.sum("home"), F.sum("away")).collect()
    blocks, parts = np.ones(tree.leaves + 1, np.int64), np.ones(tree.leaves + 1, np.int64)
    for number, home, away in sizes:
        blocks[number] = -(-home // (2 * leaf)) or 1
        parts[number] = -(-(away + home * (blocks[number] > 1)) // (4 * leaf)) or 1

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            which, leaves, home = tree.visits(fp.view(np.uint64))
            own, n, m = fp[which], blocks[leaves], parts[leaves]
            mixed = own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            block, part = (mixed % n.astype(np.uint64)).astype(np.int64), (mixed // np.uint64(7) % m.astype(np.uint64)).astype(np.int64)
            # a member lies in all parts of its block; as a query it visits the later blocks of an oversized leaf
            out = []
            for k in range(int(m[home].max(initial=0))):
                out.append((leaves, block, np.full(len(own), k), own, home & (k < m), True))
            for k in range(int(n.max(initial=0))):
                out.append((leaves, np.full(len(own), k), part, own, (k < n) & (~home | (block < k)), False))
            yield pd.concat(
                [pd.DataFrame({"leaf": a[keep], "block": b[keep], "part": c[keep], "fp": d[keep], "home": flag}) for a, b, c, d, keep, flag in out],
                ignore_index=True,
            ) if out else pd.DataFrame({"leaf": [], "block": [], "part": [], "fp": [], "home": []}).astype({"home": bool})

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("fp", ignore_index=True)
        fp = group["fp"].to_numpy(np.int64)
        label = local_links(fp.view(np.uint64), group["home"].to_numpy(bool))
        moved = label != np.arange(len(fp))
        return pd.DataFrame({"a": fp[label[moved]], "b": fp[moved]})

    dealt = distinct.select("fp").mapInPandas(deal, "leaf long, block long, part long, fp long, home boolean")
    return dealt.groupBy("leaf", "block", "part").applyInPandas(pairs, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the smallest id that links reach."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    marks = stage(source.mapInPandas(_fingerprints, "doc_id long, fp long"), "fingerprints")
    distinct = stage(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = stage(components(links(distinct)), "roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(linked, "root").select(F.col("node").alias("fp"), "component_id")
    names = stage(
        distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"), "names"
    )
    return lookup(marks, names, "fp")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _keyed_fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        marks = np.fromiter(map(fingerprint, batch["text"]), np.int64, len(batch))
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "row_key": batch["row_key"], "fp": marks})


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, of equal ids the smallest digest of the text.

    Rows without an id take part and come after all ids.  A row is known by its id and text, so an id that comes with
    several texts loses none that nothing else duplicates.  Kept rows are dealt by that key once; repeated rows are
    reduced to one in the same pass.
    """
    key = next(name for name in ("row_key", *(f"row_key_{k}" for k in range(len(docs.columns) + 1))) if name not in docs.columns)
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), whole_text()))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), digest.alias("row_key"))
    marks = stage(source.mapInPandas(_keyed_fingerprints, "doc_id long, row_key string, fp long"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))
    distinct = stage(marks.groupBy("fp").agg(first.alias("first")), "distinct")
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    best = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    keep = best.select(F.col("first.row_key").alias(key))
    return docs.withColumn(key, digest).join(keep, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
ORACLE: dict[str, str] = {}
