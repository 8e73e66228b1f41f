"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit verification.

A random walk (CGK) sends a word sequence to a bit string so that a small edit distance becomes a small Hamming
distance; each of several repeats keeps a few sampled bits as a bucket key.  A window that shares a bucket with an item
of the same size is aligned exactly.  A window is looked at only where it shares a run of words with an item that any
passage within the allowed distance must share (so many edits leave at least one such run whole), which loses nothing.

The walks of long windows part too far for few repeats, so items of over ``PIECE`` words are embedded in pieces: one of
them has at most its own share of the edits.  What shares a bucket with a piece is aligned with the whole item.

Items travel to the tasks in blocks of a fixed number; a larger benchmark takes more passes.  Documents are never
shuffled and a passage that many documents share costs each of them the same.

Defined cases: null or empty texts match nothing; items with a null id count, with a null item_id; repeated documents each get their rows and repeated items
match each; an item shorter than five words must occur whole; an empty table gives no rows.  Extra columns are not
read, except by ``decontaminate``, which keeps them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import keep_rows, read, whole_text
from crestline.llm.wordhash import hashed_words, mix

#: Least similarity: an item of n words may differ by a fifth of n word edits.
SIMILARITY = 0.8
#: Longest run of words that a window must share with its item.
RUN = 4
#: Most words of a window that is embedded; the windows of longer items are embedded in pieces.
PIECE = 40
#: Items that travel to the tasks at once.
BLOCK = 5000
#: Sampled bits in a bucket key, and the share of differing bits up to which the target recall holds.
BITS, FAR = 2, 0.7
RECALL = 0.999
REPEATS = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - FAR) ** BITS))
SEED = 7

FOUND = "doc_id long, item_id long, start long, stop long, distance int, item_words int, places int"


def allowed(n: int) -> int:
    return int(round(n * (1 - SIMILARITY) * 1000)) // 1000


def run_length(n: int) -> int:
    return min(RUN, n // (allowed(n) + 1))


def pieces(n: int) -> list[tuple[int, int]]:
    """(offset, words) of the pieces of an item of ``n`` words, as even as can be."""
    many = -(-n // PIECE)
    cuts = [n * k // many for k in range(many + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def sampled_bits(n: int) -> np.ndarray:
    """Positions of the walk over ``n`` words that each repeat keeps."""
    rng = np.random.default_rng((SEED, n))
    return np.stack([rng.choice(max(BITS, 2 * n), BITS, replace=False) for _ in range(REPEATS)])


def embed(windows: np.ndarray) -> np.ndarray:
    """Bucket keys (window, repeat) of equal-sized windows of word numbers.

    At step j the walk of a repeat writes the current word and moves on where a random bit of (repeat, j, word) is set.
    All windows and repeats step together.
    """
    count, n = windows.shape
    kept = sampled_bits(n)
    padded = np.concatenate([windows, np.full((count, 1), -1, windows.dtype)], 1).astype(np.int64)
    at = np.zeros((count, REPEATS), np.int64)
    keys = np.zeros((count, REPEATS), np.uint64)
    row, rounds = np.arange(count)[:, None], np.arange(REPEATS, dtype=np.uint64) << np.uint64(40)
    for j in range(int(kept.max()) + 1):
        word = padded[row, at].astype(np.uint64)
        hit = (kept == j).any(1)
        if hit.any():
            keys[:, hit] = mix(keys[:, hit] ^ mix(word[:, hit] + np.uint64(j << 34)))
        bit = mix(word + rounds + np.uint64(j << 50)) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), n)
    return keys


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, stop) of the part of ``text`` with the least word edit distance to ``item``.

    Of several the one that ends first, then the longest.
    """
    m = len(text)
    cost, since = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for word in item:
        through = cost[:-1] + (text != word)
        new, start = cost + 1, since.copy()  # the word is missing in the text
        better = (through < new[1:]) | ((through == new[1:]) & (since[:-1] < start[1:]))
        new[1:][better] = through[better]
        start[1:][better] = since[:-1][better]
        # words added in the text: a running minimum of cost minus position, with the earliest place that gives it
        level = new - steps
        low = np.minimum.accumulate(level)
        place = np.maximum.accumulate(np.where(level == low, steps, 0))
        cost, since = low + steps, start[place]
    stop = int(cost.argmin())
    return int(cost[stop]), int(since[stop]), stop


class Items:
    """One block of items with their word numbers, shared runs and buckets."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        hashes, bounds = hashed_words([text for _, text in items])
        self.vocabulary = np.unique(hashes)  # word number k + 1 is at place k; 0 is a word of no item
        self.items: list[tuple[int, np.ndarray]] = []
        by_run: dict[int, dict[int, set[tuple[int, int, tuple[int, int]]]]] = defaultdict(lambda: defaultdict(set))
        by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (item, offset of a piece of this size)
        for (item, _), a, b in zip(items, bounds, bounds[1:]):
            if a == b:
                continue
            ids = self.numbers(hashes[a:b])
            for begin, n in pieces(len(ids)):
                q = run_length(n)
                by_size[n].append((len(self.items), begin))
                for offset, code in enumerate(self.runs(ids, begin + np.arange(n - q + 1), q).tolist()):
                    by_run[q][code].add((n, offset, (len(self.items), begin)))
            self.items.append((item, ids))
        self.places = {q: dict(codes) for q, codes in by_run.items()}
        self.codes = {q: np.sort(np.array(list(codes), np.uint64)) for q, codes in by_run.items()}
        self.buckets: dict[int, dict[tuple[int, int], list[tuple[int, int]]]] = {}
        for n, own in by_size.items():
            table: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for piece, row in zip(own, embed(np.stack([self.items[k][1][begin : begin + n] for k, begin in own])).tolist()):
                for t, key in enumerate(row):
                    table[t, key].append(piece)
            self.buckets[n] = dict(table)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    @staticmethod
    def runs(ids: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
        """A code for the run of q words at each place."""
        code = np.zeros(len(at), np.uint64)
        for k in range(q):
            code = mix(code + ids[at + k].astype(np.uint64))
        return code

    def windows(self, ids: np.ndarray) -> dict[int, dict[int, set[tuple[int, int]]]]:
        """By size, the starts of the windows that share a run with a piece at its own place in it, and these pieces."""
        out: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for q, codes in self.codes.items():
            known = ids > 0
            whole = known[: max(0, len(known) - q + 1)].copy()
            for k in range(1, q):
                whole &= known[k : k + len(whole)]
            at = np.nonzero(whole)[0]
            code = self.runs(ids, at, q)
            hit = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
            for p, c in zip(at[hit].tolist(), code[hit].tolist()):
                for n, offset, piece in self.places[q][c]:
                    out[n][p - offset].add(piece)
        return out

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int, int]]:
        """(text, item_id, start, stop, distance, item words, places) of every item in the texts, positions in words."""
        hashes, bounds = hashed_words(texts)
        numbers = self.numbers(hashes)
        # a word of no item ends every text, so that no run spans two
        ids = np.zeros(len(numbers) + len(texts), np.int64)
        ids[np.arange(len(numbers)) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = numbers
        first = bounds + np.arange(len(bounds))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        tried: set[tuple[int, int, int]] = set()  # several pieces may ask for the same place
        for n, starts in self.windows(ids).items():
            begin = np.array(sorted(starts), np.int64)
            inside = begin[:, None] + np.arange(n)
            window = np.where((inside >= 0) & (inside < len(ids)), ids[np.clip(inside, 0, len(ids) - 1)], 0)
            middle = np.clip(begin + n // 2, 0, len(ids) - 1)
            table = self.buckets[n]
            for at, mid, row in zip(begin.tolist(), middle.tolist(), embed(window).tolist()):
                for item, offset in {i for t, key in enumerate(row) for i in table.get((t, key), ())} & starts[at]:
                    whole = len(self.items[item][1])
                    spare, own = allowed(whole), at - offset
                    # a matching window may begin or end in the text next to it, so each text is aligned on its own
                    for text in {int(np.searchsorted(first, x, side="right")) - 1 for x in (max(0, at), mid, min(at + n, len(ids)) - 1)}:
                        if text >= len(texts) or (text, item, own) in tried:
                            continue
                        tried.add((text, item, own))
                        low, high = max(int(first[text]), own - spare), min(int(first[text + 1]) - 1, own + whole + spare)
                        if high <= low:
                            continue
                        distance, a, b = align(self.items[item][1], ids[low:high])
                        if distance <= spare:
                            low -= int(first[text])
                            place = (distance, low + a, low + b)
                            best[text, item] = min(best.get((text, item), place), place)
                            places[text, item].add(low + b)
        return [(t, self.items[i][0], a, b, d, len(self.items[i][1]), len(places[t, i])) for (t, i), (d, a, b) in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, start, stop (words), distance, item_words, places.

    ``start`` and ``stop`` are of the nearest place; ``places`` counts the distinct ends of matching places.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = None
    for items in _blocks(benchmark, block):

        def search(batches: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            block_items = Items(items.value)
            for batch in batches:
                ids = batch["doc_id"].tolist()
                texts = batch["text"].tolist()
                rows = [(ids[low + k], *m) for low in range(0, len(texts), 256) for k, *m in block_items.search(texts[low : low + 256])]
                columns = ["doc_id", "item_id", "start", "stop", "distance", "item_words", "places"]
                yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64", "item_id": "Int64"})

        own = source.mapInPandas(search, FOUND)
        found = own if found is None else found.unionByName(own)
    return found


def _blocks(benchmark: DataFrame, block: int) -> list[Broadcast]:
    """The items in blocks of about ``block``, each sent to the tasks once."""
    known = benchmark.select("item_id", whole_text().alias("text"))
    many = max(1, -(-known.count() // block))
    context = benchmark.sparkSession.sparkContext
    parts = (known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k) for k in range(many))
    return [context.broadcast([(r["item_id"], r["text"]) for r in part.collect()]) for part in parts]


def decontaminate(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows whose text holds an item; every row is judged where it lies."""
    for items in _blocks(benchmark, block):

        def clean(texts: list[str | None], items=items) -> np.ndarray:
            # the tables of a block are made once per task: the broadcast value keeps them
            held = items.value
            if not isinstance(held[-1] if held else None, Items):
                held.append(Items(list(held)))
            dirty = {k for k, *_ in held[-1].search(texts)}
            return np.array([k not in dirty for k in range(len(texts))], bool)

        docs = keep_rows(docs, clean)
    return docs


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
ORACLE: dict[str, str] = {}
