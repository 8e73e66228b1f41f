"""Packing of token sequences by patterns of few documents, fitted to the length histogram by non-negative least squares.

Only the histogram of piece lengths (one row per length up to the sequence size) and the plan derived from it meet on
the driver; both are bounded by the sequence size, not by the data.  Pieces get their place from their rank among the
pieces of the same length.

Defined cases: a null or empty text is one piece of length 1 (its closing id); repeated rows are packed each; an empty
table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import read, whole_text
from crestline.session import stage

SIZE = 2048
#: Marks the end of a word for the merges; texts that hold it never get there.
END = "\x01"
VOCABULARY = "word_bpe_49k.json"
#: Words that a Python worker keeps with their ids; the older half goes when it is full.
CACHE = 500_000
#: Rounds of the fit: each adds the patterns with the largest gain, then refits the repeat counts.
ROUNDS = 60

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


class WordTokens:
    """Little-endian ids of whole texts, with the ids of each word remembered.

    Text of plain Latin letters is cut at white space; only unseen words are cut into pre-tokens and merged, many at
    once.  Ids of this vocabulary are merge ranks, so the merging is left to the faster of the two tokenizer libraries,
    with a control character as the end of a word; the last id of a pre-token is always one that ends a word, which
    tells them apart again.  Any other text goes to the vocabulary's own tokenizer whole.
    """

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        import tiktoken

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        # the byte-level alphabet: a printable byte stands for itself, the others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {
            bytes(byte[c] for c in token.removesuffix("</w>")) + END.encode() * token.endswith("</w>"): number
            for token, number in self.tokenizer.get_vocab().items()
            if token not in added
        }
        self.merges = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
        closes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.closes = closes
        plain = [chr(c) for c in range(0x21, 0x2B0) if c not in (0x85, 0xA0, 0x130) and not 0x7F <= c < 0xA1]
        plain = [c for c in plain if set(c.lower()) <= set(plain)]  # some lower cases lie outside
        letters = "".join(c for c in plain if unicodedata.category(c)[0] == "L")
        numbers = "".join(c for c in plain if unicodedata.category(c)[0] == "N")
        self.odd = re.compile(f"[^ \\t\\n\\r{re.escape(''.join(plain))}]|<\\|")
        # fixed values: the contractions are the ones of the vocabulary file's own pre-token rule
        self.parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Add ``words`` (lower case, without white space) to the known ones."""
        cut = {w: self.parts.findall(w) for w in words}
        new = list(set().union(*cut.values()))
        known: dict[str, bytes] = {}
        for low in range(0, len(new), 1000):
            some = new[low : low + 1000]
            ids = np.array(self.merges.encode_ordinary(END.join(some) + END), "<u4")
            ends = np.nonzero(self.closes[ids])[0] + 1
            raw, at = ids.tobytes(), 0
            for word, end in zip(some, (ends * 4).tolist()):
                known[word] = raw[at:end]
                at = end
        for word, parts in cut.items():
            self.known[word] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known = dict(list(self.known.items())[CACHE // 2 :])
        cut = [None if self.odd.search(t) else t.lower().split() for t in texts]
        self._learn(set().union(*(c for c in cut if c is not None)).difference(self.known))
        get = self.known.__getitem__
        return [self._whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut)]


@cache
def tokens(vocabulary: str) -> WordTokens:
    return WordTokens(vocabulary)


def _pieces(size: int, vocabulary: str):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        encode = tokens(vocabulary)
        for batch in batches:
            for low in range(0, len(batch), 512):
                some = batch.iloc[low : low + 512]
                rows = []
                for doc_id, ids in zip(some["doc_id"].tolist(), encode(some["text"].tolist())):
                    ids += b"\0\0\0\0"
                    for number, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        length = len(own) // 4
                        rows.append((doc_id, number, at // 4, length, zlib.crc32(own), part, seen[length]))
                        seen[length] += 1
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])
                yield out.astype({"doc_id": "Int64"})

    return cut


def patterns(size: int) -> np.ndarray:
    """All patterns of two or three lengths that fill ``size`` exactly, longest first; 0 stands for no third."""
    a, b = np.meshgrid(np.arange(1, size), np.arange(0, size), indexing="ij")
    c = size - a - b
    keep = (a >= c) & (c >= b) & (c >= 1)
    return np.stack([a[keep], c[keep], b[keep]], 1)


def fit(histogram: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, repeat counts): non-negative least squares of the pattern counts against the histogram.

    The set of patterns in use grows by those with the steepest descent, at most one per length and round, and the
    counts of the set are refitted by projected, accelerated gradient steps.
    """
    size = len(histogram) - 1
    every = patterns(size)
    target = histogram.astype(float)
    target[0] = 0
    scale = max(1.0, target[:size].max())
    target = target / scale
    target[size] = 0
    # a length left over is worse the longer it is: short ones fill gaps later
    weight = np.sqrt(np.arange(size + 1) / size)
    weight[0] = 0
    square = weight**2
    used = np.zeros(0, np.int64)
    x = np.zeros(0)

    def made(chosen: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.bincount(every[chosen].ravel(), np.repeat(count, 3), minlength=size + 1)

    for _ in range(rounds):
        pull = square * (target - made(used, x))
        pull[0] = 0
        gain = pull[every].sum(1)
        order = np.argsort(-gain)[: 20 * size]
        order = order[gain[order] > 1e-9]
        taken, fresh = np.zeros(size + 1, bool), []
        for i, parts in zip(order.tolist(), every[order].tolist()):
            if not (taken[parts[0]] or taken[parts[1]] or taken[parts[2]]):
                fresh.append(i)
                taken[parts] = True
                taken[0] = False
        fresh = np.setdiff1d(np.array(fresh, np.int64), used)
        if not len(fresh):
            break
        used, x = np.concatenate([used, fresh]), np.concatenate([x, np.zeros(len(fresh))])
        load = np.bincount(every[used].ravel(), minlength=size + 1)
        step = 1 / max(1e-9, (square[every[used]] * load[every[used]]).sum(1).max())
        y, t = x.copy(), 1.0
        for _ in range(300):
            pull = square * (target - made(used, y))
            pull[0] = 0
            new = np.maximum(0, y + step * pull[every[used]].sum(1))
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            y, x, t = new + (t - 1) / t2 * (new - x), new, t2
        live = x > 1e-9
        used, x = used[live], x[live]
    return every[used], x * scale


class Plan:
    """Where the k-th piece of each length goes: runs of ranks, each with its first sequence and its offset."""

    def __init__(self, histogram: np.ndarray) -> None:
        self.size = len(histogram) - 1
        self.next = np.zeros(self.size + 1, np.int64)  # rank of the next unplaced piece of each length
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        left = histogram.astype(np.int64).copy()
        self._repeat([self.size], int(left[self.size]))
        left[self.size] = 0
        found, x = fit(left)
        for i in np.argsort(-x).tolist():
            parts = [p for p in found[i].tolist() if p]
            times = round(float(x[i]))
            for p in set(parts):
                times = min(times, int(left[p]) // parts.count(p))
            if times:
                self._repeat(parts, times)
                for p in parts:
                    left[p] -= times
        self._best_fit(left)
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 4)
        self.key, self.first, self.offset = runs[:, 0] << 44 | runs[:, 1], runs[:, 2], runs[:, 3]

    def _put(self, length: int, times: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.next[length]), sequence, offset))
        self.next[length] += times

    def _repeat(self, parts: list[int], times: int) -> None:
        if times:
            for k, length in enumerate(parts):
                self._put(length, times, self.sequences, sum(parts[:k]))
            self.sequences += times

    def _best_fit(self, left: np.ndarray) -> None:
        """Pack what is left, longest first, into the open sequences with the least sufficient room.

        Sequences with the same room form runs that are handled at once, so the work follows the number of lengths.
        """
        rooms: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
        for length in range(self.size, 0, -1):
            count = int(left[length])
            while count:
                room = min((r for r in rooms if r >= length), default=None)
                if room is None:
                    each = self.size // length  # open sequences and fill them with this length
                    times = -(-count // each) if count < each else count // each
                    fill = min(each, count)
                    for k in range(fill):
                        self._put(length, times, self.sequences, k * length)
                    first, rest = self.sequences, self.size - fill * length
                    self.sequences += times
                    count -= fill * times
                    if rest:
                        rooms.setdefault(rest, []).append((first, times))
                    continue
                first, many = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                each = room // length
                times = min(many, count // each)
                fill = each
                if not times:  # fewer pieces than one of these sequences takes
                    times, fill = 1, count
                for k in range(fill):
                    self._put(length, times, first, self.size - room + k * length)
                count -= fill * times
                if many > times:
                    rooms.setdefault(room, []).append((first + times, many - times))
                if room > fill * length:
                    rooms.setdefault(room - fill * length, []).append((first, times))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        return self.first[run] + rank - (self.key[run] & (1 << 44) - 1), self.offset[run]


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenized once; each task numbers its pieces per length, and the tasks' counts give the first rank of
    every (length, task).  No piece moves but for the join to those counts.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    cut = stage(source.mapInPandas(_pieces(size, vocabulary), PIECES), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # running totals per length over the tasks: a row for each length and task, small against the pieces
    counts = stage(counts, "counts")
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    plan = Plan(histogram)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = (batch.pop("base") + batch.pop("place")).to_numpy(np.int64)
            sequence, offset = plan.place(batch["length"].to_numpy(np.int64), rank)
            yield batch.assign(sequence_id=sequence, offset=offset)

    ranked = cut.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "base", "place")
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
ORACLE: dict[str, str] = {}
