"""Stretches of words that repeat with a fixed period, found by recursive frequency splitting and a lag scan.

A run of period q and at least max(24, 3 q) words holds each of its words three times or more.  So a word that occurs
less than three times within a segment lies in no run there and splits the segment; the pieces are split again, by their
own counts, until nothing changes.  Most texts end without a segment.  Each segment left is scanned by lags: short lags
word by word, longer ones by comparing neighbouring blocks of the lag's length at its multiples (a run of length 3 q
holds two such blocks whole), and what agrees is followed to both ends word by word.

Splitting works on the larger piece in place and recounts only the smaller ones, and the lag scan looks at n / q places
for lag q, so a text of n words takes about n log n steps whatever it repeats.

Defined cases: a null or empty text has no words and no run; a null id leaves the words as they are; repeated rows each
get a row; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import read, whole_text

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Lags below this are scanned word by word: LEAST asks for more of them than TIMES does.
SHORT = LEAST // TIMES
#: Block comparisons of the lag scan that are worked out at once.
AT_ONCE = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True, order=True)
class Run:
    start: int
    period: int
    length: int


def segments(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches ``[lo, hi)`` of at least ``LEAST`` words in which every word occurs ``TIMES`` times or more.

    No run reaches out of them.  ``words`` are numbers of words.
    """
    todo = [(0, words)]
    while todo:
        base, own = todo.pop()
        own = np.unique(own, return_inverse=True)[1]
        count = np.bincount(own)
        lo, hi = 0, len(own)
        rare = np.nonzero(count[own] < TIMES)[0]
        order = first = None
        while hi - lo >= LEAST:
            if not len(rare):
                yield base + lo, base + hi
                break
            edge = np.concatenate([[lo - 1], rare, [hi]])
            size = np.diff(edge) - 1
            big = int(np.argmax(size))
            for k in np.nonzero(size >= LEAST)[0].tolist():
                if k != big:
                    todo.append((base + int(edge[k]) + 1, own[edge[k] + 1 : edge[k + 1]]))
            a, b = int(edge[big]) + 1, int(edge[big + 1])
            if b - a < LEAST:
                break
            if order is None:
                order, first = np.argsort(own, kind="stable"), np.concatenate([[0], np.cumsum(count)])
            lost, times = np.unique(np.concatenate([own[lo:a], own[b:hi]]), return_counts=True)
            count[lost] -= times
            few = lost[(count[lost] < TIMES) & (count[lost] > 0)]
            places = [order[first[w] : first[w + 1]] for w in few.tolist()]
            rare = np.sort(np.concatenate([p[np.searchsorted(p, a) : np.searchsorted(p, b)] for p in places])) if places else few
            lo, hi = a, b


def _stretch(own: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The words around ``at`` that equal the word ``lag`` later: ``[start, stop)``, empty if ``at`` itself does not."""
    last = len(own) - lag
    stop, step = at, 64
    while stop < last:
        end = min(last, stop + step)
        differ = own[stop:end] != own[stop + lag : end + lag]
        if differ.any():
            stop += int(np.argmax(differ))
            break
        stop, step = end, 2 * step
    start, step = at, 64
    while start > 0:
        low = max(0, start - step)
        differ = own[low:start] != own[low + lag : start + lag]
        if differ.any():
            start -= int(np.argmax(differ[::-1]))
            break
        start, step = low, 2 * step
    return start, stop


def lag_scan(own: np.ndarray) -> list[Run]:
    """All runs of one segment.

    Lags rise, and ``reach`` tells how far the runs found so far cover from each place.  Two equal neighbouring blocks
    inside one run of a shorter period belong to that run, so they are passed over.
    """
    n = len(own)
    reach = np.zeros(n + 1, np.int64)
    found: list[Run] = []

    def keep(start: int, stop: int, lag: int) -> None:
        end = stop + lag
        if end - start >= max(LEAST, TIMES * lag) and reach[start] < end:
            found.append(Run(start, lag, end - start))
            np.maximum(reach[start:end], end, out=reach[start:end])

    for lag in range(1, min(SHORT, n // TIMES + 1)):
        edge = np.diff((own[:-lag] == own[lag:]).astype(np.int8), prepend=0, append=0)
        start, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        long = stop - start + lag >= LEAST
        for a, b in zip(start[long].tolist(), stop[long].tolist()):
            keep(a, b, lag)
    if n < TIMES * SHORT:
        return found
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((own.astype(np.uint64) + np.uint64(1)) * _MIX * power[:n], out=total[1:])
    lags = np.arange(SHORT, n // TIMES + 1)
    many = n // lags - 1  # pairs of neighbouring blocks
    cut = np.searchsorted(np.cumsum(many), np.arange(AT_ONCE, int(many.sum()) + AT_ONCE, AT_ONCE))
    low = 0
    for high in [*(cut + 1).tolist(), len(lags)]:
        some, times = lags[low:high], many[low:high]
        low = max(low, high)
        if not len(some):
            continue
        lag = np.repeat(some, times)
        at = (np.arange(len(lag)) - np.repeat(np.cumsum(times) - times, times)) * lag
        middle = total[at + lag]
        agree = np.nonzero((middle - total[at]) * power[lag] == total[at + 2 * lag] - middle)[0]
        past, latest = 0, 0
        for q, i in zip(lag[agree].tolist(), at[agree].tolist()):
            if (q == latest and i < past) or reach[i] >= i + 2 * q:
                continue
            start, stop = _stretch(own, q, i)
            past, latest = max(stop, i + 1), q
            keep(start, stop, q)
    return found


def runs(words: np.ndarray) -> list[Run]:
    """All runs of a text, given as numbers of its words, by start and then period."""
    return sorted(Run(lo + r.start, r.period, r.length) for lo, hi in segments(words) for r in lag_scan(words[lo:hi]))


def strongest(found: list[Run]) -> Run | None:
    """The run with the greatest length / period; of equal ones the first, then the one of the shortest period."""
    best = None
    for run in found:  # by start, then period
        if best is None or run.length * best.period > best.length * run.period:
            best = run
    return best


def without_repeats(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for run in found:
        edge[run.start + run.period] += 1
        edge[run.start + run.length] -= 1
    return [words[k] for k in np.nonzero(np.cumsum(edge)[:-1] == 0)[0].tolist()]


def with_tail_repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the query's documents: every tenth, by the hash of its id, repeats a stretch up to its end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // len(tail) + 1))[: n - a]


_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _row(words: list[bytes], doc_id: int | None) -> tuple:
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    found = runs(ids) if len(words) >= LEAST else []
    best = strongest(found)
    lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in found)
    text = b" ".join(without_repeats(words, found))
    head = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
    return doc_id, len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


def periodic_runs(docs: DataFrame, repeat_tails: bool = False) -> DataFrame:
    """Per document its number of runs, the strongest one, and digests of all runs and of the text without repeats."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = text.split()  # of bytes: ASCII white space only
                rows.append(_row(with_tail_repeated(words, doc_id) if repeat_tails else words, doc_id))
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.string()) for c in columns[6:])],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(scan, _OUT)


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with each run cut to its first period; words of changed texts are joined by one space."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for k, text in enumerate(texts):
                words = (text or b"").split()
                number: dict[bytes, int] = {}
                found = runs(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))) if len(words) >= LEAST else []
                if found:
                    texts[k] = b" ".join(without_repeats(words, found))
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.schema.field(at).type))

    return docs.mapInArrow(rewrite, docs.schema)


def op12_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents"), repeat_tails=True)


QUERIES = {"op12_periodic_run_detection": op12_periodic_run_detection}
ORACLE: dict[str, str] = {}
