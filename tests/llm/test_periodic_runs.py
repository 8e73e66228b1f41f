"""Runs of repeated words against a direct search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import time
from fractions import Fraction
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from crestline.llm import periodic_runs
from crestline.llm.periodic_runs import Run


def direct(words: list) -> list[Run]:
    """Every maximal stretch of every period, kept if no smaller period fits it."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(Run(a, q, m) for (a, m), q in out.items())


def numbers(words: list) -> np.ndarray:
    index: dict = {}
    return np.array([index.setdefault(w, len(index)) for w in words], np.int64)


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.integers(1, 8)), min_size=1, max_size=8)


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_runs_against_direct_search(parts):
    words = [w for part, times in parts for w in part * times]
    assert periodic_runs.runs(numbers(words)) == direct(words)


def test_runs_inside_prose():
    rng = random.Random(2)
    for trial in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [f"u{rng.randrange(rng.choice((3, 30, 3000)))}" for _ in range(rng.randrange(60))]
            words += [rng.choice("abc") for _ in range(rng.randrange(1, 40))] * rng.randrange(1, 7)
            words += words[-rng.randrange(1, 9) :]
        assert periodic_runs.runs(numbers(words)) == direct(words), trial


def test_segments_hold_all_runs_and_no_rare_word():
    rng = random.Random(8)
    for _ in range(50):
        words = numbers([rng.randrange(rng.choice((2, 9, 60))) for _ in range(400)])
        got = list(periodic_runs.segments(words))
        for lo, hi in got:
            assert hi - lo >= 24 and np.unique(words[lo:hi], return_counts=True)[1].min() >= 3
        for run in direct(words.tolist()):
            assert any(lo <= run.start and run.start + run.length <= hi for lo, hi in got)


def expected(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = direct(words)
    best = max(found, key=lambda r: (Fraction(r.length, r.period), -r.start, -r.period), default=None)
    dropped = {i for r in found for i in range(r.start + r.period, r.start + r.length)}
    lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in found)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    head = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
    return (doc_id, len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_query_rows(spark, docs, rows):
    short = [(i, t) for i, t in rows if len(t or "") < 20_000]
    tenth = [(i, " ".join(f"w{k % 50}" for k in range(30 + i % 200))) for i in range(3000) if crc32(str(i).encode()) % 10 == 0][:60]
    given_rows = short + tenth
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in given_rows], "doc_id long, text string, start string, period int")
    got = sorted((tuple(r) for r in periodic_runs.periodic_runs(frame, repeat_tails=True).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in given_rows), key=str)


def test_empty_table_and_collapse(spark, docs, empty):
    assert periodic_runs.periodic_runs(empty).collect() == []
    assert periodic_runs.collapse(empty).collect() == []
    frame = spark.createDataFrame([(1, "x\n" + "a b c " * 9 + "y"), (2, "as\tit is"), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in periodic_runs.collapse(frame).collect()), key=str) == [(1, "x a b c y"), (2, "as\tit is"), (None, None)]
    assert periodic_runs.collapse(docs).columns == docs.columns


def test_long_texts_take_about_linear_time():
    rng = np.random.default_rng(1)
    peel = np.concatenate([np.repeat(np.arange(30_000), 1), np.arange(30_000), np.arange(30_000)])  # one long period
    shaved = np.array([k // 3 for k in range(60_000)] + list(range(20_000)))
    for words in (rng.integers(0, 50, 300_000), np.zeros(300_000, np.int64), np.tile(rng.integers(0, 9, 999), 300), peel, shaved, np.tile(np.arange(200), 1500)):
        began = time.perf_counter()
        periodic_runs.runs(words)
        assert time.perf_counter() - began < 20
