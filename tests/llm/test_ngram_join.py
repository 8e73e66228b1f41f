"""The set similarity join against all pairs of exact sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from crestline.llm import ngram_join


def exact_set(text: str | None) -> frozenset[bytes]:
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def by_all_pairs(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    sets = [exact_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                root[top(i)] = top(j)
    ids: dict[int, list[int]] = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(s), least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def joined(spark, rows):
    return sorted((tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()), key=str)


def edited(words: list[str], edits: int, rng: random.Random) -> str:
    out = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + 1] = [] if kind == 0 else [f"new{rng.randrange(10**6)}"] if kind == 1 else [out[at], f"more{rng.randrange(10**6)}"]
    return " ".join(out)


@pytest.fixture(scope="module")
def copies() -> list[tuple[int, str]]:
    """Groups of near copies around the threshold, a passage that many share, boundary cases of every kind."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for size in (3, 5, 12, 30, 31, 60, 148, 300):
        base = [rng.choice(vocabulary) for _ in range(size)]
        texts += [edited(base, rng.choice((0, 0, 1, 1, 2, 3, 6)), rng) for _ in range(14)]
    for _ in range(40):
        texts.append(" ".join([*passage, *(rng.choice(vocabulary) for _ in range(rng.randrange(4, 80)))]))
    texts += ["one", "ONE", "one two", "One  Two", "one two three", "\x0bone\x0c", "é É", "é é", "a b c", "İ x y z", "  "]
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


def test_equals_all_pairs(spark, copies):
    assert joined(spark, copies) == by_all_pairs(copies)


def test_null_empty_repeated_and_tied_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (5, "x y z"), (None, "x y z"), (None, "alone in here"), (9, " \t ")]
    assert joined(spark, rows) == by_all_pairs(rows)
    assert joined(spark, []) == []
    wide = frame(spark, rows).selectExpr("*", "1 AS n", "2 AS token", "3 AS rep", "'z' AS k1", "text AS component_id")
    assert sorted((tuple(r) for r in ngram_join.jaccard_components(wide).collect()), key=str) == by_all_pairs(rows)


def test_exact_threshold(spark):
    """Nine of ten shared shingles link, one fewer does not."""
    base = [f"t{i}" for i in range(21)]  # 19 shingles
    rows = [(1, " ".join(base)), (2, " ".join([*base[:20], "q"])), (3, " ".join([*base[:19], "q", "r"]))]
    assert joined(spark, rows) == by_all_pairs(rows)
    assert {r[2] for r in joined(spark, rows)[:2]} == {1}


def test_prefixes_of_linked_sets_meet_under_every_order():
    rng = np.random.default_rng(3)
    crowd = rng.integers(0, 20, ngram_join.BUCKETS).astype(np.uint8)
    for n in (1, 2, 9, 10, 19, 20, 57, 300):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            lost = int(rng.integers(0, n // 5 + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[lost:]], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if len(b) and 100 * shared >= 90 * (len(a) + len(b) - shared):
                apart = np.bitwise_count(ngram_join.parity(a).view(np.uint64) ^ ngram_join.parity(b).view(np.uint64)).sum()
                assert apart <= len(a) + len(b) - 2 * shared
                for order in range(ngram_join.ORDERS):
                    assert len(np.intersect1d(ngram_join.prefix(a, crowd, order), ngram_join.prefix(b, crowd, order)))


def test_long_text_and_many_near_copies(spark):
    """A long text takes its place; a group of several hundred copies is one component without all its pairs."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, edited(base, i % 3, rng)) for i in range(300)]
    rows.append((999, " ".join(f"l{i % 7919}x{i % 13}" for i in range(200_000))))
    rows.append((1000, rows[-1][1] + " and a tail"))
    assert joined(spark, rows) == by_all_pairs(rows)
