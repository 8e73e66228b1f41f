from collections import Counter

import numpy as np
import pytest
import xxhash

from crestline.llm import simhash
from crestline.llm.common import components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    digests = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in digests) > len(digests))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_rows(docs, rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints)
    least = {}
    for (doc_id, _), r in zip(rows, roots):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    expected = Counter((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots))
    found = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex(simhash.F.col("fp")).alias("f"), "component_id").collect()
    assert Counter((r.doc_id, r.f, r.component_id) for r in found) == expected
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    only_null = {r for (i, _), r in zip(rows, roots) if i is None} - least.keys()
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.values()) + Counter([None] * len(only_null))


@pytest.mark.parametrize("leaf,sample", [(8192, 1 << 16), (40, 1 << 16), (15, 200)])
def test_links_against_all_pairs(spark, leaf, sample):
    """Clusters of near fingerprints, through few and many leaves, blocks and parts."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 150, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 2, dtype=np.uint64)) for b in np.repeat(base[:10], 40)]
    chain = [np.uint64((1 << k) - 1) for k in range(0, 64, 2)]
    points = np.unique(np.array([*base, *near, *chain], np.uint64))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(3)
    found = {r.node: r.root for r in components(simhash.links(df, leaf, sample)).collect()}
    roots = brute_components([int(p) for p in points])
    groups, expected = {}, {}
    for p, r in zip(points.view(np.int64).tolist(), roots):
        groups.setdefault(found.get(p, p), set()).add(p)
        expected.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_one_row_of_each_component(spark):
    """Repeated ids with different texts, copies without an id, and whole repeated rows."""
    rows = [(1, "a long first text", 1), (1, "some other second text", 2), (2, "a long first text", 3), (None, "a long first text", 4)]
    rows += [(None, "third one alone here", 5), (None, "third one alone here", 6), (7, "fourth text of its own", 7), (7, "fourth text of its own", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key int").repartition(3)
    kept = simhash.deduplicate(df)
    assert kept.columns == ["doc_id", "text", "row_key"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted({(i, t) for i, t, _ in rows} - {(2, rows[0][1]), (None, rows[0][1])}, key=str)


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.deduplicate(empty).collect() == []
