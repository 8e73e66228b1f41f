"""Documents whose sets of word 3-grams have a Jaccard similarity of 0.9 or more, by prefixes under several token orders.

Every token order puts tokens of crowded count buckets last and breaks ties by its own hash.  Two sets that are similar
enough share one of their first tokens (their prefix) under *each* order.  Candidates come from shared prefix tokens of
the first order, with the bounds on sizes and positions; they must also share a prefix token under every other order;
only then are the sets compared, exactly.  Before a pair asks for whole sets, parity sketches of fixed size must differ
in no more bits than linked sets can differ in tokens, which spares nothing but pairs that cannot link.

Equal sets are one representative from the start.  Inside a group that shares a prefix token, everyone is first compared
with the group's most central member (the one with fewest rare tokens before the shared one); then members that are
still in different components are compared, so a group of near copies never becomes all of its pairs and no link
between components is missed.

The crowding of a token is read from a count table of ``BUCKETS`` hashed buckets over *all* tokens.  The table decides
only the order, never which pairs are found, and has the same size whatever the input.

Defined cases: a null or empty text has the empty set, size 0, and is linked with nothing; repeated rows each get a
row; a null id takes part with its text but never names a component (a component of null ids alone has a null name);
an empty table gives no rows.  Extra columns are not read.  Tokens are compared by 64-bit hashes of whole shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import components, lookup, read, whole_text
from crestline.llm.wordhash import mix, word_powers
from crestline.session import discard, stage

SHINGLE = 3
#: Similarity as a share: NUMERATOR / DENOMINATOR of the union.
NUMERATOR, DENOMINATOR = 90, 100
#: Token orders whose prefix filters are intersected.
ORDERS = 3
#: Buckets of the count table, and of the table's slices that one row carries.
BUCKETS = 1 << 23
SLICE = 1 << 13
#: Classes of crowding for each doubling of a bucket's count; 8 bits hold all of them.
FINENESS = 4
#: Bits of the parity sketch of a set.
PARITY = 512
#: Bits of the bitmap that says whose sets are needed.
NEEDED_BITS = 1 << 23
#: Rows whose sets a task holds at once.
ROWS = 512
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTOR = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SALT = [np.uint64(0x27D4EB2F165667C5 * (2 * k + 1) & (1 << 64) - 1) for k in range(ORDERS)]


def overlap_needed(a: int | Column, b: int | Column) -> int | Column:
    """Smallest size of the intersection of linked sets of ``a`` and ``b`` tokens: ceil(N (a + b) / (N + D))."""
    whole = NUMERATOR + DENOMINATOR
    total = (a + b) * NUMERATOR + (whole - 1)
    return F.floor(total / whole) if isinstance(total, Column) else total // whole


def prefix_length(n: int) -> int:
    """Tokens of a set of ``n`` that must hold the first shared token, whatever the size of the linked set."""
    least = -(-NUMERATOR * n // DENOMINATOR)
    return n - overlap_needed(n, least) + 1


def word_hashes(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of ``line``; A-Z count as a-z."""
    data = _LOWER[np.frombuffer(line, np.uint8)]
    edge = np.diff((~_SPACE[data]).astype(np.int8), prepend=0, append=0)
    start, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    up, down = word_powers(1 << max(12, len(line).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[stop] - total[start]) * down[start]), start


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The set of each text, as sorted distinct 64-bit hashes."""
    for low, high in _chunks(texts):
        some = [t or b"" for t in texts[low:high]]
        words, start = word_hashes(b"\n".join(some))
        edges = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in some])]))
        joined = words * _FACTOR[0]
        for k in range(1, SHINGLE):
            joined[:-k] += words[k:] * _FACTOR[k]
        joined = mix(joined)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a >= SHINGLE:
                yield np.unique(joined[a : b - SHINGLE + 1])
            elif b > a:
                own = sum((words[a + k] * _FACTOR[k] for k in range(b - a)), np.uint64(0))
                yield mix(np.array([own], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    low, held = 0, 0
    for k, text in enumerate(texts):
        size = len(text or b"")
        if held and held + size > CHUNK:
            yield low, k
            low, held = k, 0
        held += size + 1
    if low < len(texts):
        yield low, len(texts)


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: two sums of differently mixed tokens."""
    with np.errstate(over="ignore"):
        first, second = (mix(tokens ^ s).sum(dtype=np.uint64) for s in (_FACTOR[0], _FACTOR[1]))
    return int(first.view(np.int64)), int(second.view(np.int64))


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(BUCKETS - 1)).astype(np.intp)


def in_order(tokens: np.ndarray, crowd: np.ndarray, order: int) -> np.ndarray:
    """The place of each token in one of the global orders: crowding first, then the order's own hash."""
    return (crowd[bucket_of(tokens)].astype(np.uint64) << np.uint64(56)) | (mix(tokens ^ _SALT[order]) >> np.uint64(8))


def parity(tokens: np.ndarray) -> np.ndarray:
    """A bit for each of ``PARITY`` hash values: whether an odd number of tokens has it.

    Two sets' sketches differ in no more bits than the sets differ in tokens.
    """
    seen = np.bincount((mix(tokens ^ _FACTOR[2]) & np.uint64(PARITY - 1)).astype(np.intp), minlength=PARITY) & 1
    return np.packbits(seen.astype(np.uint8)).view(np.int64)


def prefix(tokens: np.ndarray, crowd: np.ndarray, order: int) -> np.ndarray:
    """The first tokens of a set under one order, in that order, named by their places."""
    size, place = prefix_length(len(tokens)), in_order(tokens, crowd, order)
    return np.sort(np.partition(place, size - 1)[:size] if size < len(place) else place).view(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


_MARKS = "doc_id long, n long, k1 long, k2 long, slice int, counts binary"


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (its set's size and name), then the token counts of the task, a slice a row."""
    names = ["doc_id", "n", "k1", "k2", "slice", "counts"]
    counts = np.zeros(BUCKETS, np.uint32)
    found, held = [], 0

    def count() -> None:
        nonlocal held
        if found:
            buckets, times = np.unique(bucket_of(np.concatenate(found)), return_counts=True)
            counts[buckets] += times.astype(np.uint32)
        found.clear()
        held = 0

    for batch in _small(batches):
        rows = []
        for tokens in shingle_sets(_texts(batch)):
            rows.append((len(tokens), *digest(tokens)))
            found.append(tokens)
            held += len(tokens)
            if held >= CHUNK:
                count()
        n, k1, k2 = zip(*rows)
        none = [None] * len(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, k1, k2)), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=names
        )
    count()
    slices = [k for k in range(BUCKETS // SLICE) if counts[k * SLICE : (k + 1) * SLICE].any()]
    none = pa.array([None] * len(slices), pa.int64())
    packed = pa.array([_packed(counts[k * SLICE : (k + 1) * SLICE]) for k in slices], pa.binary())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(slices, pa.int32()), packed], names=names)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest width that holds them, after a byte that names the width."""
    for width in (1, 2, 4, 8):
        if counts.max(initial=0) < 1 << (8 * width - 1):
            return bytes([width]) + counts.astype(f"<i{width}").tobytes()
    raise OverflowError("count beyond 63 bits")


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            total[k] = total[k] + _unpacked(data) if k in total else _unpacked(data)
    return total


def _slices(rows: dict[int, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(list(rows.values()), pa.binary())], names=["slice", "counts"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _slices({k: np.minimum(FINENESS * np.log2(x + 1), 255).astype(np.uint8).tobytes() for k, x in _summed(batches).items()})


def crowding(marks: DataFrame) -> np.ndarray:
    """The class of every bucket by its count: a byte each, ``BUCKETS`` in all, whatever the input.

    A task adds up the rows of its slices as they come and holds one sum for each.
    """
    slices = marks.where("slice IS NOT NULL").select("slice", "counts").repartition("slice")
    crowd = np.zeros(BUCKETS, np.uint8)
    for row in slices.mapInArrow(_classes, "slice int, counts binary").toLocalIterator():
        crowd[row.slice * SLICE : (row.slice + 1) * SLICE] = np.frombuffer(row.counts, np.uint8)
    return crowd


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[tuple[int, int], np.ndarray]]]:
    """Sets by name, batch by batch, each name once a task; empty sets left out."""
    seen: set[tuple[int, int]] = set()
    for batch in _small(batches):
        fresh = []
        for tokens in shingle_sets(_texts(batch)):
            if len(tokens) and (name := digest(tokens)) not in seen:
                seen.add(name)
                fresh.append((name, tokens))
        if fresh:
            yield fresh


def _longs(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]), pa.int32()), pa.array(np.concatenate(rows)))


def representatives(source: DataFrame, crowd: np.ndarray) -> DataFrame:
    """A row per distinct set: rep, k1, k2, n, ``first`` (its prefix under the first order) and its parity sketch."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fresh in _each_set(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([name[k] for name, _ in fresh], pa.int64()) for k in (0, 1)),
                    pa.array([len(tokens) for _, tokens in fresh], pa.int64()),
                    _longs([prefix(tokens, crowd, 0) for _, tokens in fresh]),
                    _longs([parity(tokens) for _, tokens in fresh]),
                ],
                names=["k1", "k2", "n", "first", "parity"],
            )

    found = source.mapInArrow(first, "k1 long, k2 long, n long, first array<long>, parity array<long>")
    once = found.groupBy("k1", "k2").agg(*(F.first(c).alias(c) for c in found.columns[2:]))
    # the number is fixed by being written
    return stage(once.withColumn("rep", F.monotonically_increasing_id()), "reps")


def _marked(names: DataFrame) -> np.ndarray:
    """A bitmap of ``NEEDED_BITS`` bits that holds the low bits of every k1 of ``names``."""
    place = f"(k1 & {NEEDED_BITS - 1}L)"
    words = names.select(F.expr(f"shiftright({place}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({place} & 63 as int))").alias("bit"))
    marked = np.zeros(NEEDED_BITS // 64, np.uint64)
    held = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    marked[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64).view(np.uint64)
    return marked


def full_sets(source: DataFrame, needed: DataFrame, crowd: np.ndarray) -> DataFrame:
    """(rep, the prefixes under the other orders, tokens) of ``needed`` (rep, k1, k2), from the texts once more.

    A bitmap of fixed size keeps most other texts from being shuffled; the join on the whole name decides.
    """
    marked = _marked(needed)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fresh in _each_set(batches):
            low = np.array([name[0] for name, _ in fresh], np.int64) & (NEEDED_BITS - 1)
            hit = (marked[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1)
            kept = [fresh[k] for k in np.nonzero(hit)[0].tolist()]
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([name[k] for name, _ in kept], pa.int64()) for k in (0, 1)),
                        *(_longs([prefix(tokens, crowd, order) for _, tokens in kept]) for order in range(1, ORDERS)),
                        _longs([tokens.view(np.int64) for _, tokens in kept]),
                    ],
                    names=["k1", "k2", *_OTHERS, "tokens"],
                )

    found = source.mapInArrow(wanted, "k1 long, k2 long, " + "".join(f"{c} array<long>, " for c in _OTHERS) + "tokens array<long>")
    once = found.groupBy("k1", "k2").agg(*(F.first(c).alias(c) for c in found.columns[2:]))
    return stage(once.join(needed, ["k1", "k2"]).select("rep", *_OTHERS, "tokens"), "sets")


#: Columns of the prefixes under the orders after the first.
_OTHERS = [f"p{k}" for k in range(1, ORDERS)]


def _can_link(n: str, pos: str, other_n: str, other_pos: str) -> Column:
    """Whether two sets may link whose first shared token is at these places (from 0)."""
    a, i, b, j = (F.col(c) for c in (n, pos, other_n, other_pos))
    need = overlap_needed(a, b)
    return (a - i >= need) & (b - j >= need)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()


def _close(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The distinct ``pairs`` (a, b) whose parity sketches differ in no more bits than linked sets can."""

    def side(name: str) -> DataFrame:
        return reps.select(F.col("rep").alias(name), F.col("n").alias(f"{name}_n"), F.col("parity").alias(f"{name}_parity"))

    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    bits = F.zip_with("a_parity", "b_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda total, x: total + x)
    size = F.col("a_n") + F.col("b_n")
    return both.where(apart <= size - 2 * overlap_needed(F.col("a_n"), F.col("b_n"))).select("a", "b")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among ``pairs`` (a, b): the other orders' prefixes must meet too, then the sets are compared."""

    def side(name: str, columns: list[str]) -> DataFrame:
        return sets.select(F.col("rep").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    meet = pairs.join(side("a", _OTHERS), "a").join(side("b", _OTHERS), "b")
    for c in _OTHERS:
        meet = meet.where(F.arrays_overlap(f"a_{c}", f"b_{c}"))
    asked = stage(meet.select("a", "b"), "asked")
    both = asked.join(side("a", ["tokens"]), "a").join(side("b", ["tokens"]), "b")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    linked = both.where(shared >= overlap_needed(F.size("a_tokens"), F.size("b_tokens")))
    return stage(linked.select("a", "b"), "links")


def links(reps: DataFrame, source: DataFrame, crowd: np.ndarray) -> DataFrame:
    """Links (a, b) that join all representatives which links reach; inside a component not every pair is listed."""
    rows = reps.select("rep", "n", F.posexplode("first").alias("pos", "token"))
    several = rows.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("token")
    together = rows.join(several, "token")
    centres = together.groupBy("token").agg(F.min(F.struct("pos", "rep", "n")).alias("c"))
    shared = stage(together.join(centres, "token").select("token", "rep", "n", "pos", F.col("c.rep").alias("c_rep"), F.col("c.n").alias("c_n"), F.col("c.pos").alias("c_pos")), "shared")

    star = shared.where((F.col("rep") != F.col("c_rep")) & _can_link("n", "pos", "c_n", "c_pos"))
    star = stage(_close(star.select(F.least("rep", "c_rep").alias("a"), F.greatest("rep", "c_rep").alias("b")), reps), "star")
    names = reps.select("rep", "k1", "k2")
    sets = full_sets(source, names.join(_ends(star), "rep"), crowd)
    first = _compared(star, sets)

    known = stage(components(first), "known").withColumnRenamed("node", "rep")
    placed = shared.join(known, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    home = known.select(F.col("rep").alias("c_rep"), F.col("root").alias("c_root"))
    split = placed.join(mixed, "token").join(home, "c_rep", "left").withColumn("at_home", F.col("root") == F.coalesce("c_root", "c_rep"))
    split = stage(split.select("token", "rep", "n", "pos", "root", "c_rep", "at_home"), "split")
    one = split.where("NOT at_home").select("token", "c_rep", *(F.col(c).alias(f"x_{c}") for c in ("rep", "n", "pos", "root")))
    other = split.select("token", "at_home", *(F.col(c).alias(f"y_{c}") for c in ("rep", "n", "pos", "root")))
    # two outsiders meet once; a pair with the centre was compared above
    cross = one.join(other, "token").where(
        (F.col("x_root") != F.col("y_root")) & (F.col("y_rep") != F.col("c_rep")) & (F.col("at_home") | (F.col("x_rep") < F.col("y_rep"))) & _can_link("x_n", "x_pos", "y_n", "y_pos")
    )
    cross = stage(_close(cross.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")), reps), "cross")
    for table in (shared, split):
        discard(table)
    more = full_sets(source, names.join(_ends(cross), "rep").join(sets.select("rep"), "rep", "left_anti"), crowd)
    return first.union(_compared(cross, sets.union(more)))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    marks = stage(source.mapInArrow(_mark, _MARKS), "marks")
    of_docs = marks.where("slice IS NULL")
    crowd = crowding(marks)
    reps = representatives(source.select("text"), crowd)
    roots = stage(components(links(reps, source.select("text"), crowd)), "roots")
    own = of_docs.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("count"))
    named = stage(own.join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).join(roots.withColumnRenamed("node", "rep"), "rep", "left"), "named")
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"))
    names = stage(
        named.join(least, "root", "left").select(
            F.struct("k1", "k2").alias("key"), F.coalesce("component_id", F.when(F.col("root").isNull(), F.col("least"))).alias("component_id"), F.col("count").alias("n")
        ),
        "names",
    )
    full = lookup(of_docs.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), F.struct("k1", "k2").alias("key")), names, "key").drop("key")
    bare = of_docs.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n_shingles", "component_id").unionByName(bare)


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


QUERIES = {"op13_ngram_jaccard_join": op13_ngram_jaccard_join}
ORACLE: dict[str, str] = {}
