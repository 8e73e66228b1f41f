"""Steps that several text operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import crestline
from crestline.functions.let import let
from crestline.session import stage

#: A key is hot when it holds over a thousandth of the rows, so at most a thousand keys are hot at any size.
HOT_SHARE = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per session, for the functions that run in their Python workers."""
    context = spark.sparkContext
    if getattr(context, "_crestline_sent", False):
        return
    root = Path(crestline.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="crestline-code-")) / "crestline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._crestline_sent = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(doc_id: Column, modulus: int) -> Column:
    """Stable fold of a document, from the crc32 of its id as text."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """About ``bound`` labelled rows of ``docs`` (text, label, slot), the same ones on every run.

    Rows of ``labels`` are thinned by a hash of their id until about ``bound`` are left, so the table that is
    broadcast has a known size whatever the input.  ``slot`` is a second hash, for splits of the sample.  An id with
    several labels counts with the largest; null labels and ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    rate = min(1.0, bound / max(1, known.count()))
    slot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("slot")), F.lit(1000)).cast("int")
    few = (
        known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(few), "doc_id").select("doc_id", "text", "label", slot.alias("slot"))


def running_sums(values: Column) -> Column:
    """Running sums of a list of numbers, each with its own value in.

    Worked out in blocks of about the root of the list's length, so a list of n takes about n to the power 1.5 additions
    and no list is built up element by element.
    """
    return _running(values, lambda part: F.aggregate(part, F.lit(0), lambda a, v: a + v), lambda a, b: a + b)


def running_most(values: Column) -> Column:
    """Running maxima of a list of numbers not below 0, each with its own value in; in blocks like ``running_sums``."""
    return _running(values, lambda part: F.coalesce(F.array_max(part), F.lit(0)), lambda a, b: F.greatest(a, b))


def _running(values: Column, fold: Callable[[Column], Column], both: Callable[[Column, Column], Column]) -> Column:
    def blocked(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda b: F.slice(v, b * size + 1, size))
        return let(blocks, lambda parts: let(F.transform(parts, fold), lambda folded: joined(parts, folded)))

    def joined(parts: Column, folded: Column) -> Column:
        one = lambda part, b: let(fold(F.slice(folded, 1, b)), lambda before: F.transform(part, lambda _, i: both(before, fold(F.slice(part, 1, i + 1)))))
        return F.flatten(F.transform(parts, one))

    return F.when(F.size(values) > 0, let(values, blocked)).otherwise(F.array().cast("array<int>"))


def keep_rows(docs: DataFrame, kept: Callable[[list[str | None]], np.ndarray], many: int = 512) -> DataFrame:
    """The rows of ``docs`` whose text ``kept`` marks; all columns pass through as they are and nothing is shuffled."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, many):
                some = batch.slice(low, many)
                yield some.filter(pa.array(kept(some.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def lookup(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` to ``names`` (one row per key, with its number of ``rows`` in ``n``).

    The few hot keys, a thousand at most, are broadcast; all others go through an ordinary shuffle in which no key
    holds over a thousandth of the rows.
    """
    total = names.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(total // HOT_SHARE, 100)
    few, rest = names.where(hot).drop("n"), names.where(~hot).drop("n")
    marked = rows.join(F.broadcast(few.withColumn("_hot", F.lit(True))), key, "left")
    extra = [c for c in few.columns if c != key]
    kept = [c for c in rows.columns if c != key]
    head = marked.where(F.col("_hot")).select(key, *kept, *extra)
    tail = marked.where(F.col("_hot").isNull()).select(key, *kept).join(rest, key).select(key, *kept, *extra)
    return head.unionByName(tail)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node that can be reached.

    Each round points every node at its smallest neighbour, follows these pointers to their ends by doubling, rewrites
    the edges between the ends and keeps the step as a written table.  No two ends are neighbours, so a round leaves half
    of the nodes at most.  The steps are joined at the end.
    """
    left = stage(edges.where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        step = stage(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "step")
        while True:  # each pass doubles the way to the root
            up = step.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            jumped = stage(step.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("_up") < F.col("root")).alias("moved")), "step")
            step = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        steps.append(step)
        to_a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        left = stage(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[-1]
    for step in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("_later"))
        found = step.join(later, "root", "left").select("node", F.coalesce("_later", "root").alias("root"))
    return found
