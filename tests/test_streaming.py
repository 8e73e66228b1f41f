import random

import pytest

from crestline.functions.cigar import parse_cigar
from crestline.operators.base_depth import base_depth, depth_segments
from crestline.streaming.depth import SIDES, current_depth, start_depth_stream
from crestline.streaming.pileup import OnlinePileup, UnsortedInput
from pyspark.sql import functions as F


def test_stream_of_files_gives_the_batch_depth(spark, tmp_path):
    source, table, mark = (str(tmp_path / n) for n in ("in", "sums", "mark"))
    rows = [("c", i * 3 % 40, f"{5 + i % 4}M{i % 3 + 1}D4M") for i in range(60)]
    df = spark.createDataFrame(rows, "chrom string, pos long, cigar string")
    df.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = start_depth_stream(stream.withColumn("cigar", parse_cigar(F.col("cigar"))), ["chrom"], table, mark)
    query.awaitTermination(120)
    sums = spark.read.parquet(table)
    assert sums.select("batch").distinct().count() == 3
    got = sorted(map(tuple, current_depth(sums, ["chrom"]).collect()))
    whole = depth_segments(df.withColumn("cigar", parse_cigar(F.col("cigar"))), ["chrom"]).select("chrom", "start", "stop", *SIDES)
    assert got == sorted(map(tuple, whole.collect()))


@pytest.fixture
def sorted_parts(spark, tmp_path):
    """Sorted records of two libraries in files of their own, in order of their names."""
    rng = random.Random(4)
    rows = sorted((tid, pos, s) for s in "TC" for tid in (0, 1, 2) for pos in rng.choices(range(0, 140_000, 700), k=25))
    rows = [(s, tid, f"c{tid}", pos, f"{rng.randint(3, 9)}M{rng.randint(1, 900)}{rng.choice('DN')}{rng.randint(1, 40)}M") for tid, pos, s in rows]
    form = "sample string, tid int, chrom string, pos long, cigar string"

    def write(part, some):
        spark.createDataFrame(some, form).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    size = 30
    return rows, form, [rows[i : i + size] for i in range(0, len(rows), size)], write


def pileup_of(spark, tmp_path, form):
    stream = spark.readStream.schema(form).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pile = OnlinePileup(spark, ["sample"], str(tmp_path / "out"), str(tmp_path / "state"))
    return pile, lambda: pile.start(stream.withColumn("cigar", parse_cigar(F.col("cigar"))), str(tmp_path / "mark"))


def test_online_pileup_hands_on_and_forgets(spark, tmp_path, sorted_parts):
    """Equal to the batch depth, across a stop and a restart, with a short state that is empty at the end."""
    rows, form, parts, write = sorted_parts
    for k, some in enumerate(parts[:3]):
        write(k, some)
        pile, start = pileup_of(spark, tmp_path, form)  # a new start each time, from the checkpoint
        start().awaitTermination(120)
    handed = spark.read.parquet(str(tmp_path / "out"))
    done = max(r[1:] for r in parts[2])[:1] + (max(r[3] for r in parts[2] if r[1] == parts[2][-1][1]),)
    assert handed.where(F.struct("tid", F.col("stop") - 1) >= F.struct(F.lit(done[0]), F.lit(done[1]).cast("long"))).count() == 0
    for k, some in enumerate(parts[3:], 3):
        write(k, some)
        start().awaitTermination(120)
    last = len(parts) - 1
    open_rows = pile.open_changes(last).collect()
    assert 0 < len(open_rows) < 20 and pile.open_changes(last - 2) is None
    pile.finish(last)
    assert pile.open_changes(last) is None
    whole = base_depth(spark.createDataFrame(rows, form).withColumn("cigar", parse_cigar(F.col("cigar"))), ["sample", "chrom"])
    assert sorted(map(tuple, pile.depth().select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_online_pileup_repeats_a_batch(spark, tmp_path, sorted_parts):
    rows, form, parts, _ = sorted_parts
    pile = OnlinePileup(spark, ["sample"], str(tmp_path / "out"), str(tmp_path / "state"))
    frames = [spark.createDataFrame(p, form).withColumn("cigar", parse_cigar(F.col("cigar"))) for p in parts[:3]]
    for number, frame in [(0, frames[0]), (1, frames[1]), (1, frames[1]), (2, frames[2])]:
        pile.fold(frame, number)
    pile.finish(2)
    whole = base_depth(frames[0].union(frames[1]).union(frames[2]), ["sample", "chrom"])
    assert sorted(map(tuple, pile.depth().select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_online_pileup_refuses_unsorted_input(spark, tmp_path):
    form = "sample string, tid int, chrom string, pos long, cigar string"
    pile = OnlinePileup(spark, ["sample"], str(tmp_path / "out"), str(tmp_path / "state"))
    frame = lambda tid, pos: spark.createDataFrame([("T", tid, f"c{tid}", pos, "5M")], form).withColumn("cigar", parse_cigar(F.col("cigar")))
    pile.fold(frame(1, 100), 0)
    for late in (frame(1, 99), frame(0, 500)):
        with pytest.raises(UnsortedInput):
            pile.fold(late, 1)
    pile.fold(frame(1, 100), 1)
