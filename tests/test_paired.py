"""Alternatives of mates over candidate regions, and overlap by CIGAR blocks, on cases written out by hand."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from crestline.config import CallOptions
from crestline.functions.cigar import aligned_blocks, parse_cigar
from crestline.operators.overlap import assign_first_block, moved_blocks
from crestline.plans.multi import MultiExperiment, PairedMultiExperiment
from crestline.sources import sam

REGIONS = [(1, "c1", 1000, 1400), (2, "c1", 5000, 5400), (3, "c2", 1000, 1400)]


@pytest.fixture(scope="module")
def regions(spark):
    return spark.createDataFrame(REGIONS, "pid long, chrom string, start long, stop long").cache()


def with_regions(run, regions):
    run.candidates = regions  # in place of the pass that finds them
    return run


def test_spliced_read_hits_its_far_block_and_not_the_gap(spark, regions):
    rows = [("far", "c1", 100, "50M4900N50M", 0), ("gap", "c1", 100, "50M9000N50M", 0), ("near", "c1", 1390, "5S20M", 0), ("deleted", "c1", 900, "50M400D60M", 0),
            ("moved", "c1", 940, "50M", 0), ("back", "c1", 1450, "50M", 1), ("both", "c1", 1350, "50M3600N50M", 0), ("none", "c1", 100, "*", 0)]
    tags = spark.createDataFrame(rows, "name string, chrom string, pos long, cigar string, strand int")
    blocks = moved_blocks(aligned_blocks(F.col("pos"), parse_cigar(F.col("cigar"))), F.col("strand"), 60)
    got = {r.name: r.pid for r in assign_first_block(tags.withColumn("blocks", blocks), regions, ["chrom", "name"]).collect()}
    assert got == {"far": 2, "deleted": 1, "moved": 1, "back": 1, "both": 2}


def test_single_end_reads_with_cigar_use_their_blocks(spark, regions):
    rows = [("T", "u1", "c1", 0, 100, "50M4900N50M"), ("T", "u2", "c1", 0, 100, "50M9000N50M"), ("C", "u3", "c1", 1, 1300, "50M"), ("T", "m", "c1", 0, 1000, "50M"), ("T", "m", "c1", 0, 5000, "50M"), ("T", "m", "c2", 0, 90000, "50M")]
    reads = spark.createDataFrame(rows, "sample string, read_id string, chrom string, strand int, pos long, cigar string")
    base = SimpleNamespace(options=CallOptions(fragment=120), reads=reads, per_read=reads.groupBy("sample", "read_id").agg(F.count(F.lit(1)).alias("n_align")))
    run = with_regions(MultiExperiment(base), regions)
    assert sorted((r.sample, r.pid, r.frag_start, r.n) for r in run.unique_positions.collect()) == [("C", 1, 1180, 1), ("T", 2, 100, 1)]
    assert sorted((r.read_id, r.pid, r.frag_start) for r in run.multi_alignments.collect()) == [("m", 1, 1000), ("m", 2, 5000)]


MATES = [
    # name, mate, chrom, strand, start, lead
    ("whole", 1, "c1", 0, 1000, 1000), ("whole", 2, "c1", 1, 1150, 1000),
    ("by_first", 1, "c1", 0, 1300, 1300), ("by_first", 2, "c1", 1, 1560, 1300),  # the second lies behind the region
    ("by_second", 1, "c1", 0, 700, 700), ("by_second", 2, "c1", 1, 1200, 700),
    ("lone_minus", 2, "c1", 1, 1150, 1150),
    ("two_chroms", 1, "c1", 0, 1000, 1000), ("two_chroms", 2, "c2", 1, 1150, 1150),
    ("two_regions", 1, "c1", 0, 1100, 1100), ("two_regions", 2, "c1", 1, 5200, 1100),
    ("multi", 1, "c1", 0, 1000, 1000), ("multi", 2, "c1", 1, 1150, 1000),
    ("multi", 1, "c1", 0, 5000, 5000), ("multi", 2, "c1", 1, 5150, 5000),
    ("multi", 2, "c2", 1, 1200, 1200),  # left over
    ("multi_once", 1, "c1", 0, 1000, 1000), ("multi_once", 1, "c1", 0, 90000, 90000),
    ("nowhere", 1, "c2", 0, 70000, 70000),
]


def test_alternatives_of_pairs(spark, regions):
    rows = [("T", name, mate, chrom, strand, start, "50M", lead) for name, mate, chrom, strand, start, lead in MATES]
    mates = spark.createDataFrame(rows, "sample string, read_id string, mate int, chrom string, strand int, start long, cigar string, lead long")
    run = with_regions(PairedMultiExperiment(SimpleNamespace(options=CallOptions(fragment=200)), mates), regions)
    got = sorted((r.read_id, r.multi, r.pid, r.frag_start) for r in run.alternatives.collect())
    assert got == [
        ("by_first", False, 1, 1300),
        ("by_second", False, 1, 700),
        ("lone_minus", False, 1, 1000),
        ("multi", True, 1, 1000),
        ("multi", True, 2, 5000),
        ("multi", True, 3, 1050),
        ("multi_once", True, 1, 1000),
        ("whole", False, 1, 1000),
    ]
    assert {(r.pid, r.n) for r in run.unique_counts.collect()} == {(1, 4)}
    classes = run.classes.members.groupBy("class_id").agg(F.sort_array(F.collect_list("pid")).alias("pids")).collect()
    assert sorted(r.pids for r in classes) == [[1], [1, 2, 3]]


def test_mates_of_records(spark):
    lines = ["p/1\t99\tc1\t101\t60\t40M\t=\t301\t240\t*\t*", "p/2\t147\tc1\t301\t60\t5S35M\t=\t101\t-240\t*\t*", "q\t73\tc1\t11\t60\t40M\t*\t0\t0\t*\t*", "q\t133\t*\t0\t0\t*\t*\t0\t0\t*\t*", "r\t65\tc1\t501\t60\t40M\tc2\t1\t0\t*\t*"]
    records = sam.parse_records(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = sorted(tuple(r) for r in sam.paired_mates(records, "T").collect())
    assert got == [("T", "p", 1, "c1", 0, 100, "40M", 100), ("T", "p", 2, "c1", 1, 300, "5S35M", 100), ("T", "q", 1, "c1", 0, 10, "40M", 10), ("T", "r", 1, "c1", 0, 500, "40M", 500)]
