import json
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter

from crestline.sources import bam, sam
from crestline.sources.bam import read_header


def lines(n):
    rng = random.Random(6)
    for i in range(n):
        size = rng.randint(20, 90)
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        qual = "".join(chr(33 + rng.randint(0, 40)) for _ in range(size))
        cigar = rng.choice([f"{size}M", f"5S{size - 5}M", f"{size - 8}M2I6M3H", f"10M5D{size - 10}M"])
        tags = f"NM:i:{rng.randint(-3, 900)}\tXZ:Z:v:{i}\tXA:A:q\tXF:f:0.5\tXB:B:s,{i % 7},-3"
        yield f"read{i}\t{rng.choice([0, 16, 99])}\t{rng.choice(['xx', 'yy'])}\t{rng.randint(1, 5000)}\t{rng.randint(0, 60)}\t{cigar}\t=\t{rng.randint(1, 5000)}\t{rng.randint(-400, 400)}\t{seq}\t{qual}\t{tags}"
    yield "lost\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"


def test_round_trip_over_many_splits(spark, tmp_path):
    bam.register(spark)
    text = spark.createDataFrame([(x,) for x in lines(6000)], "value string")
    records = sam.parse_records(text.coalesce(2))
    out = str(tmp_path / "bam")
    contigs = json.dumps([("xx", 10000), ("yy", 20000)])
    records.write.format("bam").option("contigs", contigs).mode("append").save(out)
    expected = sorted(r.value for r in text.collect())
    for split in (1 << 26, 40_000, 7_001):
        back = spark.read.format("bam").option("splitbytes", split).load(out)
        got = sorted(r.value for r in sam.record_lines(back).collect())
        assert got == expected
    part = next((tmp_path / "bam").glob("*.bam"))
    assert read_header(str(part))[0] == [("xx", 10000), ("yy", 20000)]
    assert back.where(F.col("rname").isNull()).count() == 1


def small_record(i, tid=0, pos=1, tag_bytes=0):
    row = {"qname": f"q{i}", "flag": 0, "rname": "xx" if tid == 0 else "*", "pos": pos, "mapq": 9, "cigar": [{"op": "M", "len": 4}]}
    row |= {"rnext": "*", "pnext": -1, "tlen": 0, "seq": "ACGT", "qual": "*", "tags": {"XZ": {"t": "Z", "v": "z" * tag_bytes}}}
    return bam.encode_record(row, {"xx": 0})


def write_bam(path, records, extra=b""):
    """One file; ``extra`` is a subfield that stands before the block size."""
    body = b"BAM\x01" + struct.pack("<iii", 0, 1, 3) + b"xx\0" + struct.pack("<i", 10000) + b"".join(records)
    with open(path, "wb") as out:
        for at in range(0, len(body), 60000):
            block = bam.compress_block(body[at : at + 60000])
            if extra:
                size = struct.unpack_from("<H", block, 16)[0] + len(extra)
                block = block[:10] + struct.pack("<H", 6 + len(extra)) + extra + b"BC\x02\0" + struct.pack("<H", size) + block[18:]
            out.write(block)
        out.write(bam.END_BLOCK)


@pytest.mark.parametrize("kind", ["beyond", "long", "subfield"])
def test_every_record_at_every_split_size(spark, tmp_path, kind):
    """Places past the contig end, records longer than a split, and another subfield before the block size."""
    bam.register(spark)
    if kind == "long":
        records = [small_record(i, tag_bytes=(300 << 10) + i if i % 5 == 0 else 40) for i in range(60)]
    else:
        records = [small_record(i, pos=20_000 if i % 5 == 0 else i % 9000) for i in range(12_000)]
    path = str(tmp_path / "x.bam")
    write_bam(path, records, b"AB\x03\0xyz" if kind == "subfield" else b"")
    for split in (1 << 26, 100_000, 9_001, 2_003 if kind == "long" else 30_011):
        back = spark.read.format("bam").option("splitbytes", split).load(path)
        assert sorted(r.qname for r in back.select("qname").collect()) == sorted(f"q{i}" for i in range(len(records)))


def test_batch_is_its_records_one_by_one(spark):
    """Batches of records are encoded and decoded to what each record gives by itself, with all kinds of tags."""
    records = sam.parse_records(spark.createDataFrame([(x,) for x in [*lines(300), *odd_lines()]], "value string")).collect()
    rows = [r.asDict(recursive=True) for r in records]
    ids = {"xx": 0, "yy": 1}
    batch = pa.RecordBatch.from_pylist([r | {"tags": list((r["tags"] or {}).items())} for r in rows], bam.ARROW)
    alone = [bam.encode_record(r, ids) for r in rows]
    assert bam.encode_batch(batch, ids) == b"".join(alone)
    assert bam.encode_batch(batch.slice(7, 90), ids) == b"".join(alone[7:97])
    starts = [sum(map(len, alone[:i])) for i in range(len(alone))]
    got = bam.decode_batch(b"".join(alone), starts, ["xx", "yy"]).to_pylist()
    expected = [dict(zip(bam.ARROW.names, bam.decode_record(a[4:], ["xx", "yy"]))) for a in alone]
    assert got == expected
    with pytest.raises(ValueError, match="does not fit"):
        bam.encode_batch(pa.RecordBatch.from_pylist([rows[0] | {"tags": [], "mapq": 256}], bam.ARROW), ids)


def odd_lines():
    """No bases, one base, lower case, other contig of the mate, a name of a contig that is not known, tags of every kind."""
    yield "a\t0\txx\t1\t0\t4M\tyy\t9\t0\t*\t*"
    yield "b\t0\txx\t70000\t255\t1M\t*\t0\t-5\tA\t*\tXI:I:4000000000"
    yield "c\t0\tzz\t5\t1\t1=200000N2X\t=\t5\t0\tacR\tI!J\tXc:c:-3\tXC:C:200\tXs:s:-300\tXS:S:60000\tXi:i:-70000\tXd:d:0.25"
    yield "d\t0\tyy\t5\t1\t*\t=\t5\t0\tACGTN\t*\tXZ:Z:\tXH:H:1F\tXA:A:c\tXB:B:f,0.5,2\tXD:B:C,7\tXE:B:i,-1"


def test_records_travel_by_the_batch():
    """A record is no longer one Python call: the writer takes Arrow batches."""
    assert issubclass(bam.BamWriter, DataSourceArrowWriter)


def test_lines_are_formed_once(spark):
    """Headers and empty lines are dropped without a filter that would form every line again below."""
    text = spark.createDataFrame([(x,) for x in ["@HD\tVN:1", "", *lines(5)]], "value string")
    parsed = sam.parse_records(sam.record_lines(sam.parse_records(text)))
    assert parsed.count() == 6
    assert "Filter" not in parsed._jdf.queryExecution().optimizedPlan().toString()
