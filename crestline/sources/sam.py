"""SAM text: header dictionary, records, and the writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions.cigar import cigar_text, five_prime, parse_cigar
from crestline.functions.flags import has, usable_mate, usable_single
from crestline.operators.reads import normal_name


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Contigs and alignments of SAM text files."""
    lines = spark.read.text(path)
    return parse_header(lines), parse_records(lines)


def parse_header(lines: DataFrame) -> DataFrame:
    """``(chrom, length)`` of the @SQ lines."""
    return lines.where(F.col("value").startswith("@SQ")).select(
        F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"),
        F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"),
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """Typed alignment records; ``pos`` is 0-based.

    A record without a contig, position or CIGAR is flagged as unmapped.
    """
    # a generator: a filter would be pushed below what forms the lines and form each line again to look at it
    kept = F.filter(F.array("value"), lambda line: ~line.startswith("@") & (line != ""))
    rows = lines.select(F.explode(kept).alias("value")).select(F.split("value", "\t").alias("f"))
    item = lambda i: F.col("f")[i]
    lost = (item(2) == "*") | (item(3) == "0") | (item(5) == "*")
    flag = item(1).cast("int")
    tags = F.map_from_entries(F.transform(F.slice("f", 12, 1 << 20), _tag))
    return rows.select(
        item(0).alias("qname"),
        F.when(lost, flag.bitwiseOR(F.lit(4))).otherwise(flag).alias("flag"),
        F.nullif(item(2), F.lit("*")).alias("rname"),
        (item(3).cast("long") - 1).alias("pos"),
        item(4).cast("int").alias("mapq"),
        parse_cigar(item(5)).alias("cigar"),
        item(6).alias("rnext"),
        (item(7).cast("long") - 1).alias("pnext"),
        item(8).cast("int").alias("tlen"),
        item(9).alias("seq"),
        item(10).alias("qual"),
        tags.alias("tags"),
    )


def _tag(text: Column) -> Column:
    """``NM:i:3`` to (NM, (i, 3)); the value may hold colons."""
    return F.struct(
        F.substring(text, 1, 2).alias("key"),
        F.struct(F.substring(text, 4, 1).alias("t"), F.substring(text, 6, 1 << 30).alias("v")).alias("value"),
    )


def tag_int(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))["v"].cast("long")


def tag_float(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))["v"].cast("double")


def tag_text(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))["v"]


def tag_array(tags: Column, name: str) -> Column:
    """Numbers of a ``B`` tag, without its leading subtype letter."""
    parts = F.split(tag_text(tags, name), ",")
    return F.transform(F.slice(parts, 2, 1 << 20), lambda v: v.cast("double"))


def set_tag(tags: Column, name: str, kind: str, value: Column) -> Column:
    entry = F.create_map(F.lit(name), F.struct(F.lit(kind).alias("t"), value.cast("string").alias("v")))
    return F.map_concat(delete_tag(tags, name), entry)


def delete_tag(tags: Column, name: str) -> Column:
    return F.map_filter(tags, lambda k, v: k != name)


def record_lines(alignments: DataFrame) -> DataFrame:
    """Alignment records as SAM text lines."""
    tag = F.transform(
        F.map_entries("tags"), lambda e: F.concat_ws(":", e["key"], e["value"]["t"], e["value"]["v"])
    )
    fixed = [
        F.col("qname"),
        F.col("flag").cast("string"),
        F.coalesce(F.col("rname"), F.lit("*")),
        (F.col("pos") + 1).cast("string"),
        F.col("mapq").cast("string"),
        cigar_text(F.col("cigar")),
        F.col("rnext"),
        (F.col("pnext") + 1).cast("string"),
        F.col("tlen").cast("string"),
        F.col("seq"),
        F.col("qual"),
    ]
    return alignments.select(F.concat_ws("\t", *fixed, tag).alias("value"))


def header_lines(contigs: DataFrame) -> DataFrame:
    return contigs.select(F.concat(F.lit("@SQ\tSN:"), "chrom", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))


def write_sam(alignments: DataFrame, contigs: list[tuple[str, int]], path: str, codec: str | None = None) -> None:
    """Write SAM parts under ``path``, with the header as a part of its own.

    ``read_sam`` takes the whole folder, in any order of its parts.
    """
    spark = alignments.sparkSession
    head = spark.createDataFrame(contigs, "chrom string, length long").coalesce(1)
    for lines, mode in ((header_lines(head), "errorifexists"), (record_lines(alignments), "append")):
        writer = lines.write.mode(mode)
        (writer.option("compression", codec) if codec else writer).text(path)


def single_end_tags(alignments: DataFrame, sample: str) -> DataFrame:
    """Reads of a single-end library as the peak caller takes them."""
    kept = alignments.where(usable_single(F.col("flag")))
    return kept.select(
        F.lit(sample).alias("sample"),
        F.col("qname").alias("read_id"),
        F.col("rname").alias("chrom"),
        F.when(F.col("flag").bitwiseAND(F.lit(16)) == 0, 0).otherwise(1).alias("strand"),
        five_prime(F.col("flag"), F.col("pos"), F.col("cigar")).alias("pos"),
        cigar_text(F.col("cigar")).alias("cigar"),
    )


def paired_fragments(alignments: DataFrame, sample: str) -> DataFrame:
    """Fragments of proper pairs: the leftmost mate's position and the template length."""
    flag = F.col("flag")
    proper = usable_mate(flag) & has(flag, "PROPER_PAIR") & (F.col("tlen") > 0)
    return alignments.where(proper).select(
        F.lit(sample).alias("sample"),
        normal_name(F.col("qname")).alias("read_id"),
        F.col("rname").alias("chrom"),
        "pos",
        F.abs("tlen").cast("long").alias("span"),
    )


def paired_mates(alignments: DataFrame, sample: str) -> DataFrame:
    """Every usable alignment of a paired-end library with the leftmost position of its template."""
    pos, other = F.col("pos").cast("long"), F.col("pnext").cast("long")
    near = F.col("rnext").isin("=") | (F.col("rnext") == F.col("rname"))
    return alignments.where(usable_mate(F.col("flag"))).select(
        F.lit(sample).alias("sample"),
        normal_name(F.col("qname")).alias("read_id"),
        F.when(has(F.col("flag"), "READ2"), 2).otherwise(1).alias("mate"),
        F.col("rname").alias("chrom"),
        F.when(has(F.col("flag"), "REVERSE"), 1).otherwise(0).alias("strand"),
        pos.alias("start"),
        cigar_text(F.col("cigar")).alias("cigar"),
        F.when(near & (other >= 0), F.least(pos, other)).otherwise(pos).alias("lead"),
    )
