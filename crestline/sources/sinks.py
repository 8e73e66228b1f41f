"""Layouts of the result files and a writer for tab-separated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Column headings of the result files.
PEAK_TABLE_HEADER = "chr\tstart\tend\tlength\tabs_summit\tpileup\t-log10(pvalue)\tfold_enrichment\t-log10(qvalue)\tname"
CANDIDATE_HEADER = "chrom\tstar\tend\tpeakID\tpileup\tpscore"
MULTI_HEADER = "chrom\tstart\tend\tIP_tags\tInput_tags\tpileup\tfold enrichment\tp-value"


def peak_table(peaks: DataFrame) -> DataFrame:
    """Peak table: 1-based start and summit, length counted as end - start + 1."""
    return peaks.select(
        F.col("chrom").alias("chr"),
        (F.col("start") + 1).alias("start"),
        F.col("stop").alias("end"),
        (F.col("stop") - F.col("start") + 1).alias("length"),
        (F.col("summit") + 1).alias("abs_summit"),
        "pileup",
        "pscore",
        "fold",
        "qscore",
        "name",
    )


def narrow_peak_rows(peaks: DataFrame) -> DataFrame:
    """Nine columns without a strand; the score is ten times q as an integer."""
    return peaks.select(
        "chrom",
        "start",
        "stop",
        "name",
        F.floor(F.col("qscore") * 10.0).cast("int").alias("score"),
        "fold",
        "pscore",
        "qscore",
        (F.col("summit") - F.col("start")).alias("summit_offset"),
    )


def bed_rows(peaks: DataFrame) -> DataFrame:
    """BED5; peaks that share a name get letters in order of their summit.

    Names are shared only by peaks with one end on one chromosome, a handful.
    """
    same = Window.partitionBy("chrom", "stop")
    order = F.row_number().over(same.orderBy("summit")) - 1
    letter = F.when(F.count(F.lit(1)).over(same) > 1, subpeak_letters(order)).otherwise(F.lit(""))
    return peaks.select(
        "chrom", "start", "stop", F.concat("name", letter).alias("name"), F.col("qscore").alias("score")
    )


def subpeak_letters(i: Column) -> Column:
    """a..z, then aa, ab, ... for any zero-based index: digits of base 26 that have no zero."""
    begin = F.struct(i.cast("long").alias("left"), F.lit("").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        letter = F.chr(F.pmod(acc["left"], F.lit(26)) + 97)
        fresh = F.struct((F.floor(acc["left"] / 26) - 1).cast("long").alias("left"), F.concat(letter, acc["out"]).alias("out"))
        return F.when(acc["left"] >= 0, fresh).otherwise(acc)

    # thirteen letters name more than any long
    return F.aggregate(F.sequence(F.lit(1), F.lit(13)), begin, step, lambda acc: acc["out"])


def candidate_rows(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "chrom", "start", "stop", F.col("pid").alias("peak_id"), "pileup", F.lit(0.0).alias("pscore")
    )


def multi_peak_rows(peaks: DataFrame) -> DataFrame:
    return peaks.select("chrom", "start", "stop", "ip_tags", "input_tags", "pileup", "fold", "pscore")


def write_lines(df: DataFrame, path: str, header: str | None = None, codec: str | None = None) -> None:
    """Write rows as tab-separated text, one part per task.

    Spark puts a header into every part file; each part is then a readable file.
    """
    text = df.select([F.col(c).cast("string") for c in df.columns])
    writer = text.write.option("sep", "\t").option("quote", "").option("escape", "")
    if header is not None:
        text = text.toDF(*header.split("\t"))
        writer = text.write.option("sep", "\t").option("header", "true").option("quote", "").option("escape", "")
    if codec:
        writer = writer.option("compression", codec)
    writer.csv(path)


def write_track(df: DataFrame, path: str, name: str) -> None:
    """Write rows as tab-separated text below a track line, which every part file has."""
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns])
    # fixed value: the track line of the layout
    track = f'track type=narrowPeak name="{name}" description="{name}" nextItemButton=on'
    df.select(line.alias(track)).write.option("header", "true").option("quote", "").option("escape", "").option("sep", "\x01").csv(path)


def write_bedgraph(steps: DataFrame, path: str) -> None:
    """bedGraph, one folder per chromosome; ``steps`` has chrom, start, stop, value."""
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"), F.col("value").cast("string"))
    steps.select(F.col("chrom").alias("contig"), line.alias("value")).write.partitionBy("contig").text(path)
