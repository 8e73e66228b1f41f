"""Tab-separated genomic text: BED, TAB, GTF, VCF, candidate tables, FASTA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GTF_FEATURES = ["stop_codon", "CDS", "exon"]
FASTA_CHUNK = 1 << 16


def data_lines(lines: DataFrame, comment: str = "#") -> DataFrame:
    return lines.where((F.trim("value") != "") & ~F.col("value").startswith(comment))


def parse_bed(lines: DataFrame) -> DataFrame:
    """BED lines (0-based half-open) to closed 0-based intervals."""
    f = F.split("value", r"\s+")
    rows = data_lines(lines).where(~F.col("value").rlike("^(track|browser)"))
    return rows.select(
        f[0].alias("chrom"), f[1].cast("long").alias("start"), (f[2].cast("long") - 1).alias("stop"), F.get(f, F.lit(3)).alias("payload")
    )


def parse_tab(lines: DataFrame) -> DataFrame:
    """chrom, from, to lines (1-based closed); without ``to`` it is one base."""
    f = F.split("value", r"\s+")
    start = f[1].cast("long") - 1
    stop = F.get(f, F.lit(2)).try_cast("long") - 1
    return data_lines(lines).select(f[0].alias("chrom"), start.alias("start"), F.coalesce(stop, start).alias("stop"))


def parse_gtf(lines: DataFrame, id_attribute: str = "gene_id") -> DataFrame:
    """Exon, CDS and stop codon lines; attributes ``key "val";`` or ``key=val;``."""
    f = F.split("value", "\t")
    gene = F.regexp_extract(f[8], r'(?:^|[;\s])' + id_attribute + r'[ =]+"?([^";]+)"?', 1)
    return data_lines(lines).where(f[2].isin(GTF_FEATURES)).select(
        gene.alias("gene"),
        f[0].alias("chrom"),
        F.when(f[6] == "-", 1).otherwise(0).alias("strand"),
        f[2].alias("type"),
        f[3].cast("long").alias("start"),
        f[4].cast("long").alias("stop"),
    )


def parse_candidates(lines: DataFrame) -> DataFrame:
    """Candidate table: heading, blank and comment lines are left out."""
    f = F.split("value", "\t")
    return data_lines(lines).where(f[0] != "chrom").select(
        f[0].alias("chrom"),
        f[1].cast("long").alias("start"),
        f[2].cast("long").alias("stop"),
        f[3].alias("peak_id"),
        f[4].cast("double").alias("pileup"),
        f[5].cast("double").alias("pscore"),
    )


def parse_vcf(lines: DataFrame) -> DataFrame:
    """Variant sites; ``pos`` is 1-based as written, ``.`` is null or empty."""
    f = F.split("value", "\t")
    none = lambda c: F.nullif(c, F.lit("."))
    return data_lines(lines).select(
        f[0].alias("chrom"),
        f[1].cast("long").alias("pos"),
        none(f[2]).alias("id"),
        f[3].alias("ref"),
        F.coalesce(F.split(none(f[4]), ","), F.array().cast("array<string>")).alias("alts"),
        none(f[5]).cast("float").alias("qual"),
        F.coalesce(F.split(none(f[6]), ";"), F.array().cast("array<string>")).alias("filters"),
        F.str_to_map(F.coalesce(none(f[7]), F.lit("")), F.lit(";"), F.lit("=")).alias("info"),
        F.slice(f, 9, 1 << 20).alias("genotypes"),
    )


def info_int(info: Column, key: str) -> Column:
    return F.try_element_at(info, F.lit(key)).cast("long")


def info_float(info: Column, key: str) -> Column:
    return F.try_element_at(info, F.lit(key)).cast("double")


def info_flag(info: Column, key: str) -> Column:
    return F.map_contains_key(info, key)


def set_info(info: Column, key: str, value: Column) -> Column:
    """INFO with one key set; a null value makes it a flag."""
    kept = delete_info(info, key)
    return F.map_concat(kept, F.create_map(F.lit(key), value.cast("string")))


def delete_info(info: Column, key: str) -> Column:
    return F.map_filter(info, lambda k, v: k != key)


def add_filter(filters: Column, name: str) -> Column:
    """Filters with one more name; PASS gives way to a failed filter, and the reverse."""
    if name == "PASS":
        return F.array(F.lit(name))
    return F.array_union(F.array_remove(filters, "PASS"), F.array(F.lit(name)))


def remove_filter(filters: Column, name: str) -> Column:
    left = F.array_remove(filters, name)
    return F.when(F.size(left) == 0, F.array(F.lit("PASS"))).otherwise(left)


def format_value(sites: DataFrame, sample: int, key: str) -> Column:
    """Value of a FORMAT key for the sample with this number, as text."""
    names = F.split(F.get("genotypes", F.lit(0)), ":")
    values = F.split(F.get("genotypes", F.lit(sample + 1)), ":")
    return F.get(values, (F.array_position(names, key) - 1).cast("int"))


def vcf_lines(sites: DataFrame) -> DataFrame:
    pairs = F.transform(
        F.map_entries("info"), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))
    )
    dot = lambda c: F.when(c == "", ".").otherwise(c)
    return sites.select(
        F.concat_ws(
            "\t",
            "chrom",
            F.col("pos").cast("string"),
            F.coalesce("id", F.lit(".")),
            "ref",
            dot(F.array_join("alts", ",")),
            F.coalesce(F.col("qual").cast("string"), F.lit(".")),
            dot(F.array_join("filters", ";")),
            dot(F.array_join(pairs, ";")),
            "genotypes",
        ).alias("value")
    )


def list_items(text: Column) -> Column:
    """Items of a comma-separated list, without empty ones."""
    return F.filter(F.split(text, ","), lambda x: x != "")


def parse_fasta_index(lines: DataFrame) -> DataFrame:
    """Contigs of a FASTA index: length, byte offset and line layout."""
    f = F.split("value", "\t")
    names = ("length", "offset", "line_bases", "line_width")
    return data_lines(lines).select(f[0].alias("name"), *[f[i + 1].cast("long").alias(n) for i, n in enumerate(names)])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of FASTA files as chunks; one record is one contig."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return chunk_sequences(records.select(name.alias("name"), body.alias("seq")))


def chunk_sequences(sequences: DataFrame, size: int = FASTA_CHUNK) -> DataFrame:
    """``(name, chunk, seq)``: fixed-size pieces, so that a range touches few rows."""
    last = F.greatest(F.ceil(F.length("seq") / size).cast("int") - 1, F.lit(0))
    pieces = sequences.select("name", "seq", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return pieces.select("name", "chunk", F.substr("seq", F.col("chunk") * size + 1, F.lit(size)).alias("seq"))


def sequence_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("name").agg(F.sum(F.length("seq")).alias("length"))


def fetch_sequence(chunks: DataFrame, ranges: DataFrame, size: int = FASTA_CHUNK) -> DataFrame:
    """Bases ``[beg, stop)`` of each range, put together from its chunks."""
    wanted = ranges.where("stop > beg").withColumn(
        "chunk", F.explode(F.sequence(F.floor(F.col("beg") / size), F.floor((F.col("stop") - 1) / size)).cast("array<int>"))
    )
    offset = F.col("chunk").cast("long") * size
    first = F.greatest(F.col("beg") - offset, F.lit(0))
    count = F.least(F.col("stop") - offset, F.lit(size)) - first
    part = F.substr("seq", (first + 1).cast("int"), count.cast("int"))
    found = wanted.join(chunks, ["name", "chunk"]).select("name", "beg", "stop", "chunk", part.alias("part"))
    # the pieces of one range, in order; together no longer than the range asked for
    pieces = F.array_sort(F.collect_list(F.struct("chunk", "part")))
    return found.groupBy("name", "beg", "stop").agg(F.array_join(F.transform(pieces, lambda p: p["part"]), "").alias("seq"))
