"""Headers of variant files: their dictionary, typed columns from it, a choice of samples, merging of many headers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.operators.running import position_in_group
from crestline.sources.text import parse_vcf

# How the types of the format are read.
TYPES = {"Integer": "int", "Float": "double", "String": "string", "Character": "string", "Flag": "boolean"}
#: Names of filters, INFO and FORMAT fields share one numbering, contigs have their own.
ID_KINDS = ("FILTER", "INFO", "FORMAT")
#: Headers whose names are numbered in one task.
HEADERS_A_TASK = 64


def header_entries(lines: DataFrame) -> DataFrame:
    """(kind, id, number, type, description) of the structured lines among ``lines`` (value and any other columns)."""
    fields = F.regexp_extract("value", r"^##\w+=<(.*)>\s*$", 1)
    # the description is quoted and may hold commas, so each field is looked up by itself
    plain = lambda key: F.nullif(F.regexp_extract(fields, rf"(?:^|,){key}=([^,\"]+)", 1), F.lit(""))
    rows = lines.where(F.col("value").rlike(r"^##\w+=<"))
    rest = [c for c in lines.columns if c != "value"]
    return rows.select(
        *rest,
        F.regexp_extract("value", r"^##(\w+)=<", 1).alias("kind"),
        plain("ID").alias("id"),
        plain("Number").alias("number"),
        plain("Type").alias("type"),
        F.nullif(F.regexp_extract(fields, r'(?:^|,)Description="((?:[^"\\]|\\.)*)"', 1), F.lit("")).alias("description"),
    ).where("id IS NOT NULL")


@dataclass(frozen=True)
class Header:
    """What the head of one file says: fields as (id, number, type), samples in order."""

    info: list[tuple[str, str, str]] = field(default_factory=list)
    format: list[tuple[str, str, str]] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    contigs: list[str] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)


def read_header(lines: DataFrame, at_once: int = 1024) -> Header:
    """The header of a file's lines; only as many lines are taken as the header has, doubling from ``at_once``."""
    spark = lines.sparkSession
    while True:
        head = [r.value for r in lines.take(at_once)]
        stop = next((k for k, line in enumerate(head) if not line.startswith("#")), len(head))
        if stop < len(head) or len(head) < at_once:
            break
        at_once *= 2
    head = head[:stop]
    entries = header_entries(spark.createDataFrame([(k, x) for k, x in enumerate(head)], "at int, value string")).orderBy("at").collect()
    of = lambda kind: [r for r in entries if r.kind == kind]
    typed = lambda kind: [(r.id, r.number or ".", r.type or "String") for r in of(kind)]
    names = next((x.rstrip("\r\n").split("\t")[9:] for x in head if x.startswith("#CHROM")), [])
    return Header(typed("INFO"), typed("FORMAT"), [r.id for r in of("FILTER")], [r.id for r in of("contig")], names)


def typed(text: Column, number: str, kind: str) -> Column:
    """A field's text as its type: a flag, one value, or a list unless the number is 1; ``.`` is null."""
    if kind == "Flag":
        return text.isNotNull()
    one = lambda x: F.nullif(x, F.lit(".")).try_cast(TYPES[kind])
    if number == "1":
        return one(text)
    return F.when(text != ".", F.transform(F.split(text, ","), one))


def typed_info(sites: DataFrame, header: Header) -> DataFrame:
    """``sites`` with ``info`` as a struct of typed fields; a field the header lacks is left out."""
    value = lambda key: F.try_element_at("info", F.lit(key))
    columns = [
        (F.map_contains_key("info", F.lit(key)) if kind == "Flag" else typed(value(key), number, kind)).alias(key) for key, number, kind in header.info
    ]
    return sites.withColumn("info", F.struct(*columns)) if columns else sites.drop("info")


def typed_samples(sites: DataFrame, header: Header) -> DataFrame:
    """``sites`` with ``genotypes`` (FORMAT, then a text per sample) as ``samples``: a struct of typed fields per sample."""
    keys = F.split(F.get("genotypes", F.lit(0)), ":")

    def sample(text: Column) -> Column:
        values = F.split(text, ":")
        part = lambda key: F.get(values, F.when(F.array_contains(keys, key), (F.array_position(keys, key) - 1).cast("int")))
        return F.struct(*[typed(part(key), number, kind).alias(key) for key, number, kind in header.format])

    return sites.withColumn("samples", F.transform(F.slice("genotypes", 2, 1 << 20), sample)).drop("genotypes")


def subset_samples(sites: DataFrame, header: Header, names: Sequence[str], exclude: bool = False) -> tuple[DataFrame, Header]:
    """Sites and header with the named samples only, or without them; in the order of the header.

    A name the header lacks is an error.
    """
    unknown = set(names) - set(header.samples)
    if unknown:
        raise ValueError(f"no sample {', '.join(sorted(unknown))}")
    kept = [k for k, name in enumerate(header.samples) if (name in set(names)) != exclude]
    columns = F.array(F.get("genotypes", F.lit(0)), *[F.get("genotypes", F.lit(k + 1)) for k in kept])
    chosen = Header(header.info, header.format, header.filters, header.contigs, [header.samples[k] for k in kept])
    return sites.withColumn("genotypes", columns), chosen


def read_typed_vcf(spark: SparkSession, path: str, samples: Sequence[str] | None = None) -> DataFrame:
    """Sites of a variant file with the column types of its header, for all samples or the named ones."""
    lines = spark.read.text(path)
    header = read_header(lines)
    sites = parse_vcf(lines)
    if samples is not None:
        sites, header = subset_samples(sites, header, samples)
    return typed_samples(typed_info(sites, header), header)


def merge_headers(entries: DataFrame) -> DataFrame:
    """One dictionary of the headers of many files.

    ``entries`` has file (number), at (place in the file), kind, id, number and type.  The first definition of a (kind,
    id) counts.  ``other_length`` and ``other_type`` tell whether a later INFO or FORMAT definition differs from it.
    ``number_in`` numbers the names from 0 in order of their first mention: filters, INFO and FORMAT fields together,
    contigs apart; the scan is cut by file, so no task numbers them all.
    """
    place = F.struct("file", "at")
    space = F.when(F.col("kind").isin(*ID_KINDS), "ID").when(F.col("kind") == "contig", "CONTIG").otherwise(F.col("kind"))
    numbered = entries.withColumn("space", space)
    differs = lambda c: (F.min(F.coalesce(c, F.lit(""))) != F.max(F.coalesce(c, F.lit("")))) & F.first("kind").isin("INFO", "FORMAT")
    defined = numbered.groupBy("space", "kind", "id").agg(
        F.min(F.struct("file", "at", "number", "type")).alias("first"), differs(F.col("number")).alias("other_length"), differs(F.col("type")).alias("other_type")
    )
    names = numbered.groupBy("space", "id").agg(F.min(place).alias("p")).select("space", "id", "p.file", "p.at")
    names = names.withColumn("_slice", F.floor(F.col("file") / HEADERS_A_TASK))
    ranked = position_in_group(names, ["space"], ["file", "at"], ["_slice"], "rank")
    return defined.join(ranked.select("space", "id", (F.col("rank") - 1).alias("number_in")), ["space", "id"]).select(
        "kind", "id", "number_in", "first.number", "first.type", "other_length", "other_type"
    )


def translations(entries: DataFrame, merged: DataFrame) -> DataFrame:
    """(file, space, own, number_in): the number of each name in its own file and in the merged dictionary."""
    space = F.when(F.col("kind").isin(*ID_KINDS), "ID").when(F.col("kind") == "contig", "CONTIG").otherwise(F.col("kind"))
    named = merged.select(space.alias("space"), "id", "number_in").distinct()
    mentions = entries.select("file", space.alias("space"), "id", "at").groupBy("file", "space", "id").agg(F.min("at").alias("at"))
    own = position_in_group(mentions.withColumn("_slice", F.shiftright("at", 16)), ["file", "space"], ["at"], ["_slice"], "rank")
    return own.join(named, ["space", "id"]).select("file", "space", "id", (F.col("rank") - 1).alias("own"), "number_in")
