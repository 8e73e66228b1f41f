"""Any tab-separated file with a contig and a position: columns by role, rows of a region by pushed filters.

Rows are read by Spark's own delimited reader, so the contig and coordinate tests of a region are pushed into the scan
and lines outside it are dropped while they are parsed, before any row is made.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions.cigar import parse_cigar, reference_length


@dataclass(frozen=True)
class Roles:
    """Which columns (from 1) hold contig, begin and end, and how positions count.

    ``end`` 0 means that the end follows from the row: one base, or what ``length`` (``ref``, ``cigar``) says of another
    column.  ``zero_based`` positions are half-open, others closed and from 1.
    """

    contig: int
    begin: int
    end: int = 0
    zero_based: bool = False
    comment: str = "#"
    length: str = ""
    length_column: int = 0
    skip_first: bool = False


# The columns of the usual formats.
PRESETS = {
    "gff": Roles(1, 4, 5),
    "bed": Roles(1, 2, 3, zero_based=True),
    "psltbl": Roles(15, 17, 18, zero_based=True),
    "sam": Roles(3, 4, comment="@", length="cigar", length_column=6),
    "vcf": Roles(1, 2, length="ref", length_column=4),
}


def _name(k: int) -> str:
    return f"c{k}"


def read_tabbed(spark: SparkSession, path: str, roles: Roles, width: int = 0) -> DataFrame:
    """The first ``width`` columns (as many as the roles need at least) as c1, c2, ...; begin and end are numbers."""
    width = max(width, roles.contig, roles.begin, roles.end, roles.length_column)
    numbers = {roles.begin, roles.end}
    schema = ", ".join(f"{_name(k)} {'long' if k in numbers else 'string'}" for k in range(1, width + 1))
    reader = spark.read.schema(schema).option("sep", "\t").option("comment", roles.comment).option("quote", "").option("header", roles.skip_first)
    # with a header the names come from the schema still; values are kept as they are
    return reader.option("enforceSchema", True).option("nullValue", "").option("emptyValue", "").csv(path)


def interval(roles: Roles) -> tuple[Column, Column]:
    """0-based half-open start and stop of a row."""
    begin = F.col(_name(roles.begin)) - (0 if roles.zero_based else 1)
    if roles.end:
        return begin, F.greatest(F.col(_name(roles.end)), begin + 1)
    if roles.length == "ref":
        return begin, begin + F.length(_name(roles.length_column))
    if roles.length == "cigar":
        return begin, begin + F.greatest(reference_length(parse_cigar(F.col(_name(roles.length_column)))), F.lit(1))
    return begin, begin + 1


def in_region(rows: DataFrame, roles: Roles, contig: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows that overlap ``[start, stop)`` of a contig, with chrom, start and stop.

    What can be said of the raw columns is said of them, so that it reaches the scan; the end that follows from a row is
    tested after it.
    """
    begin_raw, (begin, end) = F.col(_name(roles.begin)), interval(roles)
    rows = rows.where(F.col(_name(roles.contig)) == contig)
    if stop is not None:
        rows = rows.where(begin_raw < stop + (0 if roles.zero_based else 1))
    if start is not None and roles.end:
        rows = rows.where((F.col(_name(roles.end)) > start) | (begin_raw >= start + (0 if roles.zero_based else 1)))
    out = rows.select(F.col(_name(roles.contig)).alias("chrom"), begin.alias("start"), end.alias("stop"), *rows.columns)
    return out if start is None else out.where(F.col("stop") > start)


def in_regions(rows: DataFrame, roles: Roles, regions: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Rows that overlap any of a few regions, each row once; the regions' contigs and outer bounds reach the scan."""
    begin, end = interval(roles)
    contigs = sorted({c for c, _, _ in regions})
    last = max((e for _, _, e in regions), default=0)
    rows = rows.where(F.col(_name(roles.contig)).isin(contigs) & (F.col(_name(roles.begin)) < last + (0 if roles.zero_based else 1)))
    out = rows.select(F.col(_name(roles.contig)).alias("chrom"), begin.alias("start"), end.alias("stop"), *rows.columns)
    hit = F.lit(False)
    for c, s, e in regions:
        hit = hit | ((F.col("chrom") == c) & (F.col("start") < e) & (F.col("stop") > s))
    return out.where(hit)
