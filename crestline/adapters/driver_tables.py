"""Sequencing views over the star-schema test tables.

Each view is a list of select expressions that Spark and any SQL engine read
alike, so that the same rows come out on both sides of a comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAGMENT = 200
TAG_SIZE = 50
GENOME_SIZE = 1_000_000
CONTIG_LENGTH = 250_000
CONTIGS = [f"chr{i}" for i in range(1, 6)]

_MULTI = "l_orderkey % 3 = 0"
_POS = (
    "CAST(2000 + (l_partkey % 50) * 4000"
    " + (l_orderkey * 7 + l_linenumber * 13 + l_suppkey * 3) % 400 AS BIGINT)"
)
_CHROM = "concat('chr', CAST(1 + l_suppkey % 5 AS STRING))"
_SAMPLE = "CASE WHEN (l_partkey % 50 < 10) = (l_orderkey % 4 <> 0) THEN 'T' ELSE 'C' END"
_QLEN = "CAST(30 + l_quantity AS INT)"

# name -> (table, [(expression, column)])
VIEWS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    # one row per alignment; a read id with several rows is multi-mapped
    "reads": (
        "lineitem",
        [
            (f"CASE WHEN {_MULTI} THEN l_orderkey * 16 ELSE l_orderkey * 16 + l_linenumber + 1 END", "read_id"),
            (_CHROM, "chrom"),
            (_POS, "pos"),
            ("CAST((l_orderkey + l_linenumber) % 2 AS INT)", "strand"),
            (_SAMPLE, "sample"),
        ],
    ),
    # full alignment records of a paired-end run
    "alignments": (
        "lineitem",
        [
            (
                "concat('read', CAST(l_orderkey AS STRING), CASE l_orderkey % 4 WHEN 0 THEN '/1' WHEN 1 THEN '.1'"
                " WHEN 2 THEN '.2' ELSE '' END)",
                "qname",
            ),
            (
                "CAST(1 + CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN l_suppkey % 19 = 0 THEN 4 ELSE 0 END"
                " + CASE WHEN (l_orderkey + l_linenumber) % 2 = 1 THEN 16 ELSE 32 END"
                " + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END"
                " + CASE WHEN l_partkey % 29 = 0 THEN 512 ELSE 0 END"
                " + CASE WHEN l_partkey % 13 = 0 THEN 1024 ELSE 0 END AS INT)",
                "flag",
            ),
            (_CHROM, "rname"),
            (_POS, "pos"),
            ("CAST(l_quantity AS INT)", "mapq"),
            (
                "CASE l_linenumber"
                f" WHEN 1 THEN concat(CAST({_QLEN} AS STRING), 'M')"
                f" WHEN 2 THEN concat('5S', CAST({_QLEN} AS STRING), 'M')"
                f" WHEN 3 THEN concat(CAST({_QLEN} AS STRING), 'M3D10M')"
                f" WHEN 4 THEN concat(CAST({_QLEN} AS STRING), 'M200N20M')"
                f" WHEN 5 THEN concat('4H', CAST({_QLEN} AS STRING), 'M2I6M')"
                f" WHEN 6 THEN concat(CAST({_QLEN} AS STRING), '=1X4=')"
                f" ELSE concat(CAST({_QLEN} AS STRING), 'M2P8M3S') END",
                "cigar",
            ),
            ("'='", "rnext"),
            (f"{_POS} + l_linenumber * 10", "pnext"),
            ("CAST((CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END) * (150 + l_orderkey % 90) AS INT)", "tlen"),
            (
                f"substring(repeat('ACGTTGCANC', 12), 1, {_QLEN} + CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 5"
                " WHEN 3 THEN 10 WHEN 4 THEN 20 WHEN 5 THEN 8 WHEN 6 THEN 5 ELSE 11 END)",
                "seq",
            ),
            ("CAST(floor(l_discount * 100 + 0.5) AS INT)", "nm"),
            ("l_returnflag", "xt"),
            (_SAMPLE, "sample"),
        ],
    ),
    "regions": (
        "part",
        [
            ("concat('chr', CAST(1 + p_partkey % 5 AS STRING))", "chrom"),
            ("CAST(2000 + (p_partkey % 50) * 4000 + p_partkey % 97 AS BIGINT)", "start"),
            ("CAST(2000 + (p_partkey % 50) * 4000 + p_partkey % 97 + p_size * 10 AS BIGINT)", "stop"),
            ("p_partkey", "payload"),
        ],
    ),
    # exons of a gene, closed intervals; the gene is the customer of the line's order
    "exons": (
        "lineitem JOIN orders ON l_orderkey = o_orderkey",
        [
            ("o_custkey", "gene"),
            ("concat('chr', CAST(1 + o_custkey % 5 AS STRING))", "chrom"),
            ("CAST(o_custkey % 2 AS INT)", "strand"),
            ("CASE WHEN l_linenumber = 1 THEN 'UTR5' WHEN l_linenumber >= 6 THEN 'UTR3' ELSE 'CDS' END", "type"),
            ("CAST(2000 + (o_custkey % 50) * 4000 + l_linenumber * 60 + l_partkey % 40 AS BIGINT)", "start"),
            ("CAST(2000 + (o_custkey % 50) * 4000 + l_linenumber * 60 + l_partkey % 40 + 9 + l_quantity AS BIGINT)", "stop"),
        ],
    ),
    "variants": (
        "part",
        [
            ("concat('chr', CAST(1 + p_partkey % 5 AS STRING))", "chrom"),
            ("CAST(1 + (p_partkey * 37) % 20000 AS BIGINT)", "pos"),
            ("substring('ACGTACGGT', CAST(1 + p_partkey % 6 AS INT), CAST(1 + p_size % 3 AS INT))", "ref"),
            ("substring('CATGACGTA', CAST(1 + p_partkey % 5 AS INT), CAST(1 + p_partkey % 3 AS INT))", "alt"),
            ("CAST(p_size AS INT)", "qual"),
            ("CASE WHEN p_size % 5 = 0 THEN 'q10' WHEN p_size % 7 = 0 THEN 'q10;s50' ELSE 'PASS' END", "filter"),
            ("concat('DP=', CAST(p_size AS STRING), ';AF=', CAST((p_partkey % 10) / 10e0 AS STRING), CASE WHEN p_partkey % 4 = 0 THEN ';DB' ELSE '' END)", "info"),
            ("p_partkey", "vid"),
        ],
    ),
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    table, _, joined = source.partition(" JOIN ")
    rows = load(spark, sf_dir, table)
    if joined:
        other, _, condition = joined.partition(" ON ")
        rows = rows.join(load(spark, sf_dir, other), F.expr(condition))
    return rows.selectExpr(*[f"{expr} AS {alias}" for expr, alias in columns])


def view_sql(name: str) -> str:
    """The same view as a query text."""
    table, columns = VIEWS[name]
    return f"SELECT {', '.join(f'{expr} AS {alias}' for expr, alias in columns)} FROM {table}"
