"""Paired-end runs with multi-mapped reads: alternatives of mates, EM over pairs, re-scored peaks; overlap by blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.adapters.driver_tables import VIEWS, load, view, view_sql
from crestline.catalog.common import D, OPTIONS, islands_sql, poisson_sql, q4, rounded, steps_sql, with_parts
from crestline.catalog.multi import _depth_parts, converged_sql
from crestline.catalog.peaks import GAP, above_sql
from crestline.catalog.tracks import _FR, FRAGMENT_COLUMNS, fragment_experiment
from crestline.functions.cigar import aligned_blocks, parse_cigar
from crestline.operators.overlap import assign_first_block, moved_blocks
from crestline.plans.multi import WEIGHT_UNITS, PairedMultiExperiment

_BASE = dict((a, e) for e, a in VIEWS["reads"][1])
_SPAN = dict((a, e) for e, a in FRAGMENT_COLUMNS)["span"]
_LEFT = [
    (_BASE["sample"], "sample"),
    (_BASE["read_id"], "read_id"),
    ("CAST(1 + l_orderkey % 2 AS INT)", "mate"),
    (_BASE["chrom"], "chrom"),
    ("CAST(0 AS INT)", "strand"),
    (_BASE["pos"], "start"),
    ("CASE WHEN l_linenumber = 4 THEN '20M600N30M' ELSE '50M' END", "cigar"),
    (_BASE["pos"], "lead"),
]
_RIGHT = [
    (_BASE["sample"], "sample"),
    (_BASE["read_id"], "read_id"),
    ("CAST(2 - l_orderkey % 2 AS INT)", "mate"),
    (f"CASE WHEN l_partkey % 11 = 0 THEN concat('chr', CAST(1 + (l_suppkey + 1) % 5 AS STRING)) ELSE {_BASE['chrom']} END", "chrom"),
    ("CAST(1 AS INT)", "strand"),
    (f"{_BASE['pos']} + {_SPAN} - 45", "start"),
    ("CASE WHEN l_linenumber = 5 THEN '5S45M' ELSE '45M' END", "cigar"),
    (_BASE["pos"], "lead"),
]
# mates: the left and the right one of each line, some without the other, some on another chromosome
_MATES = ((_LEFT, "l_partkey % 17 <> 0"), (_RIGHT, "l_partkey % 13 <> 0 OR l_partkey % 17 = 0"))


def mates(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem")
    left, right = (lines.where(where).selectExpr(*[f"{e} AS {a}" for e, a in columns]) for columns, where in _MATES)
    return left.unionByName(right)


_runs: dict[tuple[str, str], PairedMultiExperiment] = {}


def paired(spark: SparkSession, sf: str) -> PairedMultiExperiment:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _runs:
        _runs[key] = PairedMultiExperiment(fragment_experiment(spark, sf), mates(spark, sf))
    return _runs[key]


def alternatives(spark: SparkSession, sf: str) -> DataFrame:
    return paired(spark, sf).alternatives


def paired_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(paired(spark, sf).peak_reads, "ip", "input")


def paired_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(paired(spark, sf).rescored(), "ip_tags", "input_tags", "pileup", "fold", "pscore")


SHIFT = 40


def block_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """First region that any block of an alignment hits, per distinct position and CIGAR string."""
    sites = view(spark, sf, "alignments").selectExpr("rname AS chrom", "CAST(flag & 16 <> 0 AS INT) AS strand", "pos", "cigar").distinct()
    blocks = moved_blocks(aligned_blocks(F.col("pos"), parse_cigar(F.col("cigar"))), F.col("strand"), SHIFT)
    regions = view(spark, sf, "regions").selectExpr("chrom", "start", "stop", "payload AS pid")
    return assign_first_block(sites.withColumn("blocks", blocks), regions, ["chrom", "strand", "pos", "cigar"])


QUERIES = {
    "j1_paired_alignments": alternatives,
    "g15_paired_em": paired_totals,
    "k7_paired_peaks": paired_peaks,
    "j6_block_overlap": block_overlap,
}


def _block_sql(source: str, columns: str, name: str, shift: str) -> list[tuple[str, str]]:
    """Blocks of the distinct rows of ``source``, one a row, moved along the strand."""
    return [
        (f"{name}_site", f"SELECT DISTINCT {columns}, cigar FROM {source}"),
        (
            f"{name}_op",
            "SELECT *, CAST(lens[i] AS BIGINT) AS n, ops[i] AS op FROM (SELECT *, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=XB])', 1) AS lens,"
            f" regexp_extract_all(cigar, '(\\d+)([MIDNSHP=XB])', 2) AS ops FROM {name}_site), unnest(range(1, len(ops) + 1)) AS u(i)",
        ),
        (
            f"{name}_walk",
            "SELECT *, CAST(coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END)"
            f" OVER (PARTITION BY {columns}, cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS behind FROM {name}_op",
        ),
        (
            f"{name}_block",
            f"SELECT {columns}, cigar, greatest(here + behind + move, 0) AS b_start, greatest(here + behind + n - 1 + move, 0) AS b_stop"
            f" FROM (SELECT *, CASE WHEN strand = 0 THEN {shift} ELSE -({shift}) END AS move, {columns.split(', ')[-1]} AS here FROM {name}_walk, {'len' if shift != str(SHIFT) else '(SELECT 1)'})"
            " WHERE op IN ('M', '=', 'X')",
        ),
    ]


_CANDIDATES = [
    *_FR[:-6],
    (
        "ftags",
        "SELECT sample, chrom, pos, span FROM kept UNION ALL SELECT sample, chrom, pos, span FROM fr JOIN pr USING (sample, read_id) WHERE n_align > 1",
    ),
    ("fev", dict(_FR)["fev"].replace("FROM kept", "FROM ftags")),
    *_FR[-5:],
    ("signal", "SELECT * FROM fsignal"),
    *[(n, q) for n, q in steps_sql("fr") if n in ("rated", "pairs", "scored0", "scored", "hist", "q0", "qtable")],
    *above_sql("pscore", 5.0),
    *islands_sql("above", GAP),
    (
        "placed",
        "SELECT *, row_number() OVER (PARTITION BY chrom, island ORDER BY stop) AS rn, count(*) OVER (PARTITION BY chrom, island) AS n,"
        " min(start) OVER (PARTITION BY chrom, island) AS p_start, max(stop) OVER (PARTITION BY chrom, island) AS p_stop FROM islands",
    ),
    (
        "candidates",
        "SELECT chrom, p_start AS start, p_stop AS stop, row_number() OVER (ORDER BY chrom, p_stop) AS pid"
        " FROM placed, len WHERE rn = (n + 1) // 2 AND p_stop - p_start >= d",
    ),
    ("scales", "SELECT CASE WHEN t > c THEN 1e0 / r ELSE 1e0 END AS ts, CASE WHEN t > c THEN 1e0 ELSE r END AS cs FROM sc"),
]

_SITES = "chrom, strand, start"
_ALTERNATIVES = [
    *_CANDIDATES,
    ("mates", " UNION ALL ".join(f"SELECT {', '.join(f'{e} AS {a}' for e, a in columns)} FROM lineitem WHERE {where}" for columns, where in _MATES)),
    *_block_sql("mates", _SITES, "m", "d // 2"),
    (
        "m_pid",
        f"SELECT b.chrom, strand, b.start, cigar, min(pid) AS pid FROM m_block b JOIN candidates c ON b.chrom = c.chrom AND b_stop >= c.start AND b_start <= c.stop GROUP BY ALL",
    ),
    (
        "m_rank",
        "SELECT *, start + CASE WHEN cigar = '20M600N30M' THEN 650 WHEN cigar = '50M' THEN 50 ELSE 45 END AS stop, row_number() OVER (PARTITION BY sample, read_id, mate"
        " ORDER BY chrom, lead, start, strand, cigar) AS rn FROM mates LEFT JOIN m_pid USING (chrom, strand, start, cigar)",
    ),
    (
        "z",
        "SELECT coalesce(a.sample, b.sample) AS sample, coalesce(a.read_id, b.read_id) AS read_id, coalesce(a.rn, b.rn) AS rn, a.chrom AS c1, b.chrom AS c2,"
        " a.pid AS p1, b.pid AS p2, least(CASE WHEN a.strand = 0 THEN a.start END, CASE WHEN b.strand = 0 THEN b.start END) AS forward, greatest(a.stop, b.stop) AS last"
        " FROM (SELECT * FROM m_rank WHERE mate = 1) a FULL JOIN (SELECT * FROM m_rank WHERE mate = 2) b ON a.sample = b.sample AND a.read_id = b.read_id AND a.rn = b.rn",
    ),
    (
        "alternatives",
        "SELECT sample, read_id, CAST(rn AS INT) AS rn, multi, coalesce(p1, p2) AS pid, greatest(coalesce(forward, last - d), 0) AS frag_start"
        " FROM (SELECT *, max(rn) OVER (PARTITION BY sample, read_id) > 1 AS multi FROM z), len"
        " WHERE coalesce(p1, p2) IS NOT NULL AND coalesce(c1 = c2, true) AND coalesce(p1 = p2, true)",
    ),
]
_RUN = [
    *_ALTERNATIVES,
    ("uniq_pos", "SELECT sample, pid, frag_start, count(*) AS n FROM alternatives WHERE NOT multi GROUP BY ALL"),
    ("uniq_peak", "SELECT sample, pid, CAST(sum(n) AS BIGINT) AS n FROM uniq_pos GROUP BY ALL"),
    ("ma", "SELECT sample, read_id, pid, frag_start FROM alternatives WHERE multi"),
    (
        "peak_u",
        "SELECT c.pid, c.stop - c.start + 1 AS len, coalesce(t.n, 0) AS ut, coalesce(k.n, 0) AS uc FROM candidates c"
        " LEFT JOIN (SELECT pid, n FROM uniq_peak WHERE sample = 'T') t USING (pid)"
        " LEFT JOIN (SELECT pid, n FROM uniq_peak WHERE sample = 'C') k USING (pid)",
    ),
    *converged_sql((OPTIONS.iterations + 1) // 2),
]
_U = f"{WEIGHT_UNITS}e0"
_DEPTHS = [
    (name, sql.replace(f"frag_start + {D}, -u FROM posn", "frag_start + d, -u FROM posn, (SELECT d AS d FROM len)") if name == "wev" else sql)
    for name, sql in _depth_parts(f"SELECT * FROM mpos UNION ALL SELECT sample, pid, frag_start, n * {WEIGHT_UNITS} FROM uniq_pos")
]

ORACLE = {
    "j1_paired_alignments": with_parts(_ALTERNATIVES, "SELECT * FROM alternatives"),
    "g15_paired_em": with_parts(_RUN, f"SELECT pid, {q4('ip')} AS ip, {q4('input')} AS input FROM peak_prime"),
    "k7_paired_peaks": with_parts(
        [
            *_RUN,
            *_DEPTHS,
            (
                "tops",
                f"SELECT *, t / {_U} * ts AS treat, c / {_U} * cs AS ctrl, row_number() OVER (PARTITION BY pid ORDER BY t DESC, stop) AS rn,"
                " min(stop) OVER (PARTITION BY pid) AS p_start, max(stop) OVER (PARTITION BY pid) AS p_stop FROM wdepth, scales",
            ),
            (
                "summits",
                "SELECT pid, p_start, p_stop, treat, floor(treat + 0.5e0) AS k, floor((ctrl + 0.5e0) * 100000e0 + 0.5e0) / 100000e0 AS lam FROM tops WHERE rn = 1",
            ),
            (
                "final",
                "SELECT pid, chrom, p_start AS start, p_stop AS stop, (ip + 0.1e0) * ts AS ip_tags, (input + 0.1e0) * cs AS input_tags,"
                f" treat AS pileup, g.fold, {poisson_sql('k', 'lam')} AS pscore FROM summits JOIN gated g USING (pid) JOIN candidates USING (pid), scales",
            ),
        ],
        "SELECT pid, chrom, start, stop, "
        + ", ".join(f"{q4(c)} AS {c}" for c in ("ip_tags", "input_tags", "pileup", "fold", "pscore"))
        + " FROM final",
    ),
    "j6_block_overlap": with_parts(
        [
            ("al", view_sql("alignments")),
            ("regions", view_sql("regions")),
            ("sites", "SELECT rname AS chrom, CAST(flag & 16 <> 0 AS INT) AS strand, pos, cigar FROM al"),
            *_block_sql("sites", "chrom, strand, pos", "s", str(SHIFT)),
        ],
        "SELECT b.chrom, strand, pos, cigar, min(payload) AS pid FROM s_block b JOIN regions r ON b.chrom = r.chrom AND b_stop >= r.start AND b_start <= r.stop GROUP BY ALL",
    ),
}
