"""Reads over candidate regions: overlap, EM, weighted depth, re-scored peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.catalog.common import D, OPTIONS, experiment, poisson_sql, q4, r4, rounded, with_parts
from crestline.catalog.peaks import CANDIDATES
from crestline.operators import em
from crestline.operators.sweep import coalesce_equal
from crestline.plans.multi import WEIGHT_UNITS, MultiExperiment



def multi(spark: SparkSession, sf: str) -> MultiExperiment:
    base = experiment(spark, sf)
    if not hasattr(base, "multi_run"):
        base.multi_run = MultiExperiment(base)
    return base.multi_run


def overlap_first(spark: SparkSession, sf: str) -> DataFrame:
    return multi(spark, sf).placed_tags


def peak_reads(spark: SparkSession, sf: str) -> DataFrame:
    return multi(spark, sf).unique_counts.select("sample", "pid", "n")


def peaks_with_multi(spark: SparkSession, sf: str) -> DataFrame:
    return multi(spark, sf).with_multi


def start_weights(spark: SparkSession, sf: str) -> DataFrame:
    m = multi(spark, sf)
    weights = em.start_by_read(m.multi_alignments.where("sample = 'T'"), m.peak_table("T"))
    return weights.select("read_id", "pid", "m", r4("w").alias("w"))


def equal_weight(spark: SparkSession, sf: str) -> DataFrame:
    m = multi(spark, sf)
    weights = em.equal_by_read(m.multi_alignments.where("sample = 'C'"))
    return weights.select("read_id", "pid", "m", r4("w").alias("w"))


def _by_read(m: MultiExperiment, weights: DataFrame, sample: str) -> DataFrame:
    """Weight of each (read, region), from the weight of the read's class."""
    pairs = m.multi_alignments.where(F.col("sample") == sample).groupBy("sample", "read_id", "pid").agg(F.count(F.lit(1)).alias("m"))
    tagged = pairs.join(m.classes.of_read, ["sample", "read_id"])
    joined = tagged.join(weights.select("sample", "class_id", "pid", "w"), ["sample", "class_id", "pid"])
    return joined.select("read_id", "pid", "m", r4("w").alias("w"))


def em_three(spark: SparkSession, sf: str) -> DataFrame:
    m = multi(spark, sf)
    weights = em.fixed_rounds(m.classes.members.where("sample = 'T'"), m.peak_table("T"), 3)
    return _by_read(m, weights, "T")


def em_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(multi(spark, sf).peak_reads, "ip", "input")


def gate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(multi(spark, sf).gated, "ip", "input", "fold")


def weighted_pileup(spark: SparkSession, sf: str) -> DataFrame:
    depths = multi(spark, sf).region_depths()
    return depths.select(
        "pid", "start", "stop", *[r4(F.col(c) / float(WEIGHT_UNITS)).alias(c) for c in ("t", "c")]
    )


def multi_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(multi(spark, sf).rescored(), "ip_tags", "input_tags", "pileup", "fold", "pscore")


def multi_bedgraph(spark: SparkSession, sf: str) -> DataFrame:
    """Depth of the multi-mapped treatment reads in each region, above 1e-5."""
    depths = multi(spark, sf).region_depths(multi_only=True)
    track = depths.select("pid", "start", "stop", (F.col("t") / float(WEIGHT_UNITS)).alias("value"))
    merged = coalesce_equal(track, ["pid"], "value").where("value > 0.00001")
    return rounded(merged, "value")


QUERIES = {
    "j6_overlap_first": overlap_first,
    "g13_peak_reads": peak_reads,
    "g17_peaks_with_multi": peaks_with_multi,
    "d15_start_weights": start_weights,
    "g16_equal_weight": equal_weight,
    "g15_em_three_steps": em_three,
    "g15_em_converged": em_totals,
    "p17_multi_gate": gate,
    "g11_weighted_pileup": weighted_pileup,
    "k7_multi_peaks": multi_peaks,
    "k6_multi_bedgraph": multi_bedgraph,
}

HALF, TAG = D // 2, OPTIONS.tag_size

PLACED = [
    *CANDIDATES,
    (
        "blocks",
        "SELECT DISTINCT chrom, strand, pos,"
        f" greatest(CASE WHEN strand = 0 THEN pos + {HALF} ELSE pos - {TAG - 1} - {HALF} END, 0) AS b_start,"
        f" greatest(CASE WHEN strand = 0 THEN pos + {TAG - 1} + {HALF} ELSE pos - {HALF} END, 0) AS b_stop,"
        f" greatest(CASE WHEN strand = 0 THEN pos ELSE pos - {D} END, 0) AS frag_start FROM reads",
    ),
    (
        "tag_pid",
        "SELECT b.chrom, b.strand, b.pos, min(c.pid) AS pid, min(frag_start) AS frag_start FROM blocks b JOIN candidates c"
        " ON b.chrom = c.chrom AND b_stop >= c.start AND b_start <= c.stop GROUP BY ALL",
    ),
    (
        "inside",
        "SELECT sample, read_id, n_align, pid, frag_start FROM reads JOIN tag_pid USING (chrom, strand, pos) JOIN per_read USING (sample, read_id)",
    ),
    ("uniq_pos", "SELECT sample, pid, frag_start, count(*) AS n FROM inside WHERE n_align = 1 GROUP BY ALL"),
    ("uniq_peak", "SELECT sample, pid, CAST(sum(n) AS BIGINT) AS n FROM uniq_pos GROUP BY ALL"),
    ("ma", "SELECT sample, read_id, pid, frag_start FROM inside WHERE n_align > 1"),
    (
        "peak_u",
        "SELECT c.pid, c.stop - c.start + 1 AS len, coalesce(t.n, 0) AS ut, coalesce(k.n, 0) AS uc FROM candidates c"
        " LEFT JOIN (SELECT pid, n FROM uniq_peak WHERE sample = 'T') t USING (pid)"
        " LEFT JOIN (SELECT pid, n FROM uniq_peak WHERE sample = 'C') k USING (pid)",
    ),
]


def _weights(rate_table: str, rate: str) -> str:
    return (
        f"SELECT *, CASE WHEN sum({rate}) OVER (PARTITION BY read_id) > 0 THEN {rate} / sum({rate}) OVER (PARTITION BY read_id)"
        f" ELSE 1e0 / count(*) OVER (PARTITION BY read_id) END AS w FROM"
        f" (SELECT read_id, pid, frag_start FROM ma WHERE sample = 'T') JOIN {rate_table} USING (pid)"
    )


def em_sql(steps: int) -> list[tuple[str, str]]:
    """The EM on single alignments, unrolled."""
    parts = [
        ("rate0", "SELECT pid, CAST(ut AS DOUBLE) / len AS r0 FROM peak_u"),
        ("w0", _weights("rate0", "r0")),
    ]
    for i in range(1, steps + 1):
        parts += [
            (
                f"rate{i}",
                f"SELECT pid, (ut + coalesce(sw, 0e0)) / len AS r{i} FROM peak_u LEFT JOIN (SELECT pid, sum(w) AS sw FROM w{i - 1} GROUP BY ALL) USING (pid)",
            ),
            (f"w{i}", _weights(f"rate{i}", f"r{i}")),
        ]
    return parts


_READ_WEIGHT = "SELECT read_id, pid, count(*) AS m, " + q4("max(w)") + " AS w FROM {} GROUP BY ALL"
_EQUAL = (
    "wc",
    "SELECT read_id, pid, frag_start, 1e0 / count(*) OVER (PARTITION BY read_id) AS w FROM ma WHERE sample = 'C'",
)

ORACLE = {
    "j6_overlap_first": with_parts(PLACED, "SELECT chrom, strand, pos, pid, frag_start FROM tag_pid"),
    "g13_peak_reads": with_parts(PLACED, "SELECT sample, pid, n FROM uniq_peak"),
    "g17_peaks_with_multi": with_parts(PLACED, "SELECT DISTINCT pid FROM ma WHERE sample = 'T'"),
    "d15_start_weights": with_parts([*PLACED, *em_sql(0)], _READ_WEIGHT.format("w0")),
    "g16_equal_weight": with_parts([*PLACED, _EQUAL], _READ_WEIGHT.format("wc")),
    "g15_em_three_steps": with_parts([*PLACED, *em_sql(3)], _READ_WEIGHT.format("w3")),
}


def converged_sql(max_steps: int) -> list[tuple[str, str]]:
    """All ``max_steps`` rounds, then the first one at which no weight moved."""
    parts = em_sql(max_steps)
    keys = "read_id, pid, frag_start"
    moves = " UNION ALL ".join(
        f"SELECT {i} AS step, count(*) FILTER (n.w > 0.01e0 AND abs(o.w - n.w) / n.w > 0.01e0) AS moved"
        f" FROM (SELECT DISTINCT read_id, pid, w FROM w{i - 1}) o JOIN (SELECT DISTINCT read_id, pid, w FROM w{i}) n USING (read_id, pid)"
        for i in range(1, max_steps + 1)
    )
    every = " UNION ALL ".join(f"SELECT {i} AS step, {keys}, w FROM w{i}" for i in range(1, max_steps + 1))
    return [
        *parts,
        ("moves", moves),
        ("chosen", f"SELECT coalesce(min(step) FILTER (moved = 0), {max_steps}) AS step FROM moves"),
        ("wt", f"SELECT {keys}, w FROM ({every}) WHERE step = (SELECT step FROM chosen)"),
        _EQUAL,
        (
            "peak_prime",
            "SELECT pid, ut + coalesce(st, 0e0) AS ip, uc + coalesce(sc, 0e0) AS input FROM peak_u"
            " LEFT JOIN (SELECT pid, sum(w) AS st FROM wt GROUP BY ALL) USING (pid)"
            " LEFT JOIN (SELECT pid, sum(w) AS sc FROM wc GROUP BY ALL) USING (pid)",
        ),
        (
            "gated",
            "SELECT pid, ip, input, (ip + 0.1e0) * ts / ((input + 0.1e0) * cs) AS fold FROM peak_prime, scales"
            f" WHERE pid IN (SELECT pid FROM wt) AND ip * ts > {OPTIONS.min_pileup!r} AND (ip + 0.1e0) * ts / ((input + 0.1e0) * cs) > {OPTIONS.min_fold!r}",
        ),
        (
            "mpos",
            f"SELECT 'T' AS sample, pid, frag_start, CAST(floor(w * {WEIGHT_UNITS}e0 + 0.5e0) AS BIGINT) AS u FROM wt WHERE w >= 0.01e0"
            f" UNION ALL SELECT 'C', pid, frag_start, CAST(floor(w * {WEIGHT_UNITS}e0 + 0.5e0) AS BIGINT) FROM wc WHERE w >= 0.01e0",
        ),
    ]


def _depth_parts(source: str) -> list[tuple[str, str]]:
    """Depth per region and side, each side on its own, then merged."""
    return [
        ("posn", f"SELECT sample, pid, frag_start, u FROM ({source}) WHERE pid IN (SELECT pid FROM gated)"),
        (
            "wev",
            f"SELECT sample, pid, frag_start AS pos, u AS d FROM posn UNION ALL SELECT sample, pid, frag_start + {D}, -u FROM posn",
        ),
        ("wat", "SELECT sample, pid, pos, CAST(sum(d) AS BIGINT) AS d FROM wev GROUP BY ALL"),
        (
            "wranked",
            "SELECT *, row_number() OVER w AS rn, CAST(coalesce(sum(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS depth"
            " FROM wat WINDOW w AS (PARTITION BY sample, pid ORDER BY pos)",
        ),
        (
            "wwide",
            "SELECT pid, pos, max(depth) FILTER (sample = 'T') AS t, max(depth) FILTER (sample = 'C') AS c FROM wranked"
            " WHERE pos > 0 AND (d <> 0 OR rn = 1) GROUP BY ALL",
        ),
        (
            "wfilled",
            "SELECT pid, pos, "
            + ", ".join(
                f"last_value({s} IGNORE NULLS) OVER (PARTITION BY pid ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {s}"
                for s in "tc"
            )
            + " FROM wwide",
        ),
        (
            "wdepth",
            "SELECT pid, lag(pos, 1, 0) OVER (PARTITION BY pid ORDER BY pos) AS start, pos AS stop, t, c FROM wfilled WHERE t IS NOT NULL AND c IS NOT NULL",
        ),
    ]


_STEPS = (OPTIONS.iterations + 1) // 2
CONVERGED = [*PLACED, *converged_sql(_STEPS)]
_ALL = f"SELECT * FROM mpos UNION ALL SELECT sample, pid, frag_start, n * {WEIGHT_UNITS} FROM uniq_pos"
_U = f"{WEIGHT_UNITS}e0"

ORACLE |= {
    "g15_em_converged": with_parts(CONVERGED, f"SELECT pid, {q4('ip')} AS ip, {q4('input')} AS input FROM peak_prime"),
    "p17_multi_gate": with_parts(
        CONVERGED, f"SELECT pid, {q4('ip')} AS ip, {q4('input')} AS input, {q4('fold')} AS fold FROM gated"
    ),
    "g11_weighted_pileup": with_parts(
        [*CONVERGED, *_depth_parts(_ALL)], f"SELECT pid, start, stop, {q4(f't / {_U}')} AS t, {q4(f'c / {_U}')} AS c FROM wdepth"
    ),
    "k7_multi_peaks": with_parts(
        [
            *CONVERGED,
            *_depth_parts(_ALL),
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
    "k6_multi_bedgraph": with_parts(
        [
            *CONVERGED,
            *_depth_parts("SELECT * FROM mpos"),
            ("runs0", f"SELECT pid, start, stop, t / {_U} AS value, lag(t / {_U}) OVER (PARTITION BY pid ORDER BY stop) AS pv FROM wdepth"),
            (
                "runs",
                "SELECT *, sum(CASE WHEN abs(value - pv) <= 0.00001e0 THEN 0 ELSE 1 END) OVER (PARTITION BY pid ORDER BY stop ROWS UNBOUNDED PRECEDING) AS run FROM runs0",
            ),
        ],
        f"SELECT pid, min(start) AS start, max(stop) AS stop, {q4('min_by(value, stop)')} AS value FROM runs GROUP BY pid, run HAVING min_by(value, stop) > 0.00001e0",
    ),
}
