"""Tags, duplicate caps, pileups, paired signal and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.adapters.driver_tables import VIEWS, load, view, view_sql
from crestline.catalog.common import (
    D,
    L,
    OPTIONS,
    READS,
    SIGNAL,
    TOTALS,
    TRACKS,
    WINDOWS,
    experiment,
    q4,
    r4,
    rounded,
    with_parts,
)
from crestline.functions.stats import poisson_log10_lower
from crestline.operators import scoring
from crestline.plans.narrow import Experiment, FragmentExperiment
from crestline.operators.reads import library_counts, multi_weights
from crestline.operators.running import position_in_group, tile_of
from crestline.operators.sweep import (
    centred_ends,
    clamp,
    coalesce_equal,
    combine_steps,
    directed_ends,
    max_steps,
    step_events,
    sweep,
)
from crestline.operators.tags import cap_duplicates, number_copies, pile_tags


def extend_tags(spark: SparkSession, sf: str) -> DataFrame:
    reads = view(spark, sf, "reads")
    start, stop = directed_ends(F.col("strand"), F.col("pos"), D, 10)
    return reads.select(
        "sample", "chrom", "strand", "pos", clamp(start, L).alias("start"), clamp(stop, L).alias("stop")
    )


def uniq_multi(spark: SparkSession, sf: str) -> DataFrame:
    per_read = experiment(spark, sf).per_read
    return per_read.select("sample", "read_id", "n_align", (F.col("n_align") > 1).alias("is_multi"))


def multi_weight(spark: SparkSession, sf: str) -> DataFrame:
    weighted = multi_weights(view(spark, sf, "reads"))
    return rounded(weighted.select("sample", "read_id", "chrom", "pos", "strand", "n_align", "weight"), "weight")


def library_totals(spark: SparkSession, sf: str) -> DataFrame:
    return library_counts(experiment(spark, sf).per_read)


def redundancy(spark: SparkSession, sf: str) -> DataFrame:
    ex = experiment(spark, sf)
    kept = ex.capped.groupBy("sample").agg(F.sum("n").alias("n_kept"))
    raw = ex.tracks.groupBy("sample").agg(F.sum("n_unique").alias("n_unique"))
    both = raw.join(kept, "sample")
    return both.select(
        "sample", "n_unique", "n_kept", r4((F.col("n_unique") - F.col("n_kept")) / F.col("n_unique")).alias("rate")
    )


def dedup_cap(spark: SparkSession, sf: str) -> DataFrame:
    piled = pile_tags(view(spark, sf, "reads"))
    one = cap_duplicates(piled, 1).select("sample", "chrom", "strand", "pos", "n")
    two = cap_duplicates(piled, {"T": 2, "C": 2}).select("sample", "chrom", "strand", "pos", F.col("n").alias("n2"))
    return one.join(two, ["sample", "chrom", "strand", "pos"])


def dup_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Number of each copy at its position, from the count alone."""
    return number_copies(pile_tags(view(spark, sf, "reads")), ["sample", "chrom", "strand", "pos"])


def tag_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return experiment(spark, sf).tracks.select("sample", "chrom", "strand", "pos", "n_unique", "n_multi")


def sorted_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Position of every distinct tag in its chromosome and strand order."""
    piled = pile_tags(view(spark, sf, "reads")).withColumn("tile", tile_of("pos"))
    return position_in_group(piled, ["sample", "chrom", "strand"], ["pos"], ["tile"]).drop("tile")


def pileup_treat(spark: SparkSession, sf: str) -> DataFrame:
    ex = experiment(spark, sf)
    start, stop = directed_ends(F.col("strand"), F.col("pos"), D)
    tags = ex.capped.where("sample = 'T'")
    events = step_events(tags, ["chrom"], {"depth": (start, stop, F.col("n"))}, L)
    return sweep(events, ["chrom"], ["depth"])


def contig_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Treatment depth clamped by a table of contig lengths; a contig it lacks is endless."""
    contigs = load(spark, sf, "region").where("r_regionkey < 4").selectExpr(
        "concat('chr', CAST(r_regionkey + 1 AS STRING)) AS chrom", "CAST(110000 + 30000 * r_regionkey AS BIGINT) AS length"
    )
    ex = Experiment(view(spark, sf, "reads"), OPTIONS, contigs=contigs)
    start, stop = directed_ends(F.col("strand"), F.col("pos"), D)
    tags = ex.sized(experiment(spark, sf).capped.where("sample = 'T'"))
    return sweep(step_events(tags, ["chrom"], {"depth": (start, stop, F.col("n"))}, F.col("_length")), ["chrom"], ["depth"])


def pileup_control(spark: SparkSession, sf: str) -> DataFrame:
    """Raw depths of the three control windows and their scaled maximum."""
    ex = experiment(spark, sf)
    tags = ex.capped.where("sample = 'C'")
    spans = {f"c{i}": (*centred_ends(F.col("pos"), w), F.col("n")) for i, w in enumerate(WINDOWS)}
    depths = sweep(step_events(tags, ["chrom"], spans, L), ["chrom"], list(spans))
    scaled = [F.col(f"c{i}") * (D / w) for i, w in enumerate(WINDOWS)]
    return depths.select("chrom", "start", "stop", *spans, r4(F.greatest(*scaled)).alias("local_max"))


def pair_signal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(experiment(spark, sf).signal, "treat", "ctrl")


EVENT_TYPES = {"click": "clicks", "view": "views", "signup": "signups", "error": "errors", "purchase": "purchases"}


def _event_steps(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Step functions of arbitrary doubles: per user, event values along the id."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    base = events.select(
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("chrom"),
        (F.col("event_id") + 1).alias("stop"),
        "value",
        "event_type",
    )
    return {name: base.where(F.col("event_type") == kind).drop("event_type") for kind, name in EVENT_TYPES.items()}


def merge_steps(spark: SparkSession, sf: str) -> DataFrame:
    return combine_steps(_event_steps(spark, sf), ["chrom"])


def pointwise_max(spark: SparkSession, sf: str) -> DataFrame:
    return max_steps(_event_steps(spark, sf), ["chrom"])


def paired_end_pileup(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of proper pairs, one copy per (start, stop): both strands' span."""
    alignments = view(spark, sf, "alignments")
    fragments = alignments.where("flag & 516 = 0 AND tlen > 0").selectExpr(
        "rname AS chrom", "pos AS start", "pos + abs(tlen) AS stop"
    )
    distinct = fragments.groupBy("chrom", "start", "stop").agg(F.lit(1).alias("n"))
    return sweep(step_events(distinct, ["chrom"], {"depth": (F.col("start"), F.col("stop"), F.col("n"))}, L), ["chrom"], ["depth"])


def fragment_experiment(spark: SparkSession, sf: str) -> FragmentExperiment:
    """The read view as fragments of 150 to 239 bases."""
    fragments = load(spark, sf, "lineitem").selectExpr(*[f"{e} AS {a}" for e, a in FRAGMENT_COLUMNS])
    return FragmentExperiment(fragments, OPTIONS, L)


def paired_end_signal(spark: SparkSession, sf: str) -> DataFrame:
    ex = fragment_experiment(spark, sf)
    return rounded(ex.paired_signal(ex.capped), "treat", "ctrl")


def bedgraph(spark: SparkSession, sf: str) -> DataFrame:
    signal = experiment(spark, sf).signal
    tracks = []
    for name in ("treat", "ctrl"):
        merged = coalesce_equal(signal.select("chrom", "start", "stop", name), ["chrom"], name).where(f"{name} > 0")
        tracks.append(merged.select(F.lit(name).alias("track"), "chrom", "start", "stop", r4(name).alias("value")))
    return tracks[0].unionByName(tracks[1])


def score_pairs(spark: SparkSession, sf: str) -> DataFrame:
    scored = experiment(spark, sf).scored
    return scored.select("k", r4("lam").alias("lam"), "bp", r4("pscore").alias("pscore"))


def lower_tail(spark: SparkSession, sf: str) -> DataFrame:
    scored = experiment(spark, sf).scored
    tails = scored.withColumn("lower", -poisson_log10_lower(F.col("k"), F.col("lam")))
    return rounded(tails.select("k", "lam", "lower"), "lam", "lower")


def p_hist(spark: SparkSession, sf: str) -> DataFrame:
    hist = scoring.p_histogram(experiment(spark, sf).scored)
    return hist.groupBy(r4(F.col("pkey") / 1e10).alias("pscore")).agg(F.sum("bp").alias("bp"))


def q_table(spark: SparkSession, sf: str) -> DataFrame:
    return experiment(spark, sf).q_table.select(r4(F.col("pkey") / 1e10).alias("pscore"), "bp", r4("qscore").alias("qscore"))


def q_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """p, q and fold of every segment."""
    ex = experiment(spark, sf)
    segments = scoring.scored_signal(ex.signal, ex.scored)
    looked = scoring.q_lookup(segments, ex.q_table)
    fold = (F.col("treat") + 1.0) / (F.col("ctrl") + 1.0)
    return looked.select(
        "chrom", "start", "stop", r4("pscore").alias("pscore"), r4("qscore").alias("qscore"), r4(fold).alias("fold")
    )


FRAGMENT_COLUMNS = [(e, a) for e, a in VIEWS["reads"][1] if a != "strand"] + [
    ("CAST(150 + l_orderkey % 90 AS BIGINT)", "span")
]

QUERIES = {
    "p19_extend_tags": extend_tags,
    "g2_uniq_multi": uniq_multi,
    "g3_multi_weight": multi_weight,
    "g4_library_totals": library_totals,
    "g6_dedup_cap": dedup_cap,
    "g7_redundancy": redundancy,
    "w8_dup_rank": dup_rank,
    "u3_tag_tracks": tag_tracks,
    "o1_sorted_tags": sorted_tags,
    "g8_pileup_treat": pileup_treat,
    "d2_contig_lengths": contig_lengths,
    "g9_pileup_control": pileup_control,
    "g10_paired_end_pileup": paired_end_pileup,
    "g10_paired_end_signal": paired_end_signal,
    "j3_pair_signal": pair_signal,
    "j3_merge_steps": merge_steps,
    "j4_pointwise_max": pointwise_max,
    "w7_bedgraph": bedgraph,
    "s1_pscore": score_pairs,
    "s2_lower_tail": lower_tail,
    "g12_p_hist": p_hist,
    "w2_q_table": q_table,
    "j5_q_lookup": q_lookup,
}


def _single_side(side: str, extra: str = "") -> str:
    return f"SELECT chrom, lag(pos, 1, 0) OVER (PARTITION BY chrom ORDER BY pos) AS start, pos AS stop, depth{extra} FROM steps WHERE side = '{side}'"


_STEP_PAIR = [
    (
        "ev",
        "SELECT concat('u', CAST(user_id % 5 AS STRING)) AS chrom, event_id + 1 AS stop, event_type, value FROM events",
    ),
    (
        "wide",
        "SELECT chrom, stop, " + ", ".join(f"max(value) FILTER (event_type = '{t}') AS {n}" for t, n in EVENT_TYPES.items()) + " FROM ev GROUP BY ALL",
    ),
    (
        "filled",
        "SELECT chrom, stop, "
        + ", ".join(
            f"(SELECT e.value FROM ev e WHERE e.chrom = wide.chrom AND e.event_type = '{t}' AND e.stop >= wide.stop ORDER BY e.stop LIMIT 1) AS {n}"
            for t, n in EVENT_TYPES.items()
        )
        + " FROM wide",
    ),
    (
        "merged",
        "SELECT chrom, lag(stop, 1, 0) OVER (PARTITION BY chrom ORDER BY stop) AS start, stop, "
        + ", ".join(EVENT_TYPES.values())
        + " FROM filled WHERE "
        + " AND ".join(f"{n} IS NOT NULL" for n in EVENT_TYPES.values()),
    ),
]

_PE = [
    (
        "al",
        view_sql("alignments"),
    ),
    ("frag", "SELECT DISTINCT rname AS chrom, pos AS start, pos + abs(tlen) AS stop FROM al WHERE flag & 516 = 0 AND tlen > 0"),
    (
        "ev",
        f"SELECT chrom, least(start, {L}) AS pos, 1 AS d FROM frag UNION ALL SELECT chrom, least(stop, {L}), -1 FROM frag",
    ),
    ("at_pos", "SELECT chrom, pos, sum(d) AS d FROM ev GROUP BY ALL"),
    (
        "ranked",
        "SELECT chrom, pos, d, row_number() OVER w AS rn, coalesce(sum(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth"
        " FROM at_pos WINDOW w AS (PARTITION BY chrom ORDER BY pos)",
    ),
]


def _bedgraph_sql(name: str) -> str:
    return (
        f"SELECT '{name}' AS track, chrom, min(start) AS start, max(stop) AS stop, {q4(f'min_by({name}, stop)')} AS value FROM ("
        f"SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY stop ROWS UNBOUNDED PRECEDING) AS run FROM ("
        f"SELECT chrom, start, stop, {name}, CASE WHEN abs({name} - lag({name}) OVER (PARTITION BY chrom ORDER BY stop)) <= 0.00001e0"
        f" THEN 0 ELSE 1 END AS fresh FROM signal)) GROUP BY chrom, run HAVING min_by({name}, stop) > 0"
    )


_FR_ENDS = "(SELECT chrom, pos AS p FROM kept WHERE sample = 'C' UNION ALL SELECT chrom, pos + span FROM kept WHERE sample = 'C')"
_WIDTHS = ["(SELECT d FROM len)", "1000", "10000"]
_FR = [
    ("fr", f"SELECT {', '.join(f'{e} AS {a}' for e, a in FRAGMENT_COLUMNS)} FROM lineitem"),
    ("pr", "SELECT sample, read_id, count(*) AS n_align FROM fr GROUP BY ALL"),
    ("uf", "SELECT sample, chrom, pos, span, count(*) AS c FROM fr JOIN pr USING (sample, read_id) WHERE n_align = 1 GROUP BY ALL"),
    ("kept", "SELECT sample, chrom, pos, span FROM uf"),
    (
        "tot",
        "SELECT sample, k + CAST(floor(m * (1e0 - (u - k) / CAST(u AS DOUBLE))) AS BIGINT) AS total FROM"
        " (SELECT sample, CAST(sum(c) AS BIGINT) AS u, count(*) AS k FROM uf GROUP BY ALL)"
        " JOIN (SELECT sample, count(*) FILTER (n_align > 1) AS m FROM pr GROUP BY ALL) USING (sample)",
    ),
    ("len", "SELECT CAST(floor(avg(span)) AS BIGINT) AS d FROM kept WHERE sample = 'T'"),
    (
        "sc",
        "SELECT d, t, c, t / c AS r FROM (SELECT CAST(max(total) FILTER (sample = 'T') AS DOUBLE) AS t,"
        " 2 * CAST(max(total) FILTER (sample = 'C') AS DOUBLE) AS c FROM tot), len",
    ),
    (
        "fev",
        f"SELECT 't' AS side, chrom, pos, 1 AS n FROM kept WHERE sample = 'T' UNION ALL SELECT 't', chrom, least(pos + span, {L}), -1 FROM kept WHERE sample = 'T'"
        + "".join(
            f" UNION ALL SELECT 'c{i}', chrom, least(greatest(p - {w} // 2, 0), {L}), 1 FROM {_FR_ENDS}"
            f" UNION ALL SELECT 'c{i}', chrom, least(greatest(p + {w} - {w} // 2, 0), {L}), -1 FROM {_FR_ENDS}"
            for i, w in enumerate(_WIDTHS)
        ),
    ),
    ("fat", "SELECT side, chrom, pos, sum(n) AS d FROM fev GROUP BY ALL"),
    (
        "franked",
        "SELECT *, row_number() OVER w AS rn, coalesce(sum(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth"
        " FROM fat WINDOW w AS (PARTITION BY side, chrom ORDER BY pos)",
    ),
    (
        "fwide",
        "SELECT chrom, pos, " + ", ".join(f"max(depth) FILTER (side = '{s}') AS {s}" for s in ("t", "c0", "c1", "c2"))
        + " FROM franked WHERE pos > 0 AND (d <> 0 OR rn = 1) GROUP BY ALL",
    ),
    (
        "ffilled",
        "SELECT chrom, pos, "
        + ", ".join(
            f"last_value({s} IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {s}"
            for s in ("t", "c0", "c1", "c2")
        )
        + " FROM fwide",
    ),
    (
        "fsignal",
        "SELECT chrom, lag(pos, 1, 0) OVER (PARTITION BY chrom ORDER BY pos) AS start, pos AS stop,"
        " f.t * CASE WHEN sc.t > sc.c THEN 1e0 / r ELSE 1e0 END AS treat,"
        " greatest(c0 * CASE WHEN sc.t > sc.c THEN 1e0 ELSE r END, c1 * (d / 1000e0 * CASE WHEN sc.t > sc.c THEN 1e0 ELSE r END),"
        " c2 * (d / 10000e0 * CASE WHEN sc.t > sc.c THEN 1e0 ELSE r END), CASE WHEN sc.t > sc.c THEN sc.c ELSE sc.t END * d / 1000000e0) AS ctrl"
        " FROM ffilled f, sc WHERE f.t IS NOT NULL AND c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL",
    ),
]

ORACLE = {
    "g10_paired_end_signal": with_parts(_FR, f"SELECT chrom, start, stop, {q4('treat')} AS treat, {q4('ctrl')} AS ctrl FROM fsignal"),
    "p19_extend_tags": with_parts(
        READS,
        "SELECT sample, chrom, strand, pos,"
        f" least(greatest(CASE WHEN strand = 0 THEN pos + 10 ELSE pos - 10 - {D} END, 0), {L}) AS start,"
        f" least(greatest(CASE WHEN strand = 0 THEN pos + 10 + {D} ELSE pos - 10 END, 0), {L}) AS stop FROM reads",
    ),
    "g2_uniq_multi": with_parts(TRACKS[:2], "SELECT sample, read_id, n_align, n_align > 1 AS is_multi FROM per_read"),
    "g3_multi_weight": with_parts(
        READS,
        f"SELECT sample, read_id, chrom, pos, strand, n_align, {q4('1e0 / n_align')} AS weight FROM"
        " (SELECT *, count(*) OVER (PARTITION BY sample, read_id) AS n_align FROM reads)",
    ),
    "g4_library_totals": with_parts(TOTALS, "SELECT sample, u AS n_unique, m AS n_multi FROM counts"),
    "g6_dedup_cap": with_parts(
        READS,
        "SELECT sample, chrom, strand, pos, least(count(*), 1) AS n, least(count(*), 2) AS n2 FROM reads GROUP BY ALL",
    ),
    "g7_redundancy": with_parts(
        TOTALS, f"SELECT sample, u AS n_unique, k AS n_kept, {q4('(u - k) / CAST(u AS DOUBLE)')} AS rate FROM totals"
    ),
    "w8_dup_rank": with_parts(
        READS, "SELECT sample, chrom, strand, pos, row_number() OVER (PARTITION BY sample, chrom, strand, pos) AS copy FROM reads"
    ),
    "u3_tag_tracks": with_parts(
        TRACKS,
        "SELECT sample, chrom, strand, pos, coalesce(u.n, 0) AS n_unique, coalesce(m.n, 0) AS n_multi"
        " FROM uniq u FULL JOIN multi m USING (sample, chrom, strand, pos)",
    ),
    "o1_sorted_tags": with_parts(
        READS,
        "SELECT *, row_number() OVER (PARTITION BY sample, chrom, strand ORDER BY pos) AS rn FROM"
        " (SELECT sample, chrom, strand, pos, count(*) AS n FROM reads GROUP BY ALL)",
    ),
    "g8_pileup_treat": with_parts(SIGNAL, _single_side("t")),
    "d2_contig_lengths": with_parts(
        [
            (name, sql.replace(f", {L})", ", CASE WHEN chrom = 'chr5' THEN 2147483647 ELSE 80000 + 30000 * CAST(substr(chrom, 4) AS INT) END)"))
            for name, sql in SIGNAL
        ],
        _single_side("t"),
    ),
    "g9_pileup_control": with_parts(
        SIGNAL,
        "SELECT chrom, lag(pos, 1, 0) OVER (PARTITION BY chrom ORDER BY pos) AS start, pos AS stop, c0, c1, c2, "
        + q4("greatest(" + ", ".join(f"c{i} * ({D}e0 / {w})" for i, w in enumerate(WINDOWS)) + ")")
        + " AS local_max FROM (SELECT chrom, pos, "
        + ", ".join(
            f"last_value(c{i} IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c{i}"
            for i in range(len(WINDOWS))
        )
        + " FROM wide WHERE c0 IS NOT NULL OR c1 IS NOT NULL OR c2 IS NOT NULL) WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL",
    ),
    "g10_paired_end_pileup": with_parts(
        _PE,
        "SELECT chrom, lag(pos, 1, 0) OVER (PARTITION BY chrom ORDER BY pos) AS start, pos AS stop, CAST(depth AS BIGINT) AS depth"
        " FROM ranked WHERE pos > 0 AND (d <> 0 OR rn = 1)",
    ),
    "j3_pair_signal": with_parts(SIGNAL, f"SELECT chrom, start, stop, {q4('treat')} AS treat, {q4('ctrl')} AS ctrl FROM signal"),
    "j3_merge_steps": with_parts(_STEP_PAIR, "SELECT * FROM merged"),
    "j4_pointwise_max": with_parts(_STEP_PAIR, f"SELECT chrom, start, stop, greatest({', '.join(EVENT_TYPES.values())}) AS value FROM merged"),
    "w7_bedgraph": with_parts(SIGNAL, f"{_bedgraph_sql('treat')} UNION ALL {_bedgraph_sql('ctrl')}"),
    "s1_pscore": with_parts(SIGNAL, f"SELECT k, {q4('lam')} AS lam, bp, {q4('pscore')} AS pscore FROM scored"),
    "s2_lower_tail": with_parts(
        [
            *SIGNAL,
            (
                "tails",
                "SELECT k, lam, -log10(list_sum(list_transform(range(0, k + 1),"
                " lambda i: exp(i * ln(lam) - lam - lgamma(i + 1e0))))) AS lower FROM scored",
            ),
        ],
        f"SELECT k, {q4('lam')} AS lam, {q4('lower')} AS lower FROM tails",
    ),
    "g12_p_hist": with_parts(SIGNAL, f"SELECT {q4('pkey / 10000000000e0')} AS pscore, CAST(sum(bp) AS BIGINT) AS bp FROM hist GROUP BY ALL"),
    "w2_q_table": with_parts(SIGNAL, f"SELECT {q4('pkey / 10000000000e0')} AS pscore, bp, {q4('qscore')} AS qscore FROM qtable"),
    "j5_q_lookup": with_parts(
        SIGNAL,
        f"SELECT chrom, start, stop, {q4('pscore')} AS pscore, {q4('qscore')} AS qscore, {q4('(treat + 1e0) / (ctrl + 1e0)')} AS fold"
        " FROM rated JOIN scored USING (k, lam) JOIN qtable USING (pkey)",
    ),
}
