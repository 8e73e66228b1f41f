"""What the query modules share: views, the experiment, rounding, SQL parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.adapters import driver_tables as tables
from crestline.adapters.driver_tables import view, view_sql
from crestline.config import CallOptions
from crestline.plans.narrow import Experiment

OPTIONS = CallOptions(genome_size=float(tables.GENOME_SIZE), fragment=tables.FRAGMENT, tag_size=tables.TAG_SIZE, common_regions=True)

_experiments: dict[tuple[str, str], Experiment] = {}


def experiment(spark: SparkSession, sf_dir: str) -> Experiment:
    """The run over the read view; its staged tables are shared by the queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _experiments:
        _experiments[key] = Experiment(view(spark, sf_dir, "reads"), OPTIONS, tables.CONTIG_LENGTH)
    return _experiments[key]


def reset() -> None:
    """Forget staged tables, so that a timing covers all of the work."""
    _experiments.clear()


def r4(x: Column | str) -> Column:
    """Half-up to four digits, by the same arithmetic in any engine."""
    c = F.col(x) if isinstance(x, str) else x
    return F.floor(c * 10000.0 + 0.5) / 10000.0


def q4(x: str) -> str:
    return f"floor(({x}) * 10000e0 + 0.5e0) / 10000e0"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r4(c).alias(c) if c in names else F.col(c) for c in df.columns])


def with_parts(parts: list[tuple[str, str]], final: str) -> str:
    """A WITH query whose parts are computed once each."""
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in parts) + f"\n{final}"


def poisson_sql(k: str, lam: str) -> str:
    """-log10 P(X > k): the plain upper-tail sum over log-gamma terms."""
    terms = f"CAST(ceil(greatest({lam} - {k}, 0e0) + 8e0 * sqrt(greatest({lam}, {k} + 1e0)) + 40e0) AS BIGINT)"
    tail = (
        f"list_sum(list_transform(range(1, {terms}), lambda j:"
        f" exp(j * ln({lam}) + lgamma({k} + 2e0) - lgamma({k} + 2e0 + j))))"
    )
    return f"-(({k} + 1e0) * ln({lam}) - {lam} - lgamma({k} + 2e0) + ln(1e0 + {tail})) / ln(10e0)"


# --- parts of the checking SQL, in order of use -----------------------------------

D = tables.FRAGMENT
L = tables.CONTIG_LENGTH
WINDOWS = OPTIONS.windows

READS = [("reads", view_sql("reads"))]

TRACKS = [
    *READS,
    ("per_read", "SELECT sample, read_id, count(*) AS n_align FROM reads GROUP BY ALL"),
    (
        "uniq",
        "SELECT sample, chrom, strand, pos, count(*) AS n FROM reads JOIN per_read USING (sample, read_id)"
        " WHERE n_align = 1 GROUP BY ALL",
    ),
    (
        "multi",
        "SELECT sample, chrom, strand, pos, count(*) AS n FROM reads JOIN per_read USING (sample, read_id)"
        " WHERE n_align > 1 GROUP BY ALL",
    ),
    ("capped", "SELECT sample, chrom, strand, pos, least(n, 1) AS n FROM uniq"),
]

TOTALS = [
    *TRACKS,
    (
        "counts",
        "SELECT sample, count(*) FILTER (n_align = 1) AS u, count(*) FILTER (n_align > 1) AS m FROM per_read GROUP BY ALL",
    ),
    (
        "totals",
        "SELECT sample, u, m, k, k + CAST(floor(m * (1e0 - (u - k) / CAST(u AS DOUBLE))) AS BIGINT) AS total"
        " FROM counts JOIN (SELECT sample, CAST(sum(n) AS BIGINT) AS k FROM capped GROUP BY ALL) USING (sample)",
    ),
    (
        "scales",
        f"SELECT CASE WHEN t > c THEN 1e0 / (t / c) ELSE 1e0 END AS ts, CASE WHEN t > c THEN 1e0 ELSE t / c END AS cs,"
        f" CASE WHEN t > c THEN c * {D} / {tables.GENOME_SIZE}e0 ELSE t * {D} / {tables.GENOME_SIZE}e0 END AS bg"
        " FROM (SELECT CAST(max(total) FILTER (sample = 'T') AS DOUBLE) AS t,"
        " CAST(max(total) FILTER (sample = 'C') AS DOUBLE) AS c FROM totals)",
    ),
]


def _span(side: str, source: str, where: str, start: str, stop: str) -> str:
    return (
        f"SELECT '{side}' AS side, chrom, least(greatest({start}, 0), {L}) AS pos, n AS d FROM {source} WHERE {where}"
        f" UNION ALL SELECT '{side}', chrom, least(greatest({stop}, 0), {L}), -n FROM {source} WHERE {where}"
    )


def steps_sql(source: str) -> list[tuple[str, str]]:
    """Step function of every side on its own, then merged on all breakpoints."""
    treat = _span(
        "t",
        source,
        "sample = 'T'",
        f"CASE WHEN strand = 0 THEN pos ELSE pos - {D} END",
        f"CASE WHEN strand = 0 THEN pos + {D} ELSE pos END",
    )
    control = [
        _span(f"c{i}", source, "sample = 'C'", f"pos - {w // 2}", f"pos + {w - w // 2}") for i, w in enumerate(WINDOWS)
    ]
    sides = ["t"] + [f"c{i}" for i in range(len(WINDOWS))]
    return [
        ("ev", " UNION ALL ".join([treat, *control])),
        ("at_pos", "SELECT side, chrom, pos, sum(d) AS d FROM ev GROUP BY ALL"),
        (
            "ranked",
            "SELECT side, chrom, pos, d, row_number() OVER w AS rn,"
            " coalesce(sum(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth"
            " FROM at_pos WINDOW w AS (PARTITION BY side, chrom ORDER BY pos)",
        ),
        ("steps", "SELECT side, chrom, pos, CAST(depth AS BIGINT) AS depth FROM ranked WHERE pos > 0 AND (d <> 0 OR rn = 1)"),
        (
            "wide",
            "SELECT chrom, pos, " + ", ".join(f"max(depth) FILTER (side = '{s}') AS {s}" for s in sides)
            + " FROM steps GROUP BY ALL",
        ),
        (
            "filled",
            "SELECT chrom, pos, "
            + ", ".join(
                f"last_value({s} IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {s}"
                for s in sides
            )
            + " FROM wide",
        ),
        (
            "depths",
            "SELECT chrom, lag(pos, 1, 0) OVER (PARTITION BY chrom ORDER BY pos) AS start, pos AS stop, "
            + ", ".join(sides)
            + " FROM filled WHERE "
            + " AND ".join(f"{s} IS NOT NULL" for s in sides),
        ),
        (
            "signal",
            "SELECT chrom, start, stop, t * ts AS treat, greatest("
            + ", ".join(f"c{i} * (({D}e0 / {w}) * cs)" for i, w in enumerate(WINDOWS))
            + ", bg) AS ctrl FROM depths, scales",
        ),
        (
            "rated",
            "SELECT *, CAST(floor(treat) AS INT) AS k, floor(ctrl * 100000e0 + 0.5e0) / 100000e0 AS lam FROM signal",
        ),
        ("pairs", "SELECT k, lam, CAST(sum(stop - start) AS BIGINT) AS bp FROM rated GROUP BY ALL"),
        ("scored0", f"SELECT k, lam, bp, {poisson_sql('k', 'lam')} AS pscore FROM pairs"),
        ("scored", "SELECT *, CAST(floor(pscore * 10000000000e0 + 0.5e0) AS BIGINT) AS pkey FROM scored0"),
        ("hist", "SELECT pkey, CAST(sum(bp) AS BIGINT) AS bp FROM scored GROUP BY ALL"),
        (
            "q0",
            "SELECT pkey, bp, pkey / 10000000000e0"
            " + log10(1 + coalesce(sum(bp) OVER (ORDER BY pkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"
            " - log10((SELECT sum(bp) FROM hist)) AS q FROM hist",
        ),
        ("qtable", "SELECT pkey, bp, greatest(min(q) OVER (ORDER BY pkey DESC ROWS UNBOUNDED PRECEDING), 0e0) AS qscore FROM q0"),
    ]


SIGNAL = [*TOTALS, *steps_sql("capped")]


def islands_sql(rows: str, max_gap: int, name: str = "islands") -> list[tuple[str, str]]:
    """Label the rows of the relation ``rows`` by running count of wide gaps."""
    return [
        (
            f"{name}_gap",
            f"SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY chrom ORDER BY stop) <= {max_gap} THEN 0 ELSE 1 END AS fresh FROM {rows}",
        ),
        (name, f"SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY stop ROWS UNBOUNDED PRECEDING) AS island FROM {name}_gap"),
    ]
