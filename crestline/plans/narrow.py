"""Peaks from uniquely mapped reads: tracks, paired signal, q table, regions."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.config import INT_MAX, CallOptions
from crestline.functions.stats import fold_enrichment
from crestline.operators import scoring
from crestline.operators.islands import label_islands, number_peaks, region_bounds, summit_rows
from crestline.operators.reads import fragment_tracks, read_counts, tag_tracks
from crestline.operators.sweep import centred_ends, directed_ends, step_events, sweep
from crestline.operators.tags import LibraryTotals, auto_caps, cap_duplicates
from crestline.session import stage


@dataclass(frozen=True)
class Scales:
    """Library scaling of one run."""

    treat: float
    windows: list[float]
    background: float
    control: float  # factor on raw control counts


def library_scales(treat: int, control: int, options: CallOptions) -> Scales:
    """Scale factors and the genome background rate.

    The larger library is scaled down to the smaller one, or the other way round
    with ``to_large``.  Wider control windows count in proportion to the fragment.
    """
    d = options.fragment
    ratio = treat / control
    scale_treatment = (treat <= control) if options.to_large else (treat > control)
    widths = [d / w for w in options.windows]
    if scale_treatment:
        return Scales(1.0 / ratio, widths, control * d / options.genome_size, 1.0)
    return Scales(1.0, [w * ratio for w in widths], treat * d / options.genome_size, ratio)


class Experiment:
    """Treatment and control alignments of one run, with shared intermediates.

    ``reads`` has ``sample`` ('T' or 'C'), ``read_id``, ``chrom``, ``strand``
    (0 plus, 1 minus) and ``pos`` (5' end).  ``contigs`` is a table of (chrom,
    length); a contig it lacks is endless.  Without it all contigs have ``length``.
    Tables used by several steps are staged once.
    """

    tag_columns = ("sample", "chrom", "strand", "pos")

    def __init__(self, reads: DataFrame, options: CallOptions, length: int = INT_MAX, contigs: DataFrame | None = None):
        if options.chromosomes:
            reads = reads.where(F.col("chrom").isin(options.chromosomes))
        self.reads, self.given, self.length, self.contigs = reads, options, length, contigs

    @cached_property
    def options(self) -> CallOptions:
        return self.given

    @cached_property
    def per_read(self) -> DataFrame:
        return read_counts(self.reads)

    @cached_property
    def tracks(self) -> DataFrame:
        """Tag counts per position; bounded by the genome, not by the reads."""
        return stage(tag_tracks(self.reads, self.per_read), "tracks")

    @cached_property
    def raw_totals(self) -> dict[str, tuple[int, int]]:
        """Unique and multi-mapped reads per sample."""
        sums = self.tracks.groupBy("sample").agg(F.sum("n_unique").alias("u"), F.sum("multi_reads").alias("m"))
        return {r["sample"]: (r["u"], r["m"]) for r in sums.collect()}  # one row per sample

    @cached_property
    def caps(self) -> int | dict[str, int] | None:
        if self.given.keep_dup == "auto":
            totals = {s: u + m for s, (u, m) in self.raw_totals.items()}
            return auto_caps(self.given.genome_size, totals)
        return None if self.given.keep_dup == "all" else int(self.given.keep_dup)

    @cached_property
    def capped(self) -> DataFrame:
        """Unique tags after the duplicate cap, ``n`` copies each."""
        unique = self.tracks.where("n_unique > 0").select(*self.tag_columns, F.col("n_unique").alias("n"))
        return cap_duplicates(unique, self.caps)

    @cached_property
    def totals(self) -> dict[str, LibraryTotals]:
        kept = cap_duplicates(self.tracks.withColumn("n", F.col("n_unique")), self.caps)
        sums = kept.groupBy("sample").agg(
            F.sum("n_unique").alias("u"), F.sum("multi_reads").alias("m"), F.sum("n").alias("k")
        )
        return {r["sample"]: LibraryTotals(r["u"], r["m"], r["k"]) for r in sums.collect()}  # one row per sample

    @cached_property
    def scales(self) -> Scales:
        return library_scales(self.totals["T"].total, self.totals["C"].total, self.options)

    def sized(self, tags: DataFrame) -> DataFrame:
        """Tags with the length of their contig, joined from the contig table."""
        if self.contigs is None:
            return tags.withColumn("_length", F.lit(self.length))
        known = self.contigs.groupBy("chrom").agg(F.max("length").cast("long").alias("_length"))
        return tags.join(known, "chrom", "left").withColumn("_length", F.coalesce("_length", F.lit(INT_MAX)))

    def depths(self, tags: DataFrame) -> DataFrame:
        """Raw depths of treatment and of each control window, swept together."""
        d, shift = self.options.fragment, self.options.shift
        pos, strand, n = F.col("pos"), F.col("strand"), F.col("n")
        spans = {"t": (*directed_ends(strand, pos, d, shift), F.when(F.col("sample") == "T", n))}
        for i, width in enumerate(self.options.windows):
            spans[f"c{i}"] = (*centred_ends(pos, width), F.when(F.col("sample") == "C", n))
        return sweep(step_events(self.sized(tags), ["chrom"], spans, F.col("_length")), ["chrom"], list(spans))

    def paired_signal(self, tags: DataFrame) -> DataFrame:
        """Scaled treatment and local background on every segment."""
        s = self.scales
        local = [F.col(f"c{i}") * factor for i, factor in enumerate(s.windows)]
        return self.depths(tags).select(
            "chrom",
            "start",
            "stop",
            (F.col("t") * s.treat).alias("treat"),
            F.greatest(*local, F.lit(s.background)).alias("ctrl"),
        )

    @cached_property
    def signal(self) -> DataFrame:
        return stage(self.paired_signal(self.capped), "signal")

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.staged_scores(self.signal)

    @cached_property
    def q_table(self) -> DataFrame:
        return stage(scoring.q_table(stage(scoring.p_histogram(self.scored), "hist")), "qtable")

    @cached_property
    def enriched_tags(self) -> DataFrame:
        """Tags of the candidate pass: capped unique ones plus all multi ones."""
        multi = self.tracks.where("n_multi > 0").select(*self.tag_columns, F.col("n_multi").alias("n"))
        return self.capped.unionByName(multi)


class FragmentExperiment(Experiment):
    """A paired-end run: each read is a fragment ``pos`` to ``pos + span``.

    Treatment fragments count as they are.  Both ends of a control fragment count
    as tags, so the control total doubles.  The fragment length is the mean span
    of the treatment's unique fragments.
    """

    tag_columns = ("sample", "chrom", "pos", "span")

    @cached_property
    def tracks(self) -> DataFrame:
        return stage(fragment_tracks(self.reads), "fragments")

    @cached_property
    def mean_span(self) -> int:
        treat = self.capped.where("sample = 'T'")
        return int(treat.agg(F.sum(F.col("span") * F.col("n")) / F.sum("n")).first()[0])

    @cached_property
    def options(self) -> CallOptions:
        return replace(self.given, fragment=self.mean_span)

    @cached_property
    def scales(self) -> Scales:
        return library_scales(self.totals["T"].total, 2 * self.totals["C"].total, self.options)

    def depths(self, tags: DataFrame) -> DataFrame:
        tags = self.sized(tags)
        pos, stop, n = F.col("pos"), F.col("pos") + F.col("span"), F.col("n")
        treat = {"t": (pos, stop, F.when(F.col("sample") == "T", n))}
        events = step_events(tags, ["chrom"], treat, F.col("_length"))
        control = {
            f"c{i}": (*centred_ends(F.col("end"), width), F.col("n")) for i, width in enumerate(self.options.windows)
        }
        ends = tags.where("sample = 'C'").select("chrom", "n", "_length", F.explode(F.array(pos, stop)).alias("end"))
        events = events.unionByName(step_events(ends, ["chrom"], control, F.col("_length")), allowMissingColumns=True)
        return sweep(events, ["chrom"], ["t", *control])


def passing_pairs(scored: DataFrame, kind: str, cutoff: float, table: DataFrame | None) -> DataFrame:
    """Distinct (k, lam) pairs whose score is strictly above the cutoff.

    q falls with p, so a q cutoff is a p cutoff: the smallest p that passes is
    one number, and the big signal table is never joined to the q table.
    """
    if kind == "p":
        return scored.where(F.col("pscore") > cutoff)
    lowest = table.where(F.col("qscore") > cutoff).agg(F.min("pkey")).scalar()
    return scored.where(F.col("pkey") >= lowest)


def islands_above(signal: DataFrame, pairs: DataFrame, max_gap: int) -> DataFrame:
    return label_islands(scoring.scored_signal(signal, pairs), ["chrom"], max_gap)


def close_peaks(rows: DataFrame, table: DataFrame, options: CallOptions) -> DataFrame:
    """Narrow peaks of labelled rows, with the summit's scores."""
    bounds = region_bounds(rows, ["chrom"], options.fragment)
    summits = summit_rows(rows, ["chrom", "island"])
    peaks = bounds.join(summits, ["chrom", "island"]).join(table.select("pkey", "qscore"), "pkey")
    return peaks.select(
        "chrom",
        F.col("island").alias("start"),
        F.col("region_stop").alias("stop"),
        F.floor((F.col("start") + F.col("stop")) / 2).alias("summit"),
        F.col("treat").alias("pileup"),
        "pscore",
        fold_enrichment(F.col("treat"), F.col("ctrl")).alias("fold"),
        "qscore",
    )


def call_narrow(experiment: Experiment) -> DataFrame:
    """Narrow peaks of the unique-read pass."""
    options = experiment.options
    pairs = passing_pairs(experiment.scored, options.score_kind, options.cutoff, experiment.q_table)
    rows = stage(islands_above(experiment.signal, pairs, options.tag_size), "islands")
    # staged because numbering reads the peaks several times
    peaks = stage(close_peaks(rows, experiment.q_table, options), "peaks")
    return number_peaks(peaks, f"{options.project}_peak")
