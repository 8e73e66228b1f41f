"""Peaks of multi-mapped reads: candidates, EM weights, re-scored regions."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions.cigar import aligned_blocks, parse_cigar, reference_length
from crestline.functions.stats import fold_enrichment, pscore, round_top
from crestline.operators import em, scoring
from crestline.operators.islands import middle_rows, region_bounds
from crestline.operators.joins import lookup
from crestline.operators.overlap import assign_first, assign_first_block, moved_blocks
from crestline.operators.reads import zip_mates
from crestline.operators.running import Run, running, tile_of
from crestline.operators.sweep import coalesce_equal, sweep
from crestline.plans.narrow import Experiment, islands_above, passing_pairs
from crestline.session import stage

WEIGHT_UNITS = 10**9  # weights are summed as integers, so sums never depend on order


def candidate_regions(experiment: Experiment) -> DataFrame:
    """Regions above the p cutoff on unique and multi tags together.

    ``pileup`` and ``fold`` are those of the middle segment of a region.
    """
    o = experiment.options
    signal = stage(experiment.paired_signal(experiment.enriched_tags), "signal_all")
    scored = scoring.staged_scores(signal, "scored_all")
    pairs = passing_pairs(scored, "p", -math.log10(o.candidate_pval), None)
    rows = stage(islands_above(signal, pairs, o.tag_size), "islands_all")
    bounds = region_bounds(rows, ["chrom"], o.fragment)
    middle = middle_rows(rows, ["chrom", "island"])
    regions = bounds.join(middle, ["chrom", "island"]).select(
        "chrom",
        F.col("island").alias("start"),
        F.col("region_stop").alias("stop"),
        F.col("treat").alias("pileup"),
        fold_enrichment(F.col("treat"), F.col("ctrl")).alias("fold"),
    )
    levelled = stage(regions, "regions").withColumn("_tile", tile_of("stop")).withColumn("_one", F.lit(1))
    return running(levelled, [], ["chrom", "_tile"], ["stop"], [Run("pid", "sum", "_one", True)]).drop("_tile", "_one")


class MultiExperiment:
    """Distribution of the reads of one run over its candidate regions."""

    def __init__(self, base: Experiment):
        self.base, self.options = base, base.options

    @cached_property
    def candidates(self) -> DataFrame:
        return stage(candidate_regions(self.base), "candidates")

    @cached_property
    def place_keys(self) -> list[str]:
        """What tells where a read lies: its tag position, and the CIGAR string where the reads carry one."""
        return ["chrom", "strand", "pos"] + ["cigar"] * ("cigar" in self.base.reads.columns)

    @cached_property
    def placed_tags(self) -> DataFrame:
        """Candidate of each distinct tag position (and CIGAR string) that has one.

        The aligned block, or every block of a CIGAR string, is moved half a fragment in the strand's direction.
        Working on distinct positions keeps a pile of copies at one row.
        """
        half, tag = self.options.fragment // 2, self.options.tag_size
        plus, pos = F.col("strand") == 0, F.col("pos")
        if "cigar" in self.place_keys:
            cigar = parse_cigar(F.col("cigar"))
            blocks = aligned_blocks(F.when(plus, pos).otherwise(pos - reference_length(cigar)), cigar)
            sites = self.base.reads.groupBy(*self.place_keys).agg(F.lit(1).alias("_x")).drop("_x")
            first = assign_first_block(sites.withColumn("blocks", moved_blocks(blocks, F.col("strand"), half)), self.candidates, self.place_keys, disjoint=True)
        else:
            sites = self.base.tracks.groupBy(*self.place_keys).agg(F.lit(1).alias("_x")).drop("_x")
            sites = sites.withColumn("l_start", F.greatest(F.when(plus, pos + half).otherwise(pos - tag + 1 - half), F.lit(0)))
            sites = sites.withColumn("l_stop", F.greatest(F.when(plus, pos + tag - 1 + half).otherwise(pos - half), F.lit(0)))
            first = assign_first(sites, self.candidates, self.place_keys, disjoint=True)
        begin = F.greatest(F.when(plus, pos).otherwise(pos - self.options.fragment), F.lit(0))
        return stage(first.withColumn("frag_start", begin), "placed")

    @cached_property
    def unique_tags(self) -> DataFrame:
        """Unique reads per sample and place, ``n_unique`` each."""
        if "cigar" not in self.place_keys:
            return self.base.tracks.where("n_unique > 0")
        lone = self.base.reads.groupBy("sample", "read_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*self.place_keys)).alias("tag")).where("n = 1")
        return lone.groupBy("sample", *[f"tag.{c}" for c in self.place_keys]).agg(F.count(F.lit(1)).alias("n_unique"))

    @cached_property
    def unique_positions(self) -> DataFrame:
        """Unique reads per candidate and fragment start, duplicates included."""
        joined = self.unique_tags.join(self.placed_tags, self.place_keys)
        return joined.groupBy("sample", "pid", "frag_start").agg(F.sum("n_unique").alias("n"))

    @cached_property
    def unique_counts(self) -> DataFrame:
        return self.unique_positions.groupBy("sample", "pid").agg(F.sum("n").alias("n"))

    @cached_property
    def multi_alignments(self) -> DataFrame:
        """Alignments of multi-mapped reads that fall in a candidate.

        The reads are narrowed to multi-mapped ones on the partitioning that counted them, before any look-up.
        """
        keep = self.base.per_read.where("n_align > 1").select("sample", "read_id")
        several = self.base.reads.join(keep, ["sample", "read_id"], "left_semi")
        inside = lookup(several, self.placed_tags, self.place_keys)
        return stage(inside.select("sample", "read_id", "pid", "frag_start"), "multi")

    @cached_property
    def classes(self) -> em.ReadClasses:
        return em.read_classes(self.multi_alignments)

    def peak_table(self, sample: str) -> DataFrame:
        """Every candidate with its length and unique read count."""
        unique = self.unique_counts.where(F.col("sample") == sample).select("pid", F.col("n").alias("u"))
        peaks = self.candidates.select("pid", (F.col("stop") - F.col("start") + 1).alias("len"))
        return peaks.join(unique, "pid", "left").select("pid", "len", F.coalesce("u", F.lit(0)).alias("u"))

    @cached_property
    def treat_weights(self) -> DataFrame:
        members = self.classes.members.where("sample = 'T'")
        if self.options.iterations == 0:
            return em.equal_weights(members)
        steps = (self.options.iterations + 1) // 2
        return em.estimate(members, self.peak_table("T"), steps)

    @cached_property
    def control_weights(self) -> DataFrame:
        return em.equal_weights(self.classes.members.where("sample = 'C'"))

    @cached_property
    def peak_reads(self) -> DataFrame:
        """Reads per candidate after redistribution: ``ip`` and ``input``."""
        ip = em.peak_totals(self.treat_weights, self.peak_table("T")).select("pid", F.col("prime").alias("ip"))
        inp = em.peak_totals(self.control_weights, self.peak_table("C")).select("pid", F.col("prime").alias("input"))
        return ip.join(inp, "pid")

    @cached_property
    def with_multi(self) -> DataFrame:
        """Candidates reached by a multi-mapped treatment read."""
        return self.classes.members.where("sample = 'T'").select("pid").distinct()

    @cached_property
    def gated(self) -> DataFrame:
        """Candidates dense and enriched enough to be scored again."""
        o, s = self.options, self.base.scales
        fold = (F.col("ip") + 0.1) * s.treat / ((F.col("input") + 0.1) * s.control)
        rows = self.peak_reads.join(self.with_multi, "pid", "left_semi")
        rows = rows.withColumn("fold", fold)
        kept = rows.where((F.col("ip") * s.treat > o.min_pileup) & (F.col("fold") > o.min_fold))
        return stage(kept, "gated")

    @cached_property
    def multi_positions(self) -> DataFrame:
        """Weighted multi alignments per candidate and fragment start."""
        weights = self.treat_weights.unionByName(self.control_weights)
        counted = em.weighted_positions(self.multi_alignments, self.classes, weights, self.options.min_weight)
        units = F.floor(F.col("w") * float(WEIGHT_UNITS) + 0.5).cast("long") * F.col("n")
        return stage(counted.select("sample", "pid", "frag_start", units.alias("units")), "weighted")

    def region_depths(self, multi_only: bool = False, common: bool | None = None) -> DataFrame:
        """Weighted depth of treatment and control inside each gated candidate.

        With ``common`` a candidate without any control read is left out and the
        depths end with the side that ends first; otherwise a missing side is 0.
        """
        common = self.options.common_regions if common is None else common
        positions = self.multi_positions
        if not multi_only:
            unique = self.unique_positions.select(
                "sample", "pid", "frag_start", (F.col("n") * WEIGHT_UNITS).alias("units")
            )
            positions = positions.unionByName(unique)
        positions = positions.join(self.gated.select("pid"), "pid", "left_semi")
        treat = F.when(F.col("sample") == "T", F.col("units"))
        ctrl = F.when(F.col("sample") == "C", F.col("units"))
        d = self.options.fragment
        ends = F.explode(
            F.array(
                F.struct(F.col("frag_start").alias("pos"), treat.alias("t"), ctrl.alias("c")),
                F.struct((F.col("frag_start") + d).alias("pos"), (-treat).alias("t"), (-ctrl).alias("c")),
            )
        )
        events = positions.select("pid", ends.alias("ev")).select("pid", "ev.pos", "ev.t", "ev.c")
        return sweep(events, ["pid"], ["t", "c"], common=common)

    def multi_track(self, least: float = 1e-5) -> DataFrame:
        """Depth of the multi-mapped treatment reads in each gated candidate, as bedGraph steps above ``least``."""
        depths = self.region_depths(multi_only=True, common=False)
        track = depths.select("pid", "start", "stop", (F.col("t") / float(WEIGHT_UNITS)).alias("value"))
        steps = coalesce_equal(track, ["pid"], "value").where(F.col("value") > least)
        return steps.join(self.candidates.select("pid", "chrom"), "pid").select("chrom", "start", "stop", "value")

    def rescored(self) -> DataFrame:
        """Multi-read peaks: bounds, tags, summit pileup, fold and p-score."""
        s = self.base.scales
        depths = self.region_depths().select(
            "pid",
            "stop",
            (F.col("t") / float(WEIGHT_UNITS) * s.treat).alias("treat"),
            (F.col("c") / float(WEIGHT_UNITS) * s.control).alias("ctrl"),
        )
        # the first segment that reaches the top: largest treat, then smallest stop
        best = F.max(F.struct(F.col("treat"), (-F.col("stop")).alias("_o"), F.col("ctrl"))).alias("best")
        regions = depths.groupBy("pid").agg(F.min("stop").alias("start"), F.max("stop").alias("stop"), best)
        joined = regions.join(self.gated, "pid").join(self.candidates.select("pid", "chrom"), "pid")
        pileup = F.col("best.treat")
        score = pscore(F.floor(pileup + 0.5).cast("int"), round_top(F.col("best.ctrl") + 0.5, 5))
        peaks = joined.select(
            "pid",
            "chrom",
            "start",
            "stop",
            ((F.col("ip") + 0.1) * s.treat).alias("ip_tags"),
            ((F.col("input") + 0.1) * s.control).alias("input_tags"),
            pileup.alias("pileup"),
            "fold",
            score.alias("pscore"),
        )
        return merge_overlapping(peaks) if self.options.merge_overlaps else peaks


class PairedMultiExperiment(MultiExperiment):
    """Distribution of the pairs of a paired-end run.

    ``mates`` has an alignment per row: sample, read_id, mate (1 or 2), chrom, strand, start, cigar and lead, the leftmost
    position of its template.  The k-th alignment of mate 1 goes with the k-th of mate 2; what is left over of either
    stands alone.  Such an alternative lies in the region that either mate hits.  Alternatives on two chromosomes, or in
    two regions, are left out.  A pair is multi-mapped if either mate has several alignments.
    """

    def __init__(self, base: Experiment, mates: DataFrame):
        super().__init__(base)
        self.mates = mates

    @cached_property
    def placed_mates(self) -> DataFrame:
        """Region of each distinct mate position and CIGAR string that has one."""
        keys, cigar = ["chrom", "strand", "start", "cigar"], parse_cigar(F.col("cigar"))
        sites = self.mates.groupBy(*keys).agg(F.lit(1).alias("_x")).drop("_x")
        blocks = moved_blocks(aligned_blocks(F.col("start"), cigar), F.col("strand"), self.options.fragment // 2)
        return stage(assign_first_block(sites.withColumn("blocks", blocks), self.candidates, keys, disjoint=True), "placed_mates")

    @cached_property
    def alternatives(self) -> DataFrame:
        """(sample, read_id, rn, multi, pid, frag_start) of every alternative that lies in one region."""
        keys = ["chrom", "strand", "start", "cigar"]
        placed = self.mates.join(self.placed_mates, keys, "left")
        placed = placed.withColumn("stop", F.col("start") + reference_length(parse_cigar(F.col("cigar"))))
        zipped = zip_mates(placed, ["sample", "read_id"], ["chrom", "lead", "start", "strand", "cigar"], ["chrom", "strand", "start", "stop", "pid"], counted=self.mates)
        zipped = stage(zipped, "zipped")
        several = zipped.where("rn = 2").select("sample", "read_id", F.lit(True).alias("multi"))  # once a read at most
        apart = (F.col("chrom_1") != F.col("chrom_2")) | (F.col("pid_1") != F.col("pid_2"))
        kept = zipped.where(~F.coalesce(apart, F.lit(False)) & F.coalesce("pid_1", "pid_2").isNotNull())
        forward = F.least(*[F.when(F.col(f"strand_{k}") == 0, F.col(f"start_{k}")) for k in (1, 2)])
        begin = F.coalesce(forward, F.greatest("stop_1", "stop_2") - self.options.fragment)
        joined = kept.join(several, ["sample", "read_id"], "left")
        return stage(
            joined.select(
                "sample",
                "read_id",
                "rn",
                F.coalesce("multi", F.lit(False)).alias("multi"),
                F.coalesce("pid_1", "pid_2").alias("pid"),
                F.greatest(begin, F.lit(0)).alias("frag_start"),
            ),
            "alternatives",
        )

    @cached_property
    def unique_positions(self) -> DataFrame:
        return self.alternatives.where("NOT multi").groupBy("sample", "pid", "frag_start").agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def multi_alignments(self) -> DataFrame:
        return self.alternatives.where("multi").select("sample", "read_id", "pid", "frag_start")


def merge_overlapping(peaks: DataFrame) -> DataFrame:
    """Join overlapping multi-read peaks: sums of tags, best fold and score.

    A peak opens a group when it starts at or behind the furthest stop so far;
    the group is named by the id of that peak.
    """
    order, levels = ["start", "pid"], ["_tile"]
    levelled = peaks.withColumn("_tile", tile_of("start"))
    seen = running(levelled, ["chrom"], levels, order, [Run("_reach", "max", "stop")])
    fresh = F.col("_reach").isNull() | (F.col("start") >= F.col("_reach"))
    opened = seen.withColumn("_open", F.when(fresh, F.col("pid")))
    named = running(opened, ["chrom"], levels, order, [Run("_group", "last", "_open", True)])
    merged = named.groupBy("chrom", F.col("_group").alias("pid")).agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        *[F.sum(c).alias(c) for c in ("ip_tags", "input_tags", "pileup")],
        *[F.max(c).alias(c) for c in ("fold", "pscore")],
    )
    return merged.select(*peaks.columns)
