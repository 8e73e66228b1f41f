"""Command line: ``python -m crestline.cli narrow -t treat.sam -c control.sam -o out``."""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.config import GENOME_SIZES, CallOptions, main_chromosomes
from crestline.functions.flags import usable_single
from crestline.operators.sweep import coalesce_equal
from crestline.plans.broad import call_broad
from crestline.plans.model import fit, plot_script, with_fitted_fragment
from crestline.plans.multi import MultiExperiment, PairedMultiExperiment
from crestline.plans.narrow import Experiment, FragmentExperiment, call_narrow
from crestline.session import build_session, stage
from crestline.sources import bam, sam, sinks
from crestline.sources.sniff import sniff

VERSION = "0.1.0"
log = logging.getLogger("crestline")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="crestline")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    p = commands.add_parser("narrow", help="call peaks of a treatment against a control")
    p.add_argument("-t", "--treatment", required=True)
    p.add_argument("-c", "--control", required=True)
    p.add_argument("-o", "--outputdir", default=".")
    p.add_argument("-f", "--fraglen", type=int, default=200, help="outside 50..500: fit from the data")
    p.add_argument("--keepDup", default="1", help="all, auto or 1..9")
    p.add_argument("--shift", type=int, default=0)
    p.add_argument("--lmfold", type=int, default=5)
    p.add_argument("--hmfold", type=int, default=50)
    p.add_argument("-n", "--prj_name", default="NONAME")
    p.add_argument("-p", "--pval", type=float)
    p.add_argument("-q", "--fdr", type=float, default=0.05)
    p.add_argument("--toLarge", action="store_true")
    p.add_argument("-s", "--species", default="hs", choices=sorted(GENOME_SIZES))
    p.add_argument("-g", "--gsize", type=float, default=0)
    p.add_argument("-b", "--pileup", type=float, default=5.0)
    p.add_argument("-x", "--fe", type=float, default=1.5)
    p.add_argument("-i", "--iterations", type=int, default=50)
    p.add_argument("--broad", action="store_true")
    p.add_argument("-a", "--broad-cutoff", type=float, default=0.1)
    p.add_argument("--auto", action="store_true")
    p.add_argument("--common-regions", action="store_true", help="leave out multi-read regions without any control read")
    p.add_argument("--merge-overlaps", action="store_true", help="join multi-read peaks that overlap")
    p.add_argument("--no-wig", action="store_true", help="leave the bedGraph tracks out")
    p.add_argument("--all-contigs", action="store_true", help="do not restrict to the species' chromosomes")
    return top


def options_of(args: argparse.Namespace) -> CallOptions:
    if args.keepDup not in {"all", "auto", *"123456789"}:
        raise SystemExit("--keepDup takes all, auto or 1..9")
    fitted = args.auto or not 50 <= args.fraglen <= 500
    return CallOptions(
        project=args.prj_name,
        fragment=200 if fitted else args.fraglen,
        auto_model=fitted,
        shift=args.shift,
        keep_dup=args.keepDup,
        genome_size=args.gsize or GENOME_SIZES[args.species],
        chromosomes=[] if args.all_contigs else main_chromosomes(args.species),
        fdr=args.fdr,
        pval=args.pval,
        candidate_pval=args.pval or 1e-5,
        to_large=args.toLarge,
        broad=args.broad,
        broad_cutoff=args.broad_cutoff,
        iterations=args.iterations,
        lower_fold=args.lmfold,
        upper_fold=args.hmfold,
        min_pileup=args.pileup,
        min_fold=args.fe,
        merge_overlaps=args.merge_overlaps,
        common_regions=args.common_regions,
    )


def load_alignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Contigs and records of a SAM or BAM file, told by content."""
    kind, _ = sniff(path)
    if kind == "bam":
        bam.register(spark)
        contigs = spark.createDataFrame(bam.read_header(path)[0], "chrom string, length long")
        return contigs, spark.read.format("bam").load(path)
    if kind == "cram":
        raise SystemExit("CRAM needs its reference sequence and is not read; convert it to BAM")
    if kind != "sam":
        raise SystemExit(f"{path} is neither SAM nor BAM but {kind}")
    return sam.read_sam(spark, path)


def library_shape(records: DataFrame) -> tuple[bool, int]:
    """Whether the library is paired, and its mean read length; a library without usable records is single-end."""
    row = records.where(usable_single(F.col("flag"))).agg(
        F.max(F.col("flag").bitwiseAND(F.lit(1))).alias("paired"), F.floor(F.avg(F.length("seq"))).alias("size")
    ).first()
    return bool(row["paired"]), int(row["size"] or 1)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    options, out = options_of(args), f"{args.outputdir}/{args.prj_name}"
    contigs, treat = load_alignments(spark, args.treatment)
    _, control = load_alignments(spark, args.control)
    paired, tag_size = library_shape(treat)
    if library_shape(control)[0] != paired:
        raise SystemExit("treatment and control must both be paired-end or both single-end")
    options = replace(options, tag_size=tag_size)
    to_reads = sam.paired_fragments if paired else sam.single_end_tags
    reads = to_reads(treat, "T").unionByName(to_reads(control, "C"))
    reads = stage(reads, "reads")
    contigs = stage(contigs, "contigs")
    kind = FragmentExperiment if paired else Experiment
    experiment = kind(reads, options, contigs=contigs)
    if options.auto_model and paired:
        log.warning("paired reads: the fragment length is the mean template length, so no model is fitted")
    elif options.auto_model:
        model = fit(experiment)
        options = with_fitted_fragment(options, model)
        log.info("fragment length %d from %d pairs", model.fragment, model.pairs)
        if model.lines is not None:
            text = spark.createDataFrame([(plot_script(model, args.prj_name),)], "value string")
            text.coalesce(1).write.text(f"{out}_model_r")
        experiment = kind(reads, options, contigs=contigs)
    for name, t in experiment.totals.items():
        log.info("sample %s: %d unique, %d multi, %d unique kept", name, t.unique, t.multi, t.unique_kept)
    if options.broad:
        sinks.write_lines(call_broad(experiment), f"{out}_broadpeaks")
    else:
        peaks = stage(call_narrow(experiment), "peaks")
        sinks.write_lines(sinks.peak_table(peaks), f"{out}_uniqpeaks_xls", sinks.PEAK_TABLE_HEADER)
        sinks.write_track(sinks.narrow_peak_rows(peaks), f"{out}_uniqpeaks", args.prj_name)
    if not args.no_wig:
        for track in ("treat", "ctrl"):
            steps = coalesce_equal(experiment.signal.select("chrom", "start", "stop", track), ["chrom"], track)
            sinks.write_bedgraph(steps.where(F.col(track) > 0).withColumnRenamed(track, "value"), f"{out}_{track}_uniq_bdg")
    if experiment.totals["T"].multi:
        if paired:
            mates = sam.paired_mates(treat, "T").unionByName(sam.paired_mates(control, "C"))
            multi: MultiExperiment = PairedMultiExperiment(experiment, stage(mates, "mates"))
        else:
            multi = MultiExperiment(experiment)
        sinks.write_lines(sinks.candidate_rows(multi.candidates), f"{out}_candidate_regions", sinks.CANDIDATE_HEADER)
        sinks.write_lines(sinks.multi_peak_rows(multi.rescored()), f"{out}_multiRead_peaks", sinks.MULTI_HEADER)
        if not args.no_wig:
            sinks.write_bedgraph(multi.multi_track(), f"{out}_treat_multi_bdg")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    run(SparkSession.getActiveSession() or build_session(), args)


if __name__ == "__main__":
    main()
