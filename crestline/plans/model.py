"""Fragment length from the data: the model run over a library's unique tags."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.config import DEFAULT_FRAGMENT, MODEL_MIN_PAIRS, CallOptions
from crestline.operators import model as ops
from crestline.plans.narrow import Experiment
from crestline.session import stage


@dataclass(frozen=True)
class FragmentModel:
    fragment: int
    alternatives: list[int]
    pairs: int
    lines: DataFrame | None
    correlation: DataFrame | None


def treatment_tags(experiment: Experiment) -> DataFrame:
    return experiment.capped.where("sample = 'T'").drop("sample")


def bounds_of(experiment: Experiment) -> ops.ModelBounds:
    o = experiment.options
    return ops.model_bounds(experiment.totals["T"].unique_kept, o.lower_fold, o.upper_fold, o.bandwidth, o.genome_size)


def fit(experiment: Experiment) -> FragmentModel:
    """Best lag between the strands; the default length with too few pairs."""
    bounds, tags = bounds_of(experiment), treatment_tags(experiment)
    centres = stage(ops.paired_centres(ops.strand_peaks(tags, bounds), bounds), "centres")
    pairs = centres.count()
    if pairs < MODEL_MIN_PAIRS:
        return FragmentModel(DEFAULT_FRAGMENT, [], pairs, None, None)
    lines = stage(ops.model_lines(tags, centres, bounds), "lines")
    correlation = stage(ops.cross_correlation(lines, bounds), "xcorr")
    lags = [r["lag"] for r in ops.best_lags(correlation).collect()]  # at most peak_size rows
    return FragmentModel(lags[0] if lags else DEFAULT_FRAGMENT, lags[1:], pairs, lines, correlation)


def with_fitted_fragment(options: CallOptions, model: FragmentModel) -> CallOptions:
    return replace(options, fragment=model.fragment)


def plot_script(model: FragmentModel, name: str) -> str:
    """R script that draws the strand lines and the correlation by lag."""
    def vector(values: list) -> str:
        return "c(" + ",".join(format(v, ".6g") for v in values) + ")"

    rows = model.lines.orderBy("strand", "i").collect()  # fixed length, from the bandwidth
    corr = model.correlation.orderBy("lag").collect()
    plus = [r["depth"] for r in rows if r["strand"] == 0]
    minus = [r["depth"] for r in rows if r["strand"] == 1]
    half = len(plus) // 2
    parts = [
        f"p <- {vector(plus)}",
        f"m <- {vector(minus)}",
        f"lag <- {vector([r['lag'] for r in corr])}",
        f"ycorr <- {vector([r['smooth'] for r in corr])}",
        f"x <- seq({-half}, {len(plus) - half - 1})",
        f"pdf('{name}_model.pdf')",
        f"plot(x, p, type='l', col='red', main='{name}', xlab='distance to centre', ylab='depth')",
        "lines(x, m, col='blue')",
        "plot(lag, ycorr, type='l', main='cross-correlation', xlab='lag', ylab='correlation')",
        f"abline(v={model.fragment}, lty=2)",
        "dev.off()",
    ]
    return "\n".join(parts) + "\n"
