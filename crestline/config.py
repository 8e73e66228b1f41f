"""Options of a peak-calling run."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# Effective genome sizes per species code.
GENOME_SIZES = {"hs": 2.7e9, "mm": 1.87e9, "dm": 1.2e8, "ce": 9.0e7}

DEFAULT_FRAGMENT = 150  # used when the fragment model finds too few pairs
MODEL_MIN_PAIRS = 100
INT_MAX = 2147483647  # length assumed for a contig the header does not name


def main_chromosomes(species: str) -> list[str]:
    """Chromosomes a run is restricted to; an empty list means no restriction."""
    autosomes = {"hs": 22, "mm": 19}.get(species)
    if autosomes is None:
        return []
    return [f"chr{i}" for i in range(1, autosomes + 1)] + ["chrX", "chrY"]


@dataclass(frozen=True)
class CallOptions:
    project: str = "NONAME"
    fragment: int = 200
    shift: int = 0
    tag_size: int = 50
    keep_dup: str = "1"  # "all", "auto" or a number
    genome_size: float = 2.7e9
    chromosomes: list[str] = field(default_factory=list)
    fdr: float = 0.05
    pval: float | None = None  # given: unique-read pass scores on p instead of q
    candidate_pval: float = 1e-5
    to_large: bool = False
    small_local: int = 1000
    large_local: int = 10000
    broad: bool = False
    broad_cutoff: float = 0.1
    iterations: int = 50
    lower_fold: int = 5
    upper_fold: int = 50
    bandwidth: int = 300
    min_pileup: float = 5.0
    min_fold: float = 1.5
    min_weight: float = 0.01
    merge_overlaps: bool = False
    common_regions: bool = False  # leave out regions without any control read, as the original program does
    auto_model: bool = False

    def __post_init__(self) -> None:
        if self.genome_size < 10000:
            raise ValueError("genome size must be at least 10000")
        if self.small_local > self.large_local:
            raise ValueError("need small_local <= large_local")

    @property
    def score_kind(self) -> str:
        return "q" if self.pval is None else "p"

    @property
    def cutoff(self) -> float:
        return -math.log10(self.fdr if self.pval is None else self.pval)

    @property
    def broad_log_cutoff(self) -> float:
        return -math.log10(self.broad_cutoff)

    @property
    def windows(self) -> list[int]:
        """Control window widths: fragment, then the local backgrounds that are wider."""
        wider = {w for w in (self.small_local, self.large_local) if w > self.fragment}
        return [self.fragment, *sorted(wider)]
