"""Options that change results, with the checks that a run makes before it starts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults are the reference values; kernels are functions that replace the built-in ones."""

    thresholds: tuple[int, ...] = (50, 60, 70, 80, 90, 95, 98)
    features: tuple[str, ...] = ("CDS",)
    nucleotide: bool = False
    min_length: int = 120
    cd_low: float = 98.0
    cd_step: float = 0.5
    cd_coverage: float = 0.9
    cd_cores: bool = True
    inflation: float = 1.5
    evalue: float = 1e-6
    hsp_length: float = 0.0
    hsp_proportion: float = 0.0
    paralogs: bool = True
    paralog_max: int = 3
    paralog_length: float = 0.99
    split_cut_off: float = 0.75
    split_strict: bool = False
    graph_dosage: float = 1.1
    align_dosage: float = 1.25
    core_percent: float = 95.0
    summary_cutoffs: tuple[int, ...] = (10, 25, 50, 75, 90, 95)
    retain: int = 1
    similarity_kernel: Callable | None = None
    cluster_kernel: Callable | None = None
    msa_kernel: Callable | None = None

    def __post_init__(self) -> None:
        t = self.thresholds
        if len(set(t)) < 2 or any(int(x) != x or not 0 <= x <= 100 for x in t):
            raise ValueError("thresholds: two or more different integers from 0 to 100")
        object.__setattr__(self, "thresholds", tuple(sorted(set(t))))
        if self.cd_low < max(t):
            raise ValueError("cd_low is under the highest threshold")
        if tuple(self.features) != ("CDS",):
            object.__setattr__(self, "nucleotide", True)

    @property
    def checks_sequences(self) -> bool:
        """Other features than CDS are not held to codon rules."""
        return tuple(self.features) == ("CDS",)

    def identities(self) -> list[float]:
        """The steps of the greedy rounds, from 100 down."""
        n = int(round((100 - self.cd_low) / self.cd_step))
        return [100 - k * self.cd_step for k in range(n + 1)]
