"""Options of a search."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class MoleculeType(Enum):
    """What sequences are made of."""

    PROTEIN = "protein"
    NUCLEOTIDE = "nucleotide"


class BitscoreCutoff(Enum):
    """Cutoffs that a profile may carry, and the profile column of each."""

    GATHERING = "gathering"
    TRUSTED = "trusted"
    NOISE = "noise"

    @property
    def column(self) -> str:
        return {"gathering": "ga", "trusted": "tc", "noise": "nc"}[self.value]


#: Order in which a cascade looks for cutoffs.
CASCADE = (BitscoreCutoff.TRUSTED, BitscoreCutoff.GATHERING, BitscoreCutoff.NOISE)


@dataclass(frozen=True)
class ThresholdOptions:
    """Which hits to report and to include.

    A cutoff flag (at most one) rules both and the numbers are ignored; with
    ``cascade`` each profile uses the first cutoff it has, and the numbers
    rule the profiles without any.  A bit score replaces the E-value of its level.
    """

    cut_ga: bool = False
    cut_tc: bool = False
    cut_nc: bool = False
    cascade: bool = False
    evalue: float | None = None
    bitscore: float | None = None
    dom_evalue: float | None = None
    dom_bitscore: float | None = None
    inc_evalue: float | None = None
    inc_bitscore: float | None = None
    inc_dom_evalue: float | None = None
    inc_dom_bitscore: float | None = None

    def __post_init__(self) -> None:
        flags = self.cut_ga + self.cut_tc + self.cut_nc
        if flags > 1:
            raise ValueError("at most one of cut_ga, cut_tc and cut_nc may be set")
        if flags and self.cascade:
            raise ValueError("cascade cannot be combined with a cutoff flag")

    @property
    def cutoff(self) -> BitscoreCutoff | None:
        """The cutoff that was asked for."""
        for flag, kind in ((self.cut_ga, BitscoreCutoff.GATHERING), (self.cut_tc, BitscoreCutoff.TRUSTED), (self.cut_nc, BitscoreCutoff.NOISE)):
            if flag:
                return kind
        return None


#: Thresholds where nothing else is said; iterative search includes by 0.001.
DEFAULTS = {"evalue": 10.0, "dom_evalue": 10.0, "inc_evalue": 0.01, "inc_dom_evalue": 0.01}
ITERATIVE_INC_EVALUE = 0.001
