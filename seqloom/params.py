"""Parameters of mapping, pairing and evaluation."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class SeedType(Enum):
    """Which exact matches count as seeds."""

    MEM = "mem"
    SMEM = "smem"
    PSMEM = "psmem"
    MAM = "mam"
    MUM = "mum"

    @classmethod
    def parse(cls, name: str) -> SeedType:
        """Unknown names fall back to SMEM."""
        return next((x for x in cls if x.value == name.lower()), cls.SMEM)


class Orientation(Enum):
    FR = "fr"
    RF = "rf"
    FF = "ff"

    @classmethod
    def parse(cls, name: str) -> Orientation:
        return next((x for x in cls if x.value == name.lower()), cls.FR)


@dataclass(frozen=True)
class AlignParams:
    """Defaults are those of the command line that this engine replaces."""

    sparseness: int = 1
    sample_reads: bool = False
    error_rate: float = 0.08
    seed_type: SeedType = SeedType.SMEM
    min_seed: int | None = None
    max_seeds: int = 10_000
    max_smems: int = 10
    max_mems: int = 20
    min_mem_length: int = 50
    forward: bool = True
    reverse: bool = True
    rescue: bool = True
    full_dp: bool = False
    max_failures: int = 10
    reset_failures: bool = False
    max_alignments: int = 5000
    report: int = 1
    min_coverage: float = 0.25
    local: bool = False
    bandwidth: int = 100
    match: int = 1
    mismatch: int = -4
    gap_open: int = -6
    gap_extend: int = -1
    zdrop: int = 100

    def max_edits(self, length: int) -> int:
        return int(self.error_rate * length) + 1

    def min_score(self, length: int) -> int:
        return int(length * self.match + (self.mismatch - self.match) * self.max_edits(length))

    def seed_length(self, length: int) -> int:
        """40, and 20 more for each 500 bases of a long read, fewer the more errors are allowed."""
        if self.min_seed is not None:
            return max(self.min_seed, length // self.max_edits(length) if length // self.max_edits(length) > self.min_seed else self.min_seed)
        return 40 + (int(20 * (length // 500) / (100 * self.error_rate)) if length >= 1000 else 0)

    def skip(self, k: int, stride: int) -> int:
        """Step of the read's k-mers that finds every match of the shortest auto seed length (40) or ``min_seed`` on an
        index sampled by ``stride``; 1 unless reads are sampled. Shorter seeds, of the lower tiers, may then be missed."""
        least = 40 if self.min_seed is None else self.min_seed
        return max((least - k + 1) // max(stride, 1), 1) if self.sample_reads else 1


@dataclass(frozen=True)
class PairParams:
    min_insert: int = 0
    max_insert: int = 1000
    orientation: Orientation = Orientation.FR
    mixed: bool = True
    discordant: bool = True
    dovetail: bool = False
    contain: bool = True
    overlap: bool = True
    mode: int = 1
    rescue: bool = False
    #: Alignments of a mate, best first, whose windows are searched for the other one; None: all of them.
    window_tries: int | None = None


@dataclass(frozen=True)
class EvalParams:
    qualities: tuple[int, ...] = (0,)
    windows: tuple[int, ...] = (50,)
    input_edit: str = "NM"
    reference_edit: str = "XE"
    reads: int | None = None
    paired: bool = False


def comma_list(text: str, least: int, most: int) -> tuple[int, ...]:
    """Integers of a comma list; out of range is an error."""
    out = tuple(int(x) for x in text.split(",") if x.strip())
    if any(not least <= x <= most for x in out):
        raise ValueError(f"{text}: between {least} and {most} expected")
    return out
