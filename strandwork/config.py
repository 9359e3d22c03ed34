"""What an assembly can be told."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AssemblyConfig:
    """k: k-mer length, up to 64. l: length of minimizers. coverage: expected, for visits. num_buckets: of the
    abundance histogram. cutoff: least count, or None to take it from the histogram. node_threshold: compaction stops
    at so many nodes. min_contig_len: shorter contigs aren't written. on_invalid: what becomes of windows with other
    characters than bases ('split': none, 'error', 'as_A'). walk_mode: 'reference', or 'full', which also follows wires
    that begin past the middle of an interval."""

    k: int = 32
    l: int = 8  # noqa: E741
    coverage: int = 100
    num_buckets: int = 21
    cutoff: int | None = None
    node_threshold: int = 100_000
    min_contig_len: int = 400
    on_invalid: str = "split"
    walk_mode: str = "reference"

    def __post_init__(self) -> None:
        if not 2 <= self.k <= 64:
            raise ValueError(f"k must be 2 to 64, not {self.k}")
        if not 1 <= self.l <= self.k:
            raise ValueError(f"l must be 1 to k, not {self.l}")
        if self.num_buckets < 2:
            raise ValueError("the histogram needs two buckets")
        if self.on_invalid not in ("split", "error", "as_A"):
            raise ValueError(f"on_invalid: {self.on_invalid}")
        if self.walk_mode not in ("reference", "full"):
            raise ValueError(f"walk_mode: {self.walk_mode}")
