"""Job parameters: explicit, validated before a plan is built."""

from __future__ import annotations

import math
from dataclasses import dataclass


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class SearchConfig:
    """Hybrid search."""

    candidates: int = 50
    rrf_k: int = 60
    fts_weight: float = 1.0
    vector_weight: float = 1.0
    default_top_k: int = 5

    def __post_init__(self) -> None:
        _check(1 <= self.candidates <= 1000, "candidates must be 1..1000")
        _check(self.rrf_k >= 1, "rrf_k must be at least 1")
        for w in (self.fts_weight, self.vector_weight):
            _check(math.isfinite(w) and w >= 0, "weights must be finite and not negative")
        _check(self.fts_weight > 0 or self.vector_weight > 0, "one weight must be above 0")
        _check(1 <= self.default_top_k <= 50, "top_k must be 1..50")


@dataclass(frozen=True)
class IngestConfig:
    """Splitting, embedding and versions."""

    dimension: int = 1024
    backend: str = "ollama"
    embed_batch: int = 16
    splitter_version: str = "3"
    fts_version: str = "1"
    input_version: str = "1"
    max_content_chars: int = 500_000
    query_instruction: str = ""

    def __post_init__(self) -> None:
        _check(self.dimension >= 1, "dimension must be at least 1")
        _check(1 <= self.embed_batch <= 256, "embed_batch must be 1..256")

    @property
    def pipeline_version(self) -> str:
        return f"s{self.splitter_version}+fts{self.fts_version}+ei{self.input_version}+{self.backend}+{self.dimension}"
