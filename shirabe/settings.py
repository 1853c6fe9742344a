"""Settings with their ranges, from a mapping or TOML; anything out of range is an error."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Chunking in characters, retrieval and its weights, BM25, and the limits of conversion and ingestion."""

    chunk_size: int = 200
    chunk_overlap: int = 30
    table_chunk_size: int = 714
    results: int = 10
    vector_weight: float = 0.9
    similarity_threshold: float | None = None
    k1: float = 2.5
    b: float = 0.5
    failures_most: int = 3
    items_most: int = 100
    cache_seconds: float = 300.0

    def __post_init__(self) -> None:
        checks = {
            "chunk_size": 1 <= self.chunk_size <= 100_000, "chunk_overlap": 0 <= self.chunk_overlap < self.chunk_size, "table_chunk_size": 1 <= self.table_chunk_size <= 100_000,
            "results": 1 <= self.results <= 1000, "vector_weight": 0 <= self.vector_weight <= 1, "similarity_threshold": self.similarity_threshold is None or 0 <= self.similarity_threshold <= 2,
            "k1": self.k1 >= 0, "b": 0 <= self.b <= 1, "failures_most": self.failures_most >= 1, "items_most": 1 <= self.items_most <= 100, "cache_seconds": self.cache_seconds >= 0,
        }
        bad = sorted(k for k, good in checks.items() if not good)
        if bad:
            raise ValueError(f"out of range: {', '.join(bad)}")

    @classmethod
    def of(cls, *layers: Mapping[str, object] | str) -> Settings:
        """From mappings or TOML texts; later ones go before earlier ones. Unknown names are errors."""
        names, values = {f.name for f in fields(cls)}, {}
        for layer in layers:
            values |= dict(tomllib.loads(layer) if isinstance(layer, str) else layer)
        if unknown := sorted(set(values) - names):
            raise ValueError(f"unknown: {', '.join(unknown)}")
        return cls(**values)  # type: ignore[arg-type]
