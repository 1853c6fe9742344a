"""Embedding providers: any callable from texts to vectors, run in Arrow batches; a deterministic one for tests and offline work."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[Sequence[str]], np.ndarray]


class HashedEmbedding:
    """Unit vectors from the text's SHA-256 in counter mode: equal texts give equal vectors, on any machine."""

    def __init__(self, dimensions: int = 768):
        if dimensions <= 0:
            raise ValueError("dimensions must be positive")
        self.dimensions = dimensions

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.empty((len(texts), self.dimensions), np.float64)
        for i, text in enumerate(texts):
            seed = hashlib.sha256(text.encode("utf-8", "replace")).digest()
            raw = b"".join(hashlib.sha256(seed + n.to_bytes(4, "big")).digest() for n in range(-(-self.dimensions // 8)))
            v = np.frombuffer(raw, ">i4")[: self.dimensions] / 2.0**31
            out[i] = v / np.linalg.norm(v)
        return out.astype(np.float32)


def embed(df: DataFrame, key: str, text: str, provider: Provider, prefix: str = "", batch: int = 256, carry: Sequence[str] = ()) -> DataFrame:
    """(key, *carry, embedding) of the non-blank texts, each with ``prefix`` before it; ``provider`` sees at most ``batch`` texts at once."""
    kept = [key, *carry]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", embedding array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [prefix + t for t in b.column(len(kept)).to_pylist()]
            vectors = [v for i in range(0, len(texts), batch) for v in np.asarray(provider(texts[i : i + batch]), np.float32).tolist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(vectors, pa.list_(pa.float32()))], names=[*kept, "embedding"])

    return df.select(*kept, text).filter(F.trim(F.coalesce(text, F.lit(""))) != "").mapInArrow(run, schema)
