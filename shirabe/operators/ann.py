"""Approximate nearest neighbours of outside queries: sign hashes of random projections in several tables, multi-probed, then exact distances.

More tables, more probes and fewer bits find more and cost more; recall is to be measured against ``exact_knn``. The index rows are
three numbers each; vectors are read again only for the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.operators.bm25 import best


@dataclass(frozen=True)
class Parameters:
    """tables of ``bits`` projections each; a query looks into its own bucket and those that differ in up to ``flips`` of its ``weak`` least certain bits."""

    tables: int = 12
    bits: int = 12
    weak: int = 6
    flips: int = 2
    seed: int = 17

    def __post_init__(self) -> None:
        if not (1 <= self.tables <= 256 and 1 <= self.bits <= 62 and 0 <= self.flips <= self.weak <= self.bits):
            raise ValueError("1..256 tables of 1..62 bits, and no more flips than weak bits than bits")

    def planes(self, dim: int) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(dim, self.tables * self.bits))


def buckets(df: DataFrame, key: str, vector: str, dim: int, parameters: Parameters, probe: bool = False) -> DataFrame:
    """(id, tab, code): the bucket of each row in each table; of queries (``probe``) also the buckets nearby.

    Rows whose vector is null, of another length, zero or not finite have none.
    """
    planes = parameters.planes(dim)
    weights = 1 << np.arange(parameters.bits, dtype=np.int64)
    turns = [c for n in range((parameters.flips if probe else 0) + 1) for c in combinations(range(parameters.weak), n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dim).astype(np.float64)
            side = (x @ planes).reshape(n, parameters.tables, parameters.bits)
            codes = (side > 0) @ weights
            order = np.argsort(np.abs(side), axis=2)[:, :, : parameters.weak]
            flip = weights[order]
            out = np.stack([codes ^ (flip[:, :, list(t)].sum(axis=2) if t else 0) for t in turns], axis=2)  # row, table, turn
            rows = np.repeat(np.arange(n), parameters.tables * len(turns))
            tab = np.tile(np.repeat(np.arange(parameters.tables), len(turns)), n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(tab, pa.int32()), pa.array(out.ravel(), pa.int64())], names=["id", "tab", "code"])

    kind = df.schema[key].dataType.simpleString()
    return usable(df, key, vector, dim).mapInArrow(run, f"id {kind}, tab int, code bigint")


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v) of rows whose vector has ``dim`` finite numbers, not all zero."""
    v = F.col(vector).cast("array<float>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.filter((F.size(vector) == dim) & finite & F.exists(v, lambda e: e != 0)).select(F.col(key).alias("id"), v.alias("v"))


def ann_topk(rows: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 10, dim: int = 64, parameters: Parameters | None = None) -> DataFrame:
    """(query_id, doc_id, distance, rank): about the ``k`` nearest rows by cosine distance, rounded to 6 decimals; of equals the smaller id first.

    Unusable vectors on either side take no part; empty tables give no rows; further columns are not read.
    """
    p = parameters or Parameters()
    have = buckets(rows, key, vector, dim, p).withColumnRenamed("id", "doc_id")
    ask = buckets(queries, query_key, query_vector, dim, p, probe=True).withColumnRenamed("id", "query_id")
    pairs = have.join(ask, ["tab", "code"]).select("query_id", "doc_id").distinct()
    docs = usable(rows, key, vector, dim).select(F.col("id").alias("doc_id"), F.col("v").alias("dv"))
    asked = usable(queries, query_key, query_vector, dim).select(F.col("id").alias("query_id"), F.col("v").alias("qv"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim).astype(np.float64) for i in (2, 3))
            cos = np.einsum("ij,ij->i", a, c) / (np.linalg.norm(a, axis=1) * np.linalg.norm(c, axis=1)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(1 - cos, 6) + 0.0)], names=["query_id", "doc_id", "distance"])

    kinds = f"query_id {queries.schema[query_key].dataType.simpleString()}, doc_id {rows.schema[key].dataType.simpleString()}, distance double"
    found = pairs.join(docs, "doc_id").join(asked, "query_id").select("query_id", "doc_id", "qv", "dv").mapInArrow(measure, kinds)
    return best(found, k, "distance", descending=False).select("query_id", "doc_id", "distance", "rank")
