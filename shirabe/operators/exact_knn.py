"""Exact k-NN by cosine distance of a stated query set against all rows, in blocks.

A block of at most BLOCK query vectors travels to the rows; each task keeps its k best for each query, so the exchange carries
k rows for each query and task and never the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.operators.bm25 import best

BLOCK = 4096


def knn_topk(rows: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 10, threshold: float | None = None) -> DataFrame:
    """(query_id, doc_id, distance, rank) with distance = 1 - cosine, rounded to 6 decimals; of equals the smaller id comes first.

    threshold: the greatest distance that counts. Rows and queries whose vector is null, zero or not finite take no part; every query
    meets the rows of its own length.
    """
    kinds = queries.schema[query_key].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    usable = lambda c: F.col(c).isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e)) & F.exists(c, lambda e: e != 0)
    asked = queries.filter(usable(query_vector)).select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    count = asked.count()
    blocks = max(1, -(-count // BLOCK))
    out = None
    for n in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n).orderBy("q").toArrow()
        sizes = pc.list_value_length(part["v"]).to_numpy()
        groups = []  # of each vector length: the length, query ids, unit vectors
        for dim in np.unique(sizes).tolist():
            of_length = part.filter(pa.array(sizes == dim)).combine_chunks()
            q = of_length["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            groups.append((dim, of_length["q"].combine_chunks(), q / np.linalg.norm(q, axis=1, keepdims=True)))

        def run(batches: Iterator[pa.RecordBatch], groups: list[tuple[int, pa.Array, np.ndarray]] = groups) -> Iterator[pa.RecordBatch]:
            for whole, (dim, ids, q) in ((b, g) for b in batches for g in groups):
                batch = whole.filter(pc.equal(pc.list_value_length(whole.column(1)), dim))
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                d = np.round(1 - q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
                if threshold is not None:
                    d[d > threshold] = np.inf
                if k < d.shape[1]:  # all rows as near as the k-th, so that ties are decided later
                    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                    a, b = np.nonzero((d <= edge) & np.isfinite(d))
                else:
                    a, b = np.nonzero(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), batch.column(0).take(pa.array(b)), pa.array(d[a, b])], names=["query_id", "doc_id", "distance"])

        near = rows.filter(usable(vector) & F.size(vector).isin([dim for dim, _, _ in groups])).select(key, F.col(vector).cast("array<double>")).mapInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, distance double")
        out = near if out is None else out.unionByName(near)
    return best(out, k, "distance", descending=False)
