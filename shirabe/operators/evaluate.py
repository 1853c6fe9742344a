"""Retrieval metrics over ordered result lists: one row for each query, arrays in, scalars out; no shuffle of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hits(retrieved: Column, expected: Column) -> Column:
    return F.size(F.array_intersect(retrieved, expected))


def precision(retrieved: Column, expected: Column) -> Column:
    """Of the retrieved, the share that is expected; for nothing retrieved 1 if nothing is expected, else 0."""
    n, e = F.size(F.array_distinct(retrieved)), F.size(F.array_distinct(expected))
    return F.when(n > 0, _hits(retrieved, expected) / n).when(e == 0, 1.0).otherwise(0.0)


def recall(retrieved: Column, expected: Column) -> Column:
    """Of the expected, the share that is retrieved; for nothing expected 1 if nothing is retrieved, else 0."""
    return precision(expected, retrieved)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def ndcg(retrieved: Column, expected: Column) -> Column:
    """Binary gains by log2 of the rank; the ideal list is as long as the shorter of both. Nothing expected: 1 if nothing is retrieved, else 0."""
    gain = lambda i: 1 / F.log2(i + 2)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dcg = total(F.transform(retrieved, lambda x, i: F.when(F.array_contains(expected, x), gain(i)).otherwise(0.0)))
    n = F.least(F.size(F.array_distinct(expected)), F.size(retrieved))
    ideal = total(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), gain))
    return F.when(F.size(expected) == 0, F.when(F.size(retrieved) == 0, 1.0).otherwise(0.0)).when(n == 0, 0.0).otherwise(dcg / ideal)


def mrr(retrieved: Column, expected: Column) -> Column:
    """One over the rank of the first hit; without hit 0; for nothing expected 1 if nothing is retrieved, else 0."""
    first = F.array_min(F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda i: i.isNotNull()))
    return F.when(F.size(expected) == 0, F.when(F.size(retrieved) == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(1 / first, F.lit(0.0)))


def failure_tags(retrieved: Column, expected: Column, p: Column, r: Column, n: Column) -> Column:
    """Why a query fell short, in fixed order: retrieval_miss, retrieval_noise, chunk_fragmentation, query_mismatch; none for a perfect one."""
    missed, noise = F.size(F.array_except(expected, retrieved)) > 0, F.size(F.array_except(retrieved, expected)) > 0
    tags = F.array(
        F.when(missed, "retrieval_miss"),
        F.when(noise, "retrieval_noise"),
        F.when((r > 0) & (r < 1) & (n < 0.5), "chunk_fragmentation"),
        F.when((F.size(expected) > 0) & (_hits(retrieved, expected) == 0), "query_mismatch"),
    )
    return F.when((p == 1.0) & (r == 1.0), F.array().cast("array<string>")).otherwise(F.array_compact(tags))


def score(rows: DataFrame, retrieved: str = "retrieved", expected: str = "expected", negative: str = "negative") -> DataFrame:
    """``rows`` with precision, recall, f1, ndcg, mrr (rounded to 6 decimals), the negative sources retrieved, and failure tags."""
    got, want = F.col(retrieved), F.col(expected)
    out = rows.withColumns({"precision": precision(got, want), "recall": recall(got, want), "ndcg": ndcg(got, want), "mrr": mrr(got, want)})
    out = out.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    out = out.withColumn("tags", failure_tags(got, want, F.col("precision"), F.col("recall"), F.col("ndcg"))).withColumn("negatives", F.array_intersect(got, F.col(negative)))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "ndcg", "mrr")})
