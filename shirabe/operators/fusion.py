"""Hybrid ranking: min-max normalisation and convex combination of vector and keyword scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.operators.bm25 import best

ALPHA = 0.9


def min_max(score: Column, over: str = "query_id") -> Column:
    """The score scaled to 0..1 within each group; 1 where all of a group are equal."""
    w = Window.partitionBy(over)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def combine(vector: DataFrame, keyword: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(query_id, doc_id, vector_distance, bm25_score, score): alpha * vector + (1 - alpha) * keyword over normalised scores; a missing side is 0.

    vector: (query_id, doc_id, distance); keyword: (query_id, doc_id, score). alpha is clamped to 0..1. Rows of score 0 drop out.
    """
    alpha = min(1.0, max(0.0, alpha))
    v = vector.select("query_id", "doc_id", F.col("distance").alias("vector_distance"), min_max(1 - F.col("distance")).alias("v"))
    k = keyword.select("query_id", "doc_id", F.col("score").alias("bm25_score"), min_max(F.col("score")).alias("k"))
    both = v.join(k, ["query_id", "doc_id"], "full")
    score = F.round(alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("k", F.lit(0.0)), 6)
    return both.select("query_id", "doc_id", "vector_distance", "bm25_score", score.alias("score")).filter(F.col("score") > 0)


def hybrid(vector: DataFrame, keyword: DataFrame, n: int = 10, alpha: float = ALPHA, least: float | None = None) -> DataFrame:
    """The ``n`` best of ``combine`` for each query with their rank; ``least`` is applied after the cut, so fewer may remain."""
    ranked = best(combine(vector, keyword, alpha), n)
    return ranked if least is None else ranked.filter(F.col("score") >= least)
