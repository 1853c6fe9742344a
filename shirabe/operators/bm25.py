"""Keyword search by BM25 over postings kept as ordinary DataFrames.

idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a term adds idf * tf / (tf + k1 * (1 - b + b * dl / avgdl)) for each time it stands in
the query. Scores are rounded to 6 decimals; of equals the smaller id comes first. Documents without tokens count in N and avgdl.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.functions.text import tokens
from shirabe.session import spread

K1, B = 2.5, 0.5


def postings(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, dl): how often each term stands in each document; of ``terms`` (term) alone if given.

    Restricting to the terms asked for happens before the counts are shuffled, so the exchange carries matching postings only.
    """
    cut = spread(docs.select(key, text)).select(F.col(key).alias("doc_id"), tokens(F.col(text)).alias("_t")).select("doc_id", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    if terms is not None:
        cut = cut.join(terms, "term", "left_semi")
    return cut.groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row (nd, avgdl)."""
    return docs.select(F.size(tokens(F.coalesce(F.col(text), F.lit("")))).alias("dl")).agg(F.count(F.lit(1)).alias("nd"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, term, qn): the terms of each query and how often it holds them."""
    return queries.select(F.col(key).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))


def matches(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, qn, idf, tf, dl, avgdl): every term that a document shares with a query. The corpus is tokenised once for these and once for its mean length."""
    found = postings(docs, key, text, terms.select("term").distinct())
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = corpus_stats(docs, text)  # one row
    weighted = terms.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", F.log(1 + (F.col("nd") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return found.join(weighted, "term").select("query_id", "doc_id", "qn", "idf", "tf", "dl", "avgdl")


def _part(k1: float, b: float) -> Column:
    tf = F.col("tf")
    return F.col("qn") * F.col("idf") * tf / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def scores(docs: DataFrame, key: str, text: str, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a query."""
    return matches(docs, key, text, terms).groupBy("query_id", "doc_id").agg(F.round(F.sum(_part(k1, b)), 6).alias("score")).filter(F.col("score") > 0)


def grid_topk(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, grid: Sequence[tuple[float, float]], k: int = 10) -> DataFrame:
    """(k1, b, query_id, doc_id, score, rank): the ``k`` best documents of each query under every (k1, b) of ``grid``, from one pass over the corpus."""
    found = matches(docs, key, text, query_terms(queries, query_key, query_text)).groupBy("query_id", "doc_id").agg(*(F.round(F.sum(_part(k1, b)), 6).alias(f"s{i}") for i, (k1, b) in enumerate(grid)))
    each = F.explode(F.array(*(F.struct(F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.col(f"s{i}").alias("score")) for i, (k1, b) in enumerate(grid))))
    rows = found.select("query_id", "doc_id", each.alias("g")).select("g.*", "query_id", "doc_id").filter(F.col("score") > 0)
    w = Window.partitionBy("k1", "b", "query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best(ranked: DataFrame, k: int, score: str = "score", descending: bool = True) -> DataFrame:
    """The ``k`` best rows of each query with their rank from 1 (cut before the shuffle by the group limit)."""
    order = F.col(score).desc() if descending else F.col(score).asc()
    w = Window.partitionBy("query_id").orderBy(order, F.col("doc_id").asc())
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_topk(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best documents of each query. Null texts and queries match nothing."""
    return best(scores(docs, key, text, query_terms(queries, query_key, query_text), k1, b), k)
