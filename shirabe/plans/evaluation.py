"""Retrieval quality of keyword search over the evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.operators import bm25
from shirabe.operators.evaluate import f1, precision, recall, score
from shirabe.plans.registry import Registry
from shirabe.plans.search import _DOCS, _ITEMS, _rank, sql_bm25
from shirabe.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _sources_of(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, retrieved): the sources of the ranked documents in order of their first rank."""
    first = ranked.join(docs.select("doc_id", "source"), "doc_id").groupBy("query_id", "source").agg(F.min("rank").alias("m"))
    return first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("m", "source"))).getField("source").alias("retrieved"))


def _judged(spark: SparkSession, sf: str, n: int = 10, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
    docs, items = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    got = _sources_of(bm25.bm25_topk(docs, "doc_id", "text", items, "item_id", "query", n, k1, b), docs)
    bare = lambda c: F.array_distinct(F.transform(c, lambda s: F.regexp_replace(s, "/$", "")))
    truth = items.select(F.col("item_id").alias("query_id"), bare("expected_sources").alias("expected"), bare("negative_sources").alias("negative"), F.coalesce("category", F.lit("none")).alias("category"))
    return truth.join(got, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))


_BARE = "list_distinct(list_transform({c}, lambda s: regexp_replace(s, '/$', '')))"
_JUDGE = f"""top AS (SELECT * FROM (SELECT query_id, doc_id, score, {_rank()} AS rank FROM scored) WHERE rank <= 10), fs AS (SELECT query_id, source, min(rank) AS m FROM top JOIN documents USING (doc_id) GROUP BY 1, 2),
got AS (SELECT query_id, list(source ORDER BY m, source) AS retrieved FROM fs GROUP BY 1),
j AS (SELECT item_id AS query_id, {_BARE.format(c="expected_sources")} AS expected, {_BARE.format(c="negative_sources")} AS negative, coalesce(category, 'none') AS category, coalesce(retrieved, []) AS retrieved FROM eval_items LEFT JOIN got ON item_id = query_id),
c AS (SELECT *, len(list_intersect(retrieved, expected)) AS tp, len(retrieved) AS nr, len(expected) AS ne FROM j),
p AS (SELECT *, CASE WHEN nr > 0 THEN tp / nr WHEN ne = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN ne > 0 THEN tp / ne WHEN nr = 0 THEN 1.0 ELSE 0.0 END AS r FROM c),
s AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1,
  CASE WHEN ne = 0 THEN (CASE WHEN nr = 0 THEN 1.0 ELSE 0.0 END) WHEN least(ne, nr) = 0 THEN 0.0 ELSE list_sum(list_transform(generate_series(1, nr), lambda i: CASE WHEN list_contains(expected, retrieved[i]) THEN 1 / log2(i + 1) ELSE 0.0 END)) / list_sum(list_transform(generate_series(1, least(ne, nr)), lambda i: 1 / log2(i + 1))) END AS ndcg,
  CASE WHEN ne = 0 THEN (CASE WHEN nr = 0 THEN 1.0 ELSE 0.0 END) ELSE coalesce(1.0 / list_min(list_filter(list_transform(generate_series(1, nr), lambda i: CASE WHEN list_contains(expected, retrieved[i]) THEN i END), lambda i: i IS NOT NULL)), 0.0) END AS mrr FROM p),
t AS (SELECT *, CASE WHEN p = 1 AND r = 1 THEN [] ELSE list_filter([CASE WHEN tp < ne THEN 'retrieval_miss' END, CASE WHEN tp < nr THEN 'retrieval_noise' END, CASE WHEN r > 0 AND r < 1 AND ndcg < 0.5 THEN 'chunk_fragmentation' END, CASE WHEN ne > 0 AND tp = 0 THEN 'query_mismatch' END], lambda x: x IS NOT NULL) END AS tags FROM s)"""
_JUDGED = f"{sql_bm25(_DOCS, _ITEMS)}, {_JUDGE}"
GRID = tuple((k1, b) for k1 in (1.5, 2.5) for b in (0.5, 0.75))


@query(f"WITH {_JUDGED} SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM t")
def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    return score(_judged(spark, sf)).select("query_id", "precision", "recall", "f1")


@query(f"WITH {_JUDGED} SELECT query_id, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM t")
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return score(_judged(spark, sf)).select("query_id", "ndcg", "mrr")


@query(f"WITH {_JUDGED} SELECT query_id, array_to_string(list_filter(retrieved, lambda x: list_contains(negative, x)), ',') AS negatives FROM t")
def negative_hits(spark: SparkSession, sf: str) -> DataFrame:
    return score(_judged(spark, sf)).select("query_id", F.array_join("negatives", ",").alias("negatives"))


@query(f"WITH {_JUDGED} SELECT query_id, array_to_string(tags, ',') AS tags FROM t")
def failure_tags(spark: SparkSession, sf: str) -> DataFrame:
    return score(_judged(spark, sf)).select("query_id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_JUDGED} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY 1")
def tag_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return score(_judged(spark, sf)).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_JUDGED} SELECT category, count(*) AS n, round(avg(p), 4) AS precision, round(avg(r), 4) AS recall, round(avg(f1), 4) AS f1, round(avg(ndcg), 4) AS ndcg, round(avg(mrr), 4) AS mrr FROM t GROUP BY ROLLUP (category)")
def evaluation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Averages over all queries, by category and (null) overall."""
    metrics = ("precision", "recall", "f1", "ndcg", "mrr")
    return score(_judged(spark, sf)).rollup("category").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(m), 4).alias(m) for m in metrics))


@query(f"WITH {_JUDGED} SELECT round(avg(f1), 4) AS f1, round(round(avg(f1), 4) - 0.9, 4) AS delta, round(avg(f1), 4) - 0.9 < -0.1 AS regressed FROM t")
def regression_check(spark: SparkSession, sf: str) -> DataFrame:
    """Against a baseline of 0.9: a fall of more than 0.1 is a regression."""
    now = score(_judged(spark, sf)).agg(F.round(F.avg("f1"), 4).alias("f1"))
    return now.select("f1", F.round(F.col("f1") - 0.9, 4).alias("delta"), (F.col("f1") - 0.9 < -0.1).alias("regressed"))


@query(
    f"""WITH {_JUDGED}, n AS (SELECT unnest([1, 3, 5, 10]) AS n), g AS (SELECT n, query_id, list_distinct(list(source)) AS got FROM top JOIN documents USING (doc_id), n WHERE rank <= n GROUP BY 1, 2),
    e AS (SELECT n.n, j.query_id, expected, coalesce(got, []) AS got FROM j CROSS JOIN n LEFT JOIN g ON g.n = n.n AND g.query_id = j.query_id), dq AS (SELECT n, len(list_intersect(got, expected)) AS tp, len(got) AS nr, len(expected) AS ne FROM e),
    pr AS (SELECT n, CASE WHEN nr > 0 THEN tp / nr WHEN ne = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN ne > 0 THEN tp / ne WHEN nr = 0 THEN 1.0 ELSE 0.0 END AS r FROM dq) SELECT n, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 4) AS f1 FROM pr GROUP BY 1"""
)
def depth_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """F1 for result lists of 1, 3, 5 and 10, from one ranking: the parameter grid joins the ranked rows, not the corpus."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    grid = spark.createDataFrame([(n,) for n in (1, 3, 5, 10)], "n int")
    top = bm25.bm25_topk(docs, "doc_id", "text", items, "item_id", "query").join(docs.select("doc_id", "source"), "doc_id")
    got = top.join(F.broadcast(grid), F.col("rank") <= F.col("n")).groupBy("n", "query_id").agg(F.collect_set("source").alias("got"))
    truth = items.select(F.col("item_id").alias("query_id"), F.array_distinct(F.transform("expected_sources", lambda s: F.regexp_replace(s, "/$", ""))).alias("expected"))
    all_ = truth.crossJoin(F.broadcast(grid)).join(got, ["n", "query_id"], "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    p, r = precision(F.col("got"), F.col("expected")), recall(F.col("got"), F.col("expected"))
    return all_.groupBy("n").agg(F.round(F.avg(f1(p, r)), 4).alias("f1"))


@query(" UNION ALL ".join(f"SELECT {k1}::DOUBLE AS k1, {b}::DOUBLE AS b, f1 FROM (WITH {sql_bm25(_DOCS, _ITEMS, k1, b)}, {_JUDGE} SELECT round(avg(f1), 4) AS f1 FROM t)" for k1, b in GRID))
def parameter_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Mean F1 for a grid of saturation and length weights: (k1, b, f1). All pairs are scored in one pass over the corpus."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    top = bm25.grid_topk(docs, "doc_id", "text", items, "item_id", "query", GRID).join(docs.select("doc_id", "source"), "doc_id")
    got = top.groupBy("k1", "b", "query_id").agg(F.collect_set("source").alias("got"))
    grid = spark.createDataFrame(list(GRID), "k1 double, b double")
    truth = items.select(F.col("item_id").alias("query_id"), F.array_distinct(F.transform("expected_sources", lambda s: F.regexp_replace(s, "/$", ""))).alias("expected"))
    all_ = truth.crossJoin(F.broadcast(grid)).join(got, ["k1", "b", "query_id"], "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    p, r = precision(F.col("got"), F.col("expected")), recall(F.col("got"), F.col("expected"))
    return all_.groupBy("k1", "b").agg(F.round(F.avg(f1(p, r)), 4).alias("f1"))
