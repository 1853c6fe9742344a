"""Keyword, vector and hybrid search over documents, chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shirabe.functions.text import STOP_WORDS, tokens
from shirabe.operators import bm25, fusion
from shirabe.operators.ann import ann_topk
from shirabe.operators.exact_knn import knn_topk
from shirabe.plans.registry import Registry
from shirabe.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_tokens(text: str) -> str:
    return rf"list_filter(string_split_regex(lower({text}), '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{3000}}\x{{2000}}-\x{{200A}}.,!?、。！？]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"


def sql_bm25(docs: str, queries: str, k1: float = bm25.K1, b: float = bm25.B) -> str:
    """CTEs ending in ``scored`` (query_id, doc_id, score); docs: (doc_id, text), queries: (query_id, q)."""
    return f"""d AS ({docs}), dt AS (SELECT doc_id, {sql_tokens("coalesce(text, '')")} AS ts FROM d), st AS (SELECT count(*) AS nd, avg(len(ts)) AS avgdl FROM dt),
    ex AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM dt), tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM ex GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    q AS ({queries}), qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest({sql_tokens("q")}) AS term FROM q) GROUP BY ALL),
    scored AS (SELECT query_id, doc_id, score FROM (SELECT query_id, doc_id, round(sum(qn * ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
      FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN st GROUP BY 1, 2) WHERE score > 0)"""


_ITEMS = "SELECT item_id AS query_id, query AS q FROM eval_items"
_DOCS = "SELECT doc_id, text FROM documents"
_WEB_DOCS = _DOCS + " WHERE upper(source_type) = 'WEB'"


def _rank(score: str = "score DESC") -> str:
    return f"row_number() OVER (PARTITION BY query_id ORDER BY {score}, doc_id)::INT"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _ranked(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return bm25.bm25_topk(_docs(spark, sf), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "query", k)


@query(f"WITH {sql_bm25(_DOCS, _ITEMS)} SELECT * FROM (SELECT query_id, doc_id, score, {_rank()} AS rank FROM scored) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf)


@query(f"SELECT doc_id, len(ts) AS n_terms, array_to_string(ts, ' ') AS terms FROM (SELECT doc_id, {sql_tokens('text')} AS ts FROM documents)")
def search_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", tokens(F.col("text")).alias("ts")).select("doc_id", F.when(F.col("ts").isNotNull(), F.size("ts")).cast("bigint").alias("n_terms"), F.array_join("ts", " ").alias("terms"))


@query(f"WITH {sql_bm25(_DOCS, _ITEMS)} SELECT term, df.df AS df, sum(tf.tf)::BIGINT AS cf FROM tf JOIN df USING (term) GROUP BY ALL")
def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.postings(_docs(spark, sf), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {sql_bm25(_DOCS, _ITEMS)} SELECT nd, round(avgdl, 6) AS avgdl FROM st")
def bm25_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.corpus_stats(_docs(spark, sf), "text").select("nd", F.round("avgdl", 6).alias("avgdl"))


@query("SELECT count(*) AS n, sum(strlen(text))::BIGINT AS bytes, sum(strlen(text)) > 268435456 AS over_limit FROM documents")
def corpus_size(spark: SparkSession, sf: str) -> DataFrame:
    size = F.sum(F.octet_length("text"))
    return _docs(spark, sf).agg(F.count(F.lit(1)).alias("n"), size.alias("bytes"), (size > 256 * 1024 * 1024).alias("over_limit"))


@query(
    f"WITH {sql_bm25(_DOCS, _ITEMS)}, r AS (SELECT query_id, doc_id, score, {_rank()} AS first_rank FROM scored), f AS (SELECT r.* FROM r JOIN documents USING (doc_id) WHERE first_rank <= 30 AND upper(source_type) = 'WEB')"
    " SELECT * FROM (SELECT query_id, doc_id, score, first_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM f) WHERE rank <= 10"
)
def bm25_post_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The filter comes after the first max(3n, 20) hits, so fewer than n may remain."""
    first = _ranked(spark, sf, 30).withColumnRenamed("rank", "first_rank")
    kept = first.join(_docs(spark, sf).filter(F.upper("source_type") == "WEB").select("doc_id"), "doc_id", "left_semi")
    return bm25.best(kept, 10).select("query_id", "doc_id", "score", "first_rank", "rank")


@query(f"WITH {sql_bm25(_WEB_DOCS, _ITEMS)} SELECT * FROM (SELECT query_id, doc_id, score, {_rank()} AS rank FROM scored) WHERE rank <= 10")
def bm25_pre_filtered(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).filter(F.upper("source_type") == "WEB")
    return bm25.bm25_topk(docs, "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "query")


_DIST = "round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"
_KNN = f"knn AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, {_DIST} AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)"


def _knn(spark: SparkSession, sf: str, k: int, threshold: float | None = None, label: int | None = None) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    asked = rows.filter(F.col("vec_id") % 50 == 0)
    return knn_topk(rows if label is None else rows.filter(F.col("label") == label), "vec_id", "embedding", asked, "vec_id", "embedding", k, threshold)


@query(f"WITH {_KNN} SELECT * FROM (SELECT *, {_rank('distance')} AS rank FROM knn) WHERE rank <= 10")
def knn_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, 10)


@query()
def ann_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """About what ``knn_nearest`` gives, by hashed buckets; the rows with ids divisible by 50 ask all rows."""
    rows = table(spark, sf, "embeddings")
    return ann_topk(rows, "vec_id", "embedding", rows.filter(F.col("vec_id") % 50 == 0), "vec_id", "embedding")


@query(f"WITH {_KNN} SELECT * FROM (SELECT *, {_rank('distance')} AS rank FROM knn WHERE distance <= 0.5) WHERE rank <= 10")
def knn_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, 10, 0.5)


@query(f"WITH {_KNN} SELECT * FROM (SELECT knn.*, {_rank('distance')} AS rank FROM knn JOIN embeddings l ON l.vec_id = doc_id WHERE label = 3) WHERE rank <= 10")
def knn_where(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, 10, label=3)


_BOTH = (
    f"{_KNN}, v0 AS (SELECT * FROM (SELECT *, {_rank('distance')} AS r FROM knn) WHERE r <= 30), {sql_bm25(_DOCS, 'SELECT item_id AS query_id, query AS q FROM eval_items WHERE item_id % 50 = 0')},"
    f" k0 AS (SELECT * FROM (SELECT *, {_rank()} AS r FROM scored) WHERE r <= 30),"
    " v1 AS (SELECT query_id, doc_id, distance, 1 - distance AS s, min(1 - distance) OVER w AS lo, max(1 - distance) OVER w AS hi FROM v0 WINDOW w AS (PARTITION BY query_id)),"
    " k1 AS (SELECT query_id, doc_id, score AS s, min(score) OVER w AS lo, max(score) OVER w AS hi FROM k0 WINDOW w AS (PARTITION BY query_id)),"
    " v2 AS (SELECT query_id, doc_id, distance, CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END AS n FROM v1), k2 AS (SELECT query_id, doc_id, s, CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END AS n FROM k1),"
    " c AS (SELECT coalesce(v2.query_id, k2.query_id) AS query_id, coalesce(v2.doc_id, k2.doc_id) AS doc_id, v2.distance AS vector_distance, k2.s AS bm25_score, round(0.9 * coalesce(v2.n, 0) + (1 - 0.9) * coalesce(k2.n, 0), 6) AS score"
    " FROM v2 FULL JOIN k2 ON v2.query_id = k2.query_id AND v2.doc_id = k2.doc_id)"
)


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    asked = table(spark, sf, "eval_items").filter(F.col("item_id") % 50 == 0)
    return _knn(spark, sf, 30), bm25.bm25_topk(_docs(spark, sf), "doc_id", "text", asked, "item_id", "query", 30)


@query(f"WITH {_BOTH} SELECT * FROM (SELECT c.*, {_rank()} AS rank FROM c WHERE score > 0) WHERE rank <= 10")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and vectors of equal number stand for each other; the queries are every fiftieth."""
    return fusion.hybrid(*_sides(spark, sf))


@query(f"WITH {_BOTH} SELECT * FROM (SELECT c.*, {_rank()} AS rank FROM c WHERE score > 0) WHERE rank <= 10 AND score >= 0.5")
def hybrid_least_score(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.hybrid(*_sides(spark, sf), least=0.5)


@query(f"WITH {_BOTH} SELECT query_id, doc_id, round(n, 6) AS v FROM v2")
def minmax_normalise(spark: SparkSession, sf: str) -> DataFrame:
    near, _ = _sides(spark, sf)
    return near.select("query_id", "doc_id", F.round(fusion.min_max(1 - F.col("distance")), 6).alias("v"))


@query(f"WITH {_BOTH} SELECT query_id, doc_id, score FROM c WHERE score > 0")
def convex_combination(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.combine(*_sides(spark, sf)).select("query_id", "doc_id", "score")


@query(
    f"WITH {_BOTH} SELECT 'vector' AS engine, query_id, doc_id, r AS rank, distance AS value, source_type FROM v0 LEFT JOIN documents USING (doc_id) WHERE r <= 10"
    " UNION ALL SELECT 'keyword', query_id, doc_id, r, score, source_type FROM k0 LEFT JOIN documents USING (doc_id) WHERE r <= 10"
)
def raw_dual(spark: SparkSession, sf: str) -> DataFrame:
    near, words = _sides(spark, sf)
    meta = _docs(spark, sf).select("doc_id", "source_type")
    both = near.select(F.lit("vector").alias("engine"), "query_id", "doc_id", "rank", F.col("distance").alias("value")).unionByName(
        words.select(F.lit("keyword").alias("engine"), "query_id", "doc_id", "rank", F.col("score").alias("value"))
    )
    return both.filter(F.col("rank") <= 10).join(meta, "doc_id", "left").select("engine", "query_id", "doc_id", "rank", "value", "source_type")


_TOP = f"{sql_bm25(_DOCS, _ITEMS)}, top AS (SELECT * FROM (SELECT query_id, doc_id, score, {_rank()} AS rank FROM scored) WHERE rank <= 5)"


@query(
    f"WITH {_TOP} SELECT query_id, string_agg('--- 参考情報 ' || rank || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,"
    " (SELECT string_agg(source, ',' ORDER BY m, source) FROM (SELECT source, min(rank) AS m FROM top t JOIN documents USING (doc_id) WHERE t.query_id = top.query_id GROUP BY 1)) AS sources FROM top JOIN documents USING (doc_id) GROUP BY query_id"
)
def retrieve_context(spark: SparkSession, sf: str) -> DataFrame:
    """Context blocks of the best documents and their sources in order of first use."""
    top = _ranked(spark, sf, 5).join(_docs(spark, sf).select("doc_id", "text", "source"), "doc_id")
    block = F.concat(F.lit("--- 参考情報 "), F.col("rank"), F.lit(" ---\n"), F.col("text"))
    blocks = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    firsts = top.groupBy("query_id", "source").agg(F.min("rank").alias("m")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("m", "source"))).alias("ss"))
    return blocks.join(firsts, "query_id").select("query_id", F.array_join(F.col("bs.b"), "\n\n").alias("context"), F.array_join(F.col("ss.source"), ",").alias("sources"))


@query(
    f"WITH {_TOP} SELECT query_id, rank, '[' || rank || '/5] score=' || printf('%.3f', score) || ' ' || coalesce(title, '?') AS line FROM top JOIN documents USING (doc_id)"
)
def format_results(spark: SparkSession, sf: str) -> DataFrame:
    top = _ranked(spark, sf, 5).join(_docs(spark, sf).select("doc_id", "title"), "doc_id")
    return top.select("query_id", "rank", F.format_string("[%d/5] score=%.3f %s", "rank", "score", F.coalesce("title", F.lit("?"))).alias("line"))


@query(f"WITH {_TOP} SELECT query_id, doc_id, rank, source_type, title, length(text) AS n_chars FROM top JOIN documents USING (doc_id)")
def hydrate_results(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, 5).join(_docs(spark, sf), "doc_id").select("query_id", "doc_id", "rank", "source_type", "title", F.char_length("text").cast("bigint").alias("n_chars"))


@query("SELECT source_id, string_agg(text, chr(10) ORDER BY chunk_index) AS page FROM (SELECT DISTINCT id, source_id, chunk_index, text FROM chunks) GROUP BY 1")
def full_page_text(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of each source joined in order; a chunk upserted again counts once, null texts are left out."""
    once = table(spark, sf, "chunks").select("id", "source_id", "chunk_index", "text").distinct()
    parts = once.groupBy("source_id").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("chunk_index", "text")))).alias("p"))
    return parts.select("source_id", F.when(F.size("p") > 0, F.array_join(F.col("p.text"), "\n")).alias("page"))


@query("SELECT source_id, count(*) AS n, min(chunk_index) AS first_index, max(chunk_index) AS last_index FROM (SELECT DISTINCT id, source_id, chunk_index FROM chunks) GROUP BY 1")
def chunks_by_source(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "chunks").select("id", "source_id", "chunk_index").distinct()
    return once.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"))


@query("SELECT source_type, count(DISTINCT id) AS chunks, count(DISTINCT chunk_id) AS with_vector FROM chunks LEFT JOIN chunk_vectors ON id = chunk_id GROUP BY 1")
def index_coverage(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "chunks").select("id", "source_type").distinct()
    have = table(spark, sf, "chunk_vectors").select(F.col("chunk_id").alias("id")).distinct().withColumn("h", F.lit(1))
    return ids.join(have, "id", "left").groupBy("source_type").agg(F.count(F.lit(1)).alias("chunks"), F.count("h").alias("with_vector"))
