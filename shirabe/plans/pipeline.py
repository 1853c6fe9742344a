"""Incremental processing: snapshots and their differences, stale rows, exclusions, failure runs and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.operators import changes
from shirabe.plans.registry import Registry
from shirabe.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_CUT = "2025-06-01T00:00:00.000000+00:00"


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The active sources as they stood at the cut and as they stand now."""
    rows = table(spark, sf, "sources").select("row_id", F.col("source_id").alias("path"), F.col("content_hash").alias("hash"), "title", "meta", "status", "updated_at")
    old, new = changes.snapshot(rows, "path", "updated_at", F.col("updated_at") < _CUT), changes.snapshot(rows, "path", "updated_at")
    active = F.col("status") == "active"
    return old.filter(active), new.filter(active)


_SNAPS = f"""snap AS (SELECT source_id AS path, content_hash AS hash, title, meta, status, row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, row_id DESC) AS k FROM sources),
early AS (SELECT source_id AS path, content_hash AS hash, title, meta, status, row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, row_id DESC) AS k FROM sources WHERE updated_at < '{_CUT}'),
n AS (SELECT * FROM snap WHERE k = 1 AND status = 'active'), o AS (SELECT * FROM early WHERE k = 1 AND status = 'active'),
net AS (SELECT * FROM (SELECT CASE WHEN o.hash IS NULL THEN 'A' WHEN n.hash IS NULL THEN 'D' WHEN o.hash <> n.hash THEN 'M' END AS status, coalesce(o.path, n.path) AS path, coalesce(n.hash, o.hash) AS digest FROM o FULL JOIN n ON o.path = n.path) WHERE status IS NOT NULL),
rk AS (SELECT *, CASE WHEN status <> 'M' THEN row_number() OVER (PARTITION BY status, digest ORDER BY path) END AS i FROM net),
pr AS (SELECT a.path AS came, d.path AS gone FROM rk a JOIN rk d ON a.digest = d.digest AND a.i = d.i WHERE a.status = 'A' AND d.status = 'D')"""


@query(
    f"WITH {_SNAPS} SELECT CASE WHEN came IS NOT NULL THEN 'R' ELSE status END AS status, rk.path, gone AS old_path FROM rk LEFT JOIN pr ON rk.path = came AND status = 'A' WHERE NOT (status = 'D' AND rk.path IN (SELECT gone FROM pr))"
)
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    return changes.manifest_diff(*_versions(spark, sf))


@query(f"WITH {_SNAPS} SELECT DISTINCT source_id AS path FROM sources WHERE updated_at >= '{_CUT}' AND source_id NOT IN (SELECT path FROM net) AND source_id IN (SELECT path FROM n)")
def hidden_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that were touched since the cut without a net difference and still exist."""
    old, new = _versions(spark, sf)
    touched = table(spark, sf, "sources").filter(F.col("updated_at") >= _CUT).select(F.col("source_id").alias("path")).distinct()
    return touched.join(changes.manifest_diff(old, new).select("path"), "path", "left_anti").join(new.select("path"), "path", "left_semi")


@query(f"WITH {_SNAPS} SELECT o.path, CASE WHEN o.hash <> n.hash THEN 'modified' WHEN o.title IS DISTINCT FROM n.title OR o.meta IS DISTINCT FROM n.meta THEN 'meta_only' ELSE 'same' END AS kind FROM o JOIN n ON o.path = n.path")
def classify_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A change of the data outweighs one of its description."""
    old, new = _versions(spark, sf)
    o, n = old.alias("o"), new.alias("n")
    kind = F.when(F.col("o.hash") != F.col("n.hash"), "modified").when(~F.col("o.title").eqNullSafe(F.col("n.title")) | ~F.col("o.meta").eqNullSafe(F.col("n.meta")), "meta_only").otherwise("same")
    return o.join(n, F.col("o.path") == F.col("n.path")).select(F.col("o.path").alias("path"), kind.alias("kind"))


@query("SELECT source_id AS path, content_hash AS hash FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, row_id DESC) AS k FROM sources) WHERE k = 1 AND status = 'active'")
def scan_as_added(spark: SparkSession, sf: str) -> DataFrame:
    return _versions(spark, sf)[1].select("path", "hash")


@query("SELECT DISTINCT c.id, c.source_id FROM chunks c JOIN (SELECT source_id, arg_max(total_chunks, (indexed_at, id)) AS total FROM chunks WHERE total_chunks IS NOT NULL GROUP BY 1) t ON c.source_id = t.source_id WHERE c.chunk_index >= total")
def stale_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks beyond the number that their source last had."""
    chunks = table(spark, sf, "chunks")
    total = chunks.filter(F.col("total_chunks").isNotNull()).groupBy("source_id").agg(F.max_by("total_chunks", F.struct("indexed_at", "id")).alias("total"))
    return chunks.join(total, "source_id").filter(F.col("chunk_index") >= F.col("total")).select("id", "source_id").distinct()


@query("SELECT id, epoch_us(max(indexed_at)) AS indexed_us, count(*) AS upserts FROM chunks GROUP BY 1")
def chunk_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").groupBy("id").agg(F.unix_micros(F.max("indexed_at")).alias("indexed_us"), F.count(F.lit(1)).alias("upserts"))


@query("SELECT chunk_id, epoch_us(max(embedded_at)) AS embedded_us, arg_max(len(embedding), embedded_at) AS dims, count(*) AS versions FROM (SELECT chunk_id, embedded_at, coalesce(embedding, []) AS embedding FROM chunk_vectors) GROUP BY 1")
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    dims = F.size(F.coalesce("embedding", F.array().cast("array<float>"))).cast("bigint")
    return table(spark, sf, "chunk_vectors").groupBy("chunk_id").agg(F.unix_micros(F.max("embedded_at")).alias("embedded_us"), F.max_by(dims, "embedded_at").alias("dims"), F.count(F.lit(1)).alias("versions"))


@query("SELECT DISTINCT chunk_id FROM chunk_vectors WHERE chunk_id NOT IN (SELECT id FROM chunks)")
def orphan_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_vectors").select("chunk_id").distinct().join(table(spark, sf, "chunks").select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")


@query("SELECT id, substring(sha256(text), 1, 16) AS text_hash, count(*) AS hits FROM chunks WHERE text IS NOT NULL GROUP BY 1, 2")
def token_cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of cached tokens: a chunk whose text changed gets another one."""
    key = F.substring(F.sha2("text", 256), 1, 16)
    return table(spark, sf, "chunks").filter(F.col("text").isNotNull()).groupBy("id", key.alias("text_hash")).agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT filepath FROM page_files WHERE filepath NOT IN (SELECT filepath FROM crawl_log WHERE status <> 200 AND filepath IS NOT NULL)")
def rebuild_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """What a rebuild indexes: everything but what failed before."""
    failed = table(spark, sf, "crawl_log").filter((F.col("status") != 200) & F.col("filepath").isNotNull()).select("filepath")
    return table(spark, sf, "page_files").select("filepath").join(failed, "filepath", "left_anti")


@query(
    """WITH a AS (SELECT user_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events),
    i AS (SELECT *, position - row_number() OVER (PARTITION BY user_id, f ORDER BY position) AS isl FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, f, isl ORDER BY position) AS run FROM i)
    SELECT user_id, position, run FROM r WHERE f AND run = 3"""
)
def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    return changes.failure_runs(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) >= 99 AS aborted FROM events GROUP BY 1")
def merge_results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), (F.max("value") >= 99).alias("aborted"))


@query(
    """WITH b AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value AS e FROM events), g AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b)
    SELECT user_id, event_id, sum(CASE WHEN p IS NULL OR s - p >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g"""
)
def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), "value")
    return changes.gap_sessions(rows, "user_id", ["s", "event_id"], F.col("s"), F.col("s") + F.col("value"), 3600).select("user_id", "event_id", "session")


@query("SELECT regexp_extract(filepath, '\\.([a-z]+)$', 1) AS ext, count(*) FILTER (trim(body) <> '') AS ok, count(*) FILTER (trim(coalesce(body, '')) = '') AS skipped, sum(strlen(body))::BIGINT AS bytes FROM page_files GROUP BY 1")
def conversion_summary(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.trim(F.coalesce("body", F.lit(""))) == ""
    return table(spark, sf, "page_files").groupBy(F.regexp_extract("filepath", r"\.([a-z]+)$", 1).alias("ext")).agg(
        F.count_if(~blank).alias("ok"), F.count_if(blank).alias("skipped"), F.sum(F.octet_length("body")).alias("bytes")
    )
