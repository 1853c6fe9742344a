"""Upkeep of catalogue and indexes: lookups, partial updates, placement, rebuilding, deletes in both indexes, scoped runs, imports and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shirabe.functions import paths as P
from shirabe.functions import text as T
from shirabe.functions.text import ngram_tokens
from shirabe.operators import bm25, changes
from shirabe.plans.pipeline import _SNAPS, _versions
from shirabe.plans.registry import Registry
from shirabe.plans.search import sql_tokens
from shirabe.plans.web import _PATH, _u
from shirabe.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

NOW = "2026-01-01T00:00:00.000000+00:00"
_LATEST = "(SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, row_id DESC) AS k FROM sources) WHERE k = 1)"


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources")


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest delivery of each source; one pass with partial aggregation, so a source delivered very often is combined before the exchange."""
    rows = _sources(spark, sf)
    others = [c for c in rows.columns if c not in ("source_id", "updated_at", "row_id")]
    newest = rows.groupBy("source_id").agg(F.max(F.struct("updated_at", "row_id", *others)).alias("r"))
    return newest.select("source_id", "r.*")


# --- catalogue ---


@query(f"SELECT source_type, source_id, title, status FROM {_LATEST} WHERE source_id IN (SELECT min(source_id) FROM sources GROUP BY source_type)")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One source by its id: here the first of each type. A missing id has no row."""
    wanted = _sources(spark, sf).groupBy("source_type").agg(F.min("source_id").alias("source_id")).select("source_id")
    return _latest(spark, sf).join(F.broadcast(wanted), "source_id", "left_semi").select("source_type", "source_id", "title", "status")  # one id a type


@query("SELECT row_id, CASE WHEN status = 'deleted' AND starts_with(source_id, 'web/') THEN 'active' ELSE status END AS status, status = 'deleted' AND starts_with(source_id, 'web/') AS restored FROM sources")
def restore_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Soft-deleted sources under a prefix become active again; all others stay."""
    back = (F.col("status") == "deleted") & F.col("source_id").startswith("web/")
    return _sources(spark, sf).select("row_id", F.when(back, "active").otherwise(F.col("status")).alias("status"), back.alias("restored"))


@query(
    f"WITH n AS (SELECT source_id, arg_max(title, (indexed_at, id)) AS title FROM chunks WHERE title IS NOT NULL AND title <> '' GROUP BY 1) SELECT s.source_id, coalesce(n.title, s.title) AS title, s.content_hash, n.title IS NOT NULL AND n.title IS DISTINCT FROM s.title AS changed FROM {_LATEST} s LEFT JOIN n ON s.source_id = n.source_id"
)
def update_fields(spark: SparkSession, sf: str) -> DataFrame:
    """A partial update: the given fields replace the old ones, all others stay; here titles as the index has them."""
    chunks = table(spark, sf, "chunks").filter(F.coalesce("title", F.lit("")) != "")
    new = chunks.groupBy("source_id").agg(F.max_by("title", F.struct("indexed_at", "id")).alias("new"))
    out = _latest(spark, sf).join(new, "source_id", "left")
    return out.select("source_id", F.coalesce("new", "title").alias("title"), "content_hash", (F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("title"))).alias("changed"))


@query("SELECT row_id FROM sources WHERE json_type(meta, '$.depth') IN ('BIGINT', 'UBIGINT') AND (meta->>'$.depth')::BIGINT = 2")
def json_filter_number(spark: SparkSession, sf: str) -> DataFrame:
    """Typed equality with a number: texts of the same digits do not count."""
    v = F.try_parse_json("meta")
    return _sources(spark, sf).filter((F.schema_of_variant(F.try_variant_get(v, "$.depth", "variant")) == "BIGINT") & (F.try_variant_get(v, "$.depth", "bigint") == 2)).select("row_id")


@query(
    f"""WITH h AS (SELECT substring(updated_at, 1, 10) AS day, max(row_id) AS last, count(*) AS n FROM sources WHERE source_type = 'web' GROUP BY 1)
    SELECT row_number() OVER (ORDER BY day) AS run, coalesce(lag(substring(sha256(day || last), 1, 40)) OVER (ORDER BY day), repeat('0', 40)) AS from_commit, substring(sha256(day || last), 1, 40) AS to_commit, n FROM h"""
)
def history_append(spark: SparkSession, sf: str) -> DataFrame:
    """The log of runs: each goes from the commit of the one before, the first from forty zeros. One row a day reaches the window."""
    days = _sources(spark, sf).filter(F.col("source_type") == "web").groupBy(F.substring("updated_at", 1, 10).alias("day")).agg(F.max("row_id").alias("last"), F.count(F.lit(1)).alias("n"))
    runs = days.withColumn("to_commit", F.substring(F.sha2(F.concat("day", F.col("last").cast("string")), 256), 1, 40))
    order = Window.orderBy("day")
    return runs.select(F.row_number().over(order).cast("bigint").alias("run"), F.coalesce(F.lag("to_commit").over(order), F.repeat(F.lit("0"), 40)).alias("from_commit"), "to_commit", "n")


@query(
    f"""WITH seen AS (SELECT source_id, min(collected_at) AS first FROM sources GROUP BY 1), l AS (SELECT log_id, {_PATH} AS path, nullif(collected_at, '') AS told FROM crawl_log WHERE status = 200)
    SELECT path, CASE WHEN max(first) IS NOT NULL THEN max(first) ELSE coalesce(arg_max(told, log_id), '{NOW}') END AS collected_at, max(first) IS NOT NULL AS known FROM l LEFT JOIN seen ON source_id = path GROUP BY path"""
)
def place_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files placed into the store: the time of collection is the one already known, else what comes with the file, else now."""
    seen = _sources(spark, sf).groupBy(F.col("source_id").alias("path")).agg(F.min("collected_at").alias("first"))
    log = table(spark, sf, "crawl_log").filter(F.col("status") == 200).select("log_id", P.url_to_path(F.col("url")).alias("path"), F.nullif("collected_at", F.lit("")).alias("told"))
    told = F.max_by(F.col("told"), F.when(F.col("told").isNotNull(), F.col("log_id")))
    placed = log.groupBy("path").agg(told.alias("told")).join(seen, "path", "left")
    return placed.select("path", F.coalesce("first", "told", F.lit(NOW)).alias("collected_at"), F.col("first").isNotNull().alias("known"))


@query(
    """WITH p AS (SELECT 'web/https/' || filepath AS source_id, sha256(body) AS content_hash, strlen(body)::BIGINT AS file_size, trim(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t FROM page_files)
    SELECT source_id, 'web' AS source_type, content_hash, file_size, CASE WHEN coalesce(t, '') <> '' THEN t ELSE regexp_extract(regexp_extract(source_id, '[^/]+$'), '^(.+?)(\\.[^.]*)?$', 1) END AS title, 'scan' AS origin FROM p
    UNION ALL SELECT source_id, source_type, content_hash, file_size, title, 'kept' FROM sources WHERE source_type <> 'web'"""
)
def rebuild_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """The scope (type web) is registered anew from its files; rows outside the scope stay."""
    sid = F.concat(F.lit("web/https/"), F.col("filepath"))
    found = F.trim(F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title>", 1))
    stem = F.regexp_extract(F.regexp_extract(sid, "[^/]+$", 0), r"^(.+?)(\.[^.]*)?$", 1)
    title = F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(stem)
    scan = table(spark, sf, "page_files").select(sid.alias("source_id"), F.lit("web").alias("source_type"), F.sha2("body", 256).alias("content_hash"), F.octet_length("body").cast("bigint").alias("file_size"), title.alias("title"), F.lit("scan").alias("origin"))
    kept = _sources(spark, sf).filter(F.col("source_type") != "web").select("source_id", "source_type", "content_hash", "file_size", "title", F.lit("kept").alias("origin"))
    return scan.unionByName(kept)


@query(
    """SELECT row_id, unnest(map_keys(m)) AS key, unnest(map_values(m)) AS value FROM (SELECT row_id, map_from_entries(list_filter([struct_pack(k := 'channel_id', v := channel_id), struct_pack(k := 'uploader', v := uploader), struct_pack(k := 'upload_date', v := upload_date), struct_pack(k := 'duration', v := CAST(duration AS VARCHAR))], lambda e: e.v IS NOT NULL AND e.v <> '')) AS m FROM videos)"""
)
def metadata_fields(spark: SparkSession, sf: str) -> DataFrame:
    """What a source's description keeps beside the common columns: the fields that have a value."""
    names = ("channel_id", "uploader", "upload_date", "duration")
    fields = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]), lambda _, v: v.isNotNull() & (v != ""))
    return table(spark, sf, "videos").select("row_id", F.explode(fields).alias("key", "value"))


#: The types of sources, and whether a sidecar describes each.
SIDECAR = {"web": True, "local": False, "journal": True, "zenn": True, "bluesky": True, "youtube": True, "aozora": True}


@query("SELECT t.source_type, t.has_meta, count(s.source_id) AS n FROM (VALUES ('web', true), ('local', false), ('journal', true), ('zenn', true), ('bluesky', true), ('youtube', true), ('aozora', true)) t(source_type, has_meta) LEFT JOIN sources s USING (source_type) GROUP BY 1, 2")
def type_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Every type with its attributes and its number of rows, types without rows too."""
    kinds = spark.createDataFrame(list(SIDECAR.items()), "source_type string, has_meta boolean")
    counts = _sources(spark, sf).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counts, "source_type", "left").select("source_type", "has_meta", F.coalesce("n", F.lit(0)).alias("n"))


# --- both indexes ---

_GONE = "(SELECT source_id FROM sources WHERE status = 'deleted')"


@query(
    f"""WITH dead AS (SELECT DISTINCT id FROM chunks WHERE source_id IN {_GONE}) SELECT 'text' AS idx, count(*) AS before, count(*) FILTER (id IN (SELECT id FROM dead)) AS deleted FROM (SELECT DISTINCT id FROM chunks)
    UNION ALL SELECT 'vector', count(*), count(*) FILTER (chunk_id IN (SELECT id FROM dead)) FROM (SELECT DISTINCT chunk_id FROM chunk_vectors)"""
)
def index_source_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Deleted sources leave both indexes: how many entries each had, and how many go."""
    gone = _sources(spark, sf).filter(F.col("status") == "deleted").select("source_id").distinct()
    chunks = table(spark, sf, "chunks").select("id", "source_id")
    dead = chunks.join(gone, "source_id", "left_semi").select("id").distinct().withColumn("dead", F.lit(True))

    def side(name: str, ids: DataFrame) -> DataFrame:
        return ids.join(dead, "id", "left").agg(F.count(F.lit(1)).alias("before"), F.count_if(F.coalesce("dead", F.lit(False))).alias("deleted")).select(F.lit(name).alias("idx"), "before", "deleted")

    return side("text", chunks.select("id").distinct()).unionByName(side("vector", table(spark, sf, "chunk_vectors").select(F.col("chunk_id").alias("id")).distinct()))


@query(f"SELECT c.id, s.title, s.source_type, c.section_path FROM (SELECT id, any_value(source_id) AS source_id, arg_max(section_path, (indexed_at, section_path)) AS section_path FROM chunks GROUP BY 1) c JOIN {_LATEST} s ON c.source_id = s.source_id")
def index_metadata_update(spark: SparkSession, sf: str) -> DataFrame:
    """Entries take title and type from the catalogue; text, vector and section path stay."""
    entries = table(spark, sf, "chunks").groupBy("id").agg(F.any_value("source_id").alias("source_id"), F.max_by("section_path", F.struct("indexed_at", "section_path")).alias("section_path"))
    return entries.join(_latest(spark, sf).select("source_id", "title", "source_type"), "source_id").select("id", "title", "source_type", "section_path")


@query("SELECT 'text' AS idx, count(DISTINCT id) AS before, 0::BIGINT AS after FROM chunks UNION ALL SELECT 'vector', count(DISTINCT chunk_id), 0 FROM chunk_vectors")
def index_clear(spark: SparkSession, sf: str) -> DataFrame:
    """Both indexes emptied: what they held, and what a reader finds afterwards."""

    def cleared(name: str, df: DataFrame, key: str) -> DataFrame:
        after = df.filter(F.lit(False)).agg(F.count(F.lit(1)).alias("after"))
        return df.agg(F.count_distinct(key).alias("before")).crossJoin(F.broadcast(after)).select(F.lit(name).alias("idx"), "before", "after")

    return cleared("text", table(spark, sf, "chunks"), "id").unionByName(cleared("vector", table(spark, sf, "chunk_vectors"), "chunk_id"))


@query(
    f"""WITH k AS (SELECT doc_id, text FROM documents WHERE source NOT IN (SELECT min(source) FROM documents)), e AS (SELECT DISTINCT doc_id, unnest({sql_tokens('text')}) AS term FROM k) SELECT term, count(*) AS df FROM e GROUP BY 1"""
)
def bm25_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies after all documents of a source (the first by name) are deleted."""
    docs = table(spark, sf, "documents")
    first = docs.agg(F.min("source").alias("source"))  # one row
    kept = docs.filter(F.col("source").isNotNull()).join(F.broadcast(first), "source", "left_anti")
    return bm25.postings(kept, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(
    """WITH v AS (SELECT id, sha256(text)[1:16] AS h, indexed_at, row_number() OVER (PARTITION BY id ORDER BY indexed_at, sha256(text)) AS k FROM chunks WHERE text IS NOT NULL), c AS (SELECT id, h FROM v WHERE k = 1)
    SELECT v.id, v.h AS text_hash, bool_or(c.h IS NOT NULL AND v.k > 1) AS reused FROM v LEFT JOIN c ON v.id = c.id AND v.h = c.h GROUP BY 1, 2"""
)
def token_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Upserts against the cache of tokens: those whose text is as the first one was find their tokens there, by (id, hash of the text)."""
    v = table(spark, sf, "chunks").filter(F.col("text").isNotNull()).select("id", F.substring(F.sha2("text", 256), 1, 16).alias("h"), "indexed_at", F.sha2("text", 256).alias("full"))
    per = v.groupBy("id", "h").agg(F.min(F.struct("indexed_at", "full")).alias("first"), F.count(F.lit(1)).alias("n"))
    cached = F.col("first") == F.min("first").over(Window.partitionBy("id"))
    return per.select("id", F.col("h").alias("text_hash"), (cached & (F.col("n") > 1)).alias("reused"))


@query("SELECT DISTINCT chunk_id FROM chunk_vectors WHERE chunk_id NOT IN (SELECT id FROM chunks WHERE trim(coalesce(text, ''), ' \t\n\r') <> '')")
def vectors_without_text(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors whose chunk is gone or has no text."""
    held = table(spark, sf, "chunks").filter(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^[ \t\n\r]+|[ \t\n\r]+$", "")) > 0).select(F.col("id").alias("chunk_id"))
    return table(spark, sf, "chunk_vectors").select("chunk_id").distinct().join(held, "chunk_id", "left_anti")


@query("SELECT DISTINCT c.id, c.source_id FROM chunks c JOIN (SELECT source_id, max(total_chunks) AS total FROM chunks GROUP BY 1) t ON c.source_id = t.source_id WHERE total IS NOT NULL AND c.chunk_index >= total // 2")
def shrunk_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """What goes when every source is indexed anew with half its chunks: the entries from the new number on."""
    chunks = table(spark, sf, "chunks")
    total = chunks.groupBy("source_id").agg(F.max("total_chunks").alias("total")).filter(F.col("total").isNotNull())
    return chunks.join(total, "source_id").filter(F.col("chunk_index") >= F.floor(F.col("total") / 2)).select("id", "source_id").distinct()


# --- runs ---


@query(
    f"""WITH {_SNAPS}, md AS (SELECT CASE WHEN came IS NOT NULL THEN 'R' ELSE status END AS status, rk.path, gone AS old_path FROM rk LEFT JOIN pr ON rk.path = came AND status = 'A' WHERE NOT (status = 'D' AND rk.path IN (SELECT gone FROM pr)))
    SELECT path, CASE status WHEN 'A' THEN 'add' WHEN 'M' THEN 'update' WHEN 'D' THEN 'delete' ELSE 'move' END AS action, status <> 'D' AS convert, status IN ('M', 'D') AS drop_entries, old_path FROM md"""
)
def apply_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What an incremental run does with each changed path: whether it is converted, and whether entries are dropped first."""
    diff = changes.manifest_diff(*_versions(spark, sf))
    s = F.col("status")
    action = F.when(s == "A", "add").when(s == "M", "update").when(s == "D", "delete").otherwise("move")
    return diff.select("path", action.alias("action"), (s != "D").alias("convert"), s.isin("M", "D").alias("drop_entries"), "old_path")


@query(f"WITH {_SNAPS} SELECT split_part(path, '/', 1) AS scope, count(*) FILTER (status = 'A') AS added, count(*) FILTER (status = 'D') AS deleted, count(*) FILTER (status = 'M') AS modified FROM net GROUP BY 1")
def uncommitted_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What a rebuild of each scope would find not yet committed; a scope without a row is clean. Compared path by path, without renames."""
    o, n = (v.select("path", "hash") for v in _versions(spark, sf))
    both = o.select("path", F.col("hash").alias("was")).join(n.select("path", F.col("hash").alias("now")), "path", "full")
    added, gone = F.col("was").isNull(), F.col("now").isNull()
    changed = both.filter(added | gone | (F.col("was") != F.col("now")))
    return changed.groupBy(F.substring_index("path", "/", 1).alias("scope")).agg(F.count_if(added).alias("added"), F.count_if(~added & gone).alias("deleted"), F.count_if(~added & ~gone).alias("modified"))


@query("SELECT filepath, CASE WHEN trim(body, ' \t\n\r') = '' THEN 'skipped' ELSE 'ok' END AS status, strlen(body)::BIGINT AS bytes FROM page_files WHERE regexp_matches(filepath, '\\.(md|txt)$')")
def convert_only(spark: SparkSession, sf: str) -> DataFrame:
    """A run that converts one scope (text files) and indexes nothing: blank files are skipped."""
    own = table(spark, sf, "page_files").filter(F.col("filepath").rlike(r"\.(md|txt)$"))
    blank = F.length(F.regexp_replace("body", r"^[ \t\n\r]+|[ \t\n\r]+$", "")) == 0
    return own.select("filepath", F.when(blank, "skipped").otherwise("ok").alias("status"), F.octet_length("body").cast("bigint").alias("bytes"))


@query(
    """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE lower(source_type) = 'web' AND text <> '') SELECT doc_id, i AS chunk_index, substring(sha256(doc_id::VARCHAR), 1, 16) || '_' || i AS chunk_id, length(substring(text, (i * 170 + 1)::INT, 200)) AS n_chars
    FROM (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN n <= 200 THEN 0 ELSE ceil((n - 200) / 170.0)::INT END)) AS i FROM d)"""
)
def index_only(spark: SparkSession, sf: str) -> DataFrame:
    """A run that indexes one scope (type web) from what is converted already: chunks of 200 characters, 30 of them shared."""
    own = table(spark, sf, "documents").filter((F.lower("source_type") == "web") & (F.col("text") != ""))
    cut = own.select("doc_id", F.posexplode(T.slices(F.col("text"), 200, 170)).alias("i", "piece"))
    key = F.concat(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16), F.lit("_"), F.col("i"))
    return cut.select("doc_id", F.col("i").cast("bigint").alias("chunk_index"), key.alias("chunk_id"), F.char_length("piece").cast("bigint").alias("n_chars"))


@query(
    f"""WITH o AS (SELECT {_u('url', 2)} AS host, CASE WHEN status IS NULL OR status <> 200 THEN 'skipped' WHEN coalesce(filepath, '') = '' THEN 'error' ELSE 'placed' END AS outcome FROM crawl_log)
    SELECT host, count(*) FILTER (outcome = 'placed') AS placed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'error') >= 3 AS aborted, count(*) FILTER (outcome = 'placed') = 0 AND count(*) FILTER (outcome = 'error') = 0 AS is_empty FROM o GROUP BY 1"""
)
def ingest_results(spark: SparkSession, sf: str) -> DataFrame:
    """The results of all deliveries of a host, merged: counters add up, one abort aborts all."""
    outcome = F.when(F.coalesce(F.col("status") != 200, F.lit(True)), "skipped").when(F.coalesce("filepath", F.lit("")) == "", "error").otherwise("placed")
    rows = table(spark, sf, "crawl_log").select(P.url_part(F.col("url"), 2).alias("host"), outcome.alias("o"))
    n = lambda k: F.count_if(F.col("o") == k)
    return rows.groupBy("host").agg(n("placed").alias("placed"), n("skipped").alias("skipped"), n("error").alias("errors"), (n("error") >= 3).alias("aborted"), ((n("placed") == 0) & (n("error") == 0)).alias("is_empty"))


@query(
    "SELECT coalesce(source_type, '?') || ': ' || count(*) || ' files, ' || CASE WHEN sum(file_size) < 1024 THEN sum(file_size) || ' B' WHEN sum(file_size) < 1048576 THEN printf('%.1f KB', sum(file_size) / 1024.0) WHEN sum(file_size) < 1073741824 THEN printf('%.1f MB', sum(file_size) / 1048576.0) ELSE printf('%.1f GB', sum(file_size) / 1073741824.0) END || CASE WHEN count(*) FILTER (status = 'deleted') > 0 THEN ' (' || count(*) FILTER (status = 'deleted') || ' deleted)' ELSE '' END AS line FROM sources GROUP BY source_type"
)
def operation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One line of text for each type, as a report shows it."""
    s = _sources(spark, sf).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"), F.count_if(F.col("status") == "deleted").alias("gone"))
    tail = F.when(F.col("gone") > 0, F.concat(F.lit(" ("), F.col("gone"), F.lit(" deleted)"))).otherwise("")
    return s.select(F.concat(F.coalesce("source_type", F.lit("?")), F.lit(": "), F.col("n"), F.lit(" files, "), T.size_text(F.col("bytes")), tail).alias("line"))


# --- imports ---

_HREF = """unnest(regexp_extract_all(body, '<a\\s[^>]*href="(/[^"/][^"]*)"', 1))"""


@query(
    f"""WITH l AS (SELECT 'https://' || split_part(filepath, '/', 1) || regexp_replace({_HREF}, '[?#].*$', '') AS url FROM page_files) SELECT url, count(*) AS mentions FROM l WHERE url NOT IN (SELECT regexp_replace(url, '[?#].*$', '') FROM crawl_log) GROUP BY 1"""
)
def frontier_step(spark: SparkSession, sf: str) -> DataFrame:
    """One step of a crawl: the links of all fetched pages that lead to no page fetched before."""
    href = F.explode(F.regexp_extract_all("body", F.lit(r'<a\s[^>]*href="(/[^"/][^"]*)"'), F.lit(1)))
    links = table(spark, sf, "page_files").select(F.substring_index("filepath", "/", 1).alias("host"), href.alias("href"))
    url = F.concat(F.lit("https://"), F.col("host"), F.regexp_replace("href", "[?#].*$", ""))
    visited = table(spark, sf, "crawl_log").select(F.regexp_replace("url", "[?#].*$", "").alias("url")).distinct()
    return links.groupBy(url.alias("url")).agg(F.count(F.lit(1)).alias("mentions")).join(visited, "url", "left_anti")


@query(f"SELECT log_id, CASE WHEN regexp_matches(p, '\\.[A-Za-z0-9]+$') THEN regexp_replace(p, '[^/]*$', '') ELSE rtrim(p, '/') || '/' END AS scope FROM (SELECT log_id, {_u('url', 3)} AS p FROM crawl_log)")
def crawl_scope(spark: SparkSession, sf: str) -> DataFrame:
    """The path prefix within which a crawl from a URL stays: its directory, or itself where its last segment is no file."""
    p = P.url_part(F.col("url"), 3)
    scope = F.when(p.rlike(r"\.[A-Za-z0-9]+$"), F.regexp_replace(p, "[^/]*$", "")).otherwise(F.concat(F.regexp_replace(p, "/+$", ""), F.lit("/")))
    return table(spark, sf, "crawl_log").select("log_id", scope.alias("scope"))


@query(
    f"""WITH a AS (SELECT url, min(log_id) AS first_log, bool_and(status <> 200) AS suppressed FROM crawl_log WHERE status IS NOT NULL GROUP BY 1), done AS (SELECT DISTINCT url FROM crawl_log WHERE collected_at < '2024-06') SELECT CASE WHEN suppressed THEN 'suppressed' WHEN url IN (SELECT url FROM done) THEN 'known' ELSE 'delegated' END AS kind, count(*) AS n, min(first_log) AS first_log FROM a GROUP BY 1"""
)
def delegations(spark: SparkSession, sf: str) -> DataFrame:
    """URLs handed on once each: not those that every mention suppresses, and not those that were handed on before."""
    log = table(spark, sf, "crawl_log")
    done = log.filter(F.col("collected_at") < "2024-06").select("url").distinct().withColumn("known", F.lit(True))
    one = log.filter(F.col("status").isNotNull()).groupBy("url").agg(F.min("log_id").alias("first_log"), F.bool_and(F.col("status") != 200).alias("suppressed")).join(done, "url", "left")
    kind = F.when(F.col("suppressed"), "suppressed").when(F.col("known"), "known").otherwise("delegated")
    return one.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("first_log").alias("first_log"))


@query("SELECT record_id, json_array_length(payload, '$.feed')::BIGINT AS items, payload->>'$.cursor' AS cursor, payload->>'$.cursor' IS NULL OR json_array_length(payload, '$.feed') = 0 AS last_page FROM (SELECT record_id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM feed_records) WHERE json_type(payload, '$.feed') = 'ARRAY'")
def feed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of feeds: how many posts each holds, the cursor of the next one, and whether paging ends here."""
    v = F.try_parse_json("payload")
    feed = F.try_variant_get(v, "$.feed", "array<variant>")
    rows = table(spark, sf, "feed_records").select("record_id", F.size(feed).cast("bigint").alias("items"), F.try_variant_get(v, "$.cursor", "string").alias("cursor"), feed.isNotNull().alias("listed"))
    return rows.filter("listed").select("record_id", "items", "cursor", (F.col("cursor").isNull() | (F.col("items") == 0)).alias("last_page"))


@query(
    f"""WITH d AS (SELECT source_id, regexp_extract(source_id, '[^/]+$') AS name, min(collected_at) AS first FROM sources WHERE source_type = 'local' GROUP BY 1, 2)
    SELECT source_id, CASE WHEN regexp_matches(first, '^[0-9]{{4}}-[0-9]{{2}}') THEN 'local/' || substring(first, 1, 4) || '/' || substring(first, 6, 2) || '/' || name ELSE 'local/unknown/' || name END AS target, row_number() OVER (ORDER BY source_id) AS position FROM d WHERE NOT contains(source_id, '..') QUALIFY position <= 100"""
)
def local_import(spark: SparkSession, sf: str) -> DataFrame:
    """An import of local files: in order of their paths, at most a hundred a call, paths that climb up refused, targets by year and month."""
    rows = _sources(spark, sf).filter((F.col("source_type") == "local") & ~F.col("source_id").contains("..")).groupBy("source_id").agg(F.min("collected_at").alias("first")).orderBy("source_id").limit(100)
    name = F.regexp_extract("source_id", "[^/]+$", 0)
    dated = F.concat(F.lit("local/"), F.substring("first", 1, 4), F.lit("/"), F.substring("first", 6, 2), F.lit("/"), name)
    target = F.when(F.col("first").rlike(r"^\d{4}-\d{2}"), dated).otherwise(F.concat(F.lit("local/unknown/"), name))
    return rows.select("source_id", target.alias("target"), F.row_number().over(Window.orderBy("source_id")).cast("bigint").alias("position"))


@query(
    """WITH u AS (SELECT log_id, CASE log_id % 3 WHEN 0 THEN to_base64(encode(url)) WHEN 1 THEN '*' || url ELSE '' END AS raw, replace(filepath, '/', '\\') AS path, url FROM crawl_log WHERE filepath IS NOT NULL)
    SELECT log_id, CASE WHEN raw = '' THEN 'empty' WHEN starts_with(raw, '*') THEN 'not base64' END AS problem, CASE WHEN raw <> '' AND NOT starts_with(raw, '*') THEN strlen(url) END AS bytes, trim(regexp_extract(replace(path, '\\', '/'), '[^/]*$')) AS name FROM u"""
)
def upload_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads in base64 with the paths of another system: strict decoding, and the last segment as the name."""
    k = F.col("log_id") % 3
    raw = F.when(k == 0, F.base64(F.encode("url", "UTF-8"))).when(k == 1, F.concat(F.lit("*"), "url")).otherwise("")
    rows = table(spark, sf, "crawl_log").filter(F.col("filepath").isNotNull()).select("log_id", raw.alias("raw"), F.translate("filepath", "/", "\\").alias("path"))
    good = F.col("raw").rlike(r"^(?:[A-Za-z0-9+/]{4}|\s)*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\s*$") & (F.col("raw") != "")
    decoded = F.try_to_binary(F.when(good, F.regexp_replace("raw", r"\s", "")), F.lit("base64"))
    problem = F.when(F.col("raw") == "", "empty").when(decoded.isNull(), "not base64")
    return rows.select("log_id", problem.alias("problem"), F.octet_length(decoded).cast("bigint").alias("bytes"), F.trim(F.regexp_extract(F.translate("path", "\\", "/"), "[^/]*$", 0)).alias("name"))


@query("SELECT doc_id, length(t)::BIGINT AS n_chars, t AS text FROM (SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text WHEN regexp_matches(substring(text, 1, 2000), '(?s)[。.]') THEN regexp_extract(substring(text, 1, 2000), '(?s)^.*[。.]') ELSE substring(text, 1, 2000) END AS t FROM documents WHERE text IS NOT NULL)")
def truncated_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Contents for an evaluation set: at most 2 000 characters, up to the last end of a sentence among them (a limit that is the feature)."""
    text, head = F.col("text"), F.substring("text", 1, 2000)
    cut = F.when(F.char_length(text) <= 2000, text).when(head.rlike("[。.]"), F.regexp_extract(head, "(?s)^.*[。.]", 0)).otherwise(head)
    return table(spark, sf, "documents").filter(text.isNotNull()).select("doc_id", F.char_length(cut).cast("bigint").alias("n_chars"), cut.alias("text"))


_RUN = "[ぁ-ゖァ-ヺー一-鿿々]+"


@query(
    f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_RUN}|[a-z0-9]+')) AS run FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(CASE WHEN regexp_matches(run, '^{_RUN}$') THEN list_transform(generate_series(1, greatest(length(run) - 1, 1)), lambda i: substring(run, i, 2)) ELSE [run] END) AS term FROM r)
    SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY 1"""
)
def ngram_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the tokenizer for languages without spaces, where no analyser is installed: pairs of characters, and whole words of others."""
    terms = table(spark, sf, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.explode(ngram_tokens(F.col("text"))).alias("term"))
    per = terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df"))
