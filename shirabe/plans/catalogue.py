"""The catalogue of sources: listing, filters, upserts, statistics, and its scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shirabe.functions import paths as P
from shirabe.functions import text as T
from shirabe.functions import times as D
from shirabe.plans.registry import Registry
from shirabe.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources")


_ISO = r"'^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)(Z|[+-]\d{2}:\d{2})?$'"


def sql_instant(c: str) -> str:
    z = f"regexp_extract({c}, {_ISO}, 3)"
    return (
        f"(try_cast(nullif(regexp_extract({c}, {_ISO}, 1), '') || ' ' || regexp_extract({c}, {_ISO}, 2) AS TIMESTAMP) - to_minutes(CASE WHEN {z} = '' THEN 540 WHEN {z} = 'Z' THEN 0 ELSE"
        f" (CASE WHEN {z}[1] = '-' THEN -1 ELSE 1 END) * (try_cast(substring({z}, 2, 2) AS INT) * 60 + try_cast(substring({z}, 5, 2) AS INT)) END))"
    )


def sql_iso(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%dT%H:%M:%S.%f+00:00')"


@query("SELECT source_id, source_type, updated_at FROM sources WHERE source_type = 'web' AND status = 'active' ORDER BY updated_at DESC, source_id, row_id LIMIT 20")
def list_recent(spark: SparkSession, sf: str) -> DataFrame:
    own = _sources(spark, sf).filter((F.col("source_type") == "web") & (F.col("status") == "active"))
    return own.orderBy(F.col("updated_at").desc(), "source_id", "row_id").limit(20).select("source_id", "source_type", "updated_at")


@query("SELECT row_id, source_id, updated_at FROM sources WHERE status = 'active' AND updated_at BETWEEN '2025-01-31T15:00:00.000000+00:00' AND '2025-06-30T14:59:59.999999+00:00'")
def list_date_range(spark: SparkSession, sf: str) -> DataFrame:
    low, high = D.japanese_day(F.lit("2025-02-01")), D.japanese_day(F.lit("2025-06-30"), end=True)
    return _sources(spark, sf).filter((F.col("status") == "active") & F.col("updated_at").between(low, high)).select("row_id", "source_id", "updated_at")


@query("SELECT source_type, count(*) AS n FROM sources WHERE status = 'active' GROUP BY 1")
def count_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return _sources(spark, sf).filter(F.col("status") == "active").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, source_id, collected_at FROM sources WHERE source_type = 'local' AND starts_with(source_id, 'local/2024/')")
def search_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The type follows from the prefix, so that a table partitioned by type is read in part."""
    return _sources(spark, sf).filter((F.col("source_type") == "local") & F.col("source_id").startswith("local/2024/")).select("row_id", "source_id", "collected_at")


@query("SELECT row_id FROM sources WHERE json_type(meta, '$.depth') = 'VARCHAR' AND json_extract_string(meta, '$.depth') = '3'")
def json_filter_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Typed equality: a number never equals a text."""
    v = F.try_parse_json("meta")
    return _sources(spark, sf).filter((F.schema_of_variant(F.try_variant_get(v, "$.depth", "variant")) == "STRING") & (F.try_variant_get(v, "$.depth", "string") == "3")).select("row_id")


@query("SELECT row_id, meta->>'$.lang' AS lang FROM sources WHERE json_type(meta, '$.lang') = 'VARCHAR' AND meta->>'$.lang' = 'ja'")
def json_filter_typed_text(spark: SparkSession, sf: str) -> DataFrame:
    v = F.try_parse_json("meta")
    got = F.try_variant_get(v, "$.lang", "string")
    return _sources(spark, sf).filter((F.schema_of_variant(F.try_variant_get(v, "$.lang", "variant")) == "STRING") & (got == "ja")).select("row_id", got.alias("lang"))


@query("SELECT row_id FROM sources WHERE upper(json_extract_string(meta, '$.depth')) = '3' AND upper(json_extract_string(meta, '$.lang')) = upper('Ja')")
def json_filter_loose(spark: SparkSession, sf: str) -> DataFrame:
    """Loose equality of text forms without case; all keys must be there."""
    wanted = {"depth": "3", "lang": "Ja"}
    df = _sources(spark, sf)
    for k, v in wanted.items():
        df = df.filter(F.upper(F.get_json_object("meta", f"$.{k}")) == v.upper())
    return df.select("row_id")


@query(
    """SELECT source_id, arg_max(source_type, row_id) AS source_type, arg_max(title, row_id) AS title, 'active' AS status, arg_max(content_hash, row_id) AS content_hash, arg_max(file_size, row_id) AS file_size,
    arg_min(collected_at, row_id) AS collected_at, max(row_id) AS last_row FROM sources GROUP BY source_id"""
)
def register_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries in order: each overwrites what it describes and revives the source, but the first time of collection stays."""
    last = lambda c: F.max_by(c, "row_id").alias(c)
    return (
        _sources(spark, sf)
        .groupBy("source_id")
        .agg(last("source_type"), last("title"), last("content_hash"), last("file_size"), F.min_by("collected_at", "row_id").alias("collected_at"), F.max("row_id").alias("last_row"))
        .select("source_id", "source_type", "title", F.lit("active").alias("status"), "content_hash", "file_size", "collected_at", "last_row")
    )


@query("WITH e AS (SELECT DISTINCT source_id FROM chunks WHERE total_chunks IS NULL) SELECT row_id, s.source_id, CASE WHEN e.source_id IS NOT NULL THEN 'deleted' ELSE status END AS status FROM sources s LEFT JOIN e ON s.source_id = e.source_id")
def soft_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that still grow are marked as deleted; all others keep their status."""
    gone = table(spark, sf, "chunks").filter(F.col("total_chunks").isNull()).select("source_id").distinct().withColumn("gone", F.lit(True))
    return _sources(spark, sf).join(gone, "source_id", "left").select("row_id", "source_id", F.when(F.col("gone"), "deleted").otherwise(F.col("status")).alias("status"))


@query("SELECT row_id, source_id FROM sources WHERE NOT starts_with(source_id, 'local/2024/')")
def bulk_delete(spark: SparkSession, sf: str) -> DataFrame:
    """What remains after a prefix is deleted; the closing slash keeps siblings of longer names."""
    return _sources(spark, sf).filter(~F.col("source_id").startswith("local/2024/")).select("row_id", "source_id")


_HISTORY = "h AS (SELECT event_id AS id, event_type AS mode, value > 50 AS filtered FROM events)"


@query(f"WITH {_HISTORY}, a AS (SELECT max(id) FILTER (mode IN ('purchase', 'click') AND NOT filtered) AS anchor, max(id) AS newest FROM h) SELECT anchor, newest, coalesce(newest > anchor, true) AS rebuild FROM a")
def needs_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """A rebuild is due where a run follows the last unfiltered one; filtered runs count as newer but never as the anchor."""
    h = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("mode"), (F.col("value") > 50).alias("filtered"))
    a = h.agg(F.max(F.when(F.col("mode").isin("purchase", "click") & ~F.col("filtered"), F.col("id"))).alias("anchor"), F.max("id").alias("newest"))
    return a.select("anchor", "newest", F.coalesce(F.col("newest") > F.col("anchor"), F.lit(True)).alias("rebuild"))


@query("SELECT event_type AS mode, max(event_id) AS last_id, arg_max(value, event_id) AS last_value, count(*) AS runs FROM events GROUP BY 1")
def history_last(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("mode")).agg(F.max("event_id").alias("last_id"), F.max_by("value", "event_id").alias("last_value"), F.count(F.lit(1)).alias("runs"))


@query("SELECT coalesce(source_type, 'all') AS source_type, count(*) AS files, sum(file_size)::BIGINT AS bytes, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'deleted') AS deleted FROM sources GROUP BY ROLLUP (sources.source_type)")
def stats_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = _sources(spark, sf).rollup("source_type").agg(
        F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "deleted").alias("deleted")
    )
    return out.withColumn("source_type", F.coalesce("source_type", F.lit("all")))


@query(f"SELECT row_id, coalesce({sql_iso(sql_instant('published_at'))}, published_at) AS published_at FROM sources")
def normalise_published(spark: SparkSession, sf: str) -> DataFrame:
    return _sources(spark, sf).select("row_id", D.normalised(F.col("published_at")).alias("published_at"))


@query(
    f"WITH d AS (SELECT row_id, substring(updated_at, 1, 10) AS day FROM sources) SELECT row_id, {sql_iso('try_cast(day AS TIMESTAMP) - INTERVAL 9 HOUR')} AS low, {sql_iso('try_cast(day AS TIMESTAMP) + INTERVAL 15 HOUR - INTERVAL 1 MICROSECOND')} AS high FROM d"
)
def japanese_days(spark: SparkSession, sf: str) -> DataFrame:
    day = F.substring("updated_at", 1, 10)
    return _sources(spark, sf).select("row_id", D.japanese_day(day).alias("low"), D.japanese_day(day, end=True).alias("high"))


@query(
    """WITH r AS (SELECT *, CASE source_type WHEN 'bluesky' THEN meta->>'$.created_at' WHEN 'zenn' THEN meta->>'$.published_at' WHEN 'youtube' THEN meta->>'$.upload_date' END AS raw FROM sources)
    SELECT row_id, CASE WHEN source_type = 'youtube' AND regexp_matches(raw, '^[0-9]{8}$') THEN substring(raw, 1, 4) || '-' || substring(raw, 5, 2) || '-' || substring(raw, 7, 2) || 'T00:00:00+00:00' ELSE coalesce(nullif(raw, ''), collected_at) END AS published FROM r"""
)
def resolve_published(spark: SparkSession, sf: str) -> DataFrame:
    return _sources(spark, sf).select("row_id", D.published(F.col("source_type"), F.col("meta"), F.col("collected_at")).alias("published"))


@query("SELECT row_id, coalesce(meta->>'$.title', regexp_extract(regexp_extract(source_id, '[^/]+$'), '^(.+?)(\\.[^.]*)?$', 1)) AS title FROM sources")
def resolve_title(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.regexp_extract(F.regexp_extract("source_id", "[^/]+$", 0), r"^(.+?)(\.[^.]*)?$", 1)
    return _sources(spark, sf).select("row_id", F.coalesce(F.get_json_object("meta", "$.title"), stem).alias("title"))


@query(
    """SELECT row_id, CASE WHEN file_size < 1024 THEN file_size || ' B' WHEN file_size < 1048576 THEN printf('%.1f KB', file_size / 1024.0) WHEN file_size < 1073741824 THEN printf('%.1f MB', file_size / 1048576.0)
    ELSE printf('%.1f GB', file_size / 1073741824.0) END AS size_text FROM sources"""
)
def size_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _sources(spark, sf).select("row_id", T.size_text(F.col("file_size")).alias("size_text"))


@query("SELECT row_id, CASE WHEN duration < 60 THEN printf('%.1f 秒', duration::DOUBLE) WHEN duration < 3600 THEN printf('%d 分 %.1f 秒', duration // 60, (duration % 60)::DOUBLE) ELSE printf('%d 時間 %d 分 %.1f 秒', duration // 3600, duration % 3600 // 60, (duration % 60)::DOUBLE) END AS elapsed FROM videos WHERE duration >= 0")
def elapsed_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "videos").filter(F.col("duration") >= 0).select("row_id", T.elapsed_text(F.col("duration")).alias("elapsed"))


@query("SELECT filepath, sha256(body) AS content_hash, strlen(body)::BIGINT AS file_size FROM page_files")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "page_files").select("filepath", F.sha2("body", 256).alias("content_hash"), F.octet_length("body").cast("bigint").alias("file_size"))


@query(
    f"""WITH j AS (SELECT row_id, source_id, updated_at, regexp_extract(source_id, '^journal/([0-9]{{8}}-[0-9]{{6}})', 1) AS stamp FROM sources WHERE source_type = 'journal')
    SELECT row_id, {sql_iso("strptime(stamp, '%Y%m%d-%H%M%S') - INTERVAL 9 HOUR")} AS written FROM j WHERE stamp <> ''"""
)
def journal_times(spark: SparkSession, sf: str) -> DataFrame:
    """The time in a journal file's name is Japanese time."""
    stamp = F.regexp_extract("source_id", r"^journal/(\d{8}-\d{6})", 1)
    own = _sources(spark, sf).filter((F.col("source_type") == "journal") & (stamp != ""))
    return own.select("row_id", D.iso_text(F.to_utc_timestamp(F.to_timestamp(stamp, "yyyyMMdd-HHmmss"), "Asia/Tokyo")).alias("written"))


@query(
    """SELECT row_id, regexp_matches(split_part(source_id, '/', 1), '^(web|local|journal|zenn|bluesky|youtube|aozora)$') AS known, split_part(source_id, '/', 1) AS source_type,
    NOT (ends_with(source_id, '.meta') OR regexp_matches(source_id, '(^|/)(docdata/|\\.git/)')) AS is_source FROM sources"""
)
def source_types(spark: SparkSession, sf: str) -> DataFrame:
    kind = P.source_type(F.col("source_id"))
    return _sources(spark, sf).select("row_id", kind.isNotNull().alias("known"), kind.alias("source_type"), P.is_source_file(F.col("source_id")).alias("is_source"))


@query("SELECT row_id, CASE WHEN regexp_matches(p, '^bluesky/.*media/') THEN regexp_replace(p, '/media/([^/]+)/.*$', '/\\1.json') END AS parent FROM (SELECT row_id, regexp_replace(source_id, '/([^/]+)\\.json$', '/media/\\1/0.jpg') AS p FROM sources)")
def attachment_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Media paths made of the records' own paths resolve to the records again."""
    media = F.regexp_replace("source_id", r"/([^/]+)\.json$", "/media/$1/0.jpg")
    return _sources(spark, sf).select("row_id", P.attachment_parent(media).alias("parent"))


@query(r"SELECT row_id, regexp_replace(title, '([\\%_])', '\\\1', 'g') AS escaped FROM sources")
def like_escaped(spark: SparkSession, sf: str) -> DataFrame:
    return _sources(spark, sf).select("row_id", P.like_escaped(F.col("title")).alias("escaped"))


@query("SELECT row_id, CASE WHEN trim(p) = '' THEN 'empty' WHEN starts_with(p, '/') THEN 'absolute' WHEN contains(p, '//') THEN 'double' WHEN NOT regexp_matches(split_part(p, '/', 1), '^(web|local|journal|zenn|bluesky|youtube|aozora)$') THEN 'root' END AS problem FROM (SELECT row_id, CASE row_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/' || source_id WHEN 2 THEN replace(source_id, '/', '//') WHEN 3 THEN 'x' || source_id ELSE source_id END AS p FROM sources)")
def prefix_problems(spark: SparkSession, sf: str) -> DataFrame:
    s, k = F.col("source_id"), F.col("row_id") % 5
    p = F.when(k == 0, "").when(k == 1, F.concat(F.lit("/"), s)).when(k == 2, F.replace(s, F.lit("/"), F.lit("//"))).when(k == 3, F.concat(F.lit("x"), s)).otherwise(s)
    return _sources(spark, sf).select("row_id", P.prefix_problem(p).alias("problem"))


@query("SELECT row_id, source_id, count(*) OVER (PARTITION BY source_id) AS deliveries, row_number() OVER (PARTITION BY source_id ORDER BY updated_at, row_id) AS version FROM sources")
def delivery_versions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("source_id")
    return _sources(spark, sf).select(
        "row_id", "source_id", F.count(F.lit(1)).over(w).alias("deliveries"), F.row_number().over(w.orderBy("updated_at", "row_id")).cast("bigint").alias("version")
    )
