"""Crawled pages, URLs, feeds and videos: extraction, routing, placement and conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shirabe.functions import paths as P
from shirabe.functions import text as T
from shirabe.operators.flatten_records import feed_posts, feed_rows
from shirabe.operators.html_markdown import html_to_markdown
from shirabe.plans.chunking import sql_strip
from shirabe.plans.registry import Registry
from shirabe.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "crawl_log")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "page_files")


_U = r"'^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"


def _u(c: str, n: int) -> str:
    return f"regexp_extract({c}, {_U}, {n})"


def _wide(c: str) -> str:
    return f"""translate({c}, ':?*<>|"', '：？＊＜＞｜＂')"""


_PATH = f"""CASE WHEN lower({_u("url", 1)}) IN ('http', 'https') THEN 'web/' || lower({_u("url", 1)}) || '/' || {_wide(_u("url", 2))} || '/' || {_wide(f"coalesce(nullif(trim({_u('url', 3)}, '/'), ''), 'index')")} ||
    CASE WHEN {_u("url", 4)} = '' THEN '' ELSE '？' || {_wide(_u("url", 4))} END END"""


@query(f"SELECT log_id, {_PATH} AS path FROM crawl_log")
def url_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).select("log_id", P.url_to_path(F.col("url")).alias("path"))


@query(f"SELECT log_id, lower({_u('url', 1)}) || '://' || {_u('url', 2)} || '/' || coalesce(nullif(trim({_u('url', 3)}, '/'), ''), 'index') || CASE WHEN {_u('url', 4)} = '' THEN '' ELSE '?' || {_u('url', 4)} END AS url FROM crawl_log")
def path_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Paths made of URLs give the URLs back, without fragment and outer slashes; an empty path is ``index``."""
    return _log(spark, sf).select("log_id", P.path_to_url(P.url_to_path(F.col("url"))).alias("url"))


@query(f"SELECT log_id, CASE WHEN p = '' THEN 'index.html' WHEN regexp_matches(p, '(?i)\\.(html|htm|xhtml|shtml|php|asp|aspx|jsp)$') THEN p ELSE p || '.html' END AS file FROM (SELECT log_id, trim({_u('url', 3)}, '/') AS p FROM crawl_log)")
def url_files(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).select("log_id", P.url_to_filename(F.col("url")).alias("file"))


@query(
    """SELECT log_id, CASE WHEN status IS NULL OR status <> 200 THEN 'skipped' WHEN coalesce(l.filepath, '') = '' OR p.filepath IS NULL THEN 'error' WHEN row_number() OVER (PARTITION BY l.filepath, status = 200 ORDER BY log_id) > 1 THEN 'overwritten' ELSE 'placed' END AS outcome
    FROM crawl_log l LEFT JOIN (SELECT DISTINCT filepath FROM page_files) p ON l.filepath = p.filepath"""
)
def crawl_placement(spark: SparkSession, sf: str) -> DataFrame:
    have = _pages(spark, sf).select("filepath").distinct().withColumn("have", F.lit(True))
    log = _log(spark, sf).join(have, "filepath", "left")
    nth = F.row_number().over(Window.partitionBy("filepath", F.col("status") == 200).orderBy("log_id"))
    outcome = F.when(F.coalesce(F.col("status") != 200, F.lit(True)), "skipped").when(F.col("have").isNull() | (F.coalesce("filepath", F.lit("")) == ""), "error").when(nth > 1, "overwritten").otherwise("placed")
    return log.select("log_id", outcome.alias("outcome"))


@query(
    """SELECT count(*) FILTER (k = 'line' AND url IS NOT NULL AND collected_at IS NOT NULL) AS good, count(*) FILTER (k = 'cut' OR k = 'line' AND (url IS NULL OR collected_at IS NULL)) AS bad, count(*) FILTER (k = 'blank') AS blank,
    sum(CASE WHEN k = 'line' THEN coalesce(depth, 0) END)::BIGINT AS depth, count(*) FILTER (k = 'line' AND coalesce(status, 200) = 200) AS fine FROM (SELECT *, CASE WHEN log_id % 7 = 0 THEN 'blank' WHEN log_id % 11 = 0 THEN 'cut' ELSE 'line' END AS k FROM crawl_log)"""
)
def crawl_records(spark: SparkSession, sf: str) -> DataFrame:
    """The log as JSON lines, some blank and some cut off, read again with its schema: blank lines are passed over, broken ones counted."""
    line = F.to_json(F.struct("url", "title", "status", "depth", "collected_at", "filepath"))
    raw = F.when(F.col("log_id") % 7 == 0, "  ").when(F.col("log_id") % 11 == 0, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line)
    rec = F.from_json("value", "url string, title string, status bigint, depth bigint, collected_at string, filepath string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    lines = _log(spark, sf).select(raw.alias("value"))
    rows = lines.select((F.trim("value") == "").alias("blank"), rec.alias("r")).select("blank", "r.*")
    whole = ~F.col("blank") & F.col("_bad").isNull()
    good = whole & F.col("url").isNotNull() & F.col("collected_at").isNotNull()
    return rows.agg(
        F.count_if(good).alias("good"), F.count_if(~F.col("blank") & ~good).alias("bad"), F.count_if("blank").alias("blank"),
        F.sum(F.when(whole, F.coalesce("depth", F.lit(0)))).alias("depth"), F.count_if(whole & (F.coalesce("status", F.lit(200)) == 200)).alias("fine"),
    )


_TITLE = "regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1)"


@query(f"SELECT filepath, {sql_strip(_TITLE)} AS title FROM page_files")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("filepath", T.strip(F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


@query("""SELECT filepath, unnest(regexp_extract_all(body, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM page_files""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("filepath", F.explode(F.regexp_extract_all("body", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


@query(
    """WITH l AS (SELECT split_part(filepath, '/', 1) AS host, unnest(regexp_extract_all(body, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM page_files)
    SELECT 'https://' || host || regexp_replace(href, '[?#].*$', '') AS url, count(*) AS n FROM l WHERE starts_with(href, '/') AND NOT starts_with(href, '//') GROUP BY 1"""
)
def canonical_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of a page's own host as absolute URLs without query and fragment, and how often each occurs."""
    links = page_links(spark, sf).filter(F.col("href").startswith("/") & ~F.col("href").startswith("//"))
    url = F.concat(F.lit("https://"), F.substring_index("filepath", "/", 1), F.regexp_replace("href", "[?#].*$", ""))
    return links.groupBy(url.alias("url")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_u('url', 2)} AS host, min(log_id) AS first_log, count(*) AS n FROM crawl_log GROUP BY 1")
def crawl_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct hosts with the place of their first mention, which orders them."""
    return _log(spark, sf).groupBy(P.url_part(F.col("url"), 2).alias("host")).agg(F.min("log_id").alias("first_log"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_u('url', 2)} AS host, substring(sha256(string_agg(DISTINCT url, chr(10) ORDER BY url)), 1, 16) AS crawl_key FROM crawl_log GROUP BY 1")
def crawl_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A key for each host's set of URLs, whatever their order."""
    urls = F.array_join(F.array_sort(F.collect_set("url")), "\n")
    return _log(spark, sf).groupBy(P.url_part(F.col("url"), 2).alias("host")).agg(F.substring(F.sha2(urls, 256), 1, 16).alias("crawl_key"))


@query("SELECT regexp_replace(url, '[?#].*$', '') AS url, min(log_id) AS first_log, bool_and(status = 200) AS all_fine FROM crawl_log GROUP BY 1")
def url_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).groupBy(F.regexp_replace("url", "[?#].*$", "").alias("url")).agg(F.min("log_id").alias("first_log"), F.bool_and(F.col("status") == 200).alias("all_fine"))


_VIDEO_URL = "CASE row_id % 4 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || id WHEN 1 THEN 'https://youtu.be/' || id || '?t=3' WHEN 2 THEN 'https://www.youtube.com/channel/' || coalesce(channel_id, 'x') ELSE 'https://bsky.app/profile/' || id END"


@query(f"SELECT row_id, CASE row_id % 4 WHEN 2 THEN 'invalid_youtube' WHEN 3 THEN 'skip' ELSE CASE WHEN regexp_matches(id, '^[A-Za-z0-9_-]{{11}}$') THEN 'youtube' ELSE 'invalid_youtube' END END AS kind FROM (SELECT row_id, id, {_VIDEO_URL} AS url FROM videos)")
def url_routes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "videos").select("row_id", P.route(F.expr(_VIDEO_URL)).alias("kind"))


@query("SELECT row_id, CASE row_id % 4 WHEN 0 THEN 'scheme' WHEN 1 THEN 'private' WHEN 2 THEN 'host' END AS problem FROM videos")
def url_problems(spark: SparkSession, sf: str) -> DataFrame:
    url = F.expr("CASE row_id % 4 WHEN 0 THEN 'ftp://a.example/' || id WHEN 1 THEN 'http://192.168.1.' || row_id % 200 || ':80/' || id WHEN 2 THEN 'https:///' || id ELSE 'https://a.example/' || id END")
    return table(spark, sf, "videos").select("row_id", P.url_problem(url).alias("problem"))


@query("SELECT row_id, CASE WHEN channel_id IS NULL THEN 'error' WHEN coalesce(duration, 0) <= 0 THEN 'unknown_duration' WHEN duration > 7200 THEN 'too_long' ELSE 'admitted' END AS outcome FROM videos")
def video_admission(spark: SparkSession, sf: str) -> DataFrame:
    d = F.coalesce("duration", F.lit(0))
    outcome = F.when(F.col("channel_id").isNull(), "error").when(d <= 0, "unknown_duration").when(d > 7200, "too_long").otherwise("admitted")
    return table(spark, sf, "videos").select("row_id", outcome.alias("outcome"))


@query("SELECT log_id, trim(regexp_extract(regexp_replace(filepath, '\\\\', '/', 'g'), '[^/]*$')) AS name FROM crawl_log")
def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    """The last segment of an uploaded file's path."""
    return _log(spark, sf).select("log_id", F.trim(F.regexp_extract(F.translate("filepath", "\\", "/"), "[^/]*$", 0)).alias("name"))


@query("SELECT row_id, rtrim(substring(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s-]', ' ', 'g'), '[\\s-]+', '-', 'g'), '-'), 1, 50), '-') AS topic FROM sources WHERE title IS NOT NULL")
def journal_topics(spark: SparkSession, sf: str) -> DataFrame:
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^a-z0-9\s-]", " "), r"[\s-]+", "-")
    topic = F.regexp_replace(F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, 50), "-+$", "")
    return table(spark, sf, "sources").filter(F.col("title").isNotNull()).select("row_id", topic.alias("topic"))


@query()
def pages_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Every page file as text: HTML as Markdown, other files as they are; blank ones are skipped."""
    pages = _pages(spark, sf)
    html = F.coalesce(F.col("body").contains("<html"), F.lit(False))
    blank = T.strip(F.coalesce("body", F.lit(""))) == ""
    others = pages.filter(~html).select("filepath", F.when(blank, "skipped").otherwise("ok").alias("status"), F.when(blank, "").otherwise(F.col("body")).alias("text"))
    return html_to_markdown(pages.filter(html), "filepath", "body").unionByName(others)


@query()
def feed_links(spark: SparkSession, sf: str) -> DataFrame:
    """The http(s) URLs of each post in order: facet links, then external embeds, then those beside quotes; each once."""
    rows = feed_rows(table(spark, sf, "feed_records")).filter(F.col("depth") == 0)
    tail, kind = F.col("tail"), F.element_at("cells", F.lit("$type"))
    order = F.when(tail.rlike(r"^record\.facets\[\]\.features\[\]$") & kind.endswith("#link"), 0).when(tail == "record.embed.external", 1).when(tail == "record.embed.media.external", 2)
    urls = rows.select("record_id", "item_pos", order.alias("o"), "ords", F.element_at("cells", F.lit("uri")).alias("url")).filter(F.col("o").isNotNull() & F.col("url").rlike("^https?://"))
    first = Window.partitionBy("record_id", "item_pos", "url").orderBy("o", "ords")
    place = Window.partitionBy("record_id", "item_pos").orderBy("o", "ords")
    once = urls.repartition("record_id").withColumn("n", F.row_number().over(first)).filter(F.col("n") == 1)
    return once.select("record_id", "item_pos", F.row_number().over(place).alias("position"), "url", P.route(F.col("url")).alias("kind"))


@query()
def feed_placement(spark: SparkSession, sf: str) -> DataFrame:
    """Where each post is kept, its title, and whether it was reposted; the first of equal paths stays."""
    posts = feed_posts(table(spark, sf, "feed_records")).filter((F.col("depth") == 0) & F.col("uri").isNotNull())
    did, key = F.regexp_extract("uri", "^at://([^/]+)/", 1), F.regexp_extract("uri", "([^/]+)$", 1)
    dated = F.col("created_at").rlike(r"^\d{4}-\d{2}")
    path = F.concat(F.lit("bluesky/"), F.translate(did, ":", "："), F.lit("/"), F.when(dated, F.concat(F.substring("created_at", 1, 4), F.lit("/"), F.substring("created_at", 6, 2))).otherwise(F.lit("unknown/00")), F.lit("/"), key, F.lit(".json"))
    title = F.when(F.char_length("text") > 50, F.concat(F.substring("text", 1, 50), F.lit("..."))).otherwise(F.col("text"))
    first = F.min_by(F.struct(title.alias("title"), F.col("reposted_by").isNotNull().alias("is_repost")), F.struct("record_id", "item_pos"))
    return posts.groupBy(path.alias("path")).agg(first.alias("p")).select("path", "p.title", "p.is_repost")


@query()
def feed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each post as plain text: who reposted it, its text, its media descriptions and links, and the post it quotes."""
    rows = feed_rows(table(spark, sf, "feed_records"))
    tail = F.col("tail")
    cell = lambda k: F.element_at("cells", F.lit(k))
    line = (
        F.when(tail == "reason.by", F.concat(F.lit("[Repost: @"), cell("handle"), F.lit("]")))
        .when(tail.isin("record", "value"), F.concat(F.when(F.col("depth") > 0, "[Quote]\n").otherwise(""), cell("text")))
        .when(tail.rlike(r"^(record|value)\.embed(\.media)?\.images\[\]$"), F.concat(F.lit("[Image "), cell("alt"), F.lit("]")))
        .when(tail.rlike(r"^(record|value)\.embed(\.media)?\.video$"), F.lit("[Video]"))
        .when(tail.rlike(r"^(record|value)\.embed(\.media)?\.external$"), cell("uri"))
    )
    part = F.when(tail == "reason.by", 0).when(tail.isin("record", "value"), 1).otherwise(2)
    own = rows.select("record_id", "item_pos", F.struct(F.when(tail == "reason.by", -1).otherwise(F.col("depth")).alias("d"), part.alias("p"), "ords", line.alias("l")).alias("s")).filter(F.col("s.l").isNotNull() & (F.col("s.l") != ""))
    return own.groupBy("record_id", "item_pos").agg(F.array_join(F.array_sort(F.collect_list("s")).getField("l"), "\n\n").alias("text"))
