"""Content types, chunk boundaries, chunk ids and metadata over documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shirabe.functions import text as T
from shirabe.operators import chunkers
from shirabe.plans.registry import Registry
from shirabe.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: White space as Unicode has it, for DuckDB's patterns.
WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


_T = f"(SELECT doc_id, {sql_strip('coalesce(text, chr(32))')} AS t FROM documents)"
_CELLS = f"list_filter(list_transform(fl, lambda l: string_split_regex(l, '\\t|[{WS}]{{2,}}')), lambda c: len(c) >= 3)"
_NUM = f"regexp_matches(regexp_replace({sql_strip('x')}, '[¥$€£,円%]', '', 'g'), '^-?[0-9]+\\.?[0-9]*$')"


@query(
    f"""WITH t AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM {_T}), u AS (SELECT *, list_filter(list_transform(ls, lambda l: {sql_strip("l")}), lambda l: l <> '') AS fl FROM t),
    v AS (SELECT *, {_CELLS} AS cs FROM u), w AS (SELECT *, list_filter(cs, lambda c: len(list_filter(c, lambda x: {_NUM})) * 2 >= len(c)) AS ns FROM v),
    f AS (SELECT doc_id, t, regexp_matches(t, '(?m)^#{{1,6}}\\s+.+') OR regexp_matches(t, '(?i)<h[1-6][^>]*>.*?</h[1-6]>') AS h,
      len(ls) >= 2 AND ((len(list_filter(ls, lambda l: length(l) - length(replace(l, '|', '')) >= 2)) >= 2 AND len(list_filter(ls, lambda l: regexp_matches({sql_strip("l")}, '^\\|?[\\s\\-:|]+\\|[\\s\\-:|]+\\|?$'))) > 0)
        OR (len(fl) >= 2 AND (len(cs) / len(fl) >= 0.3 OR len(ns) / len(fl) >= 0.2))) AS tb FROM w)
    SELECT doc_id, CASE WHEN t = '' THEN 'prose' WHEN tb AND h THEN 'mixed' WHEN tb THEN 'table' WHEN h THEN 'heading' ELSE 'prose' END AS kind FROM f"""
)
def content_types(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.content_type(F.col("text")).alias("kind"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[{WS}]+', ''), '[{WS}]+$', '') AS text FROM documents")
def normalised_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.normalise(F.col("text")).alias("text"))


def _exploded(df: DataFrame, parts: F.Column) -> DataFrame:
    return df.select("doc_id", F.posexplode(parts).alias("position", "part"))


def _sql_exploded(parts: str) -> str:
    return f"SELECT doc_id, (i - 1)::INT AS position, ps[i] AS part FROM (SELECT doc_id, ps, unnest(generate_series(1, len(ps))) AS i FROM (SELECT doc_id, {parts} AS ps FROM documents WHERE text IS NOT NULL))"


@query(_sql_exploded(f"list_filter(list_transform(string_split_regex(text, '\\n[{WS}]*\\n'), lambda p: {sql_strip('p')}), lambda p: p <> '')"))
def paragraph_split(spark: SparkSession, sf: str) -> DataFrame:
    return _exploded(_docs(spark, sf), T.paragraphs(F.col("text")))


@query(_sql_exploded(f"list_filter(list_transform(regexp_extract_all(text, '[^。.!?]*[。.!?]|[^。.!?]+$'), lambda p: {sql_strip('p')}), lambda p: p <> '')"))
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return _exploded(_docs(spark, sf), T.sentences(F.col("text")))


@query(_sql_exploded("list_transform(generate_series(0, (length(text) - 1) // 200), lambda i: substring(text, i * 200 + 1, 200))"))
def fixed_split(spark: SparkSession, sf: str) -> DataFrame:
    return _exploded(_docs(spark, sf), T.slices(F.col("text"), 200))


@query(_sql_exploded("list_transform(generate_series(0, CASE WHEN length(text) = 0 THEN -1 WHEN length(text) <= 200 THEN 0 ELSE ceil((length(text) - 200) / 170.0)::INT END), lambda i: substring(text, i * 170 + 1, 200))"))
def sliding_split(spark: SparkSession, sf: str) -> DataFrame:
    return _exploded(_docs(spark, sf), T.slices(F.col("text"), 200, 170))


@query("SELECT DISTINCT source_id, chunk_index, substring(sha256(source_id), 1, 16) || '_' || chunk_index AS made_id, id, string_split(id, '_')[-1]::BIGINT AS parsed_index FROM chunks")
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.substring(F.sha2(F.col("source_id"), 256), 1, 16), F.lit("_"), F.col("chunk_index"))
    return table(spark, sf, "chunks").select("source_id", "chunk_index", made.alias("made_id"), "id", F.substring_index("id", "_", -1).cast("bigint").alias("parsed_index")).distinct()


@query(
    """WITH m AS (SELECT row_id, source_id, meta, unnest(json_keys(meta)) AS k FROM sources) SELECT row_id, 'custom:' || k AS key, json_extract_string(meta, '$.' || k) AS value FROM m
    WHERE k NOT IN ('source_id', 'source_type', 'title', 'collected_at', 'id')"""
)
def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Free metadata of each source as text, its keys marked as custom; the common keys are left out."""
    pairs = F.map_filter(F.from_json("meta", "map<string,string>"), lambda k, v: ~k.isin("source_id", "source_type", "title", "collected_at", "id"))
    return table(spark, sf, "sources").select("row_id", F.explode(F.transform_keys(pairs, lambda k, v: F.concat(F.lit("custom:"), k))).alias("key", "value"))


_LEVELS = [f"last_value(CASE WHEN level = {i} THEN heading WHEN level > 0 AND level < {i} THEN '' END IGNORE NULLS) OVER w AS h{i}" for i in range(1, 7)]


@query(
    f"""WITH l AS (SELECT doc_id, i AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
    m AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#{{1,6}})[ \\t]+\\S', 1)) AS level, {sql_strip("regexp_extract(line, '^#{1,6}[ ' || chr(9) || ']+(.+)', 1)")} AS heading FROM l),
    n AS (SELECT doc_id, line_no, level, heading, {", ".join(_LEVELS)} FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
    SELECT doc_id, line_no, array_to_string(list_filter([h1, h2, h3, h4, h5, h6], lambda h: h <> ''), ' > ') AS section_path FROM n WHERE level > 0"""
)
def section_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The path of each heading: at every level the last heading, reset by a higher one."""
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    level = F.char_length(F.regexp_extract("line", r"^(#{1,6})[ \t]+\S", 1))
    heads = lines.select("doc_id", (F.col("line_no") + 1).cast("bigint").alias("line_no"), level.alias("level"), T.strip(F.regexp_extract("line", r"^#{1,6}[ \t]+(.+)", 1)).alias("heading")).filter(F.col("level") > 0)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    path = [F.last(F.when(F.col("level") == i, F.col("heading")).when(F.col("level") < i, F.lit("")), ignorenulls=True).over(w).alias(f"h{i}") for i in range(1, 7)]
    whole = heads.select("doc_id", "line_no", F.array(*path).alias("p"))
    return whole.select("doc_id", "line_no", F.array_join(F.filter("p", lambda h: F.coalesce(h, F.lit("")) != ""), " > ").alias("section_path"))


#: Sizes of the index: 200 characters and 30 of overlap; tables up to what a context of 512 tokens holds.
SIZE, OVERLAP, TABLE_SIZE = 200, 30, 714


@query()
def prose_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunkers.explode_rows(_docs(spark, sf), "doc_id", "text", lambda t: [(c,) for c in chunkers.prose_chunks(t, SIZE, OVERLAP)], "content string")


@query()
def heading_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunkers.explode_rows(_docs(spark, sf), "doc_id", "text", lambda t: chunkers.heading_chunks(t, SIZE, SIZE // 4), "heading string, level int, section_path string, content string")


@query()
def table_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunkers.explode_rows(_docs(spark, sf), "doc_id", "text", lambda t: chunkers.table_chunks(t, 1, TABLE_SIZE), "entity string, content string")


@query()
def index_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunkers.explode_rows(_docs(spark, sf), "doc_id", "text", lambda t: chunkers.routed_chunks(t, SIZE, OVERLAP, TABLE_SIZE, False), "kind string, section_path string, content string")


@query()
def evaluation_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunkers.explode_rows(_docs(spark, sf), "doc_id", "text", lambda t: chunkers.routed_chunks(t, SIZE, OVERLAP, TABLE_SIZE, True), "kind string, section_path string, content string")
