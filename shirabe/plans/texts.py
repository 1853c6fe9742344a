"""Text statistics and document fetching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.functions.filters import parse_filters, where
from shirabe.operators import chunkers
from shirabe.operators.extraction import extraction_choice
from shirabe.plans.registry import Registry
from shirabe.session import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_CLASSES = {"kana": r"[\x{3041}-\x{3096}\x{30A1}-\x{30FA}]", "kanji": r"[\x{4E00}-\x{9FFF}]", "latin": "[A-Za-z]", "digits": "[0-9]", "broken": r"[\x{FFFD}]"}
_RATIOS = ", ".join(f"round(len(regexp_extract_all(text, '{p}')) / length(text), 6) AS {k}" for k, p in _CLASSES.items())


@query(f"SELECT doc_id, {_RATIOS} FROM documents WHERE length(text) > 0")
def text_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of character classes, by which the quality of an extracted text layer is judged."""
    n = F.char_length("text")
    ratio = lambda p: F.round(F.regexp_count("text", F.lit(p)) / n, 6)
    return table(spark, sf, "documents").filter(n > 0).select("doc_id", *(ratio(p).alias(k) for k, p in _CLASSES.items()))


@query(
    r"""WITH r AS (SELECT doc_id, coalesce(text, '') AS t, regexp_matches(lower(coalesce(title, '')), 'tex|dvips|dvipdfm') AS tex, regexp_matches(lower(coalesce(source, '')), 'cmmi|cmsy|cmex|msam|msbm|stix|cambria math|latin modern math') AS math FROM documents),
    c AS (SELECT *, greatest(length(t), 1) AS n, len(regexp_extract_all(t, '[\x{FFFD}]')) AS broken, len(regexp_extract_all(t, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]')) AS cjk, len(regexp_extract_all(t, '[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]')) AS greek FROM r),
    w AS (SELECT doc_id, CASE WHEN broken / n > 0.1 THEN 'broken' WHEN cjk / n < 0.05 AND greek / n > 0.15 THEN 'greek' WHEN length(t) < 10 THEN 'empty' WHEN math THEN 'math' WHEN tex THEN 'tex' ELSE 'plain' END AS reason FROM c)
    SELECT doc_id, CASE WHEN reason = 'plain' THEN 'text' ELSE 'layout' END AS backend, CASE WHEN reason IN ('math', 'tex') THEN 'txt' WHEN reason <> 'plain' THEN 'ocr' END AS mode, reason FROM w"""
)
def extraction_choices(spark: SparkSession, sf: str) -> DataFrame:
    """How each document's text would be taken, were it the text layer of a one-page PDF made by what its title names."""
    return extraction_choice(table(spark, sf, "documents"), "doc_id", "text", F.col("title"), F.col("source"), F.lit(False))


@query("SELECT coalesce(lower(substring(lang, 1, 2)), '?') AS lang, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(strlen(text) + 1)::BIGINT AS tokens, round(sum(strlen(text) + 1) / sum(length(text)), 6) AS ratio, count(*) FILTER (strlen(text) + 1 > 512) AS above_context FROM documents GROUP BY 1")
def token_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the byte-level tokenizer for each character, by language, and how many texts exceed a context of 512."""
    size = F.octet_length("text") + 1
    return (
        table(spark, sf, "documents")
        .groupBy(F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit("?")).alias("lang"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"), F.sum(size).alias("tokens"), F.round(F.sum(size) / F.sum(F.char_length("text")), 6).alias("ratio"),
            F.count_if(size > 512).alias("above_context"),
        )
    )


@query(
    """SELECT l.log_id, CASE WHEN coalesce(l.filepath, '') = '' THEN 'no_file' WHEN p.filepath IS NULL THEN 'missing' WHEN length(p.body) > 2000 THEN 'truncated' ELSE 'whole' END AS status, substring(p.body, 1, 2000) AS text
    FROM crawl_log l LEFT JOIN page_files p ON l.filepath = p.filepath"""
)
def fetch_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The stored page of each crawl record, cut for display, with what is wrong where there is none."""
    pages = table(spark, sf, "page_files").select("filepath", "body").withColumn("have", F.lit(True))
    status = F.when(F.coalesce("filepath", F.lit("")) == "", "no_file").when(F.col("have").isNull(), "missing").when(F.char_length("body") > 2000, "truncated").otherwise("whole")
    return table(spark, sf, "crawl_log").join(pages, "filepath", "left").select("log_id", status.alias("status"), F.substring("body", 1, 2000).alias("text"))


@query("SELECT row_id FROM sources WHERE source_type = 'web' AND meta->>'$.lang' = 'en' AND json_type(meta, '$.lang') = 'VARCHAR' AND meta->>'$.tz' = 'UTC' AND json_type(meta, '$.tz') = 'VARCHAR'")
def filter_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources").filter(where("meta", parse_filters("lang=en,tz=UTC"), "web")).select("row_id")


@query("SELECT item_id, len(expected_sources) AS expected, len(negative_sources) AS negative, len(expected_keywords) AS keywords, coalesce(category, 'none') AS category FROM eval_items")
def evaluation_items(spark: SparkSession, sf: str) -> DataFrame:
    size = lambda c: F.size(c).cast("bigint").alias(c.split("_")[1] if c == "expected_keywords" else c.split("_")[0])
    return table(spark, sf, "eval_items").select("item_id", size("expected_sources"), size("negative_sources"), size("expected_keywords"), F.coalesce("category", F.lit("none")).alias("category"))


@query()
def content_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks between headings, with heading, level and path."""
    return chunkers.explode_rows(table(spark, sf, "documents"), "doc_id", "text", lambda t: chunkers.heading_chunks(t, max(1, len(t)), 0), "heading string, level int, section_path string, content string")
