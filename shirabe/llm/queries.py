"""Queries of the training-data problems over the project's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.llm.leaked_items import leaked_items
from shirabe.llm.main_body import main_lines
from shirabe.llm.pack_containers import pack_containers, token_rows
from shirabe.llm.reading_level import reading_levels
from shirabe.llm.similar_vectors import similar_vectors
from shirabe.llm.split_items import boundaries, split_items
from shirabe.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(table(spark, sf_dir, "chunk_vectors"), "chunk_id", "embedding", "embedded_at").filter(F.col("similarity") >= 0.9)
    return near.select(F.least("id", "neighbour_id").alias("chunk_id"), F.greatest("id", "neighbour_id").alias("neighbour_id")).distinct()


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "chunk_vectors"), "chunk_id", "embedding", "embedded_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries(table(spark, sf_dir, "chunks"), "id", "text").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "chunks"), "id", "text")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack_containers(token_rows(docs, "doc_id", "text"), rows=docs.count())  # counted from Parquet footers


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "reading_level").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = main_lines(table(spark, sf_dir, "page_files"), "filepath", "body", table(spark, sf_dir, "crawl_log"), "filepath", "status")
    return lines.distinct().select("filepath", F.explode("lines").alias("line_no"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_nearest": p2_nearest, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_containers": p6_containers, "p7_found": p7_found, "p8_found": p8_found}
SQL: dict[str, str] = {}
