"""Incremental ingestion: a stream of source rows kept current in chunk and vector tables, exactly once by chunk id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shirabe.functions.embedding import HashedEmbedding, Provider, embed
from shirabe.operators.chunkers import explode_rows, routed_chunks
from shirabe.sources.tables import SegmentedTable

SOURCE_SCHEMA = "source_id string, source_type string, title string, status string, updated_at string, text string"


def chunk_rows(sources: DataFrame, size: int = 200, overlap: int = 30, table_size: int = 714) -> DataFrame:
    """(chunk_id, source_id, chunk_index, kind, section_path, text) of sources with text; the id follows from source and index alone."""
    cut = explode_rows(sources, "source_id", "text", lambda t: routed_chunks(t, size, overlap, table_size, False), "kind string, section_path string, content string")
    chunk_id = F.concat(F.substring(F.sha2("source_id", 256), 1, 16), F.lit("_"), F.col("position"))
    return cut.select(chunk_id.alias("chunk_id"), "source_id", F.col("position").cast("bigint").alias("chunk_index"), "kind", "section_path", F.col("content").alias("text"))


def apply_batch(batch: DataFrame, number: int, chunks: SegmentedTable, vectors: SegmentedTable, provider: Provider) -> None:
    """One batch of changed sources: of each the newest row counts and replaces the source's chunks and vectors; a deleted or empty source keeps none.

    Only the batch's own rows are written. Applying a batch again changes nothing, so a restarted stream may repeat its last one.
    """
    names = [c for c in batch.columns if c != "source_id"]
    newest = batch.groupBy("source_id").agg(F.max_by(F.struct(*names), "updated_at").alias("r")).select("source_id", "r.*")
    live = newest.filter(F.coalesce(F.col("status") != "deleted", F.lit(True)) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    fresh = chunk_rows(live)
    vectors.write_batch(number, embed(fresh, "chunk_id", "text", provider, prefix="search_document: ", carry=("source_id",)), newest)
    chunks.write_batch(number, fresh, newest)


def ingest(spark: SparkSession, incoming: str, chunks_path: str, vectors_path: str, checkpoint: str, provider: Provider | None = None, available_now: bool = True) -> StreamingQuery:
    """A stream over JSON files of sources in ``incoming``. With ``available_now`` it ends when everything there is processed.

    The checkpoint is the log of what was processed; the three paths must be shared by all executors.
    """
    chunks, vectors = SegmentedTable(spark, chunks_path), SegmentedTable(spark, vectors_path)
    provider = provider or HashedEmbedding()
    rows = spark.readStream.schema(SOURCE_SCHEMA).json(incoming)
    writer = rows.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, chunks, vectors, provider)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
