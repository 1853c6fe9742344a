"""Timed snippets merged into paragraphs: a new one after a pause, or where the next snippet would make it too long."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clock(seconds: Column, total: Column) -> Column:
    """[mm:ss], or [h:mm:ss] in a recording of an hour or more."""
    s = F.floor(seconds).cast("bigint")
    return F.when(total >= 3600, F.format_string("[%d:%02d:%02d]", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(F.format_string("[%02d:%02d]", F.floor(s / 60), s % 60))


def merge(snippets: list[tuple[float | None, float | None, str | None]], gap: float = 2.0, most: int = 300) -> list[tuple[float, str]]:
    """(start, text) of each paragraph; snippets without readable start are skipped, texts join without a space, ends count by their maximum."""
    out: list[tuple[float, str]] = []
    start, text, ended = 0.0, "", None
    for s, e, t in snippets:
        if s is None:
            continue
        t = t or ""
        if ended is None or s - ended >= gap or len(text) + len(t) > most:
            if text:
                out.append((start, text))
            start, text = s, t
        else:
            text += t
        ended = max(x for x in (ended, e, s) if x is not None)
    if text:
        out.append((start, text))
    return out


def merge_transcripts(df: DataFrame, key: str, snippets: str, gap: float = 2.0, most: int = 300) -> DataFrame:
    """(key, position, start, text) of the paragraphs of ``snippets``, an array of (start double, end double, text string) in order.

    A transcript is one row, so nothing is shuffled. Null and empty arrays give no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, position, starts, texts = [], [], [], []
            for i, items in enumerate(batch.column(1).to_pylist()):
                for n, (s, t) in enumerate(merge([(x["start"], x["end"], x["text"]) for x in items or [] if x], gap, most)):
                    rows.append(i)
                    position.append(n)
                    starts.append(s)
                    texts.append(t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(position, pa.int32()), pa.array(starts, pa.float64()), pa.array(texts, pa.string())], names=[key, "position", "start", "text"]
            )

    return df.select(key, snippets).mapInArrow(run, f"`{key}` {kind}, position int, start double, text string")
