"""Items of varying length packed into containers of fixed capacity by harmonic classes.

Sizes fall into reciprocal classes: class j holds the sizes in (capacity / (j + 1), capacity / j], of which j go to a container. Classes
wider than STEP are divided into equal parts, and the largest item at hand stands for its class. A container is led by one class, of which it takes its fixed count; the room that this
leaves is promised to smaller classes, again in fixed counts, so that no container is half empty because its items are a little over a
half. An item's rank inside its class then gives its container by arithmetic alone.

Items are dealt to segments of about SEGMENT items by a hash, and each segment is packed by one worker independently of the others;
the number of segments follows from the number of items and not from the cluster, so equal input gives equal containers everywhere.
Rows that are equal in every column are counted before anything else and dealt out evenly, so a row that a third of all are copies of
fills every segment alike.

Shuffles: the narrow rows (key, size) twice, by row and by segment, never the texts; those are read once. Nothing reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
#: The widest part of a class, in tokens; items of a segment.
STEP, SEGMENT = 16, 65_536


def token_rows(df: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start_byte, n_bytes, n_tokens): every text as tokens of a byte-level tokenizer, one for each UTF-8 byte and one end mark.

    A text of more than ``capacity`` tokens is cut into pieces of at most ``capacity`` tokens, at code-point boundaries; each piece
    has its own end mark. An empty text is one item of one token; null has no row; repeated rows are items of their own.
    """
    room = capacity - 1
    size = F.octet_length(F.col("_text"))
    items = df.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    raw = F.encode("_text", "UTF-8")
    # a nominal cut moves back over the continuation bytes (10xxxxxx) before it, three at most
    byte_at = lambda p: F.conv(F.hex(F.substring(raw, p + 1, F.lit(1))), 16, 10).cast("int")
    inside = lambda p: byte_at(p).between(128, 191)

    def back(p):  # type: ignore[no-untyped-def]
        return F.when(~inside(p), p).when(~inside(p - 1), p - 1).when(~inside(p - 2), p - 2).otherwise(p - 3)

    step = room - 3
    nominal = F.sequence(F.lit(0), F.floor((size - 1) / step).cast("int"))
    starts = F.when(size <= room, F.array(F.lit(0))).otherwise(F.transform(nominal, lambda i: F.when(i == 0, 0).otherwise(back((i * step).cast("int")))))
    cut = items.select("doc_id", size.alias("_size"), starts.alias("_starts"))
    pieces = cut.select("doc_id", "_size", "_starts", F.posexplode("_starts").alias("piece", "start_byte"))
    end = F.coalesce(F.get("_starts", F.col("piece") + 1), F.col("_size"))
    rows = pieces.select("doc_id", F.col("piece").cast("bigint"), F.col("start_byte").cast("bigint"), (end - F.col("start_byte")).cast("bigint").alias("n_bytes"))
    return rows.withColumn("n_tokens", F.col("n_bytes") + 1)


def class_bounds(capacity: int = CAPACITY, step: int = STEP) -> np.ndarray:
    """The upper bounds of all classes, ascending: capacity / j, and those of the parts of classes wider than ``step``."""
    bounds = set()
    j = 1
    while j <= capacity:
        high, low = capacity // j, capacity // (j + 1)
        parts = max(1, -(-(high - low) // step))
        bounds |= {high - (high - low) * p // parts for p in range(parts)}
        j = capacity // low if low else capacity + 1  # equal bounds are one class
    return np.array(sorted(bounds), np.int64)


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(containers, [(class bound, items in each)]) that hold every item of one segment.

    The largest class left leads with its reciprocal count; then each class that fits the room that is left adds the count that fits.
    The same filling is used until one of its classes has too few items left.
    """
    left = {c: n for c, n in counts.items() if n > 0}
    order = sorted(left)
    while order:
        room, filling = capacity, []
        for c in reversed(order):
            n = min(room // c, left[c])
            if n:
                filling.append((c, n))
                room -= n * c
                if room < order[0]:
                    break
        times = min(left[c] // n for c, n in filling)
        yield times, filling
        for c, n in filling:
            left[c] -= times * n
            if not left[c]:
                order.remove(c)


def fill(size: np.ndarray, capacity: int = CAPACITY, bounds: np.ndarray | None = None) -> np.ndarray:
    """The container, from 0, of each item of a segment, in the order given; sizes lie in 1..capacity."""
    bounds = class_bounds(capacity) if bounds is None else bounds
    klass = bounds[np.searchsorted(bounds, size)] if len(size) else size
    order = np.argsort(klass, kind="stable")
    _, first, counts = np.unique(klass[order], return_index=True, return_counts=True)
    kinds = np.maximum.reduceat(size[order], first) if len(size) else klass  # the largest item stands for its class
    runs: dict[int, list[tuple[int, int, int]]] = {int(c): [] for c in kinds}
    used: dict[int, int] = dict.fromkeys(runs, 0)
    container = 0
    for times, filling in patterns(dict(zip(kinds.tolist(), counts.tolist())), capacity):
        for c, n in filling:
            runs[c].append((used[c], n, container))
            used[c] += times * n
        container += times
    out = np.empty(len(size), np.int64)
    for c, a, n in zip(kinds.tolist(), first.tolist(), counts.tolist()):
        start, each, at = np.array(runs[c], np.int64).T
        rank = np.arange(n)
        run = np.searchsorted(start, rank, side="right") - 1
        out[order[a : a + n]] = at[run] + (rank - start[run]) // each[run]
    return out


def pack_containers(items: DataFrame, capacity: int = CAPACITY, rows: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """``items`` (doc_id, piece, n_tokens, ...) with ``container``: none holds more than ``capacity`` tokens, and no item is divided.

    rows: about how many items there are, where that is known without reading them; else they are counted. Container numbers are
    unique; with one segment they are 0, 1, 2, ... Sizes must lie in 1..capacity; others (null among them) have a null container.
    Items in a class are taken by (doc_id, piece). Rows equal in every column are items of their own. Other columns are carried along
    and must be comparable (no maps); internal ones begin with ``__pack_``. An empty table gives an empty table.
    """
    segments = max(1, -(-(items.count() if rows is None else rows) // segment))
    columns = items.columns
    once = items.groupBy(*columns).agg(F.count(F.lit(1)).alias("__pack_n"))
    shares = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.least(F.col("__pack_n"), F.lit(segments)) - 1),
        lambda i: F.struct(F.pmod(F.xxhash64(*columns) + i, F.lit(segments)).cast("int").alias("__pack_segment"), (F.floor((F.col("__pack_n") - 1 - i) / segments) + 1).alias("__pack_n")),
    )
    dealt = once.select(*columns, F.explode(shares).alias("__pack_share")).select(*columns, "__pack_share.__pack_segment", "__pack_share.__pack_n")
    bounds = class_bounds(capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]  # one segment
        if not parts:
            return
        group = pa.Table.from_batches(parts).combine_chunks()
        group = group.take(pc.sort_indices(group, [("doc_id", "ascending"), ("piece", "ascending"), ("n_tokens", "ascending")]))
        group = group.take(pa.array(np.repeat(np.arange(group.num_rows), group["__pack_n"].to_numpy())))
        size = pc.fill_null(group["n_tokens"], 0).to_numpy()
        good = np.flatnonzero((size >= 1) & (size <= capacity))
        container = np.zeros(len(size), np.int64)
        container[good] = fill(size[good], capacity, bounds) * segments + group["__pack_segment"][0].as_py()
        usable = np.zeros(len(size), bool)
        usable[good] = True
        out = group.select(columns).append_column("container", pa.array(container, pa.int64(), mask=~usable))
        yield from out.to_batches(max_chunksize=50_000)

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return dealt.repartitionById(segments, "__pack_segment").mapInArrow(run, f"{fields}, container bigint")
