"""Change detection between snapshots of a catalogue, runs of failures, and sessions by gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(rows: DataFrame, key: str, order: str, until: Column | None = None) -> DataFrame:
    """The newest row of each key (by ``order``, then row_id) among those for which ``until`` holds."""
    rows = rows if until is None else rows.filter(until)
    names = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(order, "row_id")).alias("_r"))
    return newest.select(key, *(F.col("_r")[c].alias(c) for c in names))


def manifest_diff(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(status, path, old_path): A, M, D, and R where a path that went and one that came have the same digest.

    One full outer join by path; renames pair the remainder by digest, the n-th in path order with the n-th, so that nothing multiplies.
    """
    o, n = old.select(key, F.col(digest).alias("o")), new.select(key, F.col(digest).alias("n"))
    both = o.join(n, key, "full").select(F.col(key).alias("path"), "o", "n")
    status = F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D").when(F.col("o") != F.col("n"), "M")
    net = both.select(status.alias("status"), "path", F.coalesce("n", "o").alias("digest")).filter(F.col("status").isNotNull())
    w = Window.partitionBy("status", "digest").orderBy("path")
    ranked = net.withColumn("i", F.when(F.col("status") != "M", F.row_number().over(w)))
    side = Window.partitionBy("digest", "i")
    gone = F.max(F.when(F.col("status") == "D", F.col("path"))).over(side)
    came = F.max(F.when(F.col("status") == "A", F.col("path"))).over(side)
    moved = ranked.withColumns({"gone": F.when(F.col("i").isNotNull(), gone), "came": F.when(F.col("i").isNotNull(), came)})
    renamed = F.col("gone").isNotNull() & F.col("came").isNotNull()
    return moved.filter(~(renamed & (F.col("status") == "D"))).select(F.when(renamed, "R").otherwise(F.col("status")).alias("status"), "path", F.when(renamed, F.col("gone")).alias("old_path"))


def failure_runs(rows: DataFrame, key: str, order: list[str], failed: Column, length: int) -> DataFrame:
    """(key, position, run): where runs of ``length`` consecutive failures are completed; position counts a key's rows from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    at = rows.select(key, failed.alias("_f"), F.row_number().over(w).alias("position"), *order)
    island = F.col("position") - F.row_number().over(Window.partitionBy(key, "_f").orderBy("position"))
    run = at.withColumn("_i", island).withColumn("run", F.row_number().over(Window.partitionBy(key, "_f", "_i").orderBy("position")))
    return run.filter(F.col("_f") & (F.col("run") == length)).select(key, "position", "run")


def gap_sessions(rows: DataFrame, key: str, order: list[str], start: Column, end: Column, gap: float) -> DataFrame:
    """``rows`` with ``session``: a new one begins where a row starts ``gap`` or more after everything before it has ended."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (start - before >= gap), 1).otherwise(0)
    return rows.withColumn("_n", fresh).withColumn("session", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")
