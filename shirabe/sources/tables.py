"""Versioned tables in plain Parquet: a write goes to a new version, and a pointer names the one that counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):  # type: ignore[no-untyped-def]
    """Hadoop's file system of ``path`` and its Path class."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


class Busy(RuntimeError):
    """A table that a batch and a compaction want at one time."""


class SegmentedTable:
    """Rows of ``owner`` that are replaced together, kept as one segment for each batch; reading takes each owner's newest segment.

    A batch writes its own rows and the list of owners that it touches, nothing else; writing it again overwrites its own segment, so
    a repeated batch changes nothing. ``compact`` merges the segments into a new generation; readers see the newest finished one.
    """

    def __init__(self, spark: SparkSession, path: str, owner: str = "source_id"):
        self.spark, self.path, self.owner = spark, path.rstrip("/"), owner

    def _generation(self) -> int:
        fs, path = file_system(self.spark, self.path)
        if not fs.exists(path(self.path)):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return max([int(n[1:]) for n in names if n.startswith("g") and n[1:].isdigit() and fs.exists(path(f"{self.path}/{n}/_done"))], default=0)

    def write_batch(self, number: int, rows: DataFrame, touched: DataFrame, generation: int | None = None) -> None:
        """Segment ``number``: ``rows``, which replace all that the owners in ``touched`` had. The owners come last and make it count.

        A batch and ``compact`` never run together: each puts up its own sign, then looks for the other's. A batch that finds the table
        being compacted is refused and can be written again later.
        """
        fs, path = file_system(self.spark, self.path)
        sign = path(f"{self.path}/_writing/{number}")
        if generation is None:
            fs.create(sign, True).close()
        try:
            if generation is None and fs.exists(path(f"{self.path}/_compacting")):
                raise Busy(f"{self.path} is being compacted")
            base = f"{self.path}/g{self._generation() if generation is None else generation}"
            rows.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
            touched.select(self.owner).distinct().write.mode("overwrite").parquet(f"{base}/owners/batch={number}")
        finally:
            if generation is None:
                fs.delete(sign, False)

    def read(self) -> DataFrame | None:
        base = f"{self.path}/g{self._generation()}"
        fs, path = file_system(self.spark, self.path)
        if not fs.exists(path(f"{base}/owners")):
            return None
        newest = self.spark.read.parquet(f"{base}/owners").groupBy(self.owner).agg(F.max("batch").alias("batch"))
        return self.spark.read.parquet(f"{base}/rows").join(newest, [self.owner, "batch"]).drop("batch")

    def compact(self, number: int) -> None:
        """All that counts now, as segment ``number`` of the next generation; older generations go. Refused while a batch is being written."""
        fs, path = file_system(self.spark, self.path)
        sign = path(f"{self.path}/_compacting")
        fs.create(sign, True).close()
        try:
            busy = path(f"{self.path}/_writing")
            if fs.exists(busy) and len(fs.listStatus(busy)):
                raise Busy(f"{self.path} is being written to")
            now, old = self.read(), self._generation()
            if now is None:
                return
            self.write_batch(number, now, now, old + 1)
            fs.create(path(f"{self.path}/g{old + 1}/_done")).close()
            fs.delete(path(f"{self.path}/g{old}"), True)
        finally:
            fs.delete(sign, False)

    def delete_owners(self, number: int, owners: DataFrame) -> None:
        """Segment ``number``, in which ``owners`` have no rows."""
        now = self.read()
        if now is not None:
            self.write_batch(number, now.limit(0), owners)

    def clear(self) -> None:
        """No rows and no segments."""
        fs, path = file_system(self.spark, self.path)
        fs.delete(path(self.path), True)


class VersionedTable:
    """Readers see the version that the pointer names; a write that fails leaves it where it was.

    Files are reached through Hadoop's file system, so a path may lie on any storage that the cluster shares.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _fs(self):  # type: ignore[no-untyped-def]
        return file_system(self.spark, self.path)

    def versions(self) -> list[int]:
        """Versions whose write was finished, in order."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{v[-1]}") if v else None

    def write(self, df: DataFrame, partition_by: str | None = None) -> int:
        """The new version's number. Older ones beyond ``keep`` are removed afterwards."""
        v = self.versions()
        number = v[-1] + 1 if v else 0
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.path}/v{number}")
        fs, path = self._fs()
        for old in v[: max(0, len(v) + 1 - self.keep)]:
            fs.delete(path(f"{self.path}/v{old}"), True)
        return number

    def upsert(self, rows: DataFrame, key: str, keep_first: tuple[str, ...] = ()) -> int:
        """Rows by key: new ones come in, known ones are replaced but for the columns of ``keep_first``; of repeated keys the greatest row counts."""
        old = self.read()
        others = [c for c in rows.columns if c != key]
        new = rows.groupBy(key).agg(F.max(F.struct(*others)).alias("_r")).select(*[key if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns])
        if old is None:
            return self.write(new)
        o, n = old.alias("o"), new.alias("n")
        there = F.col(f"n.{key}").isNotNull()
        columns = [
            F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c == key
            else F.when(there & F.lit(c not in keep_first), F.col(f"n.{c}")).otherwise(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep_first else F.col(f"o.{c}")).alias(c)
            for c in old.columns
        ]
        return self.write(o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*columns))

    def delete(self, condition) -> int:  # type: ignore[no-untyped-def]
        """Everything but the rows for which ``condition`` holds."""
        old = self.read()
        if old is None:
            raise ValueError("nothing was written yet")
        return self.write(old.filter(~F.coalesce(condition, F.lit(False))))
