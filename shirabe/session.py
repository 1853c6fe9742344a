"""Session helpers: settings that the operators rely on, table loading, and dealing rows out to tasks on request."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: The setting by which a caller asks for rows to be dealt out before Python stages.
DEAL = "spark.shirabe.deal"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that change results, not resources: UTC as session time zone and the Java regular-expression dialect.

    Resource settings (shuffle partitions, memory, broadcast threshold) stay as the cluster gave them.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is read; where the caller has set ``spark.shirabe.deal``, dealt out to that many tasks, whatever its size.

    For input in a few files that cannot be split, which would keep a few cores busy. Unset, nothing is shuffled.
    """
    tasks = df.sparkSession.conf.get(DEAL, None)
    return df.repartition(int(tasks)) if tasks else df


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written once to the folder that ``spark.checkpoint.dir`` names and all executors share, and read from there.

    Only where the session names none, as in tests on one machine, a folder of its own is made.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shirabe-"))
    return df.checkpoint()
