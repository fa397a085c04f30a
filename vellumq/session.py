"""Session helpers: table access, Arrow batch limits, reliable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bounds of one Arrow batch handed to a Python worker.
ARROW_ROWS = 2000
ARROW_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, so that long texts stay small in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    except Exception:  # noqa: BLE001  (older sessions lack the setting)
        pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only where none is set and all runs on one machine (tests)."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = sc.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vellumq-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any file system that Spark knows; none if there is none."""
    p, fs = _file(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file of any file system that Spark knows."""
    p, fs = _file(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def spread(df: DataFrame) -> DataFrame:
    """A narrow scan over all cores where the table has fewer partitions than there are cores, as one small file has; larger tables stay as they are read."""
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString() or "Adaptive" in plan.toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if plan.execute().getNumPartitions() >= cores else df.repartition(cores)


def broadcast_if_small(df: DataFrame, rows: int, bytes_per_row: int, limit_bytes: int = 64 << 20) -> DataFrame:
    """``broadcast(df)`` when its counted size is below the limit, else ``df`` for a shuffled join."""
    return F.broadcast(df) if rows * bytes_per_row <= limit_bytes else df
