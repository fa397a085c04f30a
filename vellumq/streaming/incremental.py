"""Incremental indexing and windowed counts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.operators.classify import classify
from vellumq.sources.extract import extracted


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New files below a folder as a stream with their content."""
    x = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return x.where("length > 0").select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.\w+)$", 1)).alias("extension"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "content")


def index_stream(stream: DataFrame, target: str, checkpoint: str):
    """Extract texts of new files and append them to a Parquet index, batch by batch; a batch that is repeated replaces itself.

    Each batch is its own folder, named by its number, so a retry after a lost executor leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        extracted(batch).withColumn("indexed_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current_index(spark: SparkSession, target: str) -> DataFrame:
    """The index that :func:`index_stream` writes, with one row per path: that of the last batch which had it. Texts are not shuffled, only the latest batch of each path is looked up."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"], "left_semi")


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events by type and window of event time, with a watermark for late rows; the same for batch and stream."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    x = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: ``user_id, start, end, n``."""
    x = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return x.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def classified_stream(stream: DataFrame) -> DataFrame:
    """Categories of a stream of ``id, text``."""
    return classify(stream, "id", "text")
