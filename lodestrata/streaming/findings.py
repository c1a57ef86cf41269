"""Structured Streaming forms: the same plans over arriving findings, with bounded state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators import findings as ops


def arriving(spark: SparkSession, folder: str, schema: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    """Findings from parquet files as they arrive in a folder."""
    shape = spark.read.parquet(folder).schema if schema is None else schema
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def severity_counts(stream: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Counts by time window and severity; state is dropped once a window is later than ``late``."""
    rows = stream.withWatermark("created_at", late).groupBy(F.window("created_at", window), "severity").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("window_start"), "severity", "n")


def first_seen(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Findings whose fingerprint did not arrive before within the watermark; those without fingerprint are left out."""
    return stream.filter("fingerprint is not null").withWatermark("created_at", late).dropDuplicatesWithinWatermark(["fingerprint"])


def unsuppressed(stream: DataFrame, suppressions: DataFrame) -> DataFrame:
    """A stream-static anti-join; the suppressions are read anew for every batch."""
    marked = stream.join(suppressions.select("fingerprint").distinct().withColumn("_s", F.lit(True)), "fingerprint", "left")
    return marked.filter("_s is null").drop("_s")


def keep_persistence(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Merge every batch into stored persistence: ``read`` gives it, ``write`` replaces it atomically."""

    def merge(batch: DataFrame, _: int) -> None:
        now = F.lit(batch.agg(F.max("created_at")).first()[0])
        write(ops.merge_persistence(read(), batch, now))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
