"""Checking documents as they arrive.

A file stream of parsed documents is checked batch by batch; each batch is written under
its own number, so that a batch that is run again after a failure replaces itself and
nothing is counted twice. Arrivals are counted in event-time windows; how late a delivery may be is a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators import arithmetic


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """A table as a stream of its files; a single file is named by a pattern that only it matches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _plain(report: DataFrame) -> DataFrame:
    r = arithmetic.verdict(report)
    return r.select("doc_id", "document_id", "document_type", "checks_run", "n_material", "n_rounding", "verdict")


def check_stream(stream: DataFrame, out: str, checkpoint: str, doc_id: str = "row_id") -> None:
    """Reports of all documents that are there now, appended to ``out``; documents seen before are not read again."""

    def write(batch: DataFrame, number: int) -> None:
        _plain(arithmetic.reports(arithmetic.documents(batch, doc_id))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def arrivals(stream: DataFrame, at: str = "ingested_at", window: str = "7 days", lateness: str = "30 days") -> DataFrame:
    """Documents per window of their arrival.

    Written in append mode, a window comes out once, when the watermark has passed its end, and
    deliveries later than that are left out; in complete mode all windows come out each time
    and nothing is left out.
    """
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).groupBy(F.window(at, window), "document_type").agg(F.count(F.lit(1)).alias("documents")).select(F.col("window.start").alias("window_start"), "document_type", "documents")
