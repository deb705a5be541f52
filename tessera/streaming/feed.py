"""Change events (path, ts, action, payload): upserts by batch, debouncing by session windows, deduplication under a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "path string, ts timestamp, action string, mtime bigint"


def events(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """JSON lines that appear in a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(folder)


def debounced(stream: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """path, first, last, n: one row a burst, when the watermark has passed its quiet time."""
    return stream.withWatermark("ts", late).groupBy("path", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n")).select("path", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def counts(stream: DataFrame, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Events by action in tumbling windows; later ones than the watermark allows are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def distinct_events(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["path", "mtime", "action"])


def apply(stream: DataFrame, handle: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, ignored: Callable | None = None, once: bool = False) -> StreamingQuery:
    """Each batch: the last event of every path, as (changed, deleted, batch id). A batch that comes again must change nothing new: handlers upsert."""

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy("path").agg(F.max_by(F.struct("action", "mtime"), F.struct("ts", "mtime")).alias("e")).select("path", "e.*")
        if ignored is not None:
            last = last.where(~ignored(F.col("path")))
        last = last.persist()
        try:
            handle(last.where("action <> 'delete'"), last.where("action = 'delete'"), number)
        finally:
            last.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
