"""Event activity kept live: windows of arrival time that a watermark closes, and what comes after that.

Two streams. The first counts each micro-batch per window and category and splits the counts by the watermark as it stands
before the batch, that is the latest arrival of all earlier batches less the delay: late counts go to a table of their own.
The second reads the counts that are in time and adds them up per window in Spark's state store, which holds open windows
only, and appends each window once it is closed. It sees the same batches or later ones, so its own watermark is never
ahead of the first one's, and drops nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stowage.functions.events import event_category
from stowage.session import child_numbers, path_exists, remove_folder

COUNTS = "bucket_start timestamp, series string, n bigint"
# Counts of a micro-batch with an arrival time inside the window.
TIMED = f"{COUNTS}, arrived timestamp"
BATCH = "activity_batch"
MARK = "latest timestamp"


@dataclass(frozen=True)
class LiveActivity:
    """The two streams: ``counting`` feeds ``closing``."""

    counting: StreamingQuery
    closing: StreamingQuery | None

    def awaitTermination(self) -> None:
        for query in (self.counting, self.closing):
            if query is not None:
                query.awaitTermination()

    def stop(self) -> None:
        for query in (self.counting, self.closing):
            if query is not None:
                query.stop()


def _latest(spark: SparkSession, path: str, before: int):
    """The latest arrival in all batches before one."""
    written = [n for n in child_numbers(spark, f"{path}/latest", BATCH) if n < before]
    if not written:
        return None
    return spark.read.schema(MARK).parquet(f"{path}/latest/{BATCH}={max(written)}").first()["latest"]


def count_batch(batch: DataFrame, batch_id: int, path: str, width: str, delay: str) -> None:
    """Count one micro-batch into ``timely`` and ``late``. A batch that is run again finds the same counts; those that are
    there are left, as the second stream may have read them."""
    spark = batch.sparkSession
    latest = _latest(spark, path, batch_id)
    groups = [F.window("received_at", width).alias("w"), event_category(F.col("event_name")).alias("series")]
    counted = batch.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.max("received_at").alias("arrived")).persist()
    try:
        known = F.lit(latest).cast("timestamp")
        # Spark closes a window that ends at or before the watermark.
        closed = F.coalesce(F.col("w.end") <= known - F.expr(f"INTERVAL {delay}"), F.lit(False))
        rows = counted.select(F.col("w.start").alias("bucket_start"), "series", "n", "arrived", closed.alias("closed"))
        for name, chosen in (("timely", rows.where("NOT closed")), ("late", rows.where("closed").drop("arrived"))):
            folder = f"{path}/{name}/{BATCH}={batch_id}"
            if not path_exists(spark, f"{folder}/_SUCCESS"):
                chosen.drop("closed").coalesce(1).write.mode("overwrite").parquet(folder)
        mark = counted.agg(F.max("arrived").alias("latest")).select(F.greatest("latest", known).alias("latest"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{path}/latest/{BATCH}={batch_id}")
        for old in child_numbers(spark, f"{path}/latest", BATCH):
            if old < batch_id - 1:
                remove_folder(spark, f"{path}/latest/{BATCH}={old}")
    finally:
        counted.unpersist()


def close_windows(timely: DataFrame, width: str, delay: str) -> DataFrame:
    """Counts per window and category of a stream of counts, each row once its window is closed."""
    marked = timely.withWatermark("arrived", delay)
    summed = marked.groupBy(F.window("arrived", width).alias("w"), "series").agg(F.sum("n").alias("n"))
    return summed.select(F.col("w.start").alias("bucket_start"), "series", "n")


def stream_activity(
    events: DataFrame, path: str, checkpoint: str, width: str = "1 hour", available_now: bool = False, delay: str = "10 minutes"
) -> LiveActivity:
    """Count events per arrival window and category. A window is closed once an event has come ``delay`` after its end;
    events that come later still count, as late ones."""
    spark = events.sparkSession
    for name, schema in (("timely", TIMED), ("late", COUNTS), ("closed", COUNTS)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}/{BATCH}=-1")
    def start(writer, name: str) -> StreamingQuery:
        writer = writer.option("checkpointLocation", f"{checkpoint}/{name}")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def count(batch: DataFrame, batch_id: int) -> None:
        count_batch(batch, batch_id, path, width, delay)

    counting = start(events.writeStream.foreachBatch(count), "counting")
    if available_now:
        counting.awaitTermination()
    timely = spark.readStream.schema(f"{TIMED}, {BATCH} bigint").parquet(f"{path}/timely").drop(BATCH)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/closed/{BATCH}={batch_id}")

    closing = start(close_windows(timely, width, delay).writeStream.outputMode("append").foreachBatch(append), "closing")
    return LiveActivity(counting, closing)


def read_activity(spark: SparkSession, path: str, open_windows: bool = True) -> DataFrame:
    """Events per window and category so far: closed windows, late events, and the windows that are open still."""
    read = lambda name, schema: spark.read.schema(f"{schema}, {BATCH} bigint").parquet(f"{path}/{name}").drop(BATCH)
    closed = read("closed", COUNTS)
    rows = closed.unionByName(read("late", COUNTS))
    if open_windows:
        timely = read("timely", TIMED).drop("arrived")
        rows = rows.unionByName(timely.join(closed.select("bucket_start", "series"), ["bucket_start", "series"], "left_anti"))
    return rows.groupBy("bucket_start", "series").agg(F.sum("n").alias("n"))
