"""Continuous ingest of notifications into an inbox that holds every dedupe key once.

A notification that cannot be read waits and is delivered again with the next batch, five times in all; then it is a dead
letter. The waiting ones are a table of their own, one folder per batch, and each batch takes over what the batch before it
has left, so a batch that is run again delivers the same ones the same time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from stowage.operators.events import append_events, first_per_key, to_stored, unseen
from stowage.schema import INBOX, INGEST, STORED_EVENT
from stowage.session import child_numbers, remove_folder, written
from stowage.sources.notifications import accepted, parse_notifications, rejects

# Parts of the store by a hash of the dedupe key. A batch reads the parts that its keys fall into.
KEY_PARTS = 64
PART = "key_part"
STORE = T.StructType([*INBOX.fields, T.StructField(PART, T.IntegerType())])


def key_part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_PARTS)).cast("int")


def create_inbox(spark: SparkSession, path: str) -> None:
    """An empty inbox table, so that readers find it before the first batch."""
    empty = spark.createDataFrame([], STORED_EVENT)
    empty.write.mode("ignore").parquet(f"{path}/{INGEST}=-1/{PART}=0")


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path).drop(PART)


def stored_keys(spark: SparkSession, path: str, parts: list[int], without: int) -> DataFrame:
    """The stored dedupe keys of some parts, but for one batch's; other parts are not read."""
    rows = spark.read.schema(STORE).parquet(path)
    return rows.where(F.col(PART).isin(parts) & (F.col(INGEST) != without)).select("dedupe_key")


def compact_inbox(spark: SparkSession, path: str, into: str) -> None:
    """Write the inbox to a new folder with one batch folder and one file per part, for ingest to go on with.

    The rows keep their state and no folder is written over. They belong to no batch that is still to come.
    """
    rows = spark.read.schema(STORE).parquet(path).drop(INGEST)
    rows.repartition(KEY_PARTS, PART).write.partitionBy(PART).parquet(f"{into}/{INGEST}=-1")


def dedupe_batch(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a micro-batch whose key was never stored, each key once."""
    return append_events(stored, batch)


# How often a notification that cannot be read is delivered.
DELIVERIES = 5
NOTIFICATION = ["bucket_id", "body", "received_at"]
WAITING = "bucket_id string, body string, received_at timestamp, delivery int, error string"
# Deliveries without new notifications after a batch, in folders of their own.
AGAIN = "delivered_again"

Parse = Callable[[DataFrame], DataFrame]


def _last_waiting(spark: SparkSession, waiting: str, before: int | None = None) -> tuple[int, int] | None:
    """The batch, and the delivery after it, that left the newest waiting notifications."""
    batches = [n for n in child_numbers(spark, waiting, INGEST) if before is None or n < before]
    if not batches:
        return None
    return max(batches), max(child_numbers(spark, f"{waiting}/{INGEST}={max(batches)}", AGAIN))


def _read_waiting(spark: SparkSession, waiting: str, last: tuple[int, int] | None) -> DataFrame:
    if last is None:
        return spark.createDataFrame([], WAITING)
    return spark.read.schema(WAITING).parquet(f"{waiting}/{INGEST}={last[0]}/{AGAIN}={last[1]}")


def _deliver(rows: DataFrame, number: int, inbox: str, dead: str, waiting: str | None, transport: str, parse: Parse, most: int) -> None:
    """Parse, dedupe and store ``rows`` (…, delivery) as the batch folder ``number``."""
    parsed = parse(rows)
    # The body is of use where it could not be read.
    body = F.when(F.col("error").isNotNull(), F.col("body")).alias("body")
    with written(parsed.select("bucket_id", body, "received_at", "delivery", "events", "error")) as parsed:
        incoming = to_stored(accepted(parsed, ("bucket_id", "received_at")), transport)
        # At most KEY_PARTS numbers.
        parts = [row[0] for row in incoming.select(key_part(F.col("dedupe_key"))).distinct().collect()]
        earlier = stored_keys(rows.sparkSession, inbox, parts, number)
        fresh = unseen(earlier, first_per_key(incoming)).select(*STORED_EVENT.fieldNames(), key_part(F.col("dedupe_key")).alias(PART))
        # A part of a batch is one file.
        fresh.repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(f"{inbox}/{INGEST}={number}")
        bad = rejects(parsed)
        done = F.col("delivery") >= (most if waiting else 1)
        bad.where(done).select(*NOTIFICATION, "error").write.mode("overwrite").parquet(f"{dead}/{INGEST}={number}")
        if waiting:
            bad.where(~done).select(*NOTIFICATION, "delivery", "error").write.mode("overwrite").parquet(waiting)


def store_batch(
    batch: DataFrame,
    batch_id: int,
    inbox: str,
    rejected: str,
    transport: str = "stream",
    waiting: str | None = None,
    parse: Parse = parse_notifications,
    deliveries: int = DELIVERIES,
) -> None:
    """Parse, dedupe and store one micro-batch of (bucket_id, body, received_at).

    A batch owns one folder and replaces it whole, so a batch that is run again leaves the same rows. Of the store only the
    parts that the new keys fall into are read, and of those only the keys. With ``waiting`` the notifications that earlier
    batches could not read are delivered with this one, and those that cannot be read now wait there, until their
    ``deliveries`` are used up and they go to ``rejected``; without it they go there at once. ``parse`` reads notifications
    into ``events`` and ``error`` as :func:`stowage.sources.notifications.parse_notifications` does.
    """
    spark = batch.sparkSession
    rows = batch.select(*NOTIFICATION).withColumn("delivery", F.lit(1))
    left = last = None
    if waiting:
        last = _last_waiting(spark, waiting, batch_id)
        again = _read_waiting(spark, waiting, last)
        rows = rows.unionByName(again.drop("error").withColumn("delivery", F.col("delivery") + 1))
        left = f"{waiting}/{INGEST}={batch_id}/{AGAIN}=0"
    _deliver(rows, batch_id, inbox, rejected, left, transport, parse, deliveries)
    if last:
        # What this batch has taken over stays, for a repeated run of it.
        for old in child_numbers(spark, waiting, INGEST):
            if old < last[0]:
                remove_folder(spark, f"{waiting}/{INGEST}={old}")


def redeliver(
    spark: SparkSession,
    inbox: str,
    rejected: str,
    waiting: str,
    transport: str = "stream",
    parse: Parse = parse_notifications,
    deliveries: int = DELIVERIES,
) -> int:
    """Deliver the waiting notifications once more while no new ones come, and tell how many still wait.

    The stream must not run meanwhile. What is stored belongs to a batch of its own, numbered below those of the stream.
    """
    last = _last_waiting(spark, waiting)
    if last is None:
        return 0
    batch, passed = last
    rows = _read_waiting(spark, waiting, last).drop("error").withColumn("delivery", F.col("delivery") + 1)
    left = f"{waiting}/{INGEST}={batch}/{AGAIN}={passed + 1}"
    # One number per stream batch and delivery after it; -1 is the compacted store.
    _deliver(rows, -2 - (batch << 20) - passed, inbox, rejected, left, transport, parse, deliveries)
    return spark.read.schema(WAITING).parquet(left).count()


def without_repeats(source: DataFrame, horizon: str) -> DataFrame:
    """A stream of notifications without those that it has delivered before, within about ``horizon`` of each other.

    A transport that delivers at least once sends the same bytes with the same time of receipt; only those are repeats, so
    what is stored does not change. The state holds digests. Time is that of arrival here, so nothing is ever late.
    """
    digest = F.xxhash64("body").alias("_short"), F.md5(F.col("body").cast("binary")).alias("_digest")
    named = source.select("*", *digest).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", horizon)
    once = named.dropDuplicatesWithinWatermark(["bucket_id", "_short", "_digest", "received_at"])
    return once.select(*source.columns)


def stream_ingest(
    source: DataFrame,
    inbox: str,
    rejected: str,
    checkpoint: str,
    available_now: bool = False,
    waiting: str | None = None,
    horizon: str | None = None,
    parse: Parse = parse_notifications,
) -> StreamingQuery:
    """Start ingesting a stream of (bucket_id, body, received_at); dead letters go to ``rejected``.

    Notifications that cannot be read wait in ``waiting``, by default a folder beside ``rejected``, for the batches after.
    With a ``horizon``, such as ``1 hour``, repeats within it are dropped before any of their keys is looked up; the store
    decides about all others, as it does without.
    """
    create_inbox(source.sparkSession, inbox)
    place = waiting or f"{rejected}-waiting"

    def store(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, inbox, rejected, waiting=place, parse=parse)

    rows = source if horizon is None else without_repeats(source, horizon)
    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
