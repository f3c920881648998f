"""Notifications to catalog: ingest, process, apply."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.operators.events import (
    HEAD_NOT_FOUND,
    apply_mutations,
    coalesce_mutations,
    event_outcomes,
    mark_events,
    resolve_events,
    without_heads,
)
from stowage.session import cut_lineage
from stowage.streaming.apply import inbox_stream, latest_mutations, stream_apply
from stowage.streaming.ingest import read_inbox, stream_ingest


def run_change_feed(
    notifications: DataFrame,
    workspace: str,
    buckets: Callable[[], DataFrame],
    objects: Callable[[], DataFrame],
    heads: DataFrame,
    seen_at: datetime,
    unified: bool = False,
) -> DataFrame:
    """Ingest and process everything the stream holds now, and return the catalog after it.

    ``workspace`` keeps the inbox, the rejected notifications, the outcomes and the checkpoints, on shared storage; call
    again with the same one to go on from where the last call ended. ``objects`` gives the snapshot the workspace started
    from: the last mutation of every key so far is applied to it. :func:`feed_outcomes` tells how each event ended.
    """
    spark = notifications.sparkSession
    inbox, output = f"{workspace}/inbox", f"{workspace}/applied"
    stream_ingest(
        notifications, inbox, f"{workspace}/rejected", f"{workspace}/checkpoints/ingest", available_now=True
    ).awaitTermination()
    stream_apply(
        inbox_stream(spark, inbox), buckets, objects, output, f"{workspace}/checkpoints/apply", available_now=True,
        unified=unified,
    ).awaitTermination()
    return apply_mutations(objects(), cut_lineage(latest_mutations(spark, output)), heads, seen_at)


def feed_outcomes(spark: SparkSession, workspace: str, heads: DataFrame) -> DataFrame:
    """(id, state, error_message) of every event of a workspace. Processed events whose document is missing have failed."""
    outcomes = spark.read.parquet(f"{workspace}/applied/outcomes").select("id", "state", "error_message")
    lost = without_heads(latest_mutations(spark, f"{workspace}/applied"), heads).withColumnRenamed("key", "object_key")
    failed = read_inbox(spark, f"{workspace}/inbox").join(lost, ["bucket_id", "object_key"], "left_semi")
    rows = outcomes.join(failed.select("id", F.lit(True).alias("_lost")), "id", "left")
    lost_now = F.coalesce("_lost", F.lit(False)) & (F.col("state") == "processed")
    return rows.select(
        "id",
        F.when(lost_now, "failed").otherwise(F.col("state")).alias("state"),
        F.when(lost_now, HEAD_NOT_FOUND).otherwise(F.col("error_message")).alias("error_message"),
    )


def apply_events(
    events: DataFrame, buckets: DataFrame, objects: DataFrame, heads: DataFrame, at: datetime, run_id: str = "",
    unified: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(catalog, events) after processing all pending events of a batch table.

    An import or refresh without a head leaves the catalog as it is, and its events have failed.
    """
    resolved = cut_lineage(resolve_events(events.where("state = 'pending'"), buckets, objects, unified))
    mutations = cut_lineage(coalesce_mutations(resolved))
    catalog = apply_mutations(objects, mutations, heads, at, run_id)
    return catalog, mark_events(events, event_outcomes(resolved, without_heads(mutations, heads)), at)
