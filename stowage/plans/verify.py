"""Verification of the catalog against a listing."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from stowage.functions.evidence import evidence
from stowage.functions.hashing import DEFAULT_PARTITIONS, partition_id, partition_index
from stowage.operators.fingerprints import paired_fingerprints, sampled_total, should_sample
from stowage.operators.reconcile import Complete

BUCKET = ["bucket_id"]


@dataclass(frozen=True)
class Verified:
    partitions: DataFrame
    buckets: DataFrame


def _with_completeness(rows: DataFrame, complete: Complete) -> DataFrame:
    """``rows`` with ``listing_complete`` of their bucket; a listing of a prefix alone is not one of the bucket."""
    if isinstance(complete, bool):
        return rows.withColumn("listing_complete", F.lit(complete))
    whole = complete.where("complete AND coalesce(prefix, '') = ''" if "prefix" in complete.columns else "complete")
    sure = whole.select(*BUCKET).distinct().withColumn("listing_complete", F.lit(True))
    return rows.join(sure, BUCKET, "left").withColumn("listing_complete", F.coalesce("listing_complete", F.lit(False)))


def verify(
    objects: DataFrame,
    listing: DataFrame,
    day: date | datetime,
    complete: Complete = True,
    partitions: int = DEFAULT_PARTITIONS,
    rate: float = 1.0,
) -> Verified:
    """Fingerprints of both sides per bucket, compared partition by partition.

    ``partitions`` reports every partition with rows, ``buckets`` the status: healthy, needs_sync, or none where the
    listing is not complete and nothing differs. A ``rate`` below 1 checks the day's share of the partitions; the rows of
    others are left out before anything is summed, so counts are then those of the checked partitions. ``complete`` is one
    answer for all buckets or a row per bucket; a bucket whose listing was cut does not silence the others.
    """
    index = partition_index(F.col("key"), partitions)
    chosen = should_sample(partition_id(index, partitions), F.lit(rate), day) if rate < 1 else F.lit(True)
    local = objects.where(chosen).select(*BUCKET, "key", evidence(objects)["size"].alias("size"))
    compared = paired_fingerprints(local, listing.where(chosen), partitions, BUCKET)
    # A bucket has at most one row per partition here, so its totals are a small window and no second pass.
    bucket = Window.partitionBy(*BUCKET)
    compared = (
        compared.withColumn("object_count", F.sum("local_count").over(bucket))
        .withColumn("objects_listed", F.sum("upstream_count").over(bucket))
        .withColumn("partition_id", partition_id(F.col("partition_index"), partitions))
    )
    compared = _with_completeness(compared, complete)
    report = compared.select(
        *BUCKET,
        "partition_id",
        "partition_index",
        "local_count",
        "local_bytes",
        "upstream_count",
        "upstream_bytes",
        F.when(F.col("listing_complete"), F.col("drift_at")).alias("drift_at"),
    )
    mismatch = F.col("listing_complete") & (F.col("drift_at") != "")
    totals = compared.groupBy(*BUCKET, "object_count", "objects_listed", "listing_complete").agg(
        F.count(F.lit(1)).alias("partitions_scanned"), F.count_if(mismatch).alias("partitions_mismatched")
    )
    buckets = totals.withColumn("partitions_sampled", sampled_total(F.lit(rate), day, partitions))
    status = F.when(F.col("partitions_mismatched") > 0, "needs_sync").when(F.col("listing_complete"), "healthy")
    return Verified(report, buckets.withColumn("status", status))


def in_drifted_partitions(rows: DataFrame, report: DataFrame, partitions: int = DEFAULT_PARTITIONS) -> DataFrame:
    """The rows of a catalog or listing that lie in a partition found to differ, as input to a reconcile."""
    drifted = report.where("drift_at IN ('count', 'bytes')").select(*BUCKET, "partition_index")
    index: Column = partition_index(F.col("key"), partitions)
    return rows.withColumn("partition_index", index).join(drifted, [*BUCKET, "partition_index"], "left_semi").drop(
        "partition_index"
    )
