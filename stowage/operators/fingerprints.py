"""Hash-partitioned fingerprints and the daily sample of partitions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.hashing import DEFAULT_PARTITIONS, fnv1a32, partition_id, partition_index

RATE_STEPS = 10_000


def daily_epoch(at: date | datetime) -> date:
    """The UTC day of a moment."""
    if isinstance(at, datetime):
        return (at.astimezone(timezone.utc) if at.tzinfo else at).date()
    return at


def should_sample(partition: Column, rate: Column, day: date | datetime) -> Column:
    """Steady choice for a day that rotates from day to day; a rate of 1 takes all and 0 none."""
    drawn = F.pmod(fnv1a32(F.concat(partition, F.lit(daily_epoch(day).isoformat()))), F.lit(RATE_STEPS))
    return F.when(rate >= 1, True).when(rate <= 0, False).otherwise(drawn < F.floor(rate * RATE_STEPS))


def sampled_total(rate: Column, day: date | datetime, partitions: int = DEFAULT_PARTITIONS) -> Column:
    """How many partitions are checked that day at a rate, empty ones included."""
    every = F.sequence(F.lit(0), F.lit(partitions - 1))
    return F.size(F.filter(every, lambda i: should_sample(partition_id(i, partitions), rate, day))).cast("bigint")


def sample_partitions(
    scopes: DataFrame, day: date | datetime, rate: float, partitions: int = DEFAULT_PARTITIONS
) -> DataFrame:
    """The partitions to check at the rate asked for, one row each, for every scope row."""
    index = F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("partition_index")
    rows = scopes.select("*", index).withColumn("partition_id", partition_id(F.col("partition_index"), partitions))
    return rows.where(should_sample(F.col("partition_id"), F.lit(rate), day))


def fingerprints(
    rows: DataFrame, partitions: int = DEFAULT_PARTITIONS, by: Sequence[str] = (), size: str = "size"
) -> DataFrame:
    """Objects and bytes per hash partition. Summed before the shuffle, which moves at most one row per partition."""
    index = partition_index(F.col("key"), partitions)
    return (
        rows.select(*by, index.alias("partition_index"), F.coalesce(size, F.lit(0)).alias("_size"))
        .groupBy(*by, "partition_index")
        .agg(F.count(F.lit(1)).alias("object_count"), F.sum("_size").alias("bytes"))
    )


def drift() -> Column:
    """Where two fingerprints part: first the count is compared, then the bytes; '' where they agree."""
    return (
        F.when(F.col("local_count") != F.col("upstream_count"), "count")
        .when(F.col("local_bytes") != F.col("upstream_bytes"), "bytes")
        .otherwise("")
    )


def paired_fingerprints(
    local: DataFrame, upstream: DataFrame, partitions: int = DEFAULT_PARTITIONS, by: Sequence[str] = ()
) -> DataFrame:
    """Fingerprints of both sides and their drift in one aggregation over the rows of both, without a join."""
    sides = {"local": local, "upstream": upstream}
    tagged = [
        side.select(*by, "key", F.coalesce("size", F.lit(0)).alias("size"), F.lit(name).alias("_side"))
        for name, side in sides.items()
    ]
    index = partition_index(F.col("key"), partitions).alias("partition_index")
    sums = []
    for name in sides:
        mine = F.col("_side") == name
        sums.append(F.count_if(mine).alias(f"{name}_count"))
        sums.append(F.sum(F.when(mine, F.col("size")).otherwise(0)).alias(f"{name}_bytes"))
    rows = tagged[0].unionByName(tagged[1]).select(*by, index, "size", "_side")
    return rows.groupBy(*by, "partition_index").agg(*sums).withColumn("drift_at", drift())


def compare_fingerprints(local: DataFrame, upstream: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both sides per partition, and where they drift apart: first the count is compared, then the bytes."""
    keys = [*by, "partition_index"]
    sides = [
        side.select(*keys, F.col("object_count").alias(f"{name}_count"), F.col("bytes").alias(f"{name}_bytes"))
        for name, side in (("local", local), ("upstream", upstream))
    ]
    filled = {f"{n}_{m}": F.coalesce(f"{n}_{m}", F.lit(0)) for n in ("local", "upstream") for m in ("count", "bytes")}
    joined = sides[0].join(sides[1], keys, "full").withColumns(filled)
    return joined.where("local_count > 0 OR upstream_count > 0").withColumn("drift_at", drift())
