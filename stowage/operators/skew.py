"""Numbering that stays spread out when one group, or one moment of it, holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stowage.session import cut_lineage


def number_within(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``row_number`` per group without sorting a whole group in one task.

    Rows are dealt into ranges of about equal size over the group and the whole order, so a moment that very many rows
    share is split by what follows in the order. They are numbered inside each (group, range), and the counts of the
    ranges, one row per group and range, give the number that each starts from. The ranges are written once, because
    both halves must see the same ones.
    """
    group, order = list(group), list(order)
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(dealt)
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    numbered = ranged.withColumn("_n", F.row_number().over(inside))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*group, "_range")
        .agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
        .drop("_count")
    )
    joined = numbered.join(starts, [*group, "_range"])
    return joined.withColumn(name, F.col("_before") + F.col("_n")).drop("_range", "_n", "_before")
