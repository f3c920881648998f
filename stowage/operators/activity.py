"""Counts over time, by hour or by day, with the gaps filled."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.events import CATEGORIES, event_category
from stowage.operators.ordering import event_filter, job_filter
from stowage.operators.predicates import literal


def bucket_unit(start: datetime, end: datetime) -> str:
    """Hours up to two days, days beyond."""
    return "hour" if end - start <= timedelta(hours=48) else "day"


def _checked(start: datetime, end: datetime) -> str:
    if end <= start:
        raise ValueError("the end of the range must be after its start")
    return bucket_unit(start, end)


def activity(rows: DataFrame, time: str, series: Column, unit: str) -> DataFrame:
    """(bucket_start, series, n), summed before the shuffle."""
    return rows.groupBy(F.date_trunc(unit, time).alias("bucket_start"), series.alias("series")).agg(
        F.count(F.lit(1)).alias("n")
    )


def gap_fill(counts: DataFrame, start: datetime, end: datetime, series: Sequence[str], unit: str = "") -> DataFrame:
    """Every bucket from the start until before the end, for every series, with 0 where nothing happened."""
    unit = unit or _checked(start, end)
    step = F.expr("INTERVAL 1 HOUR" if unit == "hour" else "INTERVAL 1 DAY")
    first, limit = F.date_trunc(unit, literal(start).column), literal(end).column
    names = F.array(*[F.lit(s) for s in series]).cast("array<string>")
    slots = counts.sparkSession.range(0, 1, 1, 1).select(
        F.explode(F.sequence(first, limit, step)).alias("bucket_start"), names.alias("_all")
    )
    slots = slots.where(F.col("bucket_start") < limit).select("bucket_start", F.explode("_all").alias("series"))
    return slots.join(counts, ["bucket_start", "series"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def job_activity(jobs: DataFrame, start: datetime, end: datetime, series: Sequence[str] = (), **filters) -> DataFrame:
    """Jobs by creation time and type; without a series the types filtered for are shown."""
    unit = _checked(start, end)
    rows = jobs.where(job_filter(created_after=start, created_before=end, **filters))
    shown = list(series) or [t for t in filters.get("types", ()) if t]
    return gap_fill(activity(rows, "created_at", F.col("type"), unit), start, end, shown, unit)


def event_activity(
    events: DataFrame, start: datetime, end: datetime, series: Sequence[str] = CATEGORIES, **filters
) -> DataFrame:
    """Events by arrival time and category."""
    unit = _checked(start, end)
    rows = events.where(event_filter(received_after=start, received_before=end, **filters))
    counts = activity(rows, "received_at", event_category(F.col("event_name")), unit)
    return gap_fill(counts, start, end, list(series) or list(CATEGORIES), unit)
