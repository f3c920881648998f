"""Sorting, paging and lists over objects, jobs and events."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.events import event_category
from stowage.operators.predicates import ObjectFields, Operand, literal

def sort_keys(keys: Iterable[Operand | Column]) -> list[Column]:
    """Operands sort ascending with NULLs last; columns are taken as they are."""
    return [k.asc() if isinstance(k, Operand) else k for k in keys]


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of a list: without a limit all rows, a given one is kept to; a negative offset is none."""
    rows = df.offset(offset) if offset > 0 else df
    return rows if limit is None else rows.limit(limit)


def after_key(bucket_id: str, key: str) -> Column:
    """Where a list by bucket and key goes on. A page found so reads nothing before it, unlike a deep offset."""
    return (F.col("bucket_id") > bucket_id) | ((F.col("bucket_id") == bucket_id) & (F.col("key") > key))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def object_filter(
    objects: DataFrame, bucket_id: str = "", prefix: str = "", content_type: str = "", key_contains: str = ""
) -> Column:
    from stowage.operators import predicates as p

    conditions = [p.scope(bucket_id or (), prefix or ())]
    if content_type:
        conditions.append(ObjectFields(objects).attr("upstream.header.content_type").column == content_type)
    if key_contains:
        conditions.append(p.key_contains(key_contains))
    return _all(conditions)


def list_objects(
    objects: DataFrame, limit: int | None = None, offset: int = 0, after: tuple[str, str] | None = None, **filters: str
) -> DataFrame:
    """Filtered objects by bucket and key, those after a (bucket, key) if one is given."""
    rows = objects.where(object_filter(objects, **filters))
    if after is not None:
        rows = rows.where(after_key(*after))
    return page(rows.orderBy("bucket_id", "key"), limit, offset)


def job_filter(
    types: Iterable[str] = (),
    state: str = "",
    trace_id: str = "",
    requested_by_type: str = "",
    requested_by_id: str = "",
    target_type: str = "",
    target_id: str = "",
    created_after: datetime | None = None,
    created_before: datetime | None = None,
) -> Column:
    """Every filter is optional; the time range is half open."""
    equal = {
        "state": state,
        "trace_id": trace_id,
        "requested_by_type": requested_by_type,
        "requested_by_id": requested_by_id,
        "target_type": target_type,
        "target_id": target_id,
    }
    conditions = [F.col(name) == value for name, value in equal.items() if value]
    types = [t for t in types if t]
    if types:
        conditions.append(F.col("type").isin(types))
    return _all(conditions + time_range("created_at", created_after, created_before))


def time_range(column: str, after: datetime | None, before: datetime | None) -> list[Column]:
    conditions = []
    if after is not None:
        conditions.append(F.col(column) >= literal(after).column)
    if before is not None:
        conditions.append(F.col(column) < literal(before).column)
    return conditions


def list_jobs(jobs: DataFrame, limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    rows = jobs.where(job_filter(**filters)).orderBy(F.desc("created_at"), F.desc("id"))
    return page(rows, limit, offset)


def event_filter(
    bucket_id: str = "",
    state: str = "",
    category: str = "",
    received_after: datetime | None = None,
    received_before: datetime | None = None,
) -> Column:
    conditions = [F.col(name) == value for name, value in (("bucket_id", bucket_id), ("state", state)) if value]
    if category:
        conditions.append(event_category(F.col("event_name")) == category)
    return _all(conditions + time_range("received_at", received_after, received_before))


def list_events(events: DataFrame, limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    rows = events.where(event_filter(**filters)).orderBy(F.desc("received_at"), F.desc("id"))
    return page(rows, limit, offset)
