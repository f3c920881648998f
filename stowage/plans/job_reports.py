"""Reports over all job runs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from stowage.operators import jobs as ops
from stowage.operators.activity import job_activity


def trace_report(jobs: DataFrame, now: datetime) -> DataFrame:
    """Summary and phase of every trace."""
    return ops.trace_phase(ops.trace_summary(jobs, now))


def activity_report(jobs: DataFrame, start: datetime, end: datetime, types: Sequence[str] = ()) -> DataFrame:
    """Jobs per time bucket and type, gaps filled."""
    return job_activity(jobs, start, end, types, types=types)


def attention_report(jobs: DataFrame, now: datetime, stale_after: timedelta | None = None) -> dict[str, DataFrame]:
    """Work that is stale, waiting for children, or fit to be resumed."""
    return {
        "stale": ops.stale_jobs(jobs, now, stale_after),
        "awaiting_children": ops.awaiting_children(jobs),
        "resumable": ops.resumable_sync(jobs),
    }
