"""Job runs: lists, traces, staleness and activity."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from stowage.operators import activity, jobs as ops, ordering
from stowage.plans.job_reports import activity_report, attention_report, trace_report
from workloads import views as v
from workloads.registry import query
from workloads.search_queries import ntz

JOBS = v.with_views(v.JOBS)
TYPES = ["sync_bucket", "import_objects", "refresh_objects", "remove_objects"]
STALE = "state = 'running' AND locked_by IS NOT NULL AND updated_at < TIMESTAMP '1998-12-31 23:45:00'"


UNAIMED = "trace_id LIKE '%3'"


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


@query(
    "list_jobs",
    JOBS + """SELECT id, type, state, target_id, created_at FROM jobs WHERE type IN ('sync_bucket', 'import_objects')
    AND state = 'succeeded' AND created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1998-01-01'
    ORDER BY created_at DESC, id DESC LIMIT 900""",
)
def list_jobs(spark, d):
    rows = ordering.list_jobs(
        v.jobs(spark, d), 900, types=["sync_bucket", "import_objects"], state="succeeded",
        created_after=utc(1997, 1, 1), created_before=utc(1998, 1, 1),
    )
    return rows.select("id", "type", "state", "target_id", ntz("created_at"))


@query(
    "list_jobs_of_target",
    JOBS + """SELECT id, type, state, requested_by_id, created_at FROM jobs WHERE target_type = 'bucket' AND target_id = 'bucket_7'
    AND requested_by_type = 'job' ORDER BY created_at DESC, id DESC OFFSET 10""",
)
def list_jobs_of_target(spark, d):
    rows = ordering.list_jobs(v.jobs(spark, d), offset=10, target_type="bucket", target_id="bucket_7", requested_by_type="job")
    return rows.select("id", "type", "state", "requested_by_id", ntz("created_at"))


@query("count_jobs", JOBS + "SELECT count(*) AS job_count FROM jobs WHERE state = 'failed' AND type = 'remove_objects'")
def count_jobs(spark, d):
    return v.jobs(spark, d).where(ordering.job_filter(["remove_objects"], "failed")).agg(F.count(F.lit(1)).alias("job_count"))


DONE = "state IN ('succeeded', 'failed', 'cancelled') AND finished_at IS NOT NULL"


@query("last_finished", JOBS + f"SELECT type, target_type, target_id, max(finished_at) AS finished_at FROM jobs WHERE {DONE} GROUP BY ALL")
def last_finished(spark, d):
    return ops.last_finished(v.jobs(spark, d)).select("type", "target_type", "target_id", ntz("finished_at"))


@query(
    "last_succeeded",
    JOBS + "SELECT type, target_type, target_id, max(finished_at) AS finished_at FROM jobs WHERE state = 'succeeded' AND finished_at IS NOT NULL GROUP BY ALL",
)
def last_succeeded(spark, d):
    return ops.last_finished(v.jobs(spark, d), succeeded_only=True).select("type", "target_type", "target_id", ntz("finished_at"))


@query("last_finished_of_type", JOBS + f"SELECT type, max(finished_at) AS finished_at FROM jobs WHERE {DONE} GROUP BY ALL")
def last_finished_of_type(spark, d):
    return ops.last_finished(v.jobs(spark, d), by_target=False).select("type", ntz("finished_at"))


@query(
    "resumable_sync",
    JOBS + """, roots AS (SELECT * FROM jobs WHERE type = 'sync_bucket' AND id = trace_id),
    picked AS (SELECT * FROM roots r WHERE state IN ('failed', 'cancelled') AND NOT EXISTS (SELECT 1 FROM roots n
      WHERE n.target_type = r.target_type AND n.target_id = r.target_id AND n.created_at > r.created_at)
      QUALIFY row_number() OVER (PARTITION BY target_type, target_id ORDER BY id DESC) = 1)
    SELECT target_type, target_id, id, state, created_at FROM picked WHERE objects_listed > 0""",
)
def resumable_sync(spark, d):
    return attention_report(v.jobs(spark, d), v.JOBS_NOW)["resumable"].select(
        "target_type", "target_id", "id", "state", ntz("created_at")
    )


STATE = """CASE WHEN bool_or(state IN ('pending', 'running')) THEN 'running' WHEN bool_or(state = 'failed') THEN 'failed'
    WHEN bool_or(state = 'cancelled') THEN 'cancelled' ELSE 'succeeded' END AS state"""
KINDS = {"import": "import_objects", "refresh": "refresh_objects", "remove": "remove_objects"}
BATCHES = ", ".join(
    f"count(*) FILTER (type = '{t}') AS {k}_total, "
    + ", ".join(
        f"count(*) FILTER (type = '{t}' AND state = '{s}') AS {k}_{n}"
        for n, s in (("done", "succeeded"), ("failed", "failed"), ("active", "running"), ("pending", "pending"))
    )
    for k, t in KINDS.items()
)
APPLIED = ", ".join(
    f"CAST(coalesce(sum(quantity) FILTER (type = '{t}'), 0) AS BIGINT) AS {k}_applied" for k, t in KINDS.items()
)


@query("trace_state", JOBS + f"SELECT trace_id, {STATE} FROM jobs GROUP BY trace_id")
def trace_state(spark, d):
    return ops.trace_state(v.jobs(spark, d))


@query(
    "trace_job_counts",
    JOBS + "SELECT trace_id, type, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("pending", "running", "succeeded", "failed", "cancelled"))
    + " FROM jobs GROUP BY trace_id, type",
)
def trace_job_counts(spark, d):
    return ops.trace_job_counts(v.jobs(spark, d))


@query("trace_batches", JOBS + f"SELECT trace_id, {BATCHES} FROM jobs GROUP BY trace_id")
def trace_batches(spark, d):
    return ops.trace_batches(v.jobs(spark, d))


@query("trace_applied", JOBS + f"SELECT trace_id, {APPLIED} FROM jobs GROUP BY trace_id")
def trace_applied(spark, d):
    return ops.trace_applied(v.jobs(spark, d))


SUMMARY = JOBS + f""", grouped AS (SELECT trace_id, {STATE}, {BATCHES}, {APPLIED} FROM jobs GROUP BY trace_id),
    summary AS (SELECT g.*, r.phase, r.objects_listed, CAST(r.import_planned AS BIGINT) AS import_planned,
      CAST(r.refresh_planned AS BIGINT) AS refresh_planned, CAST(0 AS BIGINT) AS remove_planned,
      CAST(epoch(TIMESTAMP '1999-01-01') - epoch(r.updated_at) AS BIGINT) AS stale_seconds
      FROM grouped g JOIN jobs r ON r.id = g.trace_id AND r.id = r.trace_id)"""


@query("trace_summary", SUMMARY + " SELECT * FROM summary")
def trace_summary(spark, d):
    return ops.trace_summary(v.jobs(spark, d), v.JOBS_NOW)


_PHASE = "CASE " + " ".join(
    f"WHEN {k}_active > 0 OR {k}_pending > 0 THEN '{p}'"
    for k, p in (("import", "importing"), ("refresh", "refreshing"), ("remove", "removing"))
) + " " + " ".join(
    f"WHEN {k}_planned > 0 AND {k}_done < {k}_total THEN '{p}'"
    for k, p in (("import", "importing"), ("refresh", "refreshing"), ("remove", "removing"))
) + " WHEN phase = '' AND objects_listed > 0 THEN 'listing' ELSE phase END"


@query(
    "trace_report",
    SUMMARY + f""" SELECT * REPLACE ({_PHASE} AS phase), CASE WHEN remove_planned > 0 THEN 'removed' WHEN refresh_planned > 0
    THEN 'refreshed' WHEN import_planned > 0 THEN 'imported' ELSE 'completed' END AS terminal_phase FROM summary""",
)
def traces(spark, d):
    return trace_report(v.jobs(spark, d), v.JOBS_NOW)


@query(
    "planned_counts",
    JOBS + """, children AS (SELECT requested_by_id AS id, sum(n_objects) FILTER (type = 'import_objects') AS i,
      sum(n_objects) FILTER (type = 'refresh_objects') AS f, sum(n_objects) FILTER (type = 'remove_objects') AS r
      FROM jobs WHERE requested_by_type = 'job' GROUP BY 1)
    SELECT j.id, CAST(greatest(coalesce(i, 0), progress_import) AS BIGINT) AS import_planned,
      CAST(coalesce(f, 0) AS BIGINT) AS refresh_planned, CAST(coalesce(r, 0) AS BIGINT) AS remove_planned
    FROM jobs j LEFT JOIN children c ON c.id = j.id WHERE j.type = 'sync_bucket'""",
)
def planned_counts(spark, d):
    return ops.planned_counts(v.jobs(spark, d))


@query(
    "active_work",
    JOBS + f""", aimed AS (SELECT * REPLACE (CASE WHEN {UNAIMED} THEN NULL ELSE target_id END AS target_id) FROM jobs),
    roots AS (SELECT id, target_type, target_id FROM aimed WHERE id = trace_id AND type IN ('sync_bucket', 'scan_bucket'))
    SELECT j.id, j.trace_id, j.type, j.state, j.target_id FROM aimed j JOIN roots r ON r.id = j.trace_id
    WHERE r.target_type IS NOT DISTINCT FROM j.target_type AND r.target_id IS NOT DISTINCT FROM j.target_id
      AND state IN ('pending', 'running') AND NOT coalesce({STALE}, false)""",
)
def active_work(spark, d):
    """Some traces have no target, and are work of their own kind."""
    rows = v.jobs(spark, d)
    aimed = rows.withColumn("target_id", F.when(F.expr(UNAIMED), None).otherwise(F.col("target_id")))
    return ops.active_work(aimed, v.JOBS_NOW).select("id", "trace_id", "type", "state", "target_id")


@query("active_jobs", JOBS + "SELECT type, target_type, target_id, bool_or(state IN ('pending', 'running')) AS active FROM jobs GROUP BY ALL")
def active_jobs(spark, d):
    return ops.active_jobs(v.jobs(spark, d))


@query("active_types", JOBS + "SELECT type, bool_or(state IN ('pending', 'running')) AS active FROM jobs GROUP BY ALL")
def active_types(spark, d):
    return ops.active_jobs(v.jobs(spark, d), by_target=False)


@query(
    "children_status",
    JOBS + """, children AS (SELECT requested_by_id AS id, bool_or(state IN ('pending', 'running')) AS a, bool_or(state = 'failed') AS f
      FROM jobs WHERE requested_by_type = 'job' GROUP BY 1)
    SELECT j.id, NOT coalesce(a, false) AS children_complete, coalesce(f, false) AS children_failed
    FROM jobs j LEFT JOIN children c ON c.id = j.id""",
)
def children_status(spark, d):
    return ops.children_status(v.jobs(spark, d))


@query("awaiting_children", JOBS + "SELECT id, state FROM jobs WHERE state = 'running' AND await_children AND id = trace_id")
def awaiting_children(spark, d):
    return ops.awaiting_children(v.jobs(spark, d), roots_only=True).select("id", "state")


@query("stale_jobs", JOBS + f"SELECT id, type, target_id, updated_at FROM jobs WHERE {STALE}")
def stale_jobs(spark, d):
    return ops.stale_jobs(v.jobs(spark, d), v.JOBS_NOW).select("id", "type", "target_id", ntz("updated_at"))


@query(
    "trace_roots",
    """WITH RECURSIVE walk AS (SELECT conv_id, turn, conv_id AS c, turn AS t FROM conversations WHERE turn = 0
      UNION ALL SELECT k.conv_id, k.turn, w.c, w.t FROM conversations k JOIN walk w ON k.conv_id = w.conv_id AND k.turn = w.turn + 1)
    SELECT 'turn_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id,
      'turn_' || CAST(c AS VARCHAR) || '_' || CAST(t AS VARCHAR) AS trace_id FROM walk""",
)
def trace_roots(spark, d):
    return ops.trace_roots(v.turn_jobs(spark, d))


def _activity(rows: str, time: str, series: str, names: list[str], start: str, end: str, unit: str) -> str:
    values = ", ".join(f"('{n}')" for n in names)
    return f""", slots AS (SELECT unnest(generate_series(date_trunc('{unit}', TIMESTAMP '{start}'), TIMESTAMP '{end}' - INTERVAL 1 SECOND,
      INTERVAL 1 {unit})) AS bucket_start),
    counted AS (SELECT date_trunc('{unit}', {time}) AS bucket_start, {series} AS series, count(*) AS n FROM {rows}
      WHERE {time} >= TIMESTAMP '{start}' AND {time} < TIMESTAMP '{end}' GROUP BY ALL)
    SELECT CAST(s.bucket_start AS TIMESTAMP) AS bucket_start, k.series, coalesce(c.n, 0) AS n
    FROM slots s CROSS JOIN (VALUES {values}) k(series)
    LEFT JOIN counted c ON c.bucket_start = s.bucket_start AND c.series = k.series"""


@query("job_activity_days", JOBS + _activity("jobs", "created_at", "type", TYPES, "1997-03-01 05:00:00", "1998-03-01", "day"))
def job_activity_days(spark, d):
    rows = activity_report(v.jobs(spark, d), utc(1997, 3, 1, 5), utc(1998, 3, 1), TYPES)
    return rows.withColumn("bucket_start", ntz("bucket_start"))


@query("job_activity_hours", JOBS + _activity("jobs", "created_at", "type", TYPES[:2], "1997-03-01 05:30:00", "1997-03-03", "hour"))
def job_activity_hours(spark, d):
    rows = activity.job_activity(v.jobs(spark, d), utc(1997, 3, 1, 5, 30), utc(1997, 3, 3), types=TYPES[:2])
    return rows.withColumn("bucket_start", ntz("bucket_start"))


INBOX = v.with_views(v.EVENTS)
CATEGORIES = ["created", "removed", "metadata_changed", "other"]


@query("event_activity_days", INBOX + _activity("inbox", "received_at", v.CATEGORY, CATEGORIES, "2024-01-02 12:00:00", "2024-02-05", "day"))
def event_activity_days(spark, d):
    rows = activity.event_activity(v.upstream_events(spark, d), utc(2024, 1, 2, 12), utc(2024, 2, 5))
    return rows.withColumn("bucket_start", ntz("bucket_start"))


@query(
    "event_activity_hours",
    v.with_views(v.EVENTS, "one AS (SELECT * FROM inbox WHERE bucket_id = 'src3')")
    + _activity("one", "received_at", v.CATEGORY, CATEGORIES[:2], "2024-01-10", "2024-01-12", "hour"),
)
def event_activity_hours(spark, d):
    rows = activity.event_activity(
        v.upstream_events(spark, d), utc(2024, 1, 10), utc(2024, 1, 12), CATEGORIES[:2], bucket_id="src3"
    )
    return rows.withColumn("bucket_start", ntz("bucket_start"))


@query(
    "list_events",
    INBOX + f"""SELECT id, event_name, object_key, received_at FROM inbox WHERE bucket_id = 'src2' AND {v.CATEGORY} = 'created'
    AND received_at >= TIMESTAMP '2024-01-05' AND received_at < TIMESTAMP '2024-01-25' ORDER BY received_at DESC, id DESC""",
)
def list_events(spark, d):
    rows = ordering.list_events(
        v.upstream_events(spark, d), bucket_id="src2", state="pending", category="created",
        received_after=utc(2024, 1, 5), received_before=utc(2024, 1, 25),
    )
    return rows.select("id", "event_name", "object_key", ntz("received_at"))


@query("count_events", INBOX + f"SELECT count(*) AS event_count FROM inbox WHERE {v.CATEGORY} = 'metadata_changed'")
def count_events(spark, d):
    rows = v.upstream_events(spark, d).where(ordering.event_filter(category="metadata_changed"))
    return rows.agg(F.count(F.lit(1)).alias("event_count"))
