"""Notifications, the event inbox, and the streams over them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from stowage.functions import events as names
from stowage.operators import events as ops
from stowage.plans.change_feed import apply_events, run_change_feed
from stowage.session import scratch_path
from stowage.sources.notifications import normalize_notifications, rejected_notifications
from stowage.streaming.activity import read_activity, stream_activity
from stowage.streaming.apply import inbox_stream, latest_mutations, stream_apply
from stowage.streaming.ingest import read_inbox, stream_ingest
from workloads import views as v
from workloads.registry import query
from workloads.search_queries import ntz

AT = datetime(2024, 2, 1, tzinfo=timezone.utc)

ACTION = """CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'import' WHEN event_type = 'error' THEN 'remove' ELSE 'ignore' END"""
JOB = """CASE WHEN event_name LIKE 'ObjectCreated:%' OR event_name LIKE 's3:ObjectCreated:%' THEN 'import_objects'
    WHEN event_name LIKE 'ObjectRemoved:%' OR event_name LIKE 's3:ObjectRemoved:%' THEN 'remove_objects'
    WHEN event_name LIKE '%Tagging%' OR event_name LIKE 'ObjectAcl:%' THEN 'refresh_objects' END"""


@query(
    "event_names",
    v.with_views(v.EVENTS) + f"""SELECT i.id, {ACTION} AS action, {v.CATEGORY} AS category, {JOB} AS job_type,
    CASE WHEN event_name = 'OBJECT_FINALIZE' THEN 'import_objects' ELSE {JOB} END AS unified_job_type
    FROM inbox i JOIN events e ON e.event_id = i.event_id""",
)
def event_names(spark, d):
    name = F.col("event_name")
    return v.upstream_events(spark, d).select(
        "id", names.event_action(name).alias("action"), names.event_category(name).alias("category"),
        names.event_job_type(name).alias("job_type"), names.event_job_type(name, unified=True).alias("unified_job_type"),
    )


def _stamp(column: str) -> str:
    """RFC 3339 with the fraction's trailing zeros cut, as dedupe keys have it."""
    return f"regexp_replace(strftime({column}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z'"


HASHED_KEY = f"sha256(concat_ws('|', bucket_id, event_name, object_key, {_stamp('received_at')}))"


@query("dedupe_keys", v.with_views(v.EVENTS) + f"SELECT id, {HASHED_KEY} AS dedupe_key FROM inbox")
def dedupe_keys(spark, d):
    return v.upstream_events(spark, d).select("id", "dedupe_key")


# How each envelope's fields come back out; the events whose names mean nothing are gone.
NORMALIZED = f"""normalized AS (SELECT i.event_id AS event_no, i.event_id % 7 AS kind, i.bucket_id, i.received_at,
    CASE i.event_id % 7 WHEN 4 THEN 'b2' WHEN 5 THEN 'gcp' WHEN 6 THEN 'rustfs' ELSE 'aws' END AS upstream,
    {ACTION} AS action, i.event_name,
    CASE WHEN i.event_id % 7 = 3 THEN 'aws:eventbridge' WHEN i.event_id % 7 IN (4, 5) THEN '' ELSE 'aws:s3' END AS event_source,
    i.bucket_id AS bucket_name, CASE WHEN i.event_id % 7 IN (3, 4, 5) THEN '' ELSE 'arn:' || i.bucket_id END AS bucket_arn,
    CASE WHEN i.event_id % 7 IN (4, 5) THEN '' ELSE 'eu-west-1' END AS region, CASE WHEN i.event_id % 7 = 6 THEN 'dep-' || i.bucket_id ELSE '' END AS deployment_id, i.object_key AS key,
    CASE WHEN i.event_id % 7 = 4 THEN '' ELSE md5(i.object_key) END AS etag, CAST(floor(i.value * 100) AS BIGINT) AS size,
    CASE WHEN i.event_id % 7 = 4 THEN date_trunc('millisecond', i.received_at) ELSE i.received_at END AS event_time,
    CASE WHEN i.event_id % 7 = 4 THEN CAST(i.event_id AS VARCHAR) ELSE '' END AS event_id, '' AS version_id
  FROM inbox i JOIN events e ON e.event_id = i.event_id WHERE event_type <> 'click')"""


@query("normalize_notifications", v.with_views(v.EVENTS, NORMALIZED) + "SELECT * EXCLUDE (kind, bucket_id, received_at) FROM normalized")
def normalized(spark, d):
    raw = v.raw_notifications(spark, d).withColumnRenamed("event_id", "event_no")
    return normalize_notifications(raw, keep=("event_no",)).withColumn("event_time", ntz("event_time"))


@query(
    "rejected_notifications",
    v.with_views(v.EVENTS) + """SELECT event_id, CASE WHEN value > 20 THEN 'body is not a JSON object' ELSE 'event time is malformed' END AS error
    FROM inbox WHERE event_id % 7 = 0 AND event_name <> 'ObjectTagging:Put' OR value > 20""",
)
def rejected(spark, d):
    """Bodies cut short for large values, and times that lost their zone in the plainest envelope."""
    big = v.table(spark, d, "events").where("value > 20").select("event_id", F.lit(True).alias("big"))
    raw = v.raw_notifications(spark, d).join(big, "event_id", "left")
    body = F.col("body")
    cut = F.when(F.col("big"), F.substring(body, 1, 40)).when(
        F.pmod("event_id", F.lit(7)) == 0, F.regexp_replace(body, r'(\.\d{6})Z"', '$1"')
    )
    spoiled = raw.withColumn("body", F.coalesce(cut, body))
    return rejected_notifications(spoiled).select("event_id", "error")


def _inbox_halves(spark, d):
    """The earlier part of the month is stored; everything arrives, the later part twice."""
    rows = v.upstream_events(spark, d)
    edge = F.lit("2024-01-15T00:00:00Z").cast("timestamp")
    later = rows.where(F.col("received_at") >= edge)
    again = later.withColumns({"id": F.concat("id", F.lit("_b")), "received_at": F.col("received_at") + F.expr("INTERVAL 1 DAY")})
    return rows.where(F.col("received_at") < edge), rows.unionByName(again)


@query("append_events", v.with_views(v.EVENTS) + "SELECT id, event_name, object_key, received_at FROM inbox WHERE received_at >= TIMESTAMP '2024-01-15'")
def append_events(spark, d):
    stored, incoming = _inbox_halves(spark, d)
    return ops.append_events(stored, incoming).select("id", "event_name", "object_key", ntz("received_at"))


@query(
    "ingest_counts",
    v.with_views(v.EVENTS) + """SELECT count(*) FILTER (received_at >= TIMESTAMP '2024-01-15') AS accepted, count(*) AS duplicate,
    CAST(0 AS BIGINT) AS ignored FROM inbox""",
)
def ingest_counts(spark, d):
    return ops.ingest_counts(*_inbox_halves(spark, d))


# An earlier import of the same key makes an object known, under the id that follows from the key.
RESOLVED = f"""imports AS (SELECT bucket_id, object_key, min((received_at, id)) AS first_import FROM inbox WHERE {JOB} = 'import_objects' GROUP BY ALL),
  resolved AS (SELECT i.*, {JOB} AS job_type, b.id AS bucket, coalesce(c.id, CASE WHEN f.first_import < (i.received_at, i.id)
      THEN 'object_' || md5(i.bucket_id || chr(0) || i.object_key) END) AS found
    FROM inbox i LEFT JOIN buckets b ON b.id = i.bucket_id LEFT JOIN catalog c ON c.bucket_id = i.bucket_id AND c.key = i.object_key
    LEFT JOIN imports f ON f.bucket_id = i.bucket_id AND f.object_key = i.object_key),
  reasoned AS (SELECT *, CASE WHEN bucket IS NULL THEN 'bucket_not_found' WHEN job_type IS NULL THEN 'unsupported_event_name'
    WHEN job_type <> 'import_objects' AND found IS NULL THEN 'object_not_found' END AS skip_reason,
    CASE WHEN job_type <> 'import_objects' THEN found END AS object_id FROM resolved)"""
# The buckets of the feed that are known: all but src19, which the oracle and the query both leave out.
FEED_BUCKETS = "buckets AS (SELECT DISTINCT source AS id FROM documents WHERE source <> 'src19')"
FEED = v.with_views(v.CATALOG, FEED_BUCKETS, v.EVENTS, RESOLVED)


def _feed_buckets(spark, d):
    return v.buckets(spark, d).where("id <> 'src19'")


def _resolved(spark, d):
    return ops.resolve_events(v.upstream_events(spark, d), _feed_buckets(spark, d), v.catalog(spark, d))


@query("resolve_events", FEED + "SELECT id, bucket_id, object_key, job_type, object_id, skip_reason FROM reasoned")
def resolve_events(spark, d):
    return _resolved(spark, d).select("id", "bucket_id", "object_key", "job_type", "object_id", "skip_reason")


MUTATIONS = """mutations AS (SELECT bucket_id, object_key AS key, arg_max(job_type, (received_at, id)) AS job_type,
    max_by(coalesce(object_id, ''), (received_at, id)) AS object_id, count(*) AS event_count,
    arg_min(received_at, (received_at, id)) AS first_received_at, arg_min(id, (received_at, id)) AS first_event_id
  FROM reasoned WHERE skip_reason IS NULL GROUP BY ALL)"""
FEED_MUTATIONS = v.with_views(v.CATALOG, FEED_BUCKETS, v.EVENTS, RESOLVED, MUTATIONS)


@query("coalesce_mutations", FEED_MUTATIONS + "SELECT * FROM mutations")
def coalesce_mutations(spark, d):
    rows = ops.coalesce_mutations(_resolved(spark, d))
    return rows.withColumns({"object_id": F.coalesce("object_id", F.lit("")), "first_received_at": ntz("first_received_at")})


@query("mutation_events", FEED + "SELECT bucket_id, object_key AS key, id AS event_id, received_at FROM reasoned WHERE skip_reason IS NULL")
def mutation_events(spark, d):
    return ops.mutation_events(_resolved(spark, d)).withColumn("received_at", ntz("received_at"))


BATCHED = """batched AS (SELECT *, row_number() OVER (PARTITION BY bucket_id, job_type ORDER BY first_received_at, first_event_id) - 1 AS n
  FROM mutations)"""
FEED_BATCHES = v.with_views(v.CATALOG, FEED_BUCKETS, v.EVENTS, RESOLVED, MUTATIONS, BATCHED)


@query("batch_mutations", FEED_BATCHES + "SELECT bucket_id, job_type, key, n // 25 AS batch_no, CAST(n % 25 AS INTEGER) AS position FROM batched")
def batch_mutations(spark, d):
    rows = ops.batch_mutations(ops.coalesce_mutations(_resolved(spark, d)), 25)
    return rows.select("bucket_id", "job_type", "key", "batch_no", "position")


@query(
    "batch_payloads",
    FEED_BATCHES + """SELECT bucket_id, job_type, n // 100 AS batch_no, count(*) AS objects_count,
    string_agg(key || '=' || object_id, ' ' ORDER BY n) AS objects FROM batched GROUP BY ALL""",
)
def batch_payloads(spark, d):
    rows = ops.batch_payloads(ops.batch_mutations(ops.coalesce_mutations(_resolved(spark, d))))
    listed = F.transform("objects", lambda o: F.concat(o["key"], F.lit("="), o["id"]))
    return rows.select(
        "bucket_id", "job_type", "batch_no", F.size("objects").cast("bigint").alias("objects_count"),
        F.array_join(listed, " ").alias("objects"),
    )


@query(
    "mark_events",
    FEED + """SELECT id, CASE WHEN skip_reason IS NULL THEN 'processed' ELSE 'skipped' END AS state, skip_reason AS error_message,
    TIMESTAMP '2024-02-01' AS processed_at FROM reasoned""",
)
def mark_events(spark, d):
    marked = ops.mark_events(v.upstream_events(spark, d), ops.event_outcomes(_resolved(spark, d)), AT)
    return marked.select("id", "state", "error_message", ntz("processed_at"))


@query("pending_events", v.with_views(v.EVENTS) + "SELECT id, received_at FROM inbox ORDER BY received_at, id LIMIT 300")
def pending_events(spark, d):
    return ops.pending_events(v.upstream_events(spark, d), 300).select("id", ntz("received_at"))


def _heads(spark, d):
    return v.objects(spark, d).select(
        "bucket_id", "key",
        F.to_variant_object(F.struct(F.struct("etag", "size", "last_modified").alias("upstream"))).alias("attributes"),
    )


AFTER = """SELECT coalesce(c.id, 'object_' || md5(o.bucket_id || chr(0) || o.key)) AS id, o.bucket_id, o.key, o.etag,
    CASE WHEN w.key IS NULL THEN c.content_type END AS content_type FROM objects o
    LEFT JOIN catalog c ON c.id = o.id LEFT JOIN {m} w ON w.bucket_id = o.bucket_id AND w.key = o.key
    WHERE (c.id IS NOT NULL OR w.key IS NOT NULL) AND coalesce(w.job_type, '') <> 'remove_objects'"""


@query("apply_events", FEED_MUTATIONS + AFTER.format(m="mutations"))
def applied_events(spark, d):
    catalog, _ = apply_events(
        v.upstream_events(spark, d), _feed_buckets(spark, d), v.catalog(spark, d), _heads(spark, d), AT
    )
    return catalog.select("id", "bucket_id", "key", "etag", "content_type")


@query(
    "apply_outcomes",
    FEED_MUTATIONS + """SELECT r.id, CASE WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN m.key IS NOT NULL THEN 'failed' ELSE 'processed' END AS state,
    coalesce(skip_reason, CASE WHEN m.key IS NOT NULL THEN 'head_not_found' END) AS error_message FROM reasoned r
    LEFT JOIN (SELECT m.* FROM mutations m ANTI JOIN objects o ON o.bucket_id = m.bucket_id AND o.key = m.key WHERE job_type <> 'remove_objects') m
      ON m.bucket_id = r.bucket_id AND m.key = r.object_key""",
)
def apply_outcomes(spark, d):
    """Imports and refreshes without a document have failed."""
    _, events = apply_events(
        v.upstream_events(spark, d), _feed_buckets(spark, d), v.catalog(spark, d), _heads(spark, d), AT
    )
    return events.select("id", "state", "error_message")


# What the stream stores: each dedupe key once, under an id made from it.
INGESTED = f"""keyed AS (SELECT *, CASE WHEN event_id <> '' THEN concat_ws(':', bucket_id, event_name, key, event_id)
    ELSE sha256(concat_ws('|', bucket_id, event_name, key, {_stamp('event_time')})) END AS dedupe_key FROM normalized),
  stored AS (SELECT 'upevt_' || md5(dedupe_key) AS id, bucket_id, event_name, key AS object_key, dedupe_key, event_time, received_at FROM keyed
    QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY received_at) = 1)"""


def _ingest(spark, d):
    work = scratch_path(spark, "ingest")
    raw = v.raw_notifications(spark, d, stream=True).drop("event_id")
    stream_ingest(raw, f"{work}/inbox", f"{work}/rejected", f"{work}/checkpoint", available_now=True).awaitTermination()
    return work


@query(
    "stream_ingest",
    v.with_views(v.EVENTS, NORMALIZED, INGESTED) + "SELECT *, 'pending' AS state FROM stored",
)
def ingested(spark, d):
    inbox = read_inbox(spark, f"{_ingest(spark, d)}/inbox")
    return inbox.select("id", "bucket_id", "event_name", "object_key", "dedupe_key", ntz("event_time"), ntz("received_at"), "state")


STREAM_FEED = v.with_views(
    v.CATALOG, FEED_BUCKETS, v.EVENTS.replace("inbox AS", "all_events AS"),
    NORMALIZED.replace("FROM inbox i", "FROM all_events i"), INGESTED, "inbox AS (SELECT * FROM stored)", RESOLVED, MUTATIONS,
)


def _apply(spark, d):
    work = _ingest(spark, d)
    stream_apply(
        inbox_stream(spark, f"{work}/inbox"), lambda: _feed_buckets(spark, d), lambda: v.catalog(spark, d),
        f"{work}/applied", f"{work}/checkpoint_apply", available_now=True,
    ).awaitTermination()
    return f"{work}/applied"


@query("stream_apply_outcomes", STREAM_FEED + "SELECT id, CASE WHEN skip_reason IS NULL THEN 'processed' ELSE 'skipped' END AS state, skip_reason AS error_message FROM reasoned")
def stream_outcomes(spark, d):
    return spark.read.parquet(f"{_apply(spark, d)}/outcomes").select("id", "state", "error_message")


@query("stream_apply_mutations", STREAM_FEED + "SELECT bucket_id, key, job_type, object_id FROM mutations")
def stream_mutations(spark, d):
    return latest_mutations(spark, _apply(spark, d)).withColumn("object_id", F.coalesce("object_id", F.lit("")))


@query("change_feed", STREAM_FEED + AFTER.format(m="mutations"))
def change_feed(spark, d):
    """Notifications to catalog, both streams run to their end."""
    after = run_change_feed(
        v.raw_notifications(spark, d, stream=True).drop("event_id"), scratch_path(spark, "feed"),
        lambda: _feed_buckets(spark, d), lambda: v.catalog(spark, d), _heads(spark, d), AT,
    )
    return after.select("id", "bucket_id", "key", "etag", "content_type")


@query(
    "stream_activity",
    v.with_views(v.EVENTS) + f"""SELECT date_trunc('hour', received_at) AS bucket_start, {v.CATEGORY} AS series, count(*) AS n FROM inbox
    GROUP BY ALL""",
)
def live_activity(spark, d):
    """Every event of the data counts, however late."""
    work = scratch_path(spark, "activity")
    events = v.upstream_events(spark, d, stream=True)
    stream_activity(events, f"{work}/table", f"{work}/checkpoint", available_now=True).awaitTermination()
    return read_activity(spark, f"{work}/table").withColumn("bucket_start", ntz("bucket_start"))
