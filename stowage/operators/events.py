"""The change-event inbox: storing once, resolving, coalescing and marking."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.events import IMPORT_JOB, REFRESH_JOB, REMOVE_JOB, event_job_type
from stowage.functions.hashing import dedupe_key
from stowage.operators.objects import delete_objects, new_object_id, upsert_objects
from stowage.operators.ordering import page
from stowage.operators.predicates import literal
from stowage.operators.skew import number_within
from stowage.schema import NORMALIZED_EVENT, STORED_EVENT

BATCH_SIZE = 100
MUTATION = ["bucket_id", "key"]


def to_stored(events: DataFrame, transport: str = "stream") -> DataFrame:
    """Normalized events (with bucket_id and received_at) as pending inbox rows.

    The id follows from the dedupe key, so a retried task writes the same row.
    """
    key = dedupe_key(*[F.col(c) for c in ("bucket_id", "event_name", "key", "event_id", "event_time")])
    envelope = F.to_json(F.struct(*NORMALIZED_EVENT.fieldNames()))
    rows = events.withColumn("dedupe_key", key)
    columns = {
        "id": F.concat(F.lit("upevt_"), F.md5("dedupe_key")),
        "object_key": F.col("key"),
        "envelope": envelope,
        "transport": F.lit(transport),
        "state": F.lit("pending"),
        "error_message": F.lit(None).cast("string"),
        "processed_at": F.lit(None).cast("timestamp"),
    }
    return rows.select(*[columns.get(n, F.col(n)).alias(n) for n in STORED_EVENT.fieldNames()])


def first_per_key(incoming: DataFrame) -> DataFrame:
    """One row per dedupe key, the one received first, and how many there were."""
    rest = [c for c in incoming.columns if c != "dedupe_key"]
    row = F.min_by(F.struct(*rest), F.struct("received_at", "id")).alias("_row")
    grouped = incoming.groupBy("dedupe_key").agg(row, F.count(F.lit(1)).alias("copies"))
    return grouped.select("dedupe_key", "_row.*", "copies")


def _stored_among(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """The keys that are stored already. The store is read for this one column and matched against the new keys."""
    return stored.select("dedupe_key").join(keys.select("dedupe_key"), "dedupe_key", "left_semi").distinct()


def unseen(stored: DataFrame, unique: DataFrame) -> DataFrame:
    """The rows of ``unique``, one per dedupe key, whose key is not stored."""
    return unique.join(_stored_among(unique, stored), "dedupe_key", "left_anti")


def append_events(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming events to add: each dedupe key once, and only if it is not stored yet."""
    return unseen(stored, first_per_key(incoming)).select(*incoming.columns)


def ingest_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """accepted, duplicate and ignored; ``incoming`` may bring an ``action`` column."""
    ignored = F.col("action") == "ignore" if "action" in incoming.columns else F.lit(False)
    per_key = incoming.groupBy("dedupe_key").agg(
        F.count_if(~ignored).alias("copies"), F.count_if(ignored).alias("ignored")
    )
    hits = _stored_among(per_key, stored).withColumn("_hit", F.lit(True))
    flagged = per_key.join(hits, "dedupe_key", "left")
    accepted = F.col("_hit").isNull() & (F.col("copies") > 0)
    return flagged.agg(
        F.count_if(accepted).alias("accepted"),
        F.coalesce(F.sum(F.col("copies") - accepted.cast("int")), F.lit(0)).alias("duplicate"),
        F.coalesce(F.sum("ignored"), F.lit(0)).alias("ignored"),
    )


def pending_events(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending events, oldest first: all of them, or as many as are asked for."""
    return page(events.where("state = 'pending'").orderBy("received_at", "id"), limit)


def resolve_events(events: DataFrame, buckets: DataFrame, objects: DataFrame, unified: bool = False) -> DataFrame:
    """Events with ``job_type``, ``object_id`` and ``skip_reason``.

    Removals and refreshes need an object; imports do not. An object is known if the catalog has it or an earlier import
    among the events makes it, in which case its id is the one that import will give it. The lookups are plain left
    joins: Spark broadcasts a side only below its size threshold and splits a hot key's events otherwise.
    """
    known = buckets.select(F.col("id").alias("bucket_id"), F.lit(True).alias("_bucket"))
    found = objects.select("bucket_id", F.col("key").alias("object_key"), F.col("id").alias("_object"))
    job = event_job_type(F.col("event_name"), unified)
    rows = events.withColumn("job_type", job).join(known, "bucket_id", "left")
    order = F.struct("received_at", "id")
    imports = events.where(job == IMPORT_JOB).groupBy("bucket_id", "object_key").agg(F.min(order).alias("_imported"))
    rows = rows.join(found, ["bucket_id", "object_key"], "left").join(imports, ["bucket_id", "object_key"], "left")
    made = F.when(F.col("_imported") < order, new_object_id(F.col("bucket_id"), F.col("object_key")))
    rows = rows.withColumn("_object", F.coalesce("_object", made))
    needs_object = F.col("job_type").isin(REMOVE_JOB, REFRESH_JOB)
    reason = (
        F.when(F.col("_bucket").isNull(), "bucket_not_found")
        .when(F.col("job_type").isNull(), "unsupported_event_name")
        .when(needs_object & F.col("_object").isNull(), "object_not_found")
    )
    return rows.select(
        *events.columns,
        "job_type",
        F.when(needs_object, F.col("_object")).alias("object_id"),
        reason.alias("skip_reason"),
    )


def coalesce_mutations(resolved: DataFrame, event_ids: bool = False) -> DataFrame:
    """One mutation per (bucket, key): the latest intent by (received_at, id), and how many events it stands for.

    The events behind it are in :func:`mutation_events`, one row each. ``event_ids`` adds them as an ordered array and is
    for micro-batches only, whose size bounds the array.
    """
    usable = resolved.where("skip_reason IS NULL").withColumnRenamed("object_key", "key")
    order = F.struct("received_at", "id")
    aggregates = [
        F.max_by(F.struct("job_type", "object_id"), order).alias("_last"),
        F.min(order).alias("_first"),
        F.count(F.lit(1)).alias("event_count"),
    ]
    if event_ids:
        aggregates.append(F.array_sort(F.collect_list(order)).alias("_events"))
    grouped = usable.groupBy(*MUTATION).agg(*aggregates)
    ids = [F.transform("_events", lambda e: e["id"]).alias("event_ids")] if event_ids else []
    return grouped.select(
        *MUTATION,
        "_last.job_type",
        "_last.object_id",
        "event_count",
        F.col("_first.received_at").alias("first_received_at"),
        F.col("_first.id").alias("first_event_id"),
        *ids,
    )


def mutation_events(resolved: DataFrame) -> DataFrame:
    """(bucket_id, key, event_id, received_at) for every event that went into a mutation."""
    return resolved.where("skip_reason IS NULL").select(
        "bucket_id", F.col("object_key").alias("key"), F.col("id").alias("event_id"), "received_at"
    )


def batch_mutations(mutations: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Mutations with ``batch_no`` and ``position``: batches of ``size`` per (bucket, job type), by first appearance.

    A busy bucket is numbered range by range, so no task sorts the whole of it.
    """
    if size <= 0:
        raise ValueError("the batch size must be greater than zero")
    numbered = number_within(mutations, ["bucket_id", "job_type"], ["first_received_at", "first_event_id"], "_row")
    before = F.col("_row") - 1
    return numbered.withColumns(
        {"batch_no": F.floor(before / size).cast("bigint"), "position": F.pmod(before, F.lit(size)).cast("int")}
    ).drop("_row")


def batch_payloads(batched: DataFrame) -> DataFrame:
    """One row per batch with its objects in order; the batch size bounds the array."""
    entry = F.struct("position", F.coalesce("object_id", F.lit("")).alias("id"), "key")
    return batched.groupBy("bucket_id", "job_type", "batch_no").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["id"].alias("id"), e["key"].alias("key"))
        ).alias("objects")
    )


HEAD_NOT_FOUND = "head_not_found"


def without_heads(mutations: DataFrame, heads: DataFrame) -> DataFrame:
    """(bucket_id, key) of imports and refreshes whose document is not there."""
    return mutations.where(F.col("job_type") != REMOVE_JOB).select(*MUTATION).join(heads.select(*MUTATION), MUTATION, "left_anti")


def event_outcomes(resolved: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(id, state, error_message) as the processing of each event ended.

    Events behind a mutation of ``failed``, as :func:`without_heads` finds them, have failed and can be tried again.
    """
    skipped = F.col("skip_reason").isNotNull()
    rows, lost = resolved, F.lit(False)
    if failed is not None:
        keys = failed.select("bucket_id", F.col("key").alias("object_key"), F.lit(True).alias("_lost")).distinct()
        rows, lost = resolved.join(keys, ["bucket_id", "object_key"], "left"), F.coalesce("_lost", F.lit(False))
    return rows.select(
        "id",
        F.when(skipped, "skipped").when(lost, "failed").otherwise("processed").alias("state"),
        F.when(skipped, F.col("skip_reason")).when(lost, HEAD_NOT_FOUND).alias("error_message"),
    )


def mark_events(events: DataFrame, outcomes: DataFrame, at: datetime) -> DataFrame:
    """Events with the outcomes applied; the time of processing is set by the final states only."""
    new = outcomes.select(
        "id", F.col("state").alias("_state"), F.when(F.col("error_message") != "", F.col("error_message")).alias("_error")
    )
    marked = F.col("_state").isNotNull()
    final = F.col("_state").isin("processed", "skipped", "failed")

    def updated(name: str) -> Column:
        return {
            "state": F.coalesce("_state", "state"),
            "error_message": F.when(marked, F.col("_error")).otherwise(F.col("error_message")),
            "processed_at": F.when(final, literal(at).column).otherwise(F.col("processed_at")),
        }.get(name, F.col(name)).alias(name)

    return events.join(new, "id", "left").select(*[updated(c) for c in events.columns])


def apply_mutations(
    objects: DataFrame, mutations: DataFrame, heads: DataFrame, seen_at: datetime, run_id: str = ""
) -> DataFrame:
    """Objects after the mutations. Imports and refreshes take their documents from ``heads`` (bucket_id, key, attributes).

    One without a head changes nothing; :func:`without_heads` names it.
    """
    removals = mutations.where(F.col("job_type") == REMOVE_JOB).select(F.col("object_id").alias("id"))
    written = mutations.where(F.col("job_type") != REMOVE_JOB).select(*MUTATION, F.lit(0).alias("ordinal"))
    batch = written.join(heads.select(*MUTATION, "attributes"), MUTATION).withColumn(
        "attribute_provenance", F.create_map(F.lit("upstream"), F.lit(run_id))
    )
    return upsert_objects(delete_objects(objects, removals), batch, seen_at)


def known_objects(objects: DataFrame, mutations: DataFrame) -> DataFrame:
    """(id, bucket_id, key) as the catalog stands once ``mutations``, the last of each key, are applied to it."""
    old = objects.select(*MUTATION, F.col("id").alias("_id"))
    new = mutations.select(*MUTATION, F.col("job_type").alias("_job"), F.col("object_id").alias("_object"))
    made = F.coalesce("_id", "_object", new_object_id(F.col("bucket_id"), F.col("key")))
    after = old.join(new, MUTATION, "full").where(F.col("_job").isNull() | (F.col("_job") != REMOVE_JOB))
    return after.select(F.when(F.col("_job").isNull(), F.col("_id")).otherwise(made).alias("id"), *MUTATION)
