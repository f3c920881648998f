"""Job runs as data: targets, traces, staleness and progress, always for all of them at once."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.documents import attr_text, as_map, attr_value
from stowage.functions.events import IMPORT_JOB, REFRESH_JOB, REMOVE_JOB
from stowage.operators.predicates import literal
from stowage.session import cut_lineage

SYNC, SCAN = "sync_bucket", "scan_bucket"
ACTIVE = ("pending", "running")
FINISHED = ("succeeded", "failed", "cancelled")
STALE_AFTER = timedelta(minutes=15)
TARGET = ["target_type", "target_id"]
BATCHES = {"import": IMPORT_JOB, "refresh": REFRESH_JOB, "remove": REMOVE_JOB}
RESULT_COUNTERS = {"import": "objects_imported", "refresh": "objects_refreshed", "remove": "objects_deleted"}


def payload_text(payload: Column, key: str) -> Column:
    return F.coalesce(attr_text(payload, key), F.lit(""))


def payload_number(payload: Column, key: str) -> Column:
    """A number from a payload; anything else reads as 0."""
    value = attr_value(payload, key)
    number = F.when(F.schema_of_variant(value) != "STRING", F.try_variant_get(value, "$", "double"))
    return F.coalesce(number.cast("bigint"), F.lit(0))


def is_root() -> Column:
    return F.col("id") == F.col("trace_id")


def is_active() -> Column:
    return F.col("state").isin(*ACTIVE)


def is_stale(now: datetime, stale_after: timedelta | None = None) -> Column:
    """Running, locked, and not updated within the timeout."""
    limit = stale_after if stale_after is not None and stale_after > timedelta(0) else STALE_AFTER
    return (
        (F.col("state") == "running") & F.col("locked_by").isNotNull() & (F.col("updated_at") < literal(now - limit).column)
    )


def last_finished(jobs: DataFrame, succeeded_only: bool = False, by_target: bool = True) -> DataFrame:
    """Latest end per type, and per target unless switched off."""
    states = ("succeeded",) if succeeded_only else FINISHED
    done = jobs.where(F.col("state").isin(*states) & F.col("finished_at").isNotNull())
    keys = ["type", *TARGET] if by_target else ["type"]
    return done.groupBy(*keys).agg(F.max("finished_at").alias("finished_at"))


def _has_progress(progress: Column) -> Column:
    """Listing finished, or it got somewhere: objects counted, or a place to go on from."""
    checkpoint = attr_value(progress, "listing_checkpoint")
    started = (
        (payload_number(progress, "objects_listed") > 0)
        | (payload_number(checkpoint, "objects_listed") > 0)
        | (payload_text(checkpoint, "continuation_token") != "")
        | (payload_text(checkpoint, "marker") != "")
    )
    return (payload_text(progress, "listing_complete") == "true") | started


def resumable_sync(jobs: DataFrame, scope_prefix: str = "") -> DataFrame:
    """Per target, the newest root sync if it failed or was cancelled after making listing progress.

    "Newest" is one maximum per target, so a target with very many syncs is reduced before the shuffle.
    """
    roots = jobs.where((F.col("type") == SYNC) & is_root())
    candidate = F.col("state").isin("failed", "cancelled")
    order = F.struct("created_at", candidate.alias("candidate"), "id")
    row = F.struct("id", "state", "created_at", "input", "progress")
    newest = roots.groupBy(*TARGET).agg(F.max_by(row, order).alias("run")).select(*TARGET, "run.*")
    scope = F.coalesce(attr_text(F.col("input"), "scope_prefix"), attr_text(F.col("input"), "prefix"), F.lit(""))
    # A key that is there counts even if its value is null.
    whole = ~F.array_contains(F.map_keys(as_map(F.col("input"))), "partition")
    matches = F.coalesce(whole, F.lit(True)) & (scope == scope_prefix)
    return newest.where(candidate & matches & _has_progress(F.col("progress"))).select(*TARGET, "id", "state", "created_at")


def trace_state(jobs: DataFrame) -> DataFrame:
    """running, else failed, else cancelled, else succeeded, per trace."""
    return jobs.groupBy("trace_id").agg(_trace_state().alias("state"))


def _trace_state() -> Column:
    return (
        F.when(F.bool_or(is_active()), "running")
        .when(F.bool_or(F.col("state") == "failed"), "failed")
        .when(F.bool_or(F.col("state") == "cancelled"), "cancelled")
        .otherwise("succeeded")
    )


def trace_job_counts(jobs: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("state") == s).alias(s) for s in (*ACTIVE, *FINISHED)]
    return jobs.groupBy("trace_id", "type").agg(F.count(F.lit(1)).alias("total"), *counts)


def _batch_columns() -> list[Column]:
    """Cancelled batches count in the total only."""
    states = {"done": "succeeded", "failed": "failed", "active": "running", "pending": "pending"}
    columns = []
    for kind, job_type in BATCHES.items():
        of_kind = F.col("type") == job_type
        columns.append(F.count_if(of_kind).alias(f"{kind}_total"))
        columns += [F.count_if(of_kind & (F.col("state") == s)).alias(f"{kind}_{n}") for n, s in states.items()]
    return columns


def _applied_columns() -> list[Column]:
    columns = []
    for kind, job_type in BATCHES.items():
        text = attr_text(F.col("result"), RESULT_COUNTERS[kind])
        number = F.coalesce(F.when(text != "", text).cast("bigint"), F.lit(0))
        columns.append(F.sum(F.when(F.col("type") == job_type, number).otherwise(0)).alias(f"{kind}_applied"))
    return columns


def trace_batches(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("trace_id").agg(*_batch_columns())


def trace_applied(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("trace_id").agg(*_applied_columns())


def _root_counts() -> list[Column]:
    """Listed and planned objects of a root: from its progress, or its result where that says 0."""

    def first(progress_key: str, result_key: str) -> Column:
        count = payload_number(F.col("progress"), progress_key)
        return F.when(count != 0, count).otherwise(payload_number(F.col("result"), result_key))

    planned = [first(f"{k}_objects_count", f"{k}_objects_count").alias(f"{k}_planned") for k in BATCHES]
    return [
        payload_text(F.col("progress"), "phase").alias("phase"),
        first("objects_listed", "objects_seen").alias("objects_listed"),
        *planned,
    ]


def trace_summary(jobs: DataFrame, now: datetime) -> DataFrame:
    """One row per trace that has a root: state, batches, applied, listed and planned counts, seconds since progress.

    All counts are numbers, so they are hash-aggregated before the shuffle; the roots join on the same key.
    """
    summary = jobs.groupBy("trace_id").agg(_trace_state().alias("state"), *_batch_columns(), *_applied_columns())
    stale = F.unix_seconds(literal(now).column) - F.unix_seconds("updated_at")
    roots = jobs.where(is_root()).select("trace_id", *_root_counts(), stale.alias("stale_seconds"))
    return summary.join(roots, "trace_id")


def trace_phase(summary: DataFrame) -> DataFrame:
    """Summaries with the phase in progress, and the phase to report once finished; the first rule that holds wins."""
    doing = {"import": "importing", "refresh": "refreshing", "remove": "removing"}
    phase = F.when(F.lit(False), "")
    for kind, name in doing.items():
        phase = phase.when((F.col(f"{kind}_active") > 0) | (F.col(f"{kind}_pending") > 0), name)
    for kind, name in doing.items():
        unfinished = F.col(f"{kind}_done") < F.col(f"{kind}_total")
        phase = phase.when((F.col(f"{kind}_planned") > 0) & unfinished, name)
    phase = phase.when((F.col("phase") == "") & (F.col("objects_listed") > 0), "listing").otherwise(F.col("phase"))
    terminal = (
        F.when(F.col("remove_planned") > 0, "removed")
        .when(F.col("refresh_planned") > 0, "refreshed")
        .when(F.col("import_planned") > 0, "imported")
        .otherwise("completed")
    )
    return summary.withColumns({"phase": phase, "terminal_phase": terminal})


def planned_counts(jobs: DataFrame) -> DataFrame:
    """Per parent job: objects in its children's inputs, or what its own progress says where that is more."""
    objects = F.coalesce(F.size(F.try_variant_get(F.col("input"), "$.objects", "array<variant>")), F.lit(0))
    children = jobs.where(F.col("requested_by_type") == "job").groupBy(F.col("requested_by_id").alias("id")).agg(
        *[
            F.sum(F.when(F.col("type") == job_type, objects).otherwise(0)).alias(f"_{kind}")
            for kind, job_type in BATCHES.items()
        ]
    )
    progress = F.col("progress")
    columns = []
    for kind in BATCHES:
        stated = payload_number(progress, f"{kind}_objects_count")
        nested = payload_number(attr_value(progress, "objects_planned"), kind)
        columns.append(F.greatest(F.coalesce(f"_{kind}", F.lit(0)), stated, nested).alias(f"{kind}_planned"))
    parents = jobs.where(F.col("type") == SYNC).select("id", "progress")
    return parents.join(children, "id", "left").select("id", *columns)


def active_work(jobs: DataFrame, now: datetime, stale_after: timedelta | None = None) -> DataFrame:
    """Pending or running work that is not stale and belongs to a sync or scan of the same target."""
    roots = jobs.where(is_root() & F.col("type").isin(SYNC, SCAN)).select(
        F.col("id").alias("_root"), *[F.col(c).alias(f"_{c}") for c in TARGET]
    )
    live = jobs.where(is_active() & ~F.coalesce(is_stale(now, stale_after), F.lit(False)))
    same = F.col("trace_id") == F.col("_root")
    for column in TARGET:
        same = same & F.col(column).eqNullSafe(F.col(f"_{column}"))
    return live.join(roots, same, "left_semi")


def active_jobs(jobs: DataFrame, by_target: bool = True) -> DataFrame:
    """Whether each type, per target, has work pending or running."""
    keys = ["type", *TARGET] if by_target else ["type"]
    return jobs.groupBy(*keys).agg(F.bool_or(is_active()).alias("active"))


def children_status(jobs: DataFrame) -> DataFrame:
    """Per job: whether its direct children are all finished, and whether any failed."""
    children = jobs.where(F.col("requested_by_type") == "job").groupBy(F.col("requested_by_id").alias("id")).agg(
        F.bool_or(is_active()).alias("_active"), F.bool_or(F.col("state") == "failed").alias("_failed")
    )
    return jobs.select("id").join(children, "id", "left").select(
        "id",
        (~F.coalesce("_active", F.lit(False))).alias("children_complete"),
        F.coalesce("_failed", F.lit(False)).alias("children_failed"),
    )


def awaiting_children(jobs: DataFrame, roots_only: bool = False) -> DataFrame:
    waiting = jobs.where((F.col("state") == "running") & (payload_text(F.col("result"), "await_children") == "true"))
    return waiting.where(is_root()) if roots_only else waiting


def stale_jobs(jobs: DataFrame, now: datetime, stale_after: timedelta | None = None) -> DataFrame:
    return jobs.where(is_stale(now, stale_after))


def trace_roots(jobs: DataFrame) -> DataFrame:
    """(id, trace_id): the trace of each job, found by walking up to a root.

    A job with a trace keeps it and passes it on. A job that nobody in the table requested starts its own. Jobs on or
    below a cycle have no root and become their own traces.

    Each round doubles the distance every unfinished job has walked, and only unfinished jobs go into the next round. No
    chain is longer than the number of jobs without a trace, so past that distance only cycles are left.
    """
    rows = jobs.select(
        "id",
        "trace_id",
        F.when(F.col("requested_by_type") == "job", F.col("requested_by_id")).alias("parent"),
    )
    known = rows.select(F.col("id").alias("_parent"))
    linked = rows.join(known, F.col("parent") == F.col("_parent"), "left")
    found = F.coalesce("trace_id", F.when(F.col("_parent").isNull(), F.col("id")))
    walk = cut_lineage(linked.select("id", found.alias("found"), F.col("_parent").alias("up")))
    done = walk.where("found IS NOT NULL").select("id", "found")
    open_ = walk.where("found IS NULL").select("id", "up")
    total = left = open_.count()
    distance = 1
    nothing = F.lit(None).cast("string")
    while left:
        # Of the finished jobs only those that somebody points at go on.
        pointed = open_.select(F.col("up").alias("id")).distinct()
        ahead = done.join(pointed, "id", "left_semi").select(F.col("id").alias("_at"), F.col("found").alias("_found"), nothing.alias("_up")).unionByName(
            open_.select(F.col("id").alias("_at"), nothing.alias("_found"), F.col("up").alias("_up"))
        )
        step = cut_lineage(open_.join(ahead, F.col("up") == F.col("_at")).select("id", "_found", "_up"))
        done = done.unionByName(step.where("_found IS NOT NULL").select("id", F.col("_found").alias("found")))
        open_ = step.where("_found IS NULL").select("id", F.col("_up").alias("up"))
        if distance >= total:
            break
        left, distance = open_.count(), distance * 2
    lost = open_.select("id", F.col("id").alias("found"))
    return done.unionByName(lost).select("id", F.col("found").alias("trace_id"))
