import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from stowage.operators import activity, events as ops, jobs, ordering
from stowage.plans.change_feed import apply_events, feed_outcomes, run_change_feed
from stowage.schema import JOB_RUN, STORED_EVENT
from stowage.streaming.ingest import compact_inbox, create_inbox, dedupe_batch, read_inbox, store_batch, stored_keys, stream_ingest

T0 = datetime(2026, 6, 26, tzinfo=timezone.utc)


def events(spark, rows):
    made = [(i, b, n, k, "{}", i, "stream", "pending", None, T0, T0 + timedelta(minutes=m), None) for i, b, n, k, m in rows]
    return spark.createDataFrame(made, STORED_EVENT)


@pytest.fixture
def resolved(spark):
    buckets = spark.createDataFrame([("b",)], "id string")
    objects = spark.createDataFrame([("o1", "b", "x"), ("o2", "b", "y")], "id string, bucket_id string, key string")
    rows = events(spark, [
        ("e1", "b", "ObjectCreated:Put", "x", 1), ("e3", "b", "ObjectRemoved:Delete", "x", 3), ("e2", "b", "ObjectTagging:Put", "x", 2),
        ("e4", "b", "ObjectRemoved:Delete", "z", 4), ("e5", "q", "ObjectCreated:Put", "x", 5), ("e6", "b", "OBJECT_FINALIZE", "x", 6),
        ("e7", "b", "ObjectCreated:Put", "new", 7),
    ])
    return ops.resolve_events(rows, buckets, objects)


def test_resolve(resolved):
    rows = {r.id: (r.job_type, r.object_id, r.skip_reason) for r in resolved.collect()}
    assert rows["e1"] == ("import_objects", None, None) and rows["e2"] == ("refresh_objects", "o1", None)
    assert [rows[i][2] for i in ("e4", "e5", "e6")] == ["object_not_found", "bucket_not_found", "unsupported_event_name"]


def test_coalesce(resolved):
    for frame in (resolved, resolved.orderBy(F.rand(5))):
        rows = {r.key: r for r in ops.coalesce_mutations(frame, event_ids=True).collect()}
        assert set(rows) == {"x", "new"}
        assert (rows["x"].job_type, rows["x"].object_id, rows["x"].event_ids) == ("remove_objects", "o1", ["e1", "e2", "e3"])
        assert rows["x"].event_count == 3
    assert ops.mutation_events(resolved).where("key = 'x'").count() == 3


HEADS = "bucket_id string, key string, body string"
BUCKET_ROWS = "id string"


def feed(spark, rows, old=(), heads=("k",)):
    buckets = spark.createDataFrame([("b",)], BUCKET_ROWS)
    objects = spark.createDataFrame(list(old), "id string, bucket_id string, key string, attributes string, attribute_provenance map<string,string>, created_at timestamp, updated_at timestamp")
    objects = objects.withColumn("attributes", F.parse_json("attributes"))
    documents = spark.createDataFrame([("b", k, '{"upstream":{"etag":"e"}}') for k in heads], HEADS)
    documents = documents.select("bucket_id", "key", F.parse_json("body").alias("attributes"))
    catalog, after = apply_events(events(spark, rows), buckets, objects, documents, T0)
    return sorted(r.key for r in catalog.collect()), {r.id: (r.state, r.error_message) for r in after.collect()}


CREATED, REMOVED = "ObjectCreated:Put", "ObjectRemoved:Delete"


def test_created_and_removed_is_gone(spark):
    assert feed(spark, [("e1", "b", CREATED, "k", 1), ("e2", "b", REMOVED, "k", 2)]) == ([], {"e1": ("processed", None), "e2": ("processed", None)})


def test_removed_and_created_is_there(spark):
    old = [("o", "b", "k", "{}", {}, T0, T0)]
    assert feed(spark, [("e1", "b", REMOVED, "k", 1), ("e2", "b", CREATED, "k", 2)], old)[0] == ["k"]
    # What was never there cannot be removed.
    assert feed(spark, [("e1", "b", REMOVED, "k", 1), ("e2", "b", CREATED, "k", 2)])[1]["e1"] == ("skipped", "object_not_found")


def test_an_import_without_a_head_has_failed(spark):
    keys, outcome = feed(spark, [("e1", "b", CREATED, "k", 1), ("e2", "b", CREATED, "lost", 1)])
    assert keys == ["k"] and outcome == {"e1": ("processed", None), "e2": ("failed", "head_not_found")}


def run_feed(spark, folder, parts):
    """Each part of the messages is a call of its own on one workspace."""
    buckets = spark.createDataFrame([("b",)], BUCKET_ROWS)
    objects = spark.createDataFrame([], "id string, bucket_id string, key string, attributes string, attribute_provenance map<string,string>, created_at timestamp, updated_at timestamp").withColumn("attributes", F.parse_json("attributes"))
    heads = spark.createDataFrame([("b", k, "{}") for k in ("k", "m")], HEADS).select("bucket_id", "key", F.parse_json("body").alias("attributes"))
    for at, part in enumerate(parts):
        rows = [("b", x, T0 + timedelta(minutes=10 * at + n)) for n, x in enumerate(part)]
        spark.createDataFrame(rows, "bucket_id string, body string, received_at timestamp").coalesce(1).write.mode("append").json(f"{folder}/in")
        stream = spark.readStream.schema("bucket_id string, body string, received_at timestamp").json(f"{folder}/in")
        after = run_change_feed(stream, f"{folder}/work", lambda: buckets, lambda: objects, heads, T0, unified=True)
    outcomes = feed_outcomes(spark, f"{folder}/work", heads)
    return sorted(r.key for r in after.collect()), sorted((r.state, r.error_message or "") for r in outcomes.collect())


def test_later_batches_see_earlier_ones(spark, tmp_path):
    first, second = [body("k"), body("m"), body("lost")], [body("k", REMOVED, "2026-06-26T02:00:00Z")]
    two = run_feed(spark, str(tmp_path / "two"), [first, second])
    one = run_feed(spark, str(tmp_path / "one"), [first + second])
    assert two == one == (["m"], [("failed", "head_not_found")] + [("processed", "")] * 3)


def test_dedupe_batch(spark):
    stored, fresh = events(spark, [("a", "b", "n", "k", 0)]), events(spark, [("a", "b", "n", "k", 1), ("c", "b", "n", "k", 3)])
    assert [r.id for r in dedupe_batch(fresh, stored).collect()] == ["c"]
    assert [r.id for r in ops.pending_events(stored.unionByName(fresh), 2).collect()] == ["a", "a"]


def test_batches(spark):
    rows = spark.range(250).select(
        F.lit("b").alias("bucket_id"), F.concat(F.lit("k"), "id").alias("key"), F.lit("import_objects").alias("job_type"), F.lit(None).cast("string").alias("object_id"),
        F.timestamp_seconds(F.col("id") * 600).alias("first_received_at"), F.lpad(F.col("id").cast("string"), 4, "0").alias("first_event_id"))
    batched = ops.batch_mutations(rows)
    assert {r.batch_no: r["count"] for r in batched.groupBy("batch_no").count().collect()} == {0: 100, 1: 100, 2: 50}
    third = {r.batch_no: r.objects for r in ops.batch_payloads(batched).collect()}[2]
    assert [o.key for o in third] == [f"k{n}" for n in range(200, 250)]


def test_append_and_count(spark):
    stored = events(spark, [("a", "b", "n", "k", 0)])
    fresh = events(spark, [("a", "b", "n", "k", 1), ("c", "b", "n", "k", 3), ("c", "b", "n", "other", 2)])
    added = ops.append_events(stored, fresh).collect()
    assert [(r.id, r.object_key) for r in added] == [("c", "other")]
    assert tuple(ops.ingest_counts(stored, fresh).first()) == (1, 2, 0)


def test_mark(spark, resolved):
    stored = events(spark, [("e1", "b", "n", "x", 0), ("e9", "b", "n", "x", 0)])
    rows = {r.id: r for r in ops.mark_events(stored, ops.event_outcomes(resolved), T0).collect()}
    assert rows["e1"].state == "processed" and rows["e1"].processed_at is not None
    assert rows["e9"].state == "pending" and rows["e9"].processed_at is None


def body(key, name="ObjectCreated:Put", time="2026-06-26T01:00:00Z"):
    return json.dumps({"Records": [{"eventSource": "aws:s3", "eventName": name, "eventTime": time, "s3": {"bucket": {"name": "b"}, "object": {"key": key}}}]})


def messages(spark, bodies):
    return spark.createDataFrame([("b", x, T0) for x in bodies], "bucket_id string, body string, received_at timestamp")


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    inbox, rejected = str(tmp_path / "inbox"), str(tmp_path / "rejected")
    create_inbox(spark, inbox)
    store_batch(messages(spark, [body("a"), body("a"), body("b"), "bad"]), 0, inbox, rejected)
    for _ in range(2):
        store_batch(messages(spark, [body("b"), body("c")]), 1, inbox, rejected)
    assert sorted(r.object_key for r in read_inbox(spark, inbox).collect()) == ["a", "b", "c"]
    assert spark.read.parquet(rejected).count() == 1


def test_only_the_parts_of_new_keys_are_read_and_compaction_keeps_all(spark, tmp_path):
    inbox, rejected = str(tmp_path / "inbox"), str(tmp_path / "rejected")
    create_inbox(spark, inbox)
    for batch, names in enumerate((("a", "b", "c"), ("d", "a"))):
        store_batch(messages(spark, [body(n) for n in names]), batch, inbox, rejected)
    plan = stored_keys(spark, inbox, [3, 5], 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "key_part" in plan.split("PartitionFilters")[1]
    compact_inbox(spark, inbox, str(tmp_path / "small"))
    assert sorted(r.object_key for r in read_inbox(spark, str(tmp_path / "small")).collect()) == ["a", "b", "c", "d"]
    store_batch(messages(spark, [body("b"), body("e")]), 2, str(tmp_path / "small"), rejected)
    assert sorted(r.object_key for r in read_inbox(spark, str(tmp_path / "small")).collect()) == ["a", "b", "c", "d", "e"]


def test_stream_restarts_where_it_ended(spark, tmp_path):
    source, inbox = tmp_path / "in", str(tmp_path / "inbox")
    schema = "bucket_id string, body string, received_at timestamp"

    def run():
        stream = spark.readStream.schema(schema).json(str(source))
        stream_ingest(stream, inbox, str(tmp_path / "bad"), str(tmp_path / "check"), available_now=True).awaitTermination()
        return sorted(r.object_key for r in read_inbox(spark, inbox).collect())

    messages(spark, [body("a"), body("b")]).write.mode("append").json(str(source))
    assert run() == ["a", "b"]
    messages(spark, [body("b"), body("c")]).write.mode("append").json(str(source))
    assert run() == ["a", "b", "c"]


def test_gap_fill(spark):
    at = lambda h, m=0: datetime(2026, 6, 26, h, m, tzinfo=timezone.utc)
    rows = spark.createDataFrame([(at(11, 5), "created"), (at(11, 40), "created"), (at(13), "created")], "received_at timestamp, kind string")
    counts = activity.activity(rows, "received_at", F.col("kind"), "hour")
    filled = activity.gap_fill(counts, at(10), at(13), ["created", "removed"]).orderBy("bucket_start", "series").collect()
    assert [(r.series, r.n) for r in filled] == [("created", 0), ("removed", 0), ("created", 2), ("removed", 0), ("created", 0), ("removed", 0)]
    assert activity.bucket_unit(at(0), at(0) + timedelta(hours=48)) == "hour"
    assert activity.bucket_unit(at(0), at(0) + timedelta(days=7)) == "day"
    with pytest.raises(ValueError):
        activity.gap_fill(counts, at(10), at(10), ["created"])


def job_rows(spark, rows):
    names = JOB_RUN.fieldNames()
    text = [f"{n} {'string' if n in ('input', 'result', 'progress') else t.dataType.simpleString()}" for n, t in zip(names, JOB_RUN.fields)]
    base = dict.fromkeys(names) | {"created_at": T0, "updated_at": T0, "target_type": "bucket", "target_id": "b", "requested_by_type": "user"}
    frame = spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], ", ".join(text))
    return frame.withColumns({c: F.parse_json(c) for c in ("input", "result", "progress")})


def child(id, kind, state, **more):
    return {"id": id, "trace_id": "root", "type": kind, "state": state, "requested_by_type": "job", "requested_by_id": "root"} | more


ROOT = {"id": "root", "trace_id": "root", "type": "sync_bucket", "state": "running"}


def test_trace_summary(spark):
    rows = job_rows(spark, [
        ROOT | {"progress": '{"phase":"planned","objects_listed":1000,"import_objects_count":1000}', "result": '{"await_children":true}'},
        child("c1", "import_objects", "succeeded", result='{"objects_imported":"500"}', input='{"objects":[1,2]}'), child("c2", "import_objects", "pending", result='{"objects_imported":""}', input='{"objects":[3]}'),
    ])
    from stowage.plans.job_reports import trace_report

    row = trace_report(rows, T0 + timedelta(seconds=90)).first()
    assert (row.state, row.phase, row.objects_listed, row.import_planned, row.import_applied) == ("running", "importing", 1000, 1000, 500)
    assert (row.import_total, row.import_done, row.import_pending, row.stale_seconds, row.terminal_phase) == (2, 1, 1, 90, "imported")
    assert tuple(jobs.children_status(rows).where("id = 'root'").first())[1:] == (False, False)
    assert jobs.awaiting_children(rows, roots_only=True).count() == 1
    assert tuple(jobs.planned_counts(rows).first()) == ("root", 1000, 0, 0)
    assert jobs.active_work(rows, T0).count() == 2


@pytest.mark.parametrize(
    "states, expected", [(["succeeded", "running"], "running"), (["cancelled", "failed"], "failed"), (["cancelled", "succeeded"], "cancelled"), (["succeeded"], "succeeded")])
def test_trace_state(spark, states, expected):
    rows = job_rows(spark, [child(f"c{n}", "import_objects", s) for n, s in enumerate(states)])
    assert jobs.trace_state(rows).first().state == expected


def test_stale_and_active(spark):
    old = T0 - timedelta(minutes=16)
    rows = job_rows(spark, [ROOT | {"locked_by": "w", "updated_at": old}, ROOT | {"id": "r2", "trace_id": "r2", "locked_by": None, "updated_at": old},
                            ROOT | {"id": "r3", "trace_id": "r3", "target_id": None, "state": "pending"}])
    assert [r.id for r in jobs.stale_jobs(rows, T0).collect()] == ["root"]
    assert sorted(r.id for r in jobs.active_work(rows, T0).collect()) == ["r2", "r3"]
    assert jobs.stale_jobs(rows, T0, timedelta(hours=1)).count() == 0
    assert ordering.list_jobs(rows, state="pending").count() == 1


def test_resumable(spark):
    def sync(id, target, state, hours, progress, **more):
        return {"id": id, "trace_id": id, "type": "sync_bucket", "state": state, "target_id": target, "created_at": T0 + timedelta(hours=hours), "progress": progress, "input": "{}"} | more

    got = '{"objects_listed":5}'
    rows = job_rows(spark, [
        sync("a1", "a", "failed", 1, got), sync("a2", "a", "succeeded", 2, got), sync("b1", "b", "failed", 1, got), sync("b2", "b", "cancelled", 1, got),
        sync("b3", "b", "succeeded", 1, got), sync("c1", "c", "failed", 1, '{"objects_listed":0}'), sync("d1", "d", "failed", 1, '{"listing_checkpoint":{"marker":"m"}}'),
        sync("e1", "e", "failed", 1, got, input='{"partition":null}'), sync("f1", "f", "failed", 1, got, input='{"prefix":"p/"}'), sync("g1", "g", "failed", 1, '{"listing_complete":true}'),
    ])
    assert {r.id for r in jobs.resumable_sync(rows).collect()} == {"b2", "d1", "g1"}
    assert {r.id for r in jobs.resumable_sync(rows, "p/").collect()} == {"f1"}


def test_trace_roots(spark):
    chain = [{"id": f"n{n}", "type": "t", "state": "x", "requested_by_type": "job" if n else "user", "requested_by_id": f"n{n - 1}" if n else None} for n in range(60)]
    loop = [{"id": f"l{n}", "type": "t", "state": "x", "requested_by_type": "job", "requested_by_id": f"l{(n + 1) % 3}"} for n in range(3)]
    rest = [{"id": "below", "type": "t", "state": "x", "requested_by_type": "job", "requested_by_id": "l0"}, {"id": "orphan", "type": "t", "state": "x", "requested_by_type": "job", "requested_by_id": "nobody"},
            {"id": "kept", "trace_id": "T", "type": "t", "state": "x", "requested_by_type": "job", "requested_by_id": "l1"}, {"id": "heir", "type": "t", "state": "x", "requested_by_type": "job", "requested_by_id": "kept"}]
    roots = {r.id: r.trace_id for r in jobs.trace_roots(job_rows(spark, chain + loop + rest)).collect()}
    assert all(roots[f"n{n}"] == "n0" for n in range(60))
    assert all(roots[x] == x for x in ("l0", "l1", "l2", "below", "orphan")) and roots["kept"] == roots["heir"] == "T"
    assert len(roots) == 67
