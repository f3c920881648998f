"""Streams: what a batch reads, what a repeated one changes, deliveries, repeats, and windows of activity."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stowage import session
from stowage.operators.events import coalesce_mutations, known_objects, resolve_events
from stowage.schema import STORED_EVENT
from stowage.session import child_numbers
from stowage.sources.notifications import parse_notifications
from stowage.sources.tables import KEY_PARTS, PART, key_part, read_object_parts, write_object_parts
from stowage.streaming import activity as live
from stowage.streaming import apply as A
from stowage.streaming import ingest as I

T0 = datetime(2026, 6, 26, tzinfo=timezone.utc)
NOTE = "bucket_id string, body string, received_at timestamp"


def event(n, key, name="ObjectCreated:Put"):
    row = {"id": f"e{n:05}", "bucket_id": "b", "event_name": name, "object_key": key, "dedupe_key": f"d{n}", "transport": "t", "state": "pending",
           "received_at": T0 + timedelta(seconds=n), "event_time": T0}
    return tuple(row.get(name) for name in STORED_EVENT.fieldNames())


@pytest.fixture(scope="module")
def bucket(spark):
    return spark.createDataFrame([("b", "bucket")], "id string, name string")


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([("o1", "b", "k1"), ("o2", "b", "k2")], "id string, bucket_id string, key string")


def applied(spark, catalog, bucket, tmp_path, batches):
    """Run ``stream_apply`` over one file per batch, a micro-batch each."""
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, STORED_EVENT).coalesce(1).write.mode("append").parquet(f"{source}/ingest_batch={n}")
    stream = A.inbox_stream(spark, source, 1)
    A.stream_apply(stream, lambda: bucket, lambda: catalog, out, str(tmp_path / "check"), available_now=True).awaitTermination()
    return out


def history(n_batches, keys=5):
    out, n = [], 0
    for batch in range(n_batches):
        rows = []
        for step in range(2):
            n += 1
            rows.append(event(n, f"k{(7 * n + batch) % keys}", "ObjectRemoved:Delete" if n % 3 == 0 else "ObjectCreated:Put"))
        out.append(rows)
    return out


def test_apply_equals_all_events_at_once(spark, catalog, bucket, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "MAX_LATER", 2)
    batches = history(9)
    out = applied(spark, catalog, bucket, tmp_path, batches)
    whole = spark.createDataFrame([r for rows in batches for r in rows], STORED_EVENT)
    # A key that is imported and changed later is a refresh in batches, so the objects that are there then are compared.
    keys = lambda mutations: sorted(r.key for r in known_objects(catalog, mutations).collect())
    got = A.latest_mutations(spark, out)
    assert keys(got) == keys(coalesce_mutations(resolve_events(whole, bucket, catalog))) and got.count() == got.select("key").distinct().count()
    state = A.read_state(spark, out, 1 << 40)
    assert any(base is not None for base, _ in state.values()) and all(len(later) <= A.MAX_LATER for _, later in state.values())
    # Bases that no state names are gone, and states but for the last two.
    assert len(child_numbers(spark, f"{out}/state", A.APPLY)) == 2
    before = A.read_state(spark, out, max(child_numbers(spark, f"{out}/state", A.APPLY)) - 1)
    named = {base for s in (state, before) for base, _ in s.values() if base is not None}
    assert set(child_numbers(spark, f"{out}/bases", A.APPLY)) == named


def test_a_batch_opens_the_files_of_its_parts_only(spark, catalog, bucket, tmp_path):
    out = applied(spark, catalog, bucket, tmp_path, history(3))
    state = A.read_state(spark, out, 1 << 40)
    part = next(iter(state))
    files = A.part_files(spark, out, state, [part]).inputFiles()
    base, later = state[part]
    assert 1 <= len(files) == len(later) + (base is not None)
    assert all(f"{PART}={part}/" in file for file in files)
    assert A.part_files(spark, out, state, [p for p in range(KEY_PARTS) if p not in state]).inputFiles() == []


def test_a_repeated_batch_changes_nothing(spark, catalog, bucket, tmp_path):
    out = applied(spark, catalog, bucket, tmp_path, history(4))
    last = max(child_numbers(spark, f"{out}/state", A.APPLY))
    read = lambda: (sorted(map(str, A.latest_mutations(spark, out).collect())), A.read_state(spark, out, last))
    before = read()
    A.write_state(spark, out, A.read_state(spark, out, last - 1), last)
    assert read() == before


def test_catalog_parts(spark, tmp_path):
    rows = [(f"o{i}", "b", f"k{i}", T0, T0) for i in range(50)]
    objects = spark.createDataFrame(rows, "id string, bucket_id string, key string, created_at timestamp, updated_at timestamp").select(
        "id", "bucket_id", "key", F.parse_json(F.lit("{}")).alias("attributes"), F.create_map().cast("map<string,string>").alias("attribute_provenance"), "created_at", "updated_at"
    )
    path = str(tmp_path / "parts")
    write_object_parts(objects, path)
    stored = read_object_parts(spark, path)
    assert sorted(r.id for r in stored.collect()) == sorted(r[0] for r in rows)
    wanted = objects.where("key = 'k7'").select(key_part()).first()[0]
    found = stored.where(F.col(PART).isin([wanted]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "k7" in {r.key for r in found.collect()} and PART in plan.split("PartitionFilters")[1].split("]")[0]


def body(key):
    return json.dumps({"Records": [{"eventSource": "aws:s3", "eventName": "ObjectCreated:Put", "eventTime": "2026-06-26T01:00:00Z", "s3": {"bucket": {"name": "b"}, "object": {"key": key}}}]})


def notes(spark, bodies):
    return spark.createDataFrame([("b", x, T0) for x in bodies], NOTE)


def late_reader(readable_from):
    """A reader that cannot read ``later`` before its delivery ``readable_from``."""

    def parse(rows):
        ready = rows.withColumn("body", F.when((F.col("body") == "later") & (F.col("delivery") >= readable_from), F.lit(body("later"))).otherwise(F.col("body")))
        return parse_notifications(ready)

    return parse


def test_redelivery(spark, tmp_path):
    inbox, dead, waiting = (str(tmp_path / n) for n in ("inbox", "dead", "waiting"))
    I.create_inbox(spark, inbox)
    how = {"waiting": waiting, "parse": late_reader(3)}
    bodies = [["later", "never", body("a")], [body("b")], [body("a"), "never too"], [body("c")], [body("d")], [body("e")], [body("f")], []]
    dead_at, stored_at = [], []
    for n, found in enumerate(bodies):
        for _ in range(2 if n in (2, 4) else 1):
            I.store_batch(notes(spark, found), n, inbox, dead, **how)
        dead_at.append(sorted(r.body for r in spark.read.parquet(dead).collect()))
        stored_at.append(sorted(r.object_key for r in I.read_inbox(spark, inbox).collect()))
    # The third delivery of the first batch's notifications is with the third batch, the fifth with the fifth.
    assert stored_at[1] == ["a", "b"] and stored_at[2] == ["a", "b", "later"] and stored_at[-1] == ["a", "b", "c", "d", "e", "f", "later"]
    assert dead_at == [[], [], [], [], ["never"], ["never"], ["never", "never too"], ["never", "never too"]]
    assert all(r.error for r in spark.read.parquet(dead).collect())


def test_redelivery_without_new_notifications(spark, tmp_path):
    inbox, dead, waiting = (str(tmp_path / n) for n in ("inbox", "dead", "waiting"))
    I.create_inbox(spark, inbox)
    assert I.redeliver(spark, inbox, dead, waiting) == 0
    parse = late_reader(3)
    I.store_batch(notes(spark, ["later", "never"]), 0, inbox, dead, waiting=waiting, parse=parse)
    assert [I.redeliver(spark, inbox, dead, waiting, parse=parse) for _ in range(2)] == [2, 1]
    I.store_batch(notes(spark, [body("x")]), 1, inbox, dead, waiting=waiting, parse=parse)
    assert [I.redeliver(spark, inbox, dead, waiting, parse=parse) for _ in range(2)] == [0, 0]
    assert sorted(r.object_key for r in I.read_inbox(spark, inbox).collect()) == ["later", "x"]
    assert [r.body for r in spark.read.parquet(dead).collect()] == ["never"]


def test_repeats_are_dropped_before_the_store_is_asked(spark, tmp_path, monkeypatch):
    schema, looked = NOTE, []
    rows = [("b", body("a"), T0), ("b", body("a"), T0), ("b", body("a"), T0 + timedelta(minutes=1)), ("b", body("b"), T0), ("c", body("b"), T0)]
    store = I.store_batch

    def counting(batch, batch_id, *args, **kwargs):
        looked.append(batch.count())
        store(batch, batch_id, *args, **kwargs)

    monkeypatch.setattr(I, "store_batch", counting)
    results = []
    for horizon in (None, "1 hour"):
        looked.clear()
        work = tmp_path / str(horizon)
        for _ in range(3):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(work / "in"))
            stream = spark.readStream.schema(schema).json(str(work / "in"))
            I.stream_ingest(stream, str(work / "inbox"), str(work / "dead"), str(work / "check"), available_now=True, horizon=horizon).awaitTermination()
        stored = I.read_inbox(spark, str(work / "inbox")).select("bucket_id", "object_key", "received_at").collect()
        results.append((sorted(map(tuple, stored)), sum(looked)))
    (plain, all_looked), (filtered, few_looked) = results
    assert filtered == plain and len(plain) == 3
    assert (all_looked, few_looked) == (15, 4)


def test_activity_with_late_events_and_bounded_state(spark, tmp_path):
    """A day of events, three hours to a batch, some of them many hours late; the state holds open windows only."""
    source, path, check = (str(tmp_path / n) for n in ("in", "activity", "check"))
    names = ["ObjectCreated:Put", "ObjectRemoved:Delete"]
    schema, rows, most = "received_at timestamp, event_name string", [], 0
    for step in range(7):
        at = T0 + timedelta(hours=3 * step)
        new = [(at + timedelta(minutes=m), names[m % 2]) for m in range(0, 180, 45)]
        if step % 3 == 2:
            new += [(T0 + timedelta(minutes=5), names[0]), (at - timedelta(hours=5), names[1])]
        if step % 4 == 1:
            # Behind the newest, but in a window that is open still or was never closed.
            new += [(at - timedelta(minutes=3), names[0])]
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        found = live.stream_activity(stream, path, check, available_now=True)
        found.awaitTermination()
        progress = [p for p in found.closing.recentProgress if p["stateOperators"]]
        most = max([most, *[p["stateOperators"][0]["numRowsTotal"] for p in progress]])
        assert all(p["stateOperators"][0]["numRowsDroppedByWatermark"] == 0 for p in progress)
    whole = spark.createDataFrame(rows, schema).groupBy(F.window("received_at", "1 hour")["start"].alias("bucket_start"), live.event_category(F.col("event_name")).alias("series"))
    want = sorted(map(tuple, whole.count().collect()))
    assert sorted(map(tuple, live.read_activity(spark, path).collect())) == want
    assert spark.read.parquet(f"{path}/late").count() >= 4 and spark.read.parquet(f"{path}/closed").count() > 20
    assert most <= 12
    # A batch that is run again leaves what is there.
    last = max(child_numbers(spark, f"{path}/timely", live.BATCH))
    live.count_batch(spark.createDataFrame(rows[-4:], schema), last, path, "1 hour", "10 minutes")
    assert sorted(map(tuple, live.read_activity(spark, path).collect())) == want


def test_events_are_resolved_once_for_all_outputs(spark):
    """Mutations, their numbering and the outcomes read what was resolved; the events are not gone through again."""
    from stowage.streaming.apply import READ, process_events

    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    rows = [(f"e{n:02}", "b1", "ObjectCreated:Put", f"k{n % 7}", datetime(2026, 6, 1, tzinfo=timezone.utc), "pending") for n in range(40)]
    schema = "id string, bucket_id string, event_name string, object_key string, received_at timestamp, state string"
    events = spark.createDataFrame(rows, schema).select(*READ).mapInArrow(counted, schema)
    buckets = spark.createDataFrame([("b1",)], "id string")
    objects = spark.createDataFrame([], "id string, bucket_id string, key string")
    with process_events(events, buckets, objects) as (mutations, outcomes):
        assert len(mutations.collect()) == 7 and len(outcomes.collect()) == 40
        # Once as events and once as the imports before them.
        assert passed.value == 2 * len(rows)


def test_a_batch_holds_no_rows_in_memory_and_leaves_no_files(spark, catalog, bucket, tmp_path, monkeypatch):
    """What a batch uses more than once is in files of the shared folder that go with it."""
    held, shared = [], session.shared_dir(spark)

    def looking(module, name):
        real = getattr(module, name)

        def look(*args, **kwargs):
            files = [f for f in Path(shared).glob("batch-*") if f.name not in before]
            held.append((name, spark.sparkContext._jsc.getPersistentRDDs().size(), len(files)))
            return real(*args, **kwargs)

        monkeypatch.setattr(module, name, look)

    before = {f.name for f in Path(shared).glob("batch-*")}
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    looking(I, "rejects")
    looking(A, "write_state")
    inbox, dead, waiting = (str(tmp_path / n) for n in ("inbox", "dead", "waiting"))
    I.create_inbox(spark, inbox)
    I.store_batch(notes(spark, [body("a"), body("a"), body("b"), "bad", None]), 0, inbox, dead, waiting=waiting)
    applied(spark, catalog, bucket, tmp_path, history(1))
    # Of the second, what was resolved is gone when the state is written, and the events are still there.
    assert held == [("rejects", cached, 1), ("write_state", cached, 1)]
    assert {f.name for f in Path(shared).glob("batch-*")} == before
    assert sorted(r.object_key for r in I.read_inbox(spark, inbox).collect()) == ["a", "b"]
    left = spark.read.parquet(f"{waiting}/ingest_batch=0/{I.AGAIN}=0").collect()
    assert sorted((r.bucket_id, r.body or "", r.delivery) for r in left) == [("b", "", 1), ("b", "bad", 1)]
