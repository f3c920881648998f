import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from stowage.functions import documents as docs
from stowage.operators import attributes as attrs
from stowage.operators import duplicates as dup
from stowage.operators import fingerprints as fp
from stowage.operators import objects as ops
from stowage.operators import reconcile as diff
from stowage.operators.relations import upsert_relations
from stowage.operators.skew import number_within
from stowage.plans.duplicates import detect_duplicates, hash_members
from stowage.plans.reconcile import reconcile
from stowage.plans.verify import verify
from stowage.schema import LISTED, RELATION
from stowage.sources.tables import read_objects, replace_buckets, write_objects

T1, T2 = datetime(2026, 1, 1, tzinfo=timezone.utc), datetime(2026, 2, 1, tzinfo=timezone.utc)
EMPTY = "id string, bucket_id string, key string, body string, at timestamp"


def catalog(spark, rows):
    frame = spark.createDataFrame([(*r, T1) for r in rows], EMPTY)
    return frame.select(
        "id", "bucket_id", "key", F.parse_json("body").alias("attributes"),
        F.create_map(F.lit("upstream"), F.lit("old")).alias("attribute_provenance"),
        F.col("at").alias("created_at"), F.col("at").alias("updated_at"),
    )


def listing(spark, rows):
    return spark.createDataFrame([(b, k, e, s, t, c) for b, k, e, s, t, c in rows], LISTED)


def batch(spark, rows):
    frame = spark.createDataFrame(rows, "bucket_id string, key string, ordinal int, body string, who string")
    return frame.select(
        "bucket_id", "key", "ordinal", F.parse_json("body").alias("attributes"),
        F.create_map(F.lit("upstream"), F.col("who")).alias("attribute_provenance"),
    )


def bodies(df):
    return {r.key: r.body for r in df.select("key", F.to_json("attributes").alias("body")).collect()}


def test_upsert_merges_and_keeps(spark):
    old = catalog(spark, [("o1", "b", "a", '{"upstream":{"etag":"x"},"user":{"score":7}}'), ("o2", "b", "c", '{"user":{}}')])
    first = ops.upsert_objects(old, batch(spark, [("b", "a", 1, '{"upstream":{"etag":"y"}}', "r1"), ("b", "n", 1, "{}", "r1")]), T1)
    again = ops.upsert_objects(first, batch(spark, [("b", "a", 1, '{"upstream":{"etag":"z"}}', "r2"), ("b", "a", 2, '{"upstream":{"size":1}}', "r3")]), T2)
    rows = {r.key: r for r in again.select("id", "key", "attribute_provenance", "created_at", "updated_at").collect()}
    seen = bodies(again)
    assert seen["a"] == (
        '{"core":{"first_seen_at":"2026-01-01T00:00:00Z","last_seen_at":"2026-02-01T00:00:00Z","object_id":"o1"},'
        '"upstream":{"size":1},"user":{"score":7}}'
    )
    assert seen["c"] == '{"user":{}}'
    assert rows["a"].id == "o1" and rows["a"].attribute_provenance == {"upstream": "r3"}
    assert rows["a"].updated_at > rows["a"].created_at and rows["c"].updated_at == rows["c"].created_at
    assert rows["n"].id.startswith("object_") and len(rows) == 3


def test_deletes(spark):
    old = catalog(spark, [("o1", "b", "p/a", "{}"), ("o2", "b", "p/b", '{"core":{"last_seen_at":"2026-01-05T00:00:00Z"}}'),
                          ("o3", "b", "q", '{"core":{"last_seen_at":"2026-01-01T00:00:00Z"}}')])
    gone = spark.createDataFrame([("o1",), ("",), (None,), ("zzz",)], "id string")
    assert sorted(r.id for r in ops.delete_objects(old, gone).collect()) == ["o2", "o3"]
    assert tuple(ops.deletion_counts(old, gone).first()) == (1, 2)
    edge = datetime(2026, 1, 5, tzinfo=timezone.utc)
    assert ops.delete_unseen(old, "b", edge).count() == 2
    assert ops.delete_unseen(old, "b", edge + timedelta(seconds=1), "p/").count() == 2


def sides(spark):
    local = catalog(spark, [
        ("o1", "b", "same", '{"upstream":{"etag":"e","size":5,"last_modified":"2026-01-01T00:00:00Z"}}'),
        ("o2", "b", "size", '{"upstream":{"etag":"e","size":5,"last_modified":"2026-01-01T00:00:00Z"}}'),
        ("o3", "b", "class", '{"upstream":{"etag":"e","size":5,"last_modified":"2026-01-01T00:00:00Z","s3":{"storage_class":"A"}}}'),
        ("o4", "b", "bare", '{"user":{"kept":true}}'),
        ("o5", "b", "gone", '{"upstream":{"etag":"e","size":5}}'),
    ])
    listed = listing(spark, [("b", k, "e", s, T1, c) for k, s, c in
                             (("same", 5, ""), ("size", 6, ""), ("class", 5, "B"), ("bare", 5, ""), ("new", 1, "A"))])
    return local, listed


def test_reconcile_converges(spark):
    local, listed = sides(spark)
    done = reconcile(local, listed, T2, run_id="r")
    actions = {r.key: (r.action, r.id) for r in done.plan.collect()}
    assert {k: a for k, (a, _) in actions.items()} == {"size": "refresh", "class": "refresh", "bare": "refresh", "new": "import", "gone": "remove"}
    assert actions["gone"][1] == "o5" and actions["new"][1] == ""
    assert tuple(done.counts.first()) == (1, 3, 1)
    after = done.snapshot
    assert reconcile(after, listed, T2).plan.count() == 0
    assert bodies(after)["bare"].count('"kept":true') == 1
    # The separate plans say the same.
    assert {r.key for r in diff.plan_imports(listed, local).collect()} == {"new"}
    assert {r.key for r in diff.plan_refreshes(listed, local).collect()} == {"size", "class", "bare"}
    assert {r.key for r in diff.plan_removals(listed, local).collect()} == {"gone"}


def test_unfinished_listing_removes_nothing(spark):
    local, listed = sides(spark)
    part = listed.where("key <> 'same'")
    done = reconcile(local, part, T2, complete=False)
    assert "remove" not in {r.action for r in done.plan.collect()}
    assert {"same", "gone"} <= {r.key for r in done.snapshot.collect()}


def test_reconcile_scope(spark):
    local, listed = sides(spark)
    done = reconcile(local, listed.where("key = 'size'"), T2, bucket_id="b", prefix="s")
    assert {(r.action, r.key) for r in done.plan.collect()} == {("refresh", "size"), ("remove", "same")}
    assert {r.key for r in done.snapshot.collect()} == {"size", "class", "bare", "gone"}


def test_verify(spark):
    local, listed = sides(spark)
    status = verify(local, listed, date(2026, 1, 1)).buckets.first()
    assert status.status == "needs_sync" and status.partitions_mismatched > 0
    assert verify(local, listed, date(2026, 1, 1), complete=False).buckets.first().status is None
    # A share of the partitions is only checked if it is asked for.
    assert verify(local, listed, date(2026, 1, 1), rate=0.0).buckets.count() == 0
    after = reconcile(local, listed, T2).snapshot
    assert verify(after, listed, date(2026, 1, 1)).buckets.first().status == "healthy"
    left = spark.createDataFrame([("k", 100), ("k2", 5)], "key string, size long")
    right = spark.createDataFrame([("k", 200), ("k2", 5)], "key string, size long")
    drifts = fp.compare_fingerprints(fp.fingerprints(left, 8), fp.fingerprints(right, 8)).collect()
    assert sorted(r.drift_at for r in drifts) in (["", "bytes"], ["bytes"])


def copies(spark):
    body = '{{"upstream":{{"etag":"{}","size":{},"last_modified":{}}}}}'
    old, new = '"2026-01-01T00:00:00Z"', '"2026-01-02T00:00:00Z"'
    return catalog(spark, [
        ("o2", "b", "a", body.format("x", 4, new)), ("o1", "b", "b", body.format("x", 4, old)), ("o3", "c", "a", body.format("x", 4, '"?"')),
        ("p1", "b", "c", body.format("y", 4, old)), ("p2", "b", "d", body.format("y", 4, old)),
        ("q1", "b", "e", body.format("z", 9, old)), ("q2", "b", "f", body.format("z", 9, old)),
        ("s1", "b", "g", body.format("", 1, old)), ("s2", "b", "h", body.format("", 1, old)),
    ])


def test_duplicates(spark):
    objects = copies(spark)
    texts = [("b", "a", "same"), ("b", "b", "same"), ("c", "a", "same"), ("b", "c", "one"), ("b", "d", "two"), ("b", "e", "three")]
    contents = spark.createDataFrame(texts, "bucket_id string, key string, text string").select(
        "bucket_id", "key", F.sha2("text", 256).alias("content_sha256"), F.length("text").cast("long").alias("bytes_read")
    )
    stored = spark.createDataFrame(
        [("p1", "p2", "duplicate", {}, "old", T1, T1), ("q1", "q2", "duplicate", {}, "old", T1, T1), ("p1", "p2", "derived", {}, "old", T1, T1),
         ("p1", "o1", "duplicate", {}, "old", T1, T1)], RELATION)
    raw = spark.createDataFrame(texts, "bucket_id string, key string, content string")
    for given in (contents, raw):
        found = detect_duplicates(objects, given, stored, "run", T2)
        # An unreadable time counts as the earliest.
        assert {(r.source_object_id, r.target_object_id) for r in found.edges.collect()} == {("o3", "o1"), ("o3", "o2")}
        after = {(r.source_object_id, r.target_object_id, r.relation_type) for r in found.relations.collect()}
        assert after == {("o3", "o1", "duplicate"), ("o3", "o2", "duplicate"), ("q1", "q2", "duplicate"), ("p1", "p2", "derived"), ("p1", "o1", "duplicate")}
        assert {r.etag: r.state for r in found.groups.collect()} == {"x": "verified", "y": "mismatched", "z": "unresolved"}
        counts = found.counts.first()
        assert (counts.candidate_groups, counts.verified_groups, counts.relations_created, counts.relations_removed) == (3, 1, 2, 1)
        assert (counts.objects_hashed, counts.bytes_hashed) == (6, 23)


def test_only_members_without_a_hash_are_hashed(spark):
    members = spark.createDataFrame([("a", "b", "k1", None), ("c", "b", "k2", "h")], "id string, bucket_id string, key string, cached_sha256 string")
    contents = spark.createDataFrame([("b", "k1", "x"), ("b", "k2", "y"), ("b", "k3", "z")], "bucket_id string, key string, content string")
    found = hash_members(members, contents)
    assert {(r.id, r.hashed) for r in found.collect()} == {("a", True), ("c", False)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The semi join stands below the hashing.
    assert plan.index("sha2") < plan.index("LeftSemi")


def test_numbering_by_ranges_equals_one_window(spark):
    from pyspark.sql import Window

    frame = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"), F.pmod(F.hash("id"), F.lit(500)).alias("at"))
    numbered = number_within(frame, ["g"], ["at", "id"], "n")
    plain = frame.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("at", "id")).cast("long"))
    assert sorted(map(tuple, numbered.select("id", "n").collect())) == sorted(map(tuple, plain.select("id", "n").collect()))


def test_one_moment_with_a_third_of_the_rows_is_split(spark):
    frame = spark.range(12_000).select("id", F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("at"))
    spread = frame.repartitionByRange(8, "g", "at", "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread) <= 2 * 12_000 / 8
    assert number_within(frame, ["g"], ["at", "id"], "n").agg(F.max("n"), F.count_distinct("n")).first()[:] == (12_000, 12_000)


def test_original_does_not_depend_on_order(spark):
    members = dup.duplicate_members(dup.candidates(copies(spark)))
    pick = lambda df: {r.etag: r.o for r in df.groupBy("etag").agg(dup.group_original(F.col("last_modified"), F.col("id")).alias("o")).collect()}
    assert pick(members) == pick(members.orderBy(F.rand(1))) == {"x": "o3", "y": "p1", "z": "q1"}


def test_stored_hashes_are_reused(spark):
    hashed = catalog(spark, [("a", "b", "1", '{"upstream":{"etag":"e","size":3},"extracted":{"content_sha256":"h"}}'),
                             ("c", "b", "2", '{"upstream":{"etag":"e","size":0},"extracted":{"content_sha256":"h"}}')])
    assert {r.id: r.cached_sha256 for r in dup.candidates(hashed).collect()} == {"a": "h", "c": None}


def test_relation_upsert(spark):
    stored = spark.createDataFrame([("a", "b", "duplicate", {"v": "1"}, "r1", T1, T1)], RELATION)
    fresh = spark.createDataFrame([("a", "b", "", {"v": "2"}, "r2", T2, T2), ("a", "a", "duplicate", {}, "r2", T2, T2)], RELATION)
    row = upsert_relations(stored, fresh).collect()
    assert len(row) == 1 and row[0].attributes == {"v": "2"} and row[0].created_by_run_id == "r2" and row[0].created_at < row[0].updated_at


def test_observe_merge_and_conflict(spark):
    frame = catalog(spark, [("1", "b", "k", '{"a":{"n":1,"s":"x","t":"2026-01-01T00:00:00Z","l":[1],"z":null,"e":{}}}'), ("2", "b", "l", '{"a":{"n":1.5,"s":3}}')])
    seen = {r.path: r.value_type for r in attrs.observe_attributes(frame).collect()}
    assert seen == {"a": "unknown", "a.n": "float", "a.s": "conflict", "a.t": "timestamp", "a.l": "unknown"}
    known = spark.createDataFrame([("a.n", "integer", "observed"), ("a.t", "string", "builtin"), ("a", "string", "observed")], "path string, value_type string, source string")
    merged = {r.path: tuple(r)[1:] for r in attrs.merge_catalog(known, attrs.observe_attributes(frame)).collect()}
    assert merged["a.n"] == ("float", "observed", False) and merged["a.t"] == ("string", "builtin", False)
    assert merged["a.s"] == (None, "observed", True) and merged["a"] == ("string", "observed", False)


def test_flatten_any_depth(spark):
    deep = '{"a":' * 9 + "1" + "}" * 9
    frame = catalog(spark, [("1", "b", "k", deep), ("2", "b", "k", '{"x<y":{"q":[{"a":1}]}}')])
    assert attrs.document_depth(frame) >= 9
    paths = {".".join(r.segments) for r in attrs.flatten(frame).collect()}
    assert paths == {".".join("a" * 9), "x<y.q"}


def test_mutations(spark):
    frame = catalog(spark, [("1", "b", "k", '{"user":{"a":1,"gone":{"x":1},"hollow":{}},"upstream":{"e":{}}}'), ("2", "b", "l", '{"user":{"a":1}}'), ("3", "b", "m", '{"user":{"q":1}}')])
    edits = spark.createDataFrame(
        [("1", "set", "user.a.deep", '{"k":[1]}', "p1"), ("1", "delete", "user.gone.x", None, None), ("1", "delete", "user.hollow.y", None, None),
         ("2", "set", "user.a", '"text"', "p2"), ("2", "set", "user.b", "1", "p2"), ("3", "delete", "user.q", None, None), ("3", "set", "other.q", "1", None)],
        "id string, op string, path string, body string, provenance string",
    ).select("id", "op", "path", F.parse_json("body").alias("value"), "provenance")
    known = spark.createDataFrame([("user.a", "integer", "observed")], "path string, value_type string, source string")
    after, rejected = attrs.mutate_attributes(frame, edits, known, F.lit(T2))
    assert bodies(after) == {"k": '{"upstream":{"e":{}},"user":{"a":{"deep":{"k":[1]}}}}', "l": '{"user":{"a":1}}', "m": '{"user":{"q":1}}'}
    assert {(r.id, r.path): r.error for r in rejected.collect()} == {
        ("2", "user.a"): "type conflict", ("2", "user.b"): None, ("3", "user.q"): None, ("3", "other.q"): "path is outside the namespace"}
    kept = {r.key: r.attribute_provenance for r in after.collect()}
    assert kept["k"] == {"upstream": "old", "user.a.deep": "p1"} and kept["l"] == {"upstream": "old"}


def test_snapshots_on_disk(spark, tmp_path):
    path = str(tmp_path / "objects")
    local = catalog(spark, [("o1", "7", "a", '{"upstream":{"etag":"x","size":5}}'), ("o2", "8", "b", "{}")])
    write_objects(local, path)
    back = read_objects(spark, path)
    rows = {r.id: r for r in back.collect()}
    assert rows["o1"].bucket_id == "7" and rows["o1"].size == 5 and rows["o1"].etag == "x"
    plan = back.where("bucket_id = '7' AND size > 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket_id" in plan and "GreaterThan(size,1)" in plan
    size = back.select(docs.attr(F.col("attributes"), "upstream.size", "integer").alias("n"))
    assert "ReadSchema: struct<attributes:struct<0:string>>" in size._jdf.queryExecution().executedPlan().toString()
    replace_buckets(catalog(spark, [("o3", "8", "c", "{}")]), path, ["8"])
    spark.catalog.refreshByPath(path)
    assert sorted(r.id for r in read_objects(spark, path).collect()) == ["o1", "o3"]
    with pytest.raises(Exception):
        write_objects(local, path)
