from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from stowage.operators import ordering, predicates as p, relations as rel
from stowage.plans.search import search

VALID = [
    ("=", "string", "string"), ("<>", "integer", "float"), ("<", "integer", "integer"), (">=", "float", "integer"),
    ("<=", "timestamp", "timestamp"), ("like", "string", "string"), ("ilike", "string", "string"), ("=", "unknown", "string"),
    ("<>", "integer", "unknown"), ("like", "unknown", "string"), ("=", "boolean", "boolean"),
]
INVALID = [
    ("<", "string", "string"), (">", "boolean", "boolean"), ("=", "string", "integer"), ("like", "integer", "string"),
    ("<", "unknown", "integer"), (">=", "timestamp", "string"), ("=", "null", "string"), ("ilike", "timestamp", "string"),
]


@pytest.mark.parametrize("op, left, right", VALID)
def test_valid_types(op, left, right):
    assert p.allowed(op, left, right)


@pytest.mark.parametrize("op, left, right", INVALID)
def test_invalid_types(op, left, right):
    assert not p.allowed(op, left, right)


@pytest.fixture
def objects(spark):
    rows = [
        ("o1", "b1", "photos/a.jpg", '{"upstream":{"size":10,"header":{"content_type":"image/jpeg"}},"user":{"score":1.5}}'),
        ("o2", "b1", "photos/b_.jpg", '{"upstream":{"size":200,"header":{"content_type":"image/png"}},"user":{"ok":true}}'),
        ("o3", "b2", "docs/readme.md", '{"upstream":{"size":3000},"user":{"note":null}}'),
    ]
    frame = spark.createDataFrame(rows, "id string, bucket_id string, key string, body string")
    at = F.lit("2026-06-26T00:00:00Z").cast("timestamp")
    return frame.select("id", "bucket_id", "key", F.parse_json("body").alias("attributes"), at.alias("created_at"), at.alias("updated_at"))


TYPES = {"upstream.size": "integer", "user.score": "float", "user.ok": "boolean"}


def ids(df):
    return sorted(r.id for r in df.collect())


def test_typed_search(objects):
    found = search(objects, lambda o: (o.attr("upstream.size") >= 200) & ~(o.field("key") == "docs/readme.md"), catalog=TYPES)
    assert ids(found) == ["o2"]
    assert ids(search(objects, lambda o: o.attr("user.ok") == True, catalog=TYPES)) == ["o2"]  # noqa: E712
    assert ids(search(objects, lambda o: o.attr("user.note").is_null())) == ["o1", "o2", "o3"]
    assert ids(search(objects, lambda o: o.attr("upstream.size").cast("int").between(5, 250))) == ["o1", "o2"]


def test_type_errors(objects):
    fields = p.ObjectFields(objects, TYPES)
    for build in (
        lambda: fields.field("key") < "b",
        lambda: fields.attr("upstream.size") == "10",
        lambda: fields.attr("unknown.path") > 5,
        lambda: fields.attr("upstream.size").like("1%"),
        lambda: fields.attr("upstream.size").between(1, "x"),
        lambda: fields.field("key").between("a", "b"),
        lambda: fields.field("created_at") + p.ts("2026-01-01"),
        lambda: p.interval("1 day") - p.interval("1 day"),
        lambda: fields.field("key").cast("integer"),
    ):
        with pytest.raises(TypeError):
            build()
    for build in (lambda: fields.field("size"), lambda: fields.field("key").isin(), lambda: fields.attr("a").cast("decimal"),
                  lambda: p.interval("-1 day"), lambda: p.interval("1 fortnight"), lambda: p.ts("2026-06-26 10:00"), lambda: p.ts("26.06.2026")):
        with pytest.raises(ValueError):
            build()


def test_timestamp_literals(one):
    assert one(F.unix_seconds(p.ts("2026-06-26").column)) == int(datetime(2026, 6, 26, tzinfo=timezone.utc).timestamp())
    assert one(F.unix_seconds(p.ts("2026-06-26T09:00:00+09:00").column)) == int(datetime(2026, 6, 26, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    "text, moved", [("90 seconds", "2026-01-31T00:01:30"), ("2 WEEKS", "2026-02-14T00:00:00"), ("1 month", "2026-02-28T00:00:00"), ("1 Year", "2027-01-31T00:00:00")]
)
def test_intervals(one, text, moved):
    shifted = (p.ts("2026-01-31") + p.interval(text)).column
    assert one(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss")) == moved
    assert one(F.date_format((p.interval(text) + p.ts("2026-01-31")).column, "yyyy-MM-dd'T'HH:mm:ss")) == moved


def test_scopes(objects):
    assert ids(objects.where(p.scope("b1", "photos/b_"))) == ["o2"]
    assert ids(objects.where(p.scope(["b1", "b2"], ["docs/", "photos/a"]))) == ["o1", "o3"]
    assert ids(objects.where(p.scope())) == ["o1", "o2", "o3"]
    assert ids(objects.where(p.key_contains("A.J"))) == ["o1"]
    assert [p.join_prefix(*x) for x in (("a/", "/b"), ("a", "b"), ("", "b"), ("a/", ""))] == ["a/b", "a/b", "b", "a/"]


def test_null_order(objects):
    ordered = search(objects, order_by=lambda o: [o.attr("user.score")], catalog=TYPES).collect()
    assert ordered[0].id == "o1"
    ordered = search(objects, order_by=lambda o: [o.attr("user.score").desc(), o.field("id")], catalog=TYPES).collect()
    assert [r.id for r in ordered] == ["o2", "o3", "o1"]


def test_pages(spark, objects):
    assert ordering.page(objects.orderBy("id"), None, -5).count() == 3
    assert [r.id for r in ordering.page(objects.orderBy("id"), 1, 1).collect()] == ["o2"]
    many = spark.range(2500).select(F.col("id"), F.lit("b").alias("bucket_id"), F.lpad(F.col("id").cast("string"), 5, "0").alias("key"))
    assert ordering.page(many, 1800).count() == 1800 and ordering.page(many).count() == 2500
    rest = ordering.page(many.where(ordering.after_key("b", "02000")).orderBy("bucket_id", "key"), 3)
    assert [r.id for r in rest.collect()] == [2001, 2002, 2003]


def test_bucket_by_name(spark, objects):
    buckets = spark.createDataFrame([("b1", "photos"), ("b2", "docs")], "id string, name string")
    assert ids(objects.where(p.in_bucket(buckets, "docs"))) == ["o3"]
    assert ids(objects.where(p.in_bucket(buckets, "nowhere"))) == []


def test_relations(spark, objects):
    edges = spark.createDataFrame([("o1", "o2", "duplicate"), ("o2", "o3", "derived")], "source_object_id string, target_object_id string, relation_type string")
    assert ids(rel.has_relation(objects, edges, "duplicate", "out")) == ["o1"]
    assert ids(rel.has_relation(objects, edges, "duplicate", "in")) == ["o2"]
    assert ids(rel.has_relation(objects, edges, "duplicate")) == ["o1", "o2"]
    assert ids(rel.lacks_relation(objects, edges, "derived", "any")) == ["o1"]
    tree = rel.relation_exists(edges, "derived", "in") | (F.col("id") == "o1")
    assert ids(objects.where(tree)) == ["o1", "o3"]
    with pytest.raises(ValueError):
        rel.has_relation(objects, edges, "derived", "sideways")
    plan = rel.has_relation(objects, edges, "duplicate")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_catalog_types(spark):
    catalog = spark.createDataFrame([("a", "integer"), ("b", "json"), ("c", "string")], "path string, value_type string")
    assert p.catalog_types(catalog, ["a", "b", "zzz"]) == {"a": "integer", "b": "unknown"}
