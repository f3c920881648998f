"""Predicate index, scopes that are tables, and digests of files, each against the plain form."""

from __future__ import annotations

import hashlib
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.operators.predicates import scope
from stowage.operators.scopes import in_scope, least_prefixes
from stowage.plans import collections as P
from stowage.plans.collections import Term, indexed_members, terms_table
from stowage.plans.search import collection_members
from stowage.sources import contents as C

T0 = datetime(2026, 6, 26, tzinfo=timezone.utc)
TYPES = {"upstream.size": "integer", "user.score": "float", "user.ok": "boolean", "user.at": "timestamp"}


@pytest.fixture(scope="module")
def objects(spark):
    i = F.col("id")
    odd = lambda c: F.when(i % 7 != 0, c)
    user = F.to_json(
        F.struct(
            odd((i % 40) / 4).alias("score"), odd(i % 2 == 0).alias("ok"), F.concat(F.lit("t"), i % 5).alias("team"),
            F.date_format(F.lit(T0) + F.make_dt_interval(i % 9), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        )
    )
    document = F.parse_json(F.concat(F.lit('{"upstream":{"size":'), i % 50, F.lit('},"user":'), user, F.lit("}")))
    return spark.range(400).select(
        F.concat(F.lit("o"), i).alias("id"), F.concat(F.lit("b"), i % 4).alias("bucket_id"),
        F.concat(F.lit("p"), i % 3, F.lit("/q"), i % 11, F.lit("/"), i).alias("key"), document.alias("attributes"),
        (F.lit(T0) + F.make_dt_interval(i % 30)).alias("created_at"), F.lit(T0).alias("updated_at"),
    )


def branch(terms):
    """The same predicate as one expression."""

    def where(o):
        met = F.lit(True)
        for t in terms:
            x = o.field(t.path) if t.path in ("id", "bucket_id", "key", "created_at") else o.attr(t.path)
            c, v = x.column, F.lit(t.value) if t.value is not None else None
            met = met & {
                "=": lambda: c == v, "!=": lambda: c != v, ">=": lambda: c >= v, ">": lambda: c > v, "<=": lambda: c <= v, "<": lambda: c < v,
                "prefix": lambda: c.startswith(t.value), "is null": lambda: c.isNull(), "is not null": lambda: c.isNotNull(),
            }[t.op]()
        return F.coalesce(met, F.lit(False))

    return where


def some_terms(random):
    at = T0 + timedelta(days=int(random.integers(0, 30)))
    number = int(random.integers(-2, 52))
    choices = [
        [Term("bucket_id", "=", f"b{random.integers(0, 6)}")], [Term("key", "prefix", f"p{random.integers(0, 4)}/q{random.integers(0, 3)}")],
        [Term("key", "prefix", "")], [Term("upstream.size", ">=", number), Term("upstream.size", "<", number + int(random.integers(-3, 20)))],
        [Term("upstream.size", ">", number)], [Term("upstream.size", "<=", number)], [Term("upstream.size", "=", number)],
        [Term("user.score", ">", number / 4), Term("user.score", "<=", number / 2)], [Term("user.ok", "=", bool(number % 2))], [Term("user.team", "!=", "t1")],
        [Term("user.score", "is null")], [Term("user.score", "is not null")], [Term("created_at", ">=", at), Term("created_at", "<", at + timedelta(days=4))],
        [Term("user.at", ">", at - timedelta(days=9))], [Term("user.missing", "is null")], [Term("user.missing", "=", "x")], [],
    ]
    picked = random.choice(len(choices), size=int(random.integers(1, 4)), replace=False)
    return [term for at in picked for term in choices[at]]


def test_index_equals_branches(spark, objects):
    random = np.random.default_rng(2)
    saved = [(f"c{n}", some_terms(random)) for n in range(60)]
    got = indexed_members(objects, terms_table(spark, saved), TYPES).collect()
    want = collection_members(objects, [(name, branch(terms)) for name, terms in saved], TYPES).collect()
    assert len(got) == len(set(map(tuple, got))) and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert indexed_members(objects, terms_table(spark, []), TYPES).collect() == []
    with pytest.raises(ValueError):
        Term("key", "like", "x").row("c")


def test_many_predicates_plan_in_seconds(spark, objects):
    random = np.random.default_rng(3)
    saved = [(f"c{n}", [Term("upstream.size", ">=", float(a)), Term("upstream.size", "<", float(a + 3)), Term("bucket_id", "!=", "b1")]) for n, a in enumerate(random.uniform(0, 50, 10_000))]
    started = time.perf_counter()
    found = indexed_members(objects, terms_table(spark, saved), TYPES)
    nodes = found._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert time.perf_counter() - started < 30 and nodes < 100
    sizes = [(int(r.id[1:]) % 50, r.bucket_id) for r in objects.select("id", "bucket_id").collect()]
    want = sum(a <= s < a + 3 for s, b in sizes if b != "b1" for a in [t[0].value for _, t in saved])
    assert found.count() == want


def test_keys_make_no_pair_that_is_not_a_hit(spark, objects, monkeypatch):
    """An equality and a range are one key: what meets is what holds, not all objects of the equal value."""
    saved = [(f"c{n}", [Term("bucket_id", "=", f"b{n % 4}"), Term("upstream.size", ">=", n % 50), Term("upstream.size", "<", n % 50 + 2)]) for n in range(200)]
    looked_at = []
    meetings = P._meetings
    monkeypatch.setattr(P, "_meetings", lambda rows, index: looked_at.append(meetings(rows, index)) or looked_at[0])
    found = indexed_members(objects, terms_table(spark, saved), TYPES)
    assert looked_at[0].count() == found.count() == 400 * 2 // 50 * 100 // 4 * 4 // 2


def test_pieces_of_hot_keys_meet_each_pair_once(spark, objects, monkeypatch):
    """Keys that all objects and predicates share are cut into a grid; repeated objects are objects of their own."""
    monkeypatch.setattr(P, "CHUNK", 16)
    monkeypatch.setattr(P, "TASK_PAIRS", 500)
    random = np.random.default_rng(5)
    every = [[], [Term("upstream.size", "<=", 60)], [Term("key", "prefix", "p"), Term("bucket_id", "!=", "b1")], [Term("bucket_id", "=", "b2"), Term("upstream.size", ">", -1)]]
    saved = [(f"c{n}", every[int(random.integers(0, 4))]) for n in range(70)]
    twice = objects.unionByName(objects.where("id < 'o2'"))
    got = indexed_members(twice, terms_table(spark, saved), TYPES).collect()
    want = collection_members(twice, [(name, branch(terms)) for name, terms in saved], TYPES).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_terms_given_as_a_table(spark, objects):
    """Several terms of one path and operation must all hold; a term without a value, or of no operation, never does."""
    rows = [
        ("both", "bucket_id", "=", "b1", None), ("both", "bucket_id", "=", "b2", None), ("one", "bucket_id", "=", "b1", None),
        ("one", "key", "prefix", "p1", None), ("one", "key", "prefix", "p1/q", None), ("one", "bucket_id", "!=", "b2", None), ("one", "bucket_id", "!=", "b3", None),
        ("nested", "key", "prefix", "p1/q1", None), ("nested", "key", "prefix", "p2", None), ("empty", "bucket_id", "=", None, None), ("empty_range", "upstream.size", ">", None, None),
        ("unknown", "key", "like", "p", None), ("tight", "upstream.size", ">", None, 3.0), ("tight", "upstream.size", ">=", None, 4.5), ("tight", "upstream.size", "<", None, 5.5),
        ("tight", "key", ">=", "p1", None), (None, "bucket_id", "=", "b1", None),
    ]
    got = {}
    for name, of in indexed_members(objects, spark.createDataFrame(rows, P.TERMS), TYPES).collect():
        got.setdefault(name, set()).add(of)
    keys = {r.id: (r.bucket_id, r.key, int(r.id[1:]) % 50) for r in objects.collect()}
    assert got == {
        "one": {i for i, (b, k, _) in keys.items() if b == "b1" and k.startswith("p1/q")},
        "tight": {i for i, (_, k, size) in keys.items() if size == 5 and k >= "p1"},
    }


def prefixes_of(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "prefix string")


@pytest.mark.parametrize("texts", [["p0/", "p0/q1", "p1/q10/", "zz", "p1/q1", "p1/q10/"], [""], ["", "p1"], [], [None, "p2/q3/"]])
def test_prefix_tables(spark, objects, texts):
    got = in_scope(objects, prefixes=prefixes_of(spark, texts)).select("id").collect()
    want = objects.where(scope(prefixes=[t for t in texts if t is not None])).select("id").collect()
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("count", [0, 1, 15, 16, 17, 255, 256, 257, 4097])
def test_slots_of_any_number_of_bounds(spark, count):
    numbers = [n * 1.5 for n in range(count)]
    bounds = P.Bounds(numbers)
    asked = sorted({x for at in (0, 1, 14, 15, 16, 17, 255, 256, 272, 4095, 4096, count - 1, count) for x in (at * 1.5, at * 1.5 - 0.5)}) + [None, 1e9]
    got = spark.createDataFrame([(x,) for x in asked], "x double").select("x", bounds.slot(F.col("x")).alias("slot")).collect()
    for row in got:
        below = sum(n < row.x for n in numbers) if row.x is not None else 0
        assert row.slot == 2 * below + (row.x in numbers)


def test_a_lookup_compares_with_few_bounds(spark):
    """The constants that a lookup goes through are short but for the last, of which it sees one step."""
    sizes = lambda n: spark.range(1).select(F.transform(P.Bounds([float(x) for x in range(n)]).steps, F.size)).first()[0]
    assert sizes(20_000) == [4, 78, 1250, 20_000] and sizes(16) == [16] and sizes(0) == [0]


def test_many_predicates_are_many_tasks(spark, objects, monkeypatch):
    """However little text they are."""
    tasks = []

    def cut(df, real=P.cut_lineage):
        if "node" in df.columns and "collection_id" in df.columns:
            tasks.append(df.rdd.getNumPartitions())
        return real(df)

    monkeypatch.setattr(P, "cut_lineage", cut)
    monkeypatch.setattr(P, "PREDICATES", 10)
    predicates = [(f"c{n}", [Term("upstream.size", ">=", n), Term("upstream.size", "<", n + 20)]) for n in range(45)]
    got = indexed_members(objects, terms_table(spark, predicates), TYPES).groupBy("collection_id").count().collect()
    size = objects.selectExpr("try_variant_get(attributes, '$.upstream.size', 'bigint') AS n").collect()
    want = {name: sum(r.n is not None and low <= r.n < low + 20 for r in size) for low, name in ((n, f"c{n}") for n in range(45))}
    assert tasks == [5] and {r.collection_id: r["count"] for r in got} == {name: n for name, n in want.items() if n}


def test_scope_tables(spark, objects):
    buckets = spark.createDataFrame([("b1",), ("b3",), ("b3",)], "bucket_id string")
    got = in_scope(objects, buckets, prefixes_of(spark, ["p0/", "p1/q1"])).select("id").collect()
    assert sorted(got) == sorted(objects.where(scope(["b1", "b3"], ["p0/", "p1/q1"])).select("id").collect())
    assert in_scope(objects, buckets.where("false")).count() == 400
    assert in_scope(objects, buckets).columns == objects.columns


def test_the_plan_does_not_grow_with_the_prefixes(spark, objects):
    many = spark.range(100_000).select(F.concat(F.lit("p1/q"), F.format_string("%05d", "id"), F.lit("/")).alias("prefix"))
    few = prefixes_of(spark, ["p1/q00001/"])
    sizes = [in_scope(objects, prefixes=p)._jdf.queryExecution().optimizedPlan().toString().count("\n") for p in (few, many)]
    assert sizes[1] <= sizes[0] + 5
    assert in_scope(objects, prefixes=many.unionByName(prefixes_of(spark, ["p1/q1", "p"]))).count() == 400
    assert [r.prefix for r in least_prefixes(many.unionByName(prefixes_of(spark, ["p1/q", "x"]))).orderBy("prefix").collect()] == ["p1/q", "x"]


def test_digests_of_any_size(spark, tmp_path):
    """A sparse file above what one value can hold, read in ranges."""
    size = (1 << 31) + 5
    with open(tmp_path / "large.bin", "wb") as file:
        file.truncate(size)
    (tmp_path / "small.bin").write_bytes(b"abc")
    zeros = hashlib.sha256()
    block = bytes(1 << 22)
    for start in range(0, size, len(block)):
        zeros.update(block[: min(len(block), size - start)])
    found = {r.path.rsplit("/", 1)[1]: r for r in C.hash_contents(spark, str(tmp_path / "*.bin")).collect()}
    assert (found["large.bin"].content_sha256, found["large.bin"].bytes_read, found["large.bin"].error) == (zeros.hexdigest(), size, None)
    assert (found["small.bin"].content_sha256, found["small.bin"].bytes_read) == (hashlib.sha256(b"abc").hexdigest(), 3)


def test_changed_and_lost_files_do_not_fail_the_others(spark, tmp_path):
    for name in ("grown", "gone", "same"):
        (tmp_path / f"{name}.bin").write_bytes(b"x" * 100_000)
    listed = spark.createDataFrame(C.list_files(spark, str(tmp_path / "*.bin")).collect())
    (tmp_path / "grown.bin").write_bytes(b"x" * 100_001)
    (tmp_path / "gone.bin").unlink()
    found = {r.path.rsplit("/", 1)[1]: r for r in C.hash_listed(listed, range_bytes=1000).collect()}
    assert found["same.bin"].content_sha256 == hashlib.sha256(b"x" * 100_000).hexdigest() and found["same.bin"].error is None
    assert found["grown.bin"].content_sha256 is None and found["grown.bin"].error == C.CHANGED
    assert found["gone.bin"].content_sha256 is None and found["gone.bin"].error
