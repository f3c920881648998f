"""Bucketed snapshots: joins by bucket and key read them without a shuffle, and what they make can be written as it is."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from stowage.operators.objects import upsert_objects
from stowage.plans.reconcile import reconcile
from stowage.sources.tables import open_bucketed, write_bucketed
from stowage.schema import OBJECT_COLUMNS

T0 = datetime(2026, 6, 26, tzinfo=timezone.utc)
BUCKETS = 8


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    ids = spark.range(2000)
    key = F.concat(F.lit("k/"), F.col("id"))
    upstream = F.struct(F.md5(key).alias("etag"), F.col("id").alias("size"))
    objects = ids.select(
        F.concat(F.lit("o"), "id").alias("id"), F.concat(F.lit("b"), F.col("id") % 3).alias("bucket_id"), key.alias("key"),
        F.to_variant_object(F.struct(upstream.alias("upstream"))).alias("attributes"),
        F.create_map().cast("map<string,string>").alias("attribute_provenance"), F.lit(T0).alias("created_at"), F.lit(T0).alias("updated_at"),
    )
    path = str(tmp_path_factory.mktemp("tables") / "v1")
    return write_bucketed(objects, "catalog_v1", path, BUCKETS), path, objects


def exchanges_over(frame, table):
    """The exchanges of a plan that have the scan of ``table`` below them."""
    lines = frame._jdf.queryExecution().executedPlan().toString().split("\n")
    found, above = [], []
    for line in lines:
        depth = len(re.match(r"[\s:+\-*()\d]*", line)[0])
        above = [(d, text) for d, text in above if d < depth] + [(depth, line)]
        if table in line and "Scan" in line:
            found += [text.strip() for _, text in above if "Exchange" in text]
            found.append("scan")
    assert "scan" in found
    return [text for text in found if text != "scan"]


@pytest.fixture
def shuffled(spark):
    """Joins as with large tables: nothing small enough to be broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def listing(spark):
    rows = spark.range(100, 2100)
    return rows.select(
        F.concat(F.lit("b"), F.col("id") % 3).alias("bucket_id"), F.concat(F.lit("k/"), F.col("id")).alias("key"), F.md5("key").alias("etag"),
        F.col("id").alias("size"), F.lit(T0).alias("last_modified"), F.lit("").alias("storage_class"),
    )


def test_reconcile_and_upsert_do_not_shuffle_the_catalog(spark, stored, shuffled):
    table, _, objects = stored
    done = reconcile(table, listing(spark), T0 + timedelta(hours=1))
    assert exchanges_over(done.plan, "catalog_v1") == []
    assert exchanges_over(done.snapshot, "catalog_v1") == []
    batch = listing(spark).select("bucket_id", "key", F.parse_json(F.lit('{"user":{"a":1}}')).alias("attributes"),
                                  F.create_map(F.lit("user"), F.lit("r")).alias("attribute_provenance"), F.lit(0).alias("ordinal"))
    merged = upsert_objects(table, batch, T0)
    assert exchanges_over(merged, "catalog_v1") == []
    plain = upsert_objects(objects, batch, T0)
    pick = lambda df: sorted((r.id, r.bucket_id, r.key, str(r.doc)) for r in df.withColumn("doc", F.to_json("attributes")).select("id", "bucket_id", "key", "doc").collect())
    assert pick(merged) == pick(plain)


def test_a_new_snapshot_is_written_where_it_stands(spark, stored, shuffled, tmp_path):
    table, _, objects = stored
    done = reconcile(table, listing(spark), T0 + timedelta(hours=1), run_id="r")
    path = str(tmp_path / "v2")
    second = write_bucketed(done.snapshot, "catalog_v2", path, BUCKETS, arrange=False)
    files = spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().count()
    assert files <= BUCKETS
    plain = reconcile(objects, listing(spark), T0 + timedelta(hours=1), run_id="r").snapshot
    assert sorted((r.bucket_id, r.key) for r in second.select("bucket_id", "key").collect()) == sorted((r.bucket_id, r.key) for r in plain.select("bucket_id", "key").collect())
    again = reconcile(second, listing(spark), T0 + timedelta(hours=2))
    assert exchanges_over(again.plan, "catalog_v2") == [] and again.plan.count() == reconcile(plain, listing(spark), T0 + timedelta(hours=2)).plan.count()


def test_another_session_finds_the_table(spark, stored):
    table, path, _ = stored
    spark.sql("CREATE DATABASE IF NOT EXISTS elsewhere")
    opened = open_bucketed(spark, "elsewhere.catalog", path)
    assert opened.columns == table.columns and opened.count() == table.count()
    assert "Bucketed: true" in opened.select("bucket_id", "key").groupBy("bucket_id", "key").count()._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert set(OBJECT_COLUMNS) <= set(opened.columns)
