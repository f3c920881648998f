"""One key with a third of the rows: results stay whole and the work is split."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from stowage.operators import events as ops
from stowage.operators.relations import has_relation

T0 = datetime(2026, 6, 26, tzinfo=timezone.utc)
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def tight(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_key_is_split_in_lookups(tight):
    spark = tight
    n = F.col("id")
    key = F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), n.cast("string")))
    rows = spark.range(0, 30000, 1, 12).select(
        F.concat(F.lit("e"), F.md5(n.cast("string"))).alias("id"), F.lit("b").alias("bucket_id"), F.lit("ObjectRemoved:Delete").alias("event_name"),
        key.alias("object_key"), F.timestamp_seconds(n).alias("received_at"))
    objects = spark.range(0, 30000, 1, 4).select(
        F.concat(F.lit("o"), n.cast("string")).alias("id"), F.lit("b").alias("bucket_id"), F.when(n == 0, "hot").otherwise(F.concat(F.lit("k"), n.cast("string"))).alias("key"))
    buckets = spark.createDataFrame([("b",)], "id string")
    resolved = ops.resolve_events(rows, buckets, objects)
    found = resolved.collect()
    assert len(found) == 30000 and sum(r.object_id == "o0" for r in found) == 10000
    assert all(r.skip_reason is None for r in found)
    assert "skew=true" in resolved._jdf.queryExecution().executedPlan().toString()
    mutations = ops.coalesce_mutations(resolved)
    assert mutations.count() == 20001 and mutations.where("key = 'hot'").first().event_count == 10000


def test_hub_relations_are_reduced_before_the_join(tight):
    spark = tight
    edges = spark.range(5000).select(F.lit("hub").alias("source_object_id"), F.col("id").cast("string").alias("target_object_id"), F.lit("t").alias("relation_type"))
    objects = spark.createDataFrame([("hub",), ("7",), ("x",)], "id string")
    result = has_relation(objects, edges, "t")
    assert sorted(r.id for r in result.collect()) == ["7", "hub"]
    assert "HashAggregate" in result._jdf.queryExecution().executedPlan().toString()
