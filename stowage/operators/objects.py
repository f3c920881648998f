"""Set-oriented reads and writes of catalog rows. Each write maps an old snapshot and changes to a new snapshot."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions import documents as docs
from stowage.functions.text import format_rfc3339_nano
from stowage.operators.predicates import literal, scope
from stowage.schema import OBJECT_COLUMNS, PROMOTED

KEY = ["bucket_id", "key"]


def count_in_scope(objects: DataFrame, condition: Column | None = None) -> DataFrame:
    rows = objects if condition is None else objects.where(condition)
    return rows.agg(F.count(F.lit(1)).alias("object_count"))


def rows_for_keys(objects: DataFrame, bucket_id: str, keys: DataFrame) -> DataFrame:
    """Catalog rows of one bucket whose key is listed in ``keys``."""
    return objects.where(F.col("bucket_id") == bucket_id).join(keys.select("key"), "key", "left_semi")


def new_object_id(bucket_id: Column, key: Column) -> Column:
    """Id that a retried task computes again; a random one would differ between attempts."""
    return F.concat(F.lit("object_"), F.md5(F.concat_ws("\x00", bucket_id, key)))


def with_promoted(objects: DataFrame) -> DataFrame:
    """Objects with the plain columns read anew from the document."""
    return objects.withColumns(docs.promoted_columns(F.col("attributes")))


def last_per_key(batch: DataFrame) -> DataFrame:
    """One row per key: the highest ordinal."""
    rest = [c for c in batch.columns if c not in (*KEY, "ordinal")]
    last = F.max_by(F.struct(*rest), "ordinal").alias("_row")
    return batch.groupBy(*KEY).agg(last).select(*KEY, "_row.*")


def upsert_objects(objects: DataFrame, batch: DataFrame, seen_at: datetime) -> DataFrame:
    """Objects with ``batch`` merged in by (bucket_id, key), in one full join of the two.

    ``batch`` has bucket_id, key, attributes, attribute_provenance, ordinal and optionally id. Namespaces present in the
    new document replace the old ones whole, the id and the first time seen stay, provenance maps merge.
    """
    stamp = literal(seen_at).column
    rows = last_per_key(batch)
    fresh_id = new_object_id(F.col("bucket_id"), F.col("key"))
    rows = rows.withColumn("id", F.coalesce("id", fresh_id) if "id" in rows.columns else fresh_id)
    nothing = F.create_map().cast("map<string,string>")
    rows = rows.select(
        *KEY,
        F.col("id").alias("_id"),
        docs.with_core(F.col("attributes"), F.col("id"), format_rfc3339_nano(stamp)).alias("_attributes"),
        F.coalesce("attribute_provenance", nothing).alias("_provenance"),
    )
    touched, known = F.col("_id").isNotNull(), F.col("_known").isNotNull()
    merged = docs.merge_attributes(F.col("attributes"), F.col("_attributes"), F.col("id"))
    overlaid = docs.overlay(F.coalesce("attribute_provenance", nothing), F.col("_provenance"))
    old = objects.select(*OBJECT_COLUMNS, F.lit(True).alias("_known"))
    result = old.join(rows, KEY, "full").select(
        F.when(known, F.col("id")).otherwise(F.col("_id")).alias("id"),
        *KEY,
        F.when(~known, F.col("_attributes")).when(touched, merged).otherwise(F.col("attributes")).alias("attributes"),
        F.when(~known, F.col("_provenance"))
        .when(touched, overlaid)
        .otherwise(F.col("attribute_provenance"))
        .alias("attribute_provenance"),
        F.when(known, F.col("created_at")).otherwise(stamp).alias("created_at"),
        F.when(touched, stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    promoted = {name for name, _ in PROMOTED.values()}
    return with_promoted(result) if promoted & set(objects.columns) else result


def delete_objects(objects: DataFrame, removals: DataFrame) -> DataFrame:
    """Objects without the ids in ``removals``; rows without an id remove nothing."""
    ids = removals.where(F.coalesce("id", F.lit("")) != "").select("id").distinct()
    return objects.join(ids, "id", "left_anti")


def deletion_counts(objects: DataFrame, removals: DataFrame) -> DataFrame:
    """objects_deleted and objects_skipped; a removal without an id is skipped."""
    named = F.coalesce("id", F.lit("")) != ""
    hit = objects.select("id").join(removals.where(named).select("id"), "id", "left_semi")
    deleted = hit.agg(F.count(F.lit(1)).alias("n")).select(F.col("n").alias("objects_deleted"), F.lit(0).alias("s"))
    skipped = removals.agg(F.count_if(~named).alias("s")).select(F.lit(0).alias("objects_deleted"), "s")
    return deleted.union(skipped).agg(
        F.sum("objects_deleted").alias("objects_deleted"), F.sum("s").alias("objects_skipped")
    )


def delete_unseen(objects: DataFrame, bucket_id: str, seen_before: datetime, prefix: str = "") -> DataFrame:
    """Objects without those of one bucket and prefix last seen strictly before the given time."""
    last_seen = docs.attr(F.col("attributes"), "core.last_seen_at", "timestamp")
    gone = scope(bucket_id, prefix or ()) & (last_seen < literal(seen_before).column)
    return objects.where(~F.coalesce(gone, F.lit(False)))
