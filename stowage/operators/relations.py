"""Directed, typed relations between objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DUPLICATE = "duplicate"
EDGE = ["source_object_id", "target_object_id", "relation_type"]


def related_ids(relations: DataFrame, relation_type: str, direction: str = "any") -> DataFrame:
    """Ids at the chosen end of the relations of one type, once each.

    Making the ids distinct first keeps a hub with very many edges from landing whole in one join task.
    """
    typed = relations.where(F.col("relation_type") == relation_type)
    ends = {"out": [F.col("source_object_id")], "in": [F.col("target_object_id")]}
    ends["any"] = ends["out"] + ends["in"]
    if direction not in ends:
        raise ValueError(f"unsupported relation direction {direction!r}")
    ids = ends[direction]
    column = ids[0] if len(ids) == 1 else F.explode(F.array(*ids))
    return typed.select(column.alias("related_id")).distinct()


def has_relation(objects: DataFrame, relations: DataFrame, relation_type: str, direction: str = "any") -> DataFrame:
    ids = related_ids(relations, relation_type, direction)
    return objects.join(ids, F.col("id") == F.col("related_id"), "left_semi")


def lacks_relation(objects: DataFrame, relations: DataFrame, relation_type: str, direction: str = "any") -> DataFrame:
    ids = related_ids(relations, relation_type, direction)
    return objects.join(ids, F.col("id") == F.col("related_id"), "left_anti")


def relation_exists(relations: DataFrame, relation_type: str, direction: str = "any") -> Column:
    """The same test as a condition that can stand inside AND, OR and NOT."""
    ids = related_ids(relations, relation_type, direction)
    return ids.where(F.col("related_id") == F.col("id").outer()).exists()


def relation_types(relations: DataFrame) -> DataFrame:
    return relations.select("relation_type").distinct().orderBy("relation_type")


def upsert_relations(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (source, target, type).

    The first row keeps its creation time and any further columns, the newest brings attributes and run id. Edges from an
    object to itself are dropped, and an empty type means a duplicate.
    """
    further = [c for c in stored.columns if c not in (*EDGE, "attributes", "created_by_run_id", "created_at", "updated_at")]
    kind = F.coalesce(F.when(F.col("relation_type") != "", F.col("relation_type")), F.lit(DUPLICATE))
    fresh = incoming.withColumn("relation_type", kind).where("source_object_id <> target_object_id")
    rows = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    order = F.struct("_new", "updated_at", "created_by_run_id")
    first = F.struct("_new", "created_at")
    return rows.groupBy(*EDGE).agg(
        F.max_by("attributes", order).alias("attributes"),
        F.max_by("created_by_run_id", order).alias("created_by_run_id"),
        F.min_by("created_at", first).alias("created_at"),
        F.max_by("updated_at", order).alias("updated_at"),
        *[F.min_by(c, first).alias(c) for c in further],
    )


def duplicate_relations_between(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Duplicate relations with both ends among ``ids`` (one column, ``id``)."""
    inside = ids.select(F.col("id").alias("_member")).distinct()
    typed = relations.where(F.col("relation_type") == DUPLICATE)
    both = typed.join(inside, F.col("source_object_id") == F.col("_member"), "left_semi")
    return both.join(inside, F.col("target_object_id") == F.col("_member"), "left_semi")


def drop_duplicate_relations(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """The relations without the duplicate ones that lie wholly among ``ids``."""
    gone = duplicate_relations_between(relations, ids).select(*EDGE)
    return relations.join(gone, EDGE, "left_anti")
