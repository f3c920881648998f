"""Duplicate detection by content."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions import documents as docs
from stowage.operators.duplicates import GROUP, candidates, duplicate_members, group_summary
from stowage.operators.objects import KEY, with_promoted
from stowage.operators.predicates import literal
from stowage.operators.relations import DUPLICATE, EDGE, upsert_relations
from stowage.schema import PROMOTED
from stowage.session import cut_lineage
from stowage.sources.contents import hash_column


@dataclass(frozen=True)
class Duplicates:
    groups: DataFrame
    edges: DataFrame
    broken: DataFrame
    relations: DataFrame
    hashes: DataFrame
    counts: DataFrame


def hash_members(members: DataFrame, contents: DataFrame) -> DataFrame:
    """Members with a hash: the stored one, else the one of their content.

    ``contents`` brings either the hashes (content_sha256, bytes_read) or the contents themselves (content). Contents are
    matched against the members without a stored hash first, so only those are hashed.
    """
    if "content" in contents.columns:
        wanted = members.where("cached_sha256 IS NULL").select(*KEY)
        contents = hash_column(contents.select(*KEY, "content").join(wanted, KEY, "left_semi"), F.col("content"))
    read = contents.select(*KEY, F.col("content_sha256").alias("_read"), F.col("bytes_read").alias("_bytes"))
    joined = members.join(read, KEY, "left")
    fresh = F.col("cached_sha256").isNull() & F.col("_read").isNotNull()
    return joined.select(
        *members.columns,
        F.coalesce("cached_sha256", "_read").alias("sha256"),
        fresh.alias("hashed"),
        F.when(fresh, F.col("_bytes")).otherwise(0).alias("bytes_hashed"),
    )


def duplicate_edges(hashed: DataFrame, groups: DataFrame, run_id: str, at: datetime) -> DataFrame:
    """Original to copy, for every verified group."""
    stamp = literal(at).column
    verified = groups.where("state = 'verified'").select(*GROUP, "original_id", "content_sha256")
    rows = hashed.select("id", *GROUP).join(verified, GROUP)
    attributes = F.create_map(
        F.lit("content_sha256"), F.col("content_sha256"), F.lit("etag"), F.col("etag"), F.lit("size"),
        F.col("size").cast("string"),
    )
    return rows.where("id <> original_id").select(
        F.col("original_id").alias("source_object_id"),
        F.col("id").alias("target_object_id"),
        F.lit(DUPLICATE).alias("relation_type"),
        attributes.alias("attributes"),
        F.lit(run_id).alias("created_by_run_id"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def broken_edges(hashed: DataFrame, groups: DataFrame, relations: DataFrame) -> DataFrame:
    """Stored duplicate relations inside a group whose contents turned out to differ."""
    rows = hashed.select("id", *GROUP).join(groups.where("state = 'mismatched'").select(*GROUP), GROUP)
    duplicates = relations.where(F.col("relation_type") == DUPLICATE)
    sources = rows.select(F.col("id").alias("source_object_id"), *[F.col(c).alias(f"_s_{c}") for c in GROUP])
    targets = rows.select(F.col("id").alias("target_object_id"), *[F.col(c).alias(f"_t_{c}") for c in GROUP])
    joined = duplicates.join(sources, "source_object_id").join(targets, "target_object_id")
    return joined.where("_s_etag = _t_etag AND _s_size = _t_size").select(relations.columns)


def detect_duplicates(
    objects: DataFrame,
    contents: DataFrame,
    relations: DataFrame,
    run_id: str,
    at: datetime,
    scope: Column | None = None,
) -> Duplicates:
    """Groups by (etag, size), verified by content hash.

    ``contents`` has bucket_id, key and either content, which is hashed where it must be, or content_sha256 and
    bytes_read. A verified group gets one relation from its original
    to each copy; a group whose hashes differ loses the relations inside it; a group with a hash missing is left alone.
    """
    members = duplicate_members(candidates(objects, scope))
    # Hashing reads object contents, so its small result is written once, as are the groups, and shared by what follows.
    hashed = cut_lineage(hash_members(members, contents))
    groups = cut_lineage(group_summary(hashed.drop("member_count")))
    edges = duplicate_edges(hashed, groups, run_id, at)
    broken = broken_edges(hashed, groups, relations)
    kept = relations.join(broken.select(*EDGE), EDGE, "left_anti")
    hashes = hashed.where("hashed").select("id", *KEY, F.col("sha256").alias("content_sha256"))
    return Duplicates(groups, edges, broken, upsert_relations(kept, edges), hashes, _counts(hashed, groups, broken))


def _counts(hashed: DataFrame, groups: DataFrame, broken: DataFrame) -> DataFrame:
    """The job's counters in one row, each summed where its rows are."""
    names = ["candidate_groups", "verified_groups", "relations_created", "objects_hashed", "bytes_hashed",
             "relations_removed"]
    verified = F.col("state") == "verified"
    parts = [
        groups.agg(
            F.count(F.lit(1)).alias(names[0]),
            F.count_if(verified).alias(names[1]),
            F.coalesce(F.sum(F.when(verified, F.col("member_count") - 1)), F.lit(0)).alias(names[2]),
        ),
        hashed.agg(
            F.count_if("hashed").alias(names[3]), F.coalesce(F.sum("bytes_hashed"), F.lit(0)).alias(names[4])
        ),
        broken.agg(F.count(F.lit(1)).alias(names[5])),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def apply_hashes(objects: DataFrame, hashes: DataFrame, run_id: str) -> DataFrame:
    """Objects with newly read hashes kept in their documents."""
    fresh = hashes.select("id", F.col("content_sha256").alias("_sha256"))
    found = F.col("_sha256").isNotNull()
    provenance = F.coalesce("attribute_provenance", F.create_map().cast("map<string,string>"))
    edited = docs.set_path(F.col("attributes"), "extracted.content_sha256", F.col("_sha256"))
    rows = objects.join(fresh, "id", "left").withColumns(
        {
            "attributes": F.when(found, edited).otherwise(F.col("attributes")),
            "attribute_provenance": F.when(
                found, docs.overlay(provenance, F.create_map(F.lit("extracted"), F.lit(run_id)))
            ).otherwise(F.col("attribute_provenance")),
        }
    )
    rows = rows.select(*objects.columns)
    promoted = {name for name, _ in PROMOTED.values()}
    return with_promoted(rows) if promoted & set(objects.columns) else rows
