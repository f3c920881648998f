"""Objects that may be, or are, copies of one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.evidence import evidence
from stowage.functions import documents as docs
from stowage.functions.text import parse_rfc3339
from stowage.session import cut_lineage

GROUP = ["etag", "size"]


def cached_hash(size: Column, content_sha256: Column) -> Column:
    """A stored hash, usable only where the size is known to be positive and the hash is not empty."""
    return F.when((size > 0) & (content_sha256 != ""), content_sha256)


def candidates(objects: DataFrame, scope: Column | None = None) -> DataFrame:
    """Objects in scope with an etag and a size, reduced to what duplicate detection needs."""
    rows = objects if scope is None else objects.where(scope)
    facts = evidence(rows)
    plain = "content_sha256" in rows.columns
    stored = F.col("content_sha256") if plain else docs.attr_text(F.col("attributes"), "extracted.content_sha256")
    return rows.select(
        "id",
        "bucket_id",
        "key",
        facts["etag"].alias("etag"),
        facts["size"].alias("size"),
        facts["last_modified"].alias("last_modified"),
        cached_hash(facts["size"], stored).alias("cached_sha256"),
    ).where("etag IS NOT NULL AND etag <> '' AND size IS NOT NULL")


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(etag, size) shared by more than one candidate, with the number of members."""
    return rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("member_count")).where("member_count > 1")


def duplicate_members(rows: DataFrame) -> DataFrame:
    """Candidates whose (etag, size) is shared.

    The groups are counted first and written, so that the join shuffles two plain tables and Spark can split a group that
    holds a large part of the rows.
    """
    return rows.join(cut_lineage(duplicate_groups(rows)), GROUP)


def modified_or_first(last_modified: Column) -> Column:
    """Modification time; a missing or unreadable one counts as the earliest."""
    return F.coalesce(parse_rfc3339(last_modified), F.lit("0001-01-01T00:00:00Z").cast("timestamp"))


def group_original(last_modified: Column, object_id: Column) -> Column:
    """Aggregate: id of the earliest member, the smallest id among equals."""
    return F.min_by(object_id, F.struct(modified_or_first(last_modified), object_id))


def all_hashes_match(sha256: Column) -> Column:
    """Aggregate: every member has a hash and they are one and the same."""
    known = sha256.isNotNull() & (sha256 != "")
    return (F.count_if(known) == F.count(F.lit(1))) & (F.min(sha256) == F.max(sha256))


def group_summary(members: DataFrame) -> DataFrame:
    """Per group: members, original, common hash, and whether it is verified, mismatched or still lacks a hash."""
    missing = F.count_if(F.col("sha256").isNull() | (F.col("sha256") == ""))
    summary = members.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("member_count"),
        group_original(F.col("last_modified"), F.col("id")).alias("original_id"),
        F.min("sha256").alias("content_sha256"),
        all_hashes_match(F.col("sha256")).alias("verified"),
        missing.alias("missing_hashes"),
    )
    state = F.when(F.col("verified"), "verified").when(F.col("missing_hashes") > 0, "unresolved").otherwise("mismatched")
    return summary.withColumn("state", state)


def verified_groups(members: DataFrame) -> DataFrame:
    return group_summary(members).where("verified").select(*GROUP, "member_count", "original_id", "content_sha256")
