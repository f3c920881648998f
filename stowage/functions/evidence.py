"""What a listing says about an object, and how it meets the attribute document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions import documents as docs
from stowage.functions.text import blank_to_null, format_rfc3339
from stowage.schema import PROMOTED

EVIDENCE = ["etag", "size", "last_modified", "storage_class"]


def evidence(objects: DataFrame) -> dict[str, Column]:
    """Etag, size, last-modified text and storage class of a catalog row, from plain columns where they exist."""
    found = {}
    for path, (name, kind) in PROMOTED.items():
        if name not in EVIDENCE:
            continue
        plain = name in objects.columns
        found[name] = F.col(name) if plain else docs.attr(F.col("attributes"), path, kind, strict=False)
    return found


def listed_evidence(listing: DataFrame) -> DataFrame:
    """Listing rows with last-modified as the text the catalog keeps."""
    return listing.withColumn("last_modified", format_rfc3339(F.col("last_modified")))


def changed(listed: dict[str, Column], local: dict[str, Column]) -> Column:
    """Whether a listed object differs from its catalog row. A missing etag or time always counts as a change."""
    same = (
        local["etag"].eqNullSafe(listed["etag"])
        & (F.coalesce(local["size"], F.lit(0)) == F.coalesce(listed["size"], F.lit(0)))
        & local["last_modified"].eqNullSafe(listed["last_modified"])
        & (F.coalesce(local["storage_class"], F.lit("")) == F.coalesce(listed["storage_class"], F.lit("")))
        & local["etag"].isNotNull()
        & local["last_modified"].isNotNull()
    )
    return ~same


def _upstream(etag: Column, size: Column, last_modified: Column, below: Column | None, s3: Column) -> Column:
    return docs.variant_object(
        {"etag": blank_to_null(etag), "size": size, "last_modified": blank_to_null(last_modified), "s3": s3}, below
    )


def listed_attributes(etag: Column, size: Column, last_modified: Column, storage_class: Column) -> Column:
    """Smallest document for a listed object; empty and zero values are left out."""
    s3 = docs.variant_object({"storage_class": blank_to_null(storage_class)})
    upstream = _upstream(etag, F.when(size != 0, size), last_modified, None, s3)
    return F.to_variant_object(
        F.create_map(F.lit("upstream"), F.coalesce(upstream, F.to_variant_object(docs.empty_map())))
    )


def overlay_evidence(
    attributes: Column, etag: Column, size: Column, last_modified: Column, storage_class: Column
) -> Column:
    """Captured document with the non-empty listing facts laid over its ``upstream`` part."""
    below = F.coalesce(docs.as_map(docs.attr_value(attributes, "upstream")), docs.empty_map())
    s3_below = F.coalesce(docs.as_map(F.element_at(below, F.lit("s3"))), docs.empty_map())
    s3 = F.when(
        blank_to_null(storage_class).isNotNull(),
        docs.variant_object({"storage_class": blank_to_null(storage_class)}, s3_below),
    )
    upstream = _upstream(etag, F.when(size > 0, size), last_modified, below, s3)
    whole = F.coalesce(docs.as_map(attributes), docs.empty_map())
    part = F.create_map(F.lit("upstream"), F.coalesce(upstream, F.to_variant_object(docs.empty_map())))
    return F.to_variant_object(docs.overlay(whole, part))
