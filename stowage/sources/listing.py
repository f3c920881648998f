"""Saved listing pages (ListBucketResult XML): one row per object, and whether the pages of a bucket are all of them.

The pages of a listing are a linked list. Each names the cursor that it was asked for with and, while there is more, the
cursor of the page after it. A bucket's listing is complete if its pages are one chain: it starts at a page without a
cursor, every next cursor leads to a page, and it ends at a page that says there is no more. Pages on no such chain, be it
of another listing or a circle, make it incomplete, as does a page that was lost or came back as an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stowage.functions.text import parse_integer, parse_rfc3339
from stowage.session import cut_lineage
from stowage.sources.fence import fence

# The providers whose pages are understood.
PROVIDERS = ("aws", "r2", "b2", "gcp", "rustfs")

PAGE = (
    "Contents array<struct<Key: string, ETag: string, Size: string, LastModified: string, StorageClass: string>>,"
    " IsTruncated string, Marker string, ContinuationToken string, StartAfter string, Prefix string,"
    " NextMarker string, NextContinuationToken string"
)
CURSORS = {
    "marker": "Marker",
    "continuation_token": "ContinuationToken",
    "start_after": "StartAfter",
    "prefix": "Prefix",
    "next_marker": "NextMarker",
    "next_continuation_token": "NextContinuationToken",
}
FAILURE = "Code string, Message string"
KEEP_SPACES = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}


def parse_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (upstream, status, body, …) with objects, truncation, own and next cursors and an ``error``.

    ``marker``, ``continuation_token``, ``start_after`` and ``prefix`` are what the request asked for, as the page repeats it.

    A page is good as a whole or not at all: an HTTP status from 400 on, a size that is no integer or a time that is not
    RFC 3339 makes it an error.
    """
    parsed = pages.withColumn("_page", F.from_xml("body", PAGE, KEEP_SPACES)).withColumn(
        "_failure", F.from_xml("body", FAILURE)
    )

    def listed(entry):
        return F.struct(
            F.coalesce(entry["Key"], F.lit("")).alias("key"),
            F.coalesce(F.trim(entry["ETag"]), F.lit("")).alias("etag"),
            parse_integer(F.trim(entry["Size"])).alias("size"),
            parse_rfc3339(F.trim(entry["LastModified"])).alias("last_modified"),
            F.coalesce(F.trim(entry["StorageClass"]), F.lit("")).alias("storage_class"),
        )

    rows = F.coalesce(
        F.transform("_page.Contents", listed),
        F.array().cast(
            "array<struct<key: string, etag: string, size: bigint, last_modified: timestamp, storage_class: string>>"
        ),
    )
    failed = F.col("status") >= 400
    named = F.concat_ws(" ", "_failure.Code", "_failure.Message")
    error = (
        F.when(~F.col("upstream").isin(*PROVIDERS), F.concat(F.lit("unsupported upstream "), "upstream"))
        .when(failed & (named != ""), F.concat(F.lit("status "), F.col("status").cast("string"), F.lit(": "), named))
        .when(failed, F.concat(F.lit("status "), F.col("status").cast("string")))
        .when(F.exists("_objects", lambda o: o["size"].isNull()), "object size is malformed")
        .when(F.exists("_objects", lambda o: o["last_modified"].isNull()), "object time is malformed")
    )
    truncated = F.lower(F.trim(F.coalesce("_page.IsTruncated", F.lit("")))) == "true"
    staged = (
        parsed.withColumn("_objects", rows)
        .withColumns(
            {
                "error": error,
                "is_truncated": truncated,
                **{name: F.coalesce(f"_page.{element}", F.lit("")) for name, element in CURSORS.items()},
            }
        )
        .withColumn("objects", F.when(F.col("error").isNull(), F.col("_objects")))
        .drop("_page", "_failure", "_objects")
    )
    return fence(staged, ["error", "is_truncated", *CURSORS, "objects"])


def read_listing(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per listed object of every good page."""
    return parse_pages(pages).select(*keep, F.inline_outer("objects")).where("key IS NOT NULL")


def once_per_key(listing: DataFrame) -> DataFrame:
    """Listed objects with each key of a bucket once, as pages that were read twice do not give them; the newest counts."""
    rest = [c for c in listing.columns if c not in ("bucket_id", "key")]
    newest = F.max_by(F.struct(*rest), F.struct("last_modified", "etag"))
    return listing.groupBy("bucket_id", "key").agg(newest.alias("_row")).select("bucket_id", "key", "_row.*")


def listing_complete(pages: DataFrame, by: tuple[str, ...] = ("bucket_id",)) -> DataFrame:
    """Whether each bucket's pages were all read and one of them says there is no more.

    Both must hold for a complete listing, but a lost page goes unnoticed; :func:`listing_chains` follows the cursors, and
    it alone allows removals.
    """
    parsed = parse_pages(pages)
    return parsed.groupBy(*by).agg(
        (F.count_if(F.col("error").isNotNull()) == 0).alias("_read"), F.bool_or(~F.col("is_truncated")).alias("_end")
    ).select(*by, (F.col("_read") & F.col("_end")).alias("complete"))


# Fixed values of ``reason``, in the order in which they are looked for.
FAILED, PREFIXES, MANY_FIRST, NO_FIRST, FORK, BROKEN, CIRCLE = (
    "a page failed",
    "pages are of several prefixes",
    "several first pages",
    "no first page",
    "a cursor has two pages",
    "the chain does not reach an end",
    "pages lead in a circle",
)


def _page_links(pages: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Each distinct page as (own cursor, next cursor), by digest: no own cursor is the start, no next one the end.

    A truncated page without a cursor goes on after its last key, as version 1 listings do. ``StartAfter`` counts as a
    cursor: such a page is not the first of its bucket.
    """
    parsed = parse_pages(pages)
    filled = lambda *names: F.coalesce(*[F.nullif(F.col(name), F.lit("")) for name in names])
    last_key = F.when(F.size("objects") > 0, F.element_at("objects", -1)["key"])
    own = filled("continuation_token", "marker", "start_after")
    after = F.when(F.col("is_truncated"), F.coalesce(filled("next_continuation_token", "next_marker"), F.nullif(last_key, F.lit("")), F.lit("")))
    return parsed.select(
        *by, "error", "prefix", F.md5(own.cast("binary")).alias("own"), F.md5(after.cast("binary")).alias("next")
    )


def _page_sums(links: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per bucket what can be told without following the cursors. A page that was read twice is one page."""
    distinct = links.groupBy(*by, "own", "next").agg(
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count(F.lit(1)).alias("read"),
        F.min("prefix").alias("low"),
        F.max("prefix").alias("high"),
    )
    good = F.col("failed") == 0
    return distinct.groupBy(*by).agg(
        F.sum("read").alias("pages_read"),
        F.sum("failed").alias("pages_failed"),
        F.count_if(good).alias("pages"),
        F.count_if(good & F.col("own").isNull()).alias("first"),
        F.count_if(good & F.col("next").isNull()).alias("last"),
        F.min("low").alias("prefix"),
        (F.min("low") != F.max("high")).alias("mixed"),
    )


def _chained(links: DataFrame, sums: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, steps): how many pages the chain of a bucket's first page has, for those buckets where it ends.

    Pointer doubling: every page knows the cursor some pages ahead and how many those are, and both double with each
    join, so a bucket of n pages takes log2(n) joins. Keys are single pages, so a bucket with very many of them is spread
    like the others. Pages that have arrived at the end leave the join.
    """
    pages = links.where("error IS NULL").select(*by, "own", "next").distinct()
    jumps = cut_lineage(pages.select(*by, F.coalesce("own", F.lit("")).alias("page"), F.col("next").alias("ahead"), F.lit(1).cast("long").alias("steps")))
    longest = sums.agg(F.max("pages")).first()[0] or 0
    reach = 1
    while reach < longest:
        later = jumps.select(*by, F.col("page").alias("ahead"), F.col("ahead").alias("_then"), F.col("steps").alias("_more"), F.lit(True).alias("_met"))
        under_way = jumps.where("ahead IS NOT NULL").join(later, [*by, "ahead"], "left")
        # A cursor without a page leads nowhere, and its page never arrives.
        moved = under_way.where("_met").select(*by, "page", F.col("_then").alias("ahead"), (F.col("steps") + F.col("_more")).alias("steps"))
        jumps = cut_lineage(jumps.where("ahead IS NULL").unionByName(moved))
        reach *= 2
    return jumps.where("page = '' AND ahead IS NULL").select(*by, "steps")


def listing_chains(pages: DataFrame, by: tuple[str, ...] = ("bucket_id",)) -> DataFrame:
    """One row per bucket: pages, those read and failed, the prefix listed, whether the listing is complete, and the
    ``reason`` why not.

    Pages of several listings of one bucket need a column in ``by`` that tells them apart; else two chains are two first
    pages. A page that was read twice, with the same cursors, counts once. A failed page names no cursors, so it makes the
    listing incomplete even if it was read later. A null in a column of ``by`` is a bucket of its own.
    """
    keyed = _page_links(pages, by).withColumn("_bucket", F.md5(F.to_json(F.struct(*by)).cast("binary")))
    links = cut_lineage(keyed)
    sums = cut_lineage(_page_sums(links, ("_bucket", *by)))
    # Own cursors that two different pages have; a whole bucket of them is still one row per cursor.
    forks = links.where("error IS NULL").select("_bucket", "own", "next").distinct().groupBy("_bucket", "own").count().where("count > 1")
    forked = cut_lineage(forks.select("_bucket").distinct().withColumn("forked", F.lit(True)))
    single = (F.col("pages_failed") == 0) & (F.col("first") == 1) & (F.col("last") == 1) & ~F.col("mixed")
    sound = cut_lineage(sums.where(single).join(forked, "_bucket", "left_anti").select("_bucket", "pages"))
    followed = _chained(links.join(sound, "_bucket", "left_semi"), sound, ("_bucket",))
    joined = sums.join(forked, "_bucket", "left").join(followed, "_bucket", "left")
    reason = (
        F.when(F.col("pages_failed") > 0, FAILED)
        .when(F.col("mixed"), PREFIXES)
        .when(F.col("first") > 1, MANY_FIRST)
        .when(F.col("first") == 0, NO_FIRST)
        .when(F.col("forked"), FORK)
        .when((F.col("last") != 1) | F.col("steps").isNull(), BROKEN)
        .when(F.col("steps") != F.col("pages"), CIRCLE)
    )
    counts = ["pages", "pages_read", "pages_failed", "prefix"]
    return joined.select(*by, *counts, reason.isNull().alias("complete"), reason.alias("reason"))
