"""Scopes that are tables: any of many buckets and any of many key prefixes, in a plan that does not grow with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def prefix_lengths(prefixes: DataFrame) -> list[int]:
    """The distinct lengths of some prefixes; a key has some thousand characters at most, and so has this list."""
    return sorted(row[0] for row in prefixes.select(F.length("prefix")).where("prefix IS NOT NULL").distinct().collect())


def starts(text: Column, lengths: list[int]) -> Column:
    """The beginnings of ``text`` of the given lengths, those that it is long enough for."""
    long_enough = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(text))
    return F.transform(long_enough, lambda n: F.left(text, n))


def least_prefixes(prefixes: DataFrame) -> DataFrame:
    """The distinct prefixes that no shorter one of them covers; no text begins with two of these."""
    distinct = prefixes.select("prefix").where("prefix IS NOT NULL").distinct()
    lengths = prefix_lengths(distinct)
    if len(lengths) < 2:
        return distinct
    shorter = F.filter(starts(F.col("prefix"), lengths), lambda start: start != F.col("prefix"))
    begun = distinct.select("prefix", F.explode(shorter).alias("start"))
    covered = begun.join(distinct.select(F.col("prefix").alias("start")), "start").select("prefix").distinct()
    return distinct.join(covered, "prefix", "left_anti")


def in_scope(objects: DataFrame, buckets: DataFrame | None = None, prefixes: DataFrame | None = None) -> DataFrame:
    """Objects of any of the buckets (bucket_id) and with any of the literal key prefixes (prefix).

    An absent or empty table means all, and the empty prefix is one that every key has. The plan is the same for ten
    prefixes and a hundred thousand: a key's beginnings of the lengths that occur meet the prefixes in one equi-join, and as
    covered prefixes are dropped before, a key meets one at most. Spark broadcasts the tables while they are small.
    """
    rows = objects
    if buckets is not None and buckets.limit(1).count():
        rows = rows.join(buckets.select("bucket_id").distinct(), "bucket_id", "left_semi").select(*objects.columns)
    if prefixes is not None:
        least = least_prefixes(prefixes)
        lengths = prefix_lengths(least)
        if lengths:
            begun = rows.withColumn("_start", F.explode(starts(F.col("key"), lengths)))
            rows = begun.join(least.withColumnRenamed("prefix", "_start"), "_start", "left_semi").select(*rows.columns)
    return rows
