"""Difference between a bucket listing and the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.evidence import EVIDENCE, changed, evidence, listed_evidence
from stowage.operators.objects import KEY


def _listed(listing: DataFrame) -> DataFrame:
    return listed_evidence(listing).select(*KEY, *EVIDENCE)


def _local(objects: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    named = [column.alias(f"local_{name}") for name, column in evidence(objects).items()]
    return objects.select("id", *KEY, *named, *[F.col(c).alias(f"old_{c}") for c in carry])


def _changed() -> Column:
    return changed({n: F.col(n) for n in EVIDENCE}, {n: F.col(f"local_{n}") for n in EVIDENCE})


def plan_imports(listing: DataFrame, objects: DataFrame) -> DataFrame:
    """Listed, not in the catalog."""
    rows = _listed(listing).join(objects.select(*KEY), KEY, "left_anti")
    return rows.select(F.lit("import").alias("action"), "bucket_id", F.lit("").alias("id"), "key", *EVIDENCE)


def plan_refreshes(listing: DataFrame, objects: DataFrame) -> DataFrame:
    """In both, and different."""
    rows = _listed(listing).join(_local(objects), KEY).where(_changed())
    return rows.select(F.lit("refresh").alias("action"), "bucket_id", "id", "key", *EVIDENCE)


def plan_removals(listing: DataFrame, objects: DataFrame, scope: Column | None = None) -> DataFrame:
    """In the catalog's scope, not listed."""
    inside = objects if scope is None else objects.where(scope)
    return inside.select("id", *KEY).join(listing.select(*KEY), KEY, "left_anti")


def compare(listing: DataFrame, objects: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One full outer join by key with the action for each row; NULL where nothing is to be done.

    ``carry`` names catalog columns to bring along, each as ``old_<name>``.
    """
    listed = _listed(listing).withColumn("_listed", F.lit(True))
    local = _local(objects, carry).withColumn("_known", F.lit(True))
    action = (
        F.when(F.col("_known").isNull(), "import")
        .when(F.col("_listed").isNull(), "remove")
        .when(_changed(), "refresh")
    )
    return listed.join(local, KEY, "full").withColumn("action", action)


Complete = bool | DataFrame


def without_unsure_removals(compared: DataFrame, complete: Complete, keep: bool = False) -> DataFrame:
    """``compared`` without the removals that its listing does not allow.

    ``complete`` is one answer for all buckets, or a row per bucket (bucket_id, complete) as
    :func:`stowage.sources.listing.listing_chains` gives them; with a ``prefix`` only keys below it are covered. A bucket
    without a row is not complete. With ``keep`` it is the other way round: removals that are allowed go, the rest stays.
    """
    removal = F.coalesce(F.col("action") == "remove", F.lit(False))
    if isinstance(complete, bool):
        return compared.where(~removal) if complete == keep else compared
    prefix = F.coalesce("prefix", F.lit("")) if "prefix" in complete.columns else F.lit("")
    sure = complete.where("complete").select("bucket_id", prefix.alias("_prefix"), F.lit(True).alias("_sure"))
    # Several rows of one bucket, as of several prefixes, must not double the rows they meet.
    covers = sure.groupBy("bucket_id").agg(F.collect_set("_prefix").alias("_prefixes"))
    covered = F.coalesce(F.exists("_prefixes", lambda p: F.startswith(F.col("key"), p)), F.lit(False))
    return compared.join(covers, "bucket_id", "left").where(~removal | (~covered if keep else covered)).drop("_prefixes")


def plan_mutations(listing: DataFrame, objects: DataFrame, complete: Complete = True) -> DataFrame:
    """Imports, refreshes and removals at once. A bucket whose listing did not finish plans no removals."""
    planned = without_unsure_removals(compare(listing, objects).where(F.col("action").isNotNull()), complete)
    return planned.select("action", "bucket_id", F.coalesce("id", F.lit("")).alias("id"), "key", *EVIDENCE)


def plan_counts(plan: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("action") == a).alias(f"{a}_objects_count") for a in ("import", "refresh", "remove")]
    return plan.agg(*counts)
