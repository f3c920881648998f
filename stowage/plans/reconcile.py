"""Bringing the catalog in step with a listing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions import documents as docs
from stowage.functions.evidence import EVIDENCE, overlay_evidence
from stowage.functions.text import format_rfc3339_nano
from stowage.operators.objects import KEY, new_object_id, with_promoted
from stowage.operators.predicates import in_partition, literal, scope
from stowage.operators.reconcile import Complete, compare, plan_counts, plan_mutations, without_unsure_removals
from stowage.schema import OBJECT_COLUMNS, PROMOTED


@dataclass(frozen=True)
class Reconciled:
    plan: DataFrame
    build: Callable[[], DataFrame]

    @cached_property
    def counts(self) -> DataFrame:
        return plan_counts(self.plan)

    @cached_property
    def snapshot(self) -> DataFrame:
        return self.build()


def _scope(bucket_id: str, prefix: str, partition: tuple[int, int] | None) -> Column:
    inside = scope(bucket_id or (), prefix or ())
    return inside if partition is None else inside & in_partition(*partition)


def reconcile(
    objects: DataFrame,
    listing: DataFrame,
    seen_at: datetime,
    complete: Complete = True,
    bucket_id: str = "",
    prefix: str = "",
    partition: tuple[int, int] | None = None,
    heads: DataFrame | None = None,
    run_id: str = "",
) -> Reconciled:
    """Plan, counts and new snapshot for the listed part of the catalog.

    ``complete`` may differ by bucket, see :func:`stowage.operators.reconcile.without_unsure_removals`.
    ``partition`` is (number of partitions, index). ``heads`` may bring captured documents by (bucket_id, key); the
    listing's own facts are laid over them. Rows outside the scope pass through unchanged.
    """
    inside = _scope(bucket_id, prefix, partition)
    scoped, listed = objects.where(inside), listing.where(inside)
    plan = plan_mutations(listed, scoped, complete)
    return Reconciled(plan, lambda: _apply(objects, inside, listed, seen_at, complete, heads, run_id))


def _apply(objects, inside, listing, seen_at, complete, heads, run_id) -> DataFrame:
    """The same full outer join carrying whole rows, with each action applied where its row is."""
    stamp = literal(seen_at).column
    nothing = F.to_variant_object(docs.empty_map())
    carried = [c for c in OBJECT_COLUMNS if c not in ("id", *KEY)]
    rows = compare(listing, objects.where(inside), carried)
    rows = without_unsure_removals(rows, complete, keep=True)
    captured = nothing
    if heads is not None:
        rows = rows.join(heads.select(*KEY, F.col("attributes").alias("captured")), KEY, "left")
        captured = F.coalesce("captured", nothing)
    row_id = F.coalesce("id", new_object_id(F.col("bucket_id"), F.col("key")))
    written = F.col("action").isin("import", "refresh")
    # Documents are built in steps, each a column of its own, so that no step is computed twice.
    rows = rows.withColumn("facts", F.when(written, overlay_evidence(captured, *[F.col(n) for n in EVIDENCE])))
    seen = format_rfc3339_nano(stamp)
    rows = rows.withColumn("fresh", F.when(written, docs.with_core(F.col("facts"), row_id, seen)))
    merged = docs.merge_attributes(F.col("old_attributes"), F.col("fresh"), row_id)
    old_provenance = F.coalesce("old_attribute_provenance", F.create_map().cast("map<string,string>"))
    provenance = docs.overlay(old_provenance, F.create_map(F.lit("upstream"), F.lit(run_id)))
    snapshot = rows.select(
        row_id.alias("id"),
        *KEY,
        F.when(F.col("action") == "import", F.col("fresh"))
        .when(F.col("action") == "refresh", merged)
        .otherwise(F.col("old_attributes"))
        .alias("attributes"),
        F.when(written, provenance).otherwise(F.col("old_attribute_provenance")).alias("attribute_provenance"),
        F.coalesce("old_created_at", stamp).alias("created_at"),
        F.when(written, stamp).otherwise(F.col("old_updated_at")).alias("updated_at"),
    )
    snapshot = snapshot.unionByName(objects.where(~inside).select(*OBJECT_COLUMNS))
    promoted = {name for name, _ in PROMOTED.values()}
    return with_promoted(snapshot) if promoted & set(objects.columns) else snapshot
