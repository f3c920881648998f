"""Keeping the attribute catalog in step with a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stowage.operators.attributes import merge_catalog, observe_attributes


def observe_catalog(objects: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new catalog, conflicting paths) after looking at every document."""
    merged = merge_catalog(catalog, observe_attributes(objects))
    columns = ["path", "value_type", "source"]
    kept = merged.where("NOT (conflict AND value_type IS NULL)").select(*columns)
    return kept, merged.where("conflict").select(*columns)
