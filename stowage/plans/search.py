"""Catalog search and saved predicates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from stowage.operators.ordering import page, sort_keys
from stowage.operators.predicates import ObjectFields, Operand

Predicate = Column | str | Callable[[ObjectFields], Column]


def _condition(where: Predicate, fields: ObjectFields) -> Column:
    if isinstance(where, str):
        return F.expr(where)
    return where(fields) if callable(where) and not isinstance(where, Column) else where


def search(
    objects: DataFrame,
    where: Predicate | None = None,
    order_by: Callable[[ObjectFields], Iterable[Operand | Column]] | Iterable[Operand | Column] = (),
    limit: int | None = None,
    offset: int = 0,
    scope: Column | None = None,
    catalog: Mapping[str, str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Scope, then predicate, then order, then offset and limit.

    ``where`` and ``order_by`` may be functions of :class:`ObjectFields`. No order is added that was not asked for, and
    without a limit all rows are found.
    """
    fields = ObjectFields(objects, catalog, strict)
    rows = objects if scope is None else objects.where(scope)
    if where is not None:
        rows = rows.where(_condition(where, fields))
    keys = sort_keys(order_by(fields) if callable(order_by) else order_by)
    if keys:
        rows = rows.orderBy(*keys)
    return page(rows, limit, offset)


def saved_predicate(collection_id: str, where: Predicate) -> tuple[str, Predicate]:
    """A named predicate: a Column, an SQL expression or a function of the object fields."""
    if not collection_id:
        raise ValueError("a saved predicate needs an id")
    return collection_id, where


def collection_members(
    objects: DataFrame, predicates: Iterable[tuple[str, Predicate]], catalog: Mapping[str, str] | None = None
) -> DataFrame:
    """(collection_id, object_id) for every predicate an object meets, from one scan of the objects."""
    fields = ObjectFields(objects, catalog)
    hits = [F.when(_condition(where, fields), F.lit(name)) for name, where in predicates]
    matched = F.filter(F.array(*hits), lambda c: c.isNotNull())
    return objects.select(F.explode(matched).alias("collection_id"), F.col("id").alias("object_id"))
