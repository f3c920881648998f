"""Typed operands over catalog rows: fields, attributes, literals and the comparisons their types allow."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions import documents as docs
from stowage.functions.hashing import partition_index
from stowage.schema import CAST_TYPES, PROMOTED

FIELDS = {
    "id": "string",
    "bucket_id": "string",
    "key": "string",
    "created_at": "timestamp",
    "updated_at": "timestamp",
}
NUMERIC = ("integer", "float")
_INTERVAL = re.compile(r"^(\d+)\s+(second|minute|hour|day|week|month|year)s?$", re.IGNORECASE)
_ZONED = re.compile(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")


def allowed(op: str, left: str, right: str) -> bool:
    """Whether ``op`` applies to the two types: ranges need numbers or times, patterns need strings."""
    if "null" in (left, right):
        return False
    if "unknown" in (left, right):
        return op in ("=", "<>", "like", "ilike")
    numbers = left in NUMERIC and right in NUMERIC
    if op in ("=", "<>"):
        return left == right or numbers
    if op in ("<", "<=", ">", ">="):
        return numbers or left == right == "timestamp"
    return op in ("like", "ilike") and left == right == "string"


class Operand:
    """A Column with its catalog type; comparing two of them yields a plain Column."""

    def __init__(self, column: Column, type_name: str, text: Column | None = None, strict: bool = True):
        self.column, self.type, self._text, self._strict = column, type_name, text, strict

    def cast(self, type_name: str) -> Operand:
        """Read an attribute as another type; only attributes can be cast."""
        target = CAST_TYPES.get(type_name.strip().lower())
        if target is None:
            raise ValueError(f"unsupported cast type {type_name!r}")
        if self._text is None:
            raise TypeError("only attributes and timestamp text can be cast")
        return Operand(docs.cast_text(self._text, target, self._strict), target, self._text, self._strict)

    def _compare(self, op: str, other, apply) -> Column:
        other = literal(other)
        if not allowed(op, self.type, other.type):
            raise TypeError(f"cannot apply {op} to {self.type} and {other.type}")
        return apply(self.column, other.column)

    def __eq__(self, other):
        return self._compare("=", other, lambda a, b: a == b)

    def __ne__(self, other):
        return self._compare("<>", other, lambda a, b: a != b)

    def __lt__(self, other):
        return self._compare("<", other, lambda a, b: a < b)

    def __le__(self, other):
        return self._compare("<=", other, lambda a, b: a <= b)

    def __gt__(self, other):
        return self._compare(">", other, lambda a, b: a > b)

    def __ge__(self, other):
        return self._compare(">=", other, lambda a, b: a >= b)

    __hash__ = None

    def _shift(self, other, sign: int, swapped: bool = False) -> Operand:
        other = literal(other)
        left, right = (other, self) if swapped else (self, other)
        if (left.type, right.type) == ("timestamp", "interval"):
            return Operand(left.column + right.column if sign > 0 else left.column - right.column, "timestamp")
        if sign > 0 and (left.type, right.type) == ("interval", "timestamp"):
            return Operand(right.column + left.column, "timestamp")
        raise TypeError(f"invalid arithmetic between {left.type} and {right.type}")

    def __add__(self, other):
        return self._shift(other, 1)

    def __radd__(self, other):
        return self._shift(other, 1, swapped=True)

    def __sub__(self, other):
        return self._shift(other, -1)

    def like(self, pattern: str) -> Column:
        return self._compare("like", pattern, lambda a, _: a.like(pattern))

    def ilike(self, pattern: str) -> Column:
        return self._compare("ilike", pattern, lambda a, _: a.ilike(pattern))

    def isin(self, *values) -> Column:
        if not values:
            raise ValueError("the value list is empty")
        operands = [literal(v) for v in values]
        for operand in operands:
            if not allowed("=", self.type, operand.type):
                raise TypeError(f"cannot apply in to {self.type} and {operand.type}")
        return self.column.isin(*[o.column for o in operands])

    def between(self, lower, upper) -> Column:
        lower, upper = literal(lower), literal(upper)
        same = lower.type == upper.type or (lower.type in NUMERIC and upper.type in NUMERIC)
        if not (same and allowed(">=", self.type, lower.type) and allowed("<=", self.type, upper.type)):
            raise TypeError(f"cannot apply between to {self.type}, {lower.type} and {upper.type}")
        return self.column.between(lower.column, upper.column)

    def is_null(self) -> Column:
        return self.column.isNull()

    def is_not_null(self) -> Column:
        return self.column.isNotNull()

    def asc(self) -> Column:
        return self.column.asc_nulls_last()

    def desc(self) -> Column:
        return self.column.desc_nulls_first()


def literal(value) -> Operand:
    """Python value as a typed operand; operands pass through."""
    if isinstance(value, Operand):
        return value
    if value is None:
        return Operand(F.lit(None), "null")
    if isinstance(value, bool):
        return Operand(F.lit(value), "boolean")
    if isinstance(value, int):
        return Operand(F.lit(value).cast("bigint"), "integer")
    if isinstance(value, float):
        return Operand(F.lit(value), "float")
    if isinstance(value, datetime):
        return Operand(_instant(value), "timestamp")
    if isinstance(value, str):
        return Operand(F.lit(value), "string")
    raise TypeError(f"no literal for {type(value).__name__}")


def _instant(value: datetime) -> Column:
    utc = value.astimezone(timezone.utc) if value.tzinfo else value
    return F.to_timestamp(F.lit(utc.strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"))


def ts(text: str) -> Operand:
    """Timestamp literal: a date means UTC midnight, anything else must be RFC 3339."""
    try:
        parsed = datetime.combine(date.fromisoformat(text), datetime.min.time()) if len(text) == 10 else None
        if parsed is None and _ZONED.match(text):
            parsed = datetime.fromisoformat(text)
    except ValueError:
        parsed = None
    if parsed is None:
        raise ValueError(f"invalid timestamp value {text!r}")
    return Operand(_instant(parsed), "timestamp")


def interval(text: str) -> Operand:
    """``N unit`` from seconds to years, singular or plural."""
    found = _INTERVAL.match(text.strip())
    if not found:
        raise ValueError(f"invalid interval {text!r}")
    count, unit = int(found.group(1)), found.group(2).upper()
    if unit == "WEEK":
        count, unit = 7 * count, "DAY"
    return Operand(F.expr(f"INTERVAL {count} {unit}"), "interval")


def now(at: datetime | None = None) -> Operand:
    """The current time, or the given one where results must repeat."""
    return Operand(F.current_timestamp() if at is None else _instant(at), "timestamp")


class ObjectFields:
    """Fields and attributes of an objects frame, with attribute types taken from a catalog."""

    def __init__(self, objects: DataFrame, catalog: Mapping[str, str] | None = None, strict: bool = True):
        self._columns, self._catalog, self._strict = set(objects.columns), catalog or {}, strict

    def field(self, name: str) -> Operand:
        if name not in FIELDS:
            raise ValueError(f"unknown field {name!r}")
        return Operand(F.col(name), FIELDS[name])

    def attr(self, path: str) -> Operand:
        """Attribute in its catalog type, or as text of unknown type. Promoted paths read the plain column."""
        known = self._catalog.get(path, "unknown")
        plain, stored = PROMOTED.get(path, (None, None))
        if plain in self._columns:
            text = F.col(plain) if stored == "string" else F.col(plain).cast("string")
            if known == stored:
                return Operand(F.col(plain), known, text, self._strict)
        else:
            text = docs.attr_text(F.col("attributes"), path)
        return Operand(docs.cast_text(text, known, self._strict), known, text, self._strict)


def catalog_types(catalog: DataFrame, paths: Iterable[str]) -> dict[str, str]:
    """Types of the named paths; at most one row per name comes back."""
    wanted = list(dict.fromkeys(paths))
    rows = catalog.where(F.col("path").isin(wanted)).select("path", "value_type").limit(len(wanted)).collect()
    return {r.path: "unknown" if r.value_type == "json" else r.value_type for r in rows}


def join_prefix(bucket_prefix: str, scope_prefix: str) -> str:
    """Bucket and scope prefix with exactly one slash between them."""
    if not bucket_prefix or not scope_prefix:
        return bucket_prefix or scope_prefix
    return bucket_prefix.removesuffix("/") + "/" + scope_prefix.removeprefix("/")


def scope(buckets: str | Iterable[str] = (), prefixes: str | Iterable[str] = ()) -> Column:
    """Any of the buckets and any of the literal key prefixes; an empty list means all."""
    buckets = [buckets] if isinstance(buckets, str) else list(buckets)
    prefixes = [prefixes] if isinstance(prefixes, str) else list(prefixes)
    condition = F.lit(True)
    if buckets:
        condition = condition & F.col("bucket_id").isin(buckets)
    if prefixes:
        condition = condition & reduce(lambda a, b: a | b, (F.col("key").startswith(p) for p in prefixes))
    return condition


def key_contains(text: str) -> Column:
    """Case-insensitive; ``%`` and ``_`` in the text are wildcards."""
    return F.col("key").ilike(f"%{text}%")


def content_type_is(objects: DataFrame, value: str) -> Column:
    return ObjectFields(objects).attr("upstream.header.content_type") == value


def in_partition(partitions: int, index: int) -> Column:
    return partition_index(F.col("key"), partitions) == index


def in_bucket(buckets: DataFrame, name: str) -> Column:
    """Bucket by name, usable inside any condition; an unknown name matches nothing."""
    return F.col("bucket_id") == buckets.where(F.col("name") == name).agg(F.min("id")).scalar()
