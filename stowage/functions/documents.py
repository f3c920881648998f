"""Attribute documents: reading by path, building, merging, editing and typing VARIANT values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, functions as F

from stowage.functions.text import RFC3339, parse_boolean, parse_float, parse_integer
from stowage.schema import CAST_TYPES, SPARK_TYPES

VARIANT_MAP = "map<string,variant>"


def split_path(path: str) -> list[str]:
    """Dotted path to segments; empty segments do not count."""
    segments = [s for s in path.split(".") if s]
    if not segments:
        raise ValueError("attribute path is empty")
    return segments


def _quoted(segment: str) -> str:
    if '"' not in segment:
        return f'["{segment}"]'
    if "'" not in segment:
        return f"['{segment}']"
    raise ValueError(f"attribute path segment {segment!r} mixes both kinds of quotes")


def value_at(document: Column, segments: Sequence[str], as_type: str = "variant") -> Column:
    """The value at some object keys, whatever is in their names."""
    if any('"' in segment and "'" in segment for segment in segments):
        # Such a name has no VARIANT path.
        found = reduce(lambda value, segment: F.element_at(as_map(value), F.lit(segment)), segments, document)
        return F.try_variant_get(found, "$", as_type)
    return F.try_variant_get(document, "$" + "".join(map(_quoted, segments)), as_type)


def variant_paths(path: str) -> list[str]:
    """VARIANT paths for a dotted path; a numeric segment is tried as an object key, then as an array index."""
    choices = [[_quoted(s)] + ([f"[{int(s)}]"] if s.isdecimal() else []) for s in split_path(path)]
    return ["$" + "".join(steps) for steps in product(*choices)]


def _read(document: Column, path: str, as_type: str) -> Column:
    reads = [F.try_variant_get(document, p, as_type) for p in variant_paths(path)]
    return reads[0] if len(reads) == 1 else F.coalesce(*reads)


def attr_text(document: Column, path: str) -> Column:
    """The value at ``path`` as text; a missing path and a JSON null both read as NULL."""
    return _read(document, path, "string")


def attr_value(document: Column, path: str) -> Column:
    return _read(document, path, "variant")


def cast_text(text: Column, type_name: str, strict: bool = True) -> Column:
    """Text as one of the catalog's types. A value that does not fit fails the query, or is NULL unless ``strict``."""
    target = SPARK_TYPES[CAST_TYPES.get(type_name.strip().lower(), type_name)]
    return text.cast(target) if strict else text.try_cast(target)


def attr(document: Column, path: str, type_name: str = "string", strict: bool = True) -> Column:
    return cast_text(attr_text(document, path), type_name, strict)


def none_if_empty(entries: Column) -> Column:
    return F.get(F.filter(F.array(entries), lambda m: F.size(m) > 0), 0)


def variant_object(children: Mapping[str, Column], base: Column | None = None) -> Column:
    """VARIANT object of the non-NULL children laid over an optional map; NULL when nothing is left."""
    parts = []
    if base is not None:
        parts.append(F.coalesce(F.transform_values(base, lambda _, v: v.cast("variant")), empty_map()))
    if children:
        entries = [x for name, value in children.items() for x in (F.lit(name), value.cast("variant"))]
        parts.append(F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()))
    return F.to_variant_object(none_if_empty(parts[0] if len(parts) == 1 else overlay(*parts)))


def as_map(document: Column) -> Column:
    """Top level of an object as a map; NULL for anything that is not an object."""
    return F.try_variant_get(document, "$", VARIANT_MAP)


def empty_map() -> Column:
    return F.from_json(F.lit("{}"), VARIANT_MAP)


def overlay(below: Column, above: Column) -> Column:
    """Shallow merge of two maps; keys of ``above`` win, which the session's map key policy sees to."""
    return F.map_concat(below, above)


def merge_attributes(old: Column, new: Column, object_id: Column) -> Column:
    """Shallow merge of two documents with the ``core`` namespace rebuilt.

    The object id and the first time seen stay with the old document, the last time seen moves to the new one.
    """
    core = variant_object(
        {
            "object_id": object_id,
            "first_seen_at": F.coalesce(attr_text(old, "core.first_seen_at"), attr_text(new, "core.first_seen_at")),
            "last_seen_at": attr_text(new, "core.last_seen_at"),
        }
    )
    merged = overlay(F.coalesce(as_map(old), empty_map()), F.coalesce(as_map(new), empty_map()))
    return F.to_variant_object(overlay(merged, F.create_map(F.lit("core"), core)))


def with_core(document: Column, object_id: Column, seen_at: Column) -> Column:
    """Document with ``core`` stamped; a first time seen that is already there stays."""
    core = F.coalesce(as_map(attr_value(document, "core")), empty_map())
    stamp = variant_object(
        {
            "object_id": object_id,
            "first_seen_at": F.coalesce(attr_text(document, "core.first_seen_at"), seen_at),
            "last_seen_at": seen_at,
        }
    )
    stamped = F.to_variant_object(overlay(core, as_map(stamp)))
    return F.to_variant_object(
        overlay(F.coalesce(as_map(document), empty_map()), F.create_map(F.lit("core"), stamped))
    )


def _set(node: Column, segments: list[str], value: Column) -> Column:
    below = F.coalesce(as_map(node), empty_map())
    head, rest = segments[0], segments[1:]
    child = value.cast("variant") if not rest else _set(F.element_at(below, F.lit(head)), rest, value)
    return F.to_variant_object(overlay(below, F.create_map(F.lit(head), child)))


def set_path(document: Column, path: str, value: Column) -> Column:
    """Put ``value`` at ``path``, creating parents and replacing parents that are not objects."""
    return _set(document, split_path(path), value)


def _delete(node: Column, segments: list[str]) -> Column:
    """The node without the path; NULL when that empties it."""
    below, head, rest = as_map(node), segments[0], segments[1:]
    others = F.map_filter(below, lambda k, _: k != head)
    if not rest:
        kept = others
    else:
        child = F.element_at(below, F.lit(head))
        edited = _delete(child, rest)
        replaced = F.when(edited.isNotNull(), overlay(below, F.create_map(F.lit(head), edited))).otherwise(others)
        kept = F.when(as_map(child).isNull(), below).otherwise(replaced)
    return F.when(below.isNull(), node).when(F.size(kept) > 0, F.to_variant_object(kept))


def delete_path(document: Column, path: str) -> Column:
    """Drop ``path`` and every parent that is empty afterwards; the root object itself stays."""
    return F.coalesce(_delete(document, split_path(path)), F.to_variant_object(empty_map()))


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT<")


def infer_type(value: Column, kind: Column | None = None) -> Column:
    """Catalog type of a leaf; NULL for a JSON null. A whole number is an integer however it is written.

    ``kind`` is the value's own schema where the caller has it as a column already.
    """
    kind = F.schema_of_variant(value) if kind is None else kind
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind.startswith("OBJECT<") | kind.startswith("ARRAY<"), "unknown")
        .when(kind == "BOOLEAN", "boolean")
        .when(numeric & (number == F.floor(number)), "integer")
        .when(numeric, "float")
        .when((kind == "STRING") & text.rlike(RFC3339) & text.try_cast("timestamp").isNotNull(), "timestamp")
        .when(kind == "STRING", "string")
    )


def widen_pair(existing: Column, incoming: Column) -> Column:
    """The type that holds both, or 'conflict'; a side that is NULL gives way to the other."""
    numeric = ("integer", "float")
    return (
        F.when(existing.isNull(), incoming)
        .when(incoming.isNull() | (existing == incoming), existing)
        .when(existing == "unknown", incoming)
        .when(incoming == "unknown", existing)
        .when(existing.isin(*numeric) & incoming.isin(*numeric), "float")
        .otherwise("conflict")
    )


def widen_types(types: Column) -> Column:
    """Fold of :func:`widen_pair` over a set of types."""
    known = F.array_distinct(F.filter(types, lambda t: t.isNotNull() & (t != "unknown")))
    numeric = F.size(F.array_except(known, F.array(F.lit("integer"), F.lit("float")))) == 0
    return (
        F.when(F.size(known) == 0, "unknown")
        .when(F.size(known) == 1, F.get(known, 0))
        .when(numeric, "float")
        .otherwise("conflict")
    )


def coerce(text: Column, type_name: str) -> Column:
    """Captured text as the VARIANT its rule declares; NULL where it does not fit."""
    readers = {"integer": parse_integer, "float": parse_float, "boolean": parse_boolean}
    return readers.get(type_name, lambda c: c)(text).cast("variant")


def path_prefixes(path: Column) -> Column:
    """Every proper prefix of a dotted path."""
    parts = F.split(path, r"\.")
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")),
    ).otherwise(F.array().cast("array<string>"))


def promoted_columns(document: Column, paths: Iterable[str] | None = None) -> dict[str, Column]:
    """The plain columns kept beside a document, read from it."""
    from stowage.schema import PROMOTED

    wanted = list(PROMOTED) if paths is None else list(paths)
    return {PROMOTED[p][0]: attr(document, p, PROMOTED[p][1], strict=False) for p in wanted}
