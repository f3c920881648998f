"""The attribute catalog: types observed in documents, widened over time, and edits that respect them."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stowage.functions import documents as docs
from stowage.schema import BUILTIN_ATTRIBUTES, CATALOG_ENTRY, REGISTERED_ATTRIBUTES
from stowage.session import cut_lineage

USER_NAMESPACE = "user"
LEAF_TYPES = ("string", "integer", "float", "boolean", "timestamp")


def document_depth(documents: DataFrame, column: str = "attributes") -> int:
    """Levels of nesting in the deepest document: one number from one pass over the documents.

    Documents of the same shape are made one before the shuffle, and only shapes are measured.
    """
    shapes = documents.select(F.schema_of_variant(F.col(column)).alias("shape")).distinct()
    schema = F.col("shape")
    # Only structure matters: quoted names are cut out before brackets are counted.
    marks = F.split(F.regexp_replace(F.regexp_replace(schema, "`[^`]*`", ""), "[^<>]", ""), "")
    walked = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("top")),
        lambda s, m: F.struct(
            (s["at"] + F.when(m == "<", 1).when(m == ">", -1).otherwise(0)).alias("at"),
            F.greatest(s["top"], s["at"] + F.when(m == "<", 1).otherwise(0)).alias("top"),
        ),
        lambda s: s["top"],
    )
    return shapes.agg(F.max(walked).alias("depth")).first().depth or 0


def flatten(
    documents: DataFrame, column: str = "attributes", keep: tuple[str, ...] = (), depth: int | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """(keep…, segments, value): one row per leaf. Arrays are leaves.

    Every level is one explode of the rows before it, without a shuffle. The depth is measured unless given. JSON nulls
    and empty objects are dropped unless ``keep_empty``.
    """
    levels = document_depth(documents, column) if depth is None else depth
    rows = documents.select(*keep, F.array().cast("array<string>").alias("segments"), F.col(column).alias("value"))
    for _ in range(levels):
        inner = F.when(docs.is_object(F.col("value")), F.col("value"))
        rows = rows.select(*keep, "segments", "value", inner.alias("_inner")).lateralJoin(
            documents.sparkSession.tvf.variant_explode_outer(F.col("_inner").outer()).select(
                F.col("key").alias("_key"), F.col("value").alias("_child")
            )
        ).select(
            *keep,
            F.when(F.col("_key").isNull(), F.col("segments"))
            .otherwise(F.concat("segments", F.array("_key")))
            .alias("segments"),
            F.when(F.col("_key").isNull(), F.col("value")).otherwise(F.col("_child")).alias("value"),
        )
    if keep_empty:
        return rows
    empty = docs.is_object(F.col("value")) | (F.schema_of_variant("value") == "VOID") | F.col("value").isNull()
    return rows.where(~empty)


# Flags of what a path's values are; ``unknown`` are arrays.
FLAGS = {"string": 1, "integer": 2, "float": 4, "boolean": 8, "timestamp": 16, "unknown": 32}
# Paths whose values one pass looks at.
PASS_PATHS = 200


def merged_schema(documents: DataFrame, column: str = "attributes") -> T.DataType | None:
    """One schema for all documents, from one reduced pass: structs for objects, VARIANT where values do not agree."""
    text = documents.agg(F.schema_of_variant_agg(F.col(column))).first()[0]
    if text is None:
        return None
    # Quoted names are left as they are.
    return T.DataType.fromDDL(re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], text))


def _schema_leaves(kind: T.DataType, segments: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    if not isinstance(kind, T.StructType):
        return [(segments, kind)] if segments else []
    return [leaf for field in kind.fields for leaf in _schema_leaves(field.dataType, (*segments, field.name))]


def _leaf_flags(document: Column, segments: tuple[str, ...], kind: T.DataType) -> Column:
    """The flag of the value at a path, 0 where there is none; only what the schema leaves open is looked at."""
    number = lambda value: F.when(value.isNull(), 0).when(value == F.floor(value), FLAGS["integer"]).otherwise(FLAGS["float"])
    if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
        return number(docs.value_at(document, segments, "double"))
    value = docs.value_at(document, segments)
    found = docs.infer_type(value)
    # An object under a path where others have values is looked at by itself.
    other = F.when(docs.is_object(value), 0)
    return F.coalesce(other, *[F.when(found == name, flag) for name, flag in FLAGS.items()], F.lit(0))


def _observed_leaves(documents: DataFrame, column: str, prefix: tuple[str, ...] = ()) -> dict[tuple[str, ...], int]:
    """Flags by path, for paths that some document has a value at."""
    schema = merged_schema(documents, column)
    if schema is None:
        return {}
    certain = {T.LongType: "integer", T.BooleanType: "boolean", T.ArrayType: "unknown"}
    found, open_paths, mixed = {}, [], []
    for segments, kind in _schema_leaves(schema):
        if type(kind) in certain:
            found[segments] = FLAGS[certain[type(kind)]]
        elif not isinstance(kind, T.NullType):
            open_paths.append((segments, kind))
            if isinstance(kind, T.VariantType):
                mixed.append(segments)
    document = F.col(column)
    for first in range(0, len(open_paths), PASS_PATHS):
        part = open_paths[first : first + PASS_PATHS]
        flags = documents.agg(*[F.bit_or(_leaf_flags(document, *leaf)).alias(f"_{n}") for n, leaf in enumerate(part)]).first()
        found |= {segments: flags[n] for n, (segments, _) in enumerate(part) if flags[n]}
    found = {(*prefix, *segments): flag for segments, flag in found.items()}
    for segments in mixed:
        inner = documents.select(docs.value_at(document, segments).alias("_inner")).where(docs.is_object(F.col("_inner")))
        found |= _observed_leaves(inner, "_inner", (*prefix, *segments))
    return found


def observe_attributes(documents: DataFrame, column: str = "attributes") -> DataFrame:
    """(path, value_type) over all documents; the type is 'conflict' where values do not fit together.

    The documents' merged schema tells all paths and most types in one reduced pass. A second one reads only the paths that
    it leaves open, numbers with decimals, texts that may be times, values of several types, each from its own Parquet
    column where documents are stored so, and folds them into one number per path. No leaf is exploded. Paths are a row
    each on the driver, as in the catalog that they go to.
    """
    leaves = _observed_leaves(documents, column)
    typed = [(".".join(segments), [t for t in LEAF_TYPES if flag & FLAGS[t]]) for segments, flag in leaves.items()]
    typed = documents.sparkSession.createDataFrame(typed, "path string, types array<string>")
    untyped = F.array().cast("array<string>").alias("types")
    parents = typed.select(F.explode(docs.path_prefixes(F.col("path"))).alias("path"), untyped)
    merged = typed.unionByName(parents).groupBy("path").agg(F.flatten(F.collect_set("types")).alias("types"))
    return merged.select("path", docs.widen_types(F.array_distinct("types")).alias("value_type"))


def merge_catalog(catalog: DataFrame, observed: DataFrame) -> DataFrame:
    """Catalog after an observation, with a ``conflict`` flag on rows whose types do not fit.

    Built-in and registered paths never change. A conflicting path keeps its old type, or none if it is new.
    """
    seen = observed.select("path", F.col("value_type").alias("_seen"))
    joined = catalog.select("path", "value_type", "source").join(seen, "path", "full")
    fixed = F.col("source").isin("builtin", "registered")
    widened = docs.widen_pair(F.col("value_type"), F.col("_seen"))
    new = F.col("source").isNull()
    result = (
        F.when(new, F.col("_seen")).when(fixed | F.col("_seen").isNull(), F.col("value_type")).otherwise(widened)
    )
    clash = F.coalesce((result == "conflict") | (F.col("_seen") == "conflict"), F.lit(False))
    conflict = ~F.coalesce(fixed, F.lit(False)) & clash
    return joined.select(
        "path",
        F.when(conflict, F.col("value_type")).otherwise(result).alias("value_type"),
        F.coalesce("source", F.lit("observed")).alias("source"),
        conflict.alias("conflict"),
    )


def seed_entries(spark: SparkSession, definitions: Mapping[str, str], source: str) -> DataFrame:
    return spark.createDataFrame([(p, t, source) for p, t in definitions.items()], CATALOG_ENTRY)


def seed_catalog(catalog: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Catalog with the given definitions, by default the built-in and registered ones.

    They replace each other but never an observed path.
    """
    if seeds is None:
        spark = catalog.sparkSession
        seeds = seed_entries(spark, BUILTIN_ATTRIBUTES, "builtin").unionByName(
            seed_entries(spark, REGISTERED_ATTRIBUTES, "registered")
        )
    new = seeds.select("path", F.col("value_type").alias("_type"), F.col("source").alias("_source"))
    joined = catalog.select("path", "value_type", "source").join(new, "path", "full")
    takes = F.col("_source").isNotNull() & (F.col("source").isNull() | F.col("source").isin("builtin", "registered"))
    return joined.select(
        "path",
        F.when(takes, F.col("_type")).otherwise(F.col("value_type")).alias("value_type"),
        F.when(takes, F.col("_source")).otherwise(F.col("source")).alias("source"),
    )


def _nested(entries: Column, level: int, depth: int) -> Column:
    """Document built from (segments, value) entries that share their first ``level`` segments."""
    at = F.lit(level + 1)
    names = F.array_distinct(F.transform(entries, lambda e: F.element_at(e["segments"], at)))

    def child(name: Column) -> Column:
        inside = F.filter(entries, lambda e: F.element_at(e["segments"], at) == name)
        leaf = F.get(inside, 0)
        if level + 1 >= depth:
            return F.struct(name.alias("key"), leaf["value"].alias("value"))
        deeper = F.when(F.size(leaf["segments"]) == level + 1, leaf["value"]).otherwise(_nested(inside, level + 1, depth))
        return F.struct(name.alias("key"), deeper.alias("value"))

    return F.to_variant_object(F.map_from_entries(F.transform(names, child)))


def edit_errors(edits: DataFrame, catalog: DataFrame, namespace: str = USER_NAMESPACE) -> DataFrame:
    """Edits with an ``error``: a path outside the namespace or malformed, or a value whose type does not fit."""
    rest = F.substring("path", len(namespace) + 2, 1 << 30)
    types = catalog.select("path", F.col("value_type").alias("_known"))
    joined = edits.withColumn("path", F.trim("path")).join(types, "path", "left")
    known = F.when(F.col("_known") == "json", "unknown").otherwise(F.col("_known"))
    clash = (F.col("op") == "set") & (docs.widen_pair(known, docs.infer_type(F.col("value"))) == "conflict")
    error = (
        F.when(F.col("path") == "", "path is required")
        .when(~F.col("path").startswith(f"{namespace}."), "path is outside the namespace")
        .when((rest == "") | rest.contains(".."), "path is invalid")
        .when(F.coalesce(clash, F.lit(False)), "type conflict")
    )
    return joined.withColumn("error", error).select(*edits.columns, "error")


def mutate_attributes(
    objects: DataFrame, edits: DataFrame, catalog: DataFrame, updated_at: Column, namespace: str = USER_NAMESPACE
) -> tuple[DataFrame, DataFrame]:
    """(objects after the edits, rejected edits).

    ``edits`` has id, op ('set' or 'delete'), path, value (VARIANT) and provenance. All edits of an object are rejected
    if one is. Sets go before deletes, and the sets of one object must not lie one below another; a delete also drops the
    parents it leaves empty. Only edited documents are taken apart into rows, and put together again with one shuffle by
    object.
    """
    # The edits, and later the rows of the edited documents, are written once: several steps read them.
    checked = cut_lineage(edit_errors(edits, catalog, namespace))
    bad = checked.where("error IS NOT NULL").select("id").distinct()
    rejected = checked.join(bad, "id", "left_semi")
    good = checked.join(bad, "id", "left_anti").withColumn("steps", F.filter(F.split("path", r"\."), lambda s: s != ""))
    sets = good.where("op = 'set'")
    deletes = good.where("op = 'delete'").select("id", F.col("steps").alias("_cut"))
    touched = objects.join(good.select("id").distinct(), "id", "left_semi").select("id", "attributes")
    depth = max(document_depth(touched), 1)
    leaves = flatten(touched, keep=("id",), depth=depth, keep_empty=True).where(F.size("segments") > 0)
    # A set takes the place of what is below its path and of any leaf above it.
    over = sets.select("id", F.col("steps").alias("_put"))
    survivors = leaves.join(
        over,
        (leaves["id"] == over["id"]) & (_starts("segments", "_put") | _starts("_put", "segments")),
        "left_anti",
    )
    new_depth = max(document_depth(sets, "value"), 0)
    written = flatten(
        sets.select("id", "steps", "value"), "value", ("id", "steps"), new_depth, keep_empty=True
    ).select("id", F.concat("steps", "segments").alias("segments"), "value")
    after_sets = survivors.unionByName(written)
    emptied = docs.is_object(F.col("value")) & _starts("_cut", "segments")
    remaining = cut_lineage(
        after_sets.join(
            deletes, (after_sets["id"] == deletes["id"]) & (_starts("segments", "_cut") | emptied), "left_anti"
        )
    )
    longest = remaining.agg(F.max(F.size("segments")).alias("n")).first().n or 1
    entries = F.collect_list(F.struct("segments", "value"))
    rebuilt = remaining.groupBy("id").agg(entries.alias("_entries")).select(
        "id", _nested(F.col("_entries"), 0, longest).alias("_document")
    )
    notes = good.groupBy("id").agg(
        F.map_from_entries(
            F.collect_set(F.when((F.col("op") == "set") & F.col("provenance").isNotNull(), F.struct("path", "provenance")))
        ).alias("_notes"),
        F.collect_set(F.when(F.col("op") == "delete", F.col("path"))).alias("_gone"),
    )
    joined = objects.join(notes, "id", "left").join(rebuilt, "id", "left")
    edited = F.col("_gone").isNotNull()
    provenance = docs.overlay(F.coalesce("attribute_provenance", F.create_map().cast("map<string,string>")), F.col("_notes"))
    provenance = F.map_filter(provenance, lambda k, _: ~F.array_contains(F.col("_gone"), k))
    result = joined.withColumns(
        {
            "attributes": F.when(edited, F.coalesce("_document", F.to_variant_object(docs.empty_map()))).otherwise(
                F.col("attributes")
            ),
            "attribute_provenance": F.when(edited, provenance).otherwise(F.col("attribute_provenance")),
            "updated_at": F.when(edited, updated_at).otherwise(F.col("updated_at")),
        }
    )
    return result.select(*objects.columns), rejected


def _starts(path: str, prefix: str) -> Column:
    """Whether the segments of ``path`` begin with those of ``prefix``."""
    return F.slice(F.col(path), F.lit(1), F.size(prefix)) == F.col(prefix)
