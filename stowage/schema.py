"""Column layouts of the catalog tables."""

from __future__ import annotations

from pyspark.sql import types as T

TIMESTAMP = T.TimestampType()
STRING = T.StringType()
LONG = T.LongType()
VARIANT = T.VariantType()

OBJECT = T.StructType(
    [
        T.StructField("id", STRING),
        T.StructField("bucket_id", STRING),
        T.StructField("key", STRING),
        T.StructField("attributes", VARIANT),
        T.StructField("attribute_provenance", T.MapType(STRING, STRING)),
        T.StructField("created_at", TIMESTAMP),
        T.StructField("updated_at", TIMESTAMP),
    ]
)
OBJECT_COLUMNS = OBJECT.fieldNames()

# Attribute paths kept as plain columns beside the document, so that filters on them reach the Parquet scan.
PROMOTED = {
    "upstream.etag": ("etag", "string"),
    "upstream.size": ("size", "integer"),
    "upstream.last_modified": ("last_modified", "string"),
    "upstream.header.content_type": ("content_type", "string"),
    "upstream.s3.storage_class": ("storage_class", "string"),
    "extracted.content_sha256": ("content_sha256", "string"),
}

LISTED = T.StructType(
    [
        T.StructField("bucket_id", STRING),
        T.StructField("key", STRING),
        T.StructField("etag", STRING),
        T.StructField("size", LONG),
        T.StructField("last_modified", TIMESTAMP),
        T.StructField("storage_class", STRING),
    ]
)

RELATION = T.StructType(
    [
        T.StructField("source_object_id", STRING),
        T.StructField("target_object_id", STRING),
        T.StructField("relation_type", STRING),
        T.StructField("attributes", T.MapType(STRING, STRING)),
        T.StructField("created_by_run_id", STRING),
        T.StructField("created_at", TIMESTAMP),
        T.StructField("updated_at", TIMESTAMP),
    ]
)

CATALOG_ENTRY = T.StructType(
    [T.StructField("path", STRING), T.StructField("value_type", STRING), T.StructField("source", STRING)]
)

NORMALIZED_EVENT = T.StructType(
    [
        T.StructField("upstream", STRING),
        T.StructField("action", STRING),
        T.StructField("event_name", STRING),
        T.StructField("event_source", STRING),
        T.StructField("bucket_name", STRING),
        T.StructField("bucket_arn", STRING),
        T.StructField("region", STRING),
        T.StructField("deployment_id", STRING),
        T.StructField("key", STRING),
        T.StructField("etag", STRING),
        T.StructField("size", LONG),
        T.StructField("event_time", TIMESTAMP),
        T.StructField("event_id", STRING),
        T.StructField("version_id", STRING),
    ]
)

STORED_EVENT = T.StructType(
    [
        T.StructField("id", STRING),
        T.StructField("bucket_id", STRING),
        T.StructField("event_name", STRING),
        T.StructField("object_key", STRING),
        T.StructField("envelope", STRING),
        T.StructField("dedupe_key", STRING),
        T.StructField("transport", STRING),
        T.StructField("state", STRING),
        T.StructField("error_message", STRING),
        T.StructField("event_time", TIMESTAMP),
        T.StructField("received_at", TIMESTAMP),
        T.StructField("processed_at", TIMESTAMP),
    ]
)

# The inbox as it is stored: one folder per micro-batch.
INGEST = "ingest_batch"
INBOX = T.StructType([*STORED_EVENT.fields, T.StructField(INGEST, LONG)])

JOB_RUN = T.StructType(
    [
        T.StructField("id", STRING),
        T.StructField("trace_id", STRING),
        T.StructField("type", STRING),
        T.StructField("state", STRING),
        T.StructField("requested_by_type", STRING),
        T.StructField("requested_by_id", STRING),
        T.StructField("target_type", STRING),
        T.StructField("target_id", STRING),
        T.StructField("input", VARIANT),
        T.StructField("result", VARIANT),
        T.StructField("progress", VARIANT),
        T.StructField("locked_by", STRING),
        T.StructField("finished_at", TIMESTAMP),
        T.StructField("created_at", TIMESTAMP),
        T.StructField("updated_at", TIMESTAMP),
    ]
)

# Attribute definitions every catalog starts with.
BUILTIN_ATTRIBUTES = {
    "upstream.size": "integer",
    "upstream.last_modified": "timestamp",
    "upstream.header.content_type": "string",
    "upstream.s3.version_id": "string",
    "core.first_seen_at": "timestamp",
    "core.last_seen_at": "timestamp",
    "core.object_id": "string",
}
REGISTERED_ATTRIBUTES = {"extracted.content_sha256": "string"}

# Names accepted by a cast, and the type each stands for.
CAST_TYPES = {
    "text": "string",
    "varchar": "string",
    "string": "string",
    "integer": "integer",
    "int": "integer",
    "bigint": "integer",
    "float": "float",
    "real": "float",
    "double": "float",
    "boolean": "boolean",
    "bool": "boolean",
    "timestamp": "timestamp",
    "timestamptz": "timestamp",
    "date": "timestamp",
}

SPARK_TYPES = {
    "string": "string",
    "unknown": "string",
    "integer": "bigint",
    "float": "double",
    "boolean": "boolean",
    "timestamp": "timestamp",
}
