"""Storage change notifications: seven envelopes, one JSON body per row, to normalized events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.documents import as_map, is_object
from stowage.functions.events import decode_key, decode_payload, event_action, event_provider
from stowage.functions.text import get_ci, parse_rfc3339
from stowage.schema import NORMALIZED_EVENT
from stowage.sources.fence import fence

# The fields each envelope carries.
RECORDS = (
    "array<struct<eventSource: string, awsRegion: string, eventName: string, eventTime: string,"
    " responseElements: map<string, string>, s3: struct<bucket: struct<name: string, arn: string>,"
    " object: struct<key: string, size: bigint, eTag: string, versionId: string>>>>"
)
EVENTBRIDGE = (
    "struct<time: string, region: string, detail: struct<bucket: struct<name: string>,"
    " object: struct<key: string, size: bigint, etag: string, `version-id`: string>>>"
)
B2_EVENTS = (
    "array<struct<eventId: string, eventTimestamp: bigint, eventType: string, bucketName: string,"
    " objectName: string, objectSize: bigint>>"
)
PUBSUB = "struct<attributes: map<string, string>, data: string>"
R2 = "struct<action: string, bucket: string, eventTime: string, object: struct<key: string, size: bigint, eTag: string>>"


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _time_error(text: Column, at: Column) -> Column:
    return F.when(_text(text) == "", "event time is empty").when(at.isNull(), "event time is malformed")


def _has(keys: Column, name: str) -> Column:
    return F.array_contains(keys, name)


def _inner(value: Column, keys: Column) -> Column:
    """What an envelope wraps: an object under ``body``, or the message of a topic notification; else the envelope."""
    below = F.try_variant_get(value, "$.body", "variant")
    wraps = _has(keys, "body") & ~_has(keys, "Records") & ~_has(keys, "records")
    notice = _has(keys, "Type") & (F.try_variant_get(value, "$.Type", "string") == "Notification")
    message = F.try_variant_get(value, "$.Message", "string")
    return (
        F.when(wraps & is_object(below), below)
        .when(notice & (F.trim(_text(message)) != ""), F.try_parse_json(message))
        .otherwise(value)
    )


def _top_keys(value: Column) -> Column:
    return F.map_keys(as_map(value))


def _unwrap(df: DataFrame, body: str) -> DataFrame:
    """``df`` with the innermost envelope in ``_value`` and its top-level keys in ``_keys``.

    A wrapper needs one of two words, so their number bounds the depth; most bodies have neither. Two levels are plain
    columns, which Spark compiles; the rare deeper body goes on in a loop of its own length.
    """
    text = F.col(body)

    def times(word: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)

    rounds, value, keys = F.col("_rounds"), F.col("_value"), F.col("_keys")
    staged = df.withColumns(
        {
            "_rounds": (times("body") + times("Message")).cast("int"),
            "_value": F.try_parse_json(text),
            "_keys": F.json_object_keys(text),
        }
    )
    for level in (1, 2):
        staged = staged.withColumn("_value", F.when(rounds >= level, _inner(value, keys)).otherwise(value))
        staged = staged.withColumn("_keys", F.when(rounds >= level, _top_keys(value)).otherwise(keys))
    more = F.sequence(F.lit(3), F.greatest(rounds, F.lit(3)))
    deepest = F.aggregate(more, value, lambda v, _: _inner(v, _top_keys(v)))
    staged = staged.withColumn("_value", F.when(rounds > 2, deepest).otherwise(value))
    return staged.withColumn("_keys", F.when(rounds > 2, _top_keys(value)).otherwise(keys))


def envelope_format(keys: Column) -> Column:
    """Envelope by its top-level keys; NULL for none of the known ones."""
    return (
        F.when(_has(keys, "Type"), "sns")
        .when(_has(keys, "detail-type"), "eventbridge")
        .when(_has(keys, "events"), "b2")
        .when(_has(keys, "message"), "gcp")
        .when(_has(keys, "action") & _has(keys, "bucket"), "r2")
        .when(_has(keys, "Records"), "s3")
        .when(_has(keys, "records"), "rustfs")
    )


# What the envelopes say about one event, as they write it; the same for all of them.
RAW = {
    "kind": "string", "name": "string", "source": "string", "time": "string", "millis": "bigint", "bucket": "string",
    "arn": "string", "region": "string", "deployment": "string", "key": "string", "etag": "string", "size": "bigint",
    "size_text": "string", "event_id": "string", "version": "string", "broken": "boolean", "unread": "boolean",
}


def _raw(kind: str, **fields: Column) -> Column:
    named = {"kind": F.lit(kind), **fields}
    return F.struct(*[named.get(n, F.lit(None)).cast(t).alias(n) for n, t in RAW.items()])


def _s3_raw(record: Column, kind: str) -> Column:
    return _raw(
        kind,
        name=record["eventName"],
        source=record["eventSource"],
        time=record["eventTime"],
        bucket=record["s3"]["bucket"]["name"],
        arn=record["s3"]["bucket"]["arn"],
        region=record["awsRegion"],
        deployment=get_ci(record["responseElements"], "x-rustfs-deployment-id"),
        key=record["s3"]["object"]["key"],
        etag=record["s3"]["object"]["eTag"],
        size=record["s3"]["object"]["size"],
        version=record["s3"]["object"]["versionId"],
    )


def _eventbridge_raw(name: Column, body: Column) -> Column:
    stored = body["detail"]["object"]
    return _raw(
        "eventbridge",
        name=name,
        source=F.lit("aws:eventbridge"),
        time=body["time"],
        bucket=body["detail"]["bucket"]["name"],
        region=body["region"],
        key=stored["key"],
        etag=stored["etag"],
        size=stored["size"],
        version=stored["version-id"],
        broken=body.isNull(),
    )


def _b2_raw(item: Column) -> Column:
    return _raw(
        "b2",
        name=item["eventType"],
        millis=item["eventTimestamp"],
        bucket=item["bucketName"],
        key=item["objectName"],
        size=item["objectSize"],
        event_id=item["eventId"],
    )


def _pubsub_raw(message: Column, payload: Column) -> Column:
    values = message["attributes"]
    return _raw(
        "gcp",
        name=values["eventType"],
        time=values["eventTime"],
        bucket=values["bucketId"],
        key=values["objectId"],
        etag=F.try_variant_get(payload, "$.md5Hash", "string"),
        size_text=F.try_variant_get(payload, "$.size", "string"),
        version=values["objectGeneration"],
        broken=message.isNull(),
        unread=(F.trim(_text(message["data"])) != "") & as_map(payload).isNull(),
    )


def _r2_raw(body: Column) -> Column:
    return _raw(
        "r2",
        name=body["action"],
        time=body["eventTime"],
        bucket=body["bucket"],
        key=body["object"]["key"],
        etag=body["object"]["eTag"],
        size=body["object"]["size"],
        broken=body.isNull(),
    )


def _read(raw: Column) -> dict[str, Column]:
    """What is worked out from one raw event: its key, action and time."""
    records = raw["kind"].isin("s3", "rustfs")
    key = _text(raw["key"])
    return {
        "key": F.when(records & (key != ""), decode_key(key)).otherwise(key),
        "action": event_action(raw["name"]),
        "at": F.when(raw["kind"] == "b2", F.timestamp_millis(F.coalesce(raw["millis"], F.lit(0)))).otherwise(
            parse_rfc3339(raw["time"])
        ),
    }


def _error(raw: Column, read: dict[str, Column]) -> Column:
    """What is wrong with one event, by the rules of its envelope."""
    kind, key, action = raw["kind"], read["key"], read["action"]
    late = _time_error(raw["time"], read["at"])
    skipped = (key == "") | (action == "ignore")
    size = _text(raw["size_text"])
    return (
        F.when(kind == "b2", F.lit(None).cast("string"))
        .when(kind.isin("s3", "rustfs"), F.when(key.isNull(), "object key is malformed").when(~skipped, late))
        .when((kind == "gcp") & (action == "ignore"), F.lit(None).cast("string"))
        .when(raw["broken"], "envelope is malformed")
        .when(kind == "r2", F.when(~skipped, late))
        .when(kind == "eventbridge", late)
        .otherwise(
            F.coalesce(
                late,
                F.when(raw["unread"], "message data is malformed"),
                F.when((size != "") & ~size.rlike(r"^[+-]?\d+$"), "object size is malformed"),
            )
        )
    )


def _event(raw: Column, read: dict[str, Column]) -> list[Column]:
    """The columns of a normalized event; absent text is '' and an absent size 0."""
    kind = raw["kind"]
    size = F.when(kind == "gcp", _text(raw["size_text"]).try_cast("bigint")).otherwise(raw["size"])
    columns = {
        "upstream": F.when(kind == "s3", event_provider(_text(raw["source"])))
        .when(kind == "eventbridge", "aws")
        .otherwise(kind),
        "action": read["action"],
        "event_name": raw["name"],
        "event_source": raw["source"],
        "bucket_name": raw["bucket"],
        "bucket_arn": raw["arn"],
        "region": raw["region"],
        "deployment_id": raw["deployment"],
        "key": read["key"],
        "etag": raw["etag"],
        "event_id": raw["event_id"],
        "version_id": raw["version"],
    }
    columns = {name: _text(value) for name, value in columns.items()}
    columns |= {"size": F.coalesce(size, F.lit(0)).cast("bigint"), "event_time": read["at"]}
    return [columns[f.name].cast(f.dataType).alias(f.name) for f in NORMALIZED_EVENT.fields]


def _once(raw: Column, build: Callable[[Column, dict[str, Column]], Column]) -> Column:
    """``build`` over a raw event and what is read from it, each part computed once."""
    read = [value.alias(name) for name, value in _read(raw).items()]
    return F.get(F.transform(F.array(F.struct(*read)), lambda r: build(raw, {n: r[n] for n in ("key", "action", "at")})), 0)


def _opened(df: DataFrame, body: str) -> DataFrame:
    """``df`` with ``format``, what its envelope holds, and ``_unread``, why a notification cannot be read at all.

    Each step is a column of its own, and a body is read only as the envelope it is.
    """
    staged = _unwrap(df, body)
    staged = staged.withColumn("format", envelope_format(F.col("_keys")))
    value, kind = F.col("_value"), F.col("format")

    def read(name: str, path: str, schema: str) -> Column:
        return F.when(kind == name, F.try_variant_get(value, path, schema))

    staged = staged.withColumns(
        {
            "_records": F.coalesce(read("s3", "$.Records", RECORDS), read("rustfs", "$.records", RECORDS)),
            "_b2": read("b2", "$.events", B2_EVENTS),
            "_bridge": read("eventbridge", "$", EVENTBRIDGE),
            "_bridge_name": read("eventbridge", '$["detail-type"]', "string"),
            "_message": read("gcp", "$.message", PUBSUB),
            "_r2": read("r2", "$", R2),
            "_topic": read("sns", "$.Type", "string"),
        }
    )
    staged = staged.withColumn("_payload", decode_payload(F.col("_message.data")))
    topic = F.col("_topic")
    quiet = F.coalesce(topic.isin("SubscriptionConfirmation", "UnsubscribeConfirmation"), F.lit(False))
    # A list that is there but does not have the shape it should; a JSON null counts as an empty list.
    listed = F.coalesce(
        read("s3", "$.Records", "variant"), read("rustfs", "$.records", "variant"), read("b2", "$.events", "variant")
    )
    misshapen = F.when(
        F.coalesce(F.size("_records"), F.size("_b2")).isNull(),
        listed.isNotNull() & (F.schema_of_variant(listed) != "VOID"),
    )
    unread = (
        F.when(F.col(body).isNull() | value.isNull() | F.col("_keys").isNull(), "body is not a JSON object")
        .when(kind.isNull(), "unsupported format")
        .when((kind == "sns") & (topic == "Notification"), "topic message is empty")
        .when((kind == "sns") & ~quiet, "unsupported topic message type")
        .when(misshapen, "envelope is malformed")
    )
    return staged.withColumn("_unread", unread)


def _single_raw(kind: Column) -> Column:
    """The raw event of an envelope that holds one."""
    return (
        F.when(kind == "eventbridge", _eventbridge_raw(F.col("_bridge_name"), F.col("_bridge")))
        .when(kind == "gcp", _pubsub_raw(F.col("_message"), F.col("_payload")))
        .when(kind == "r2", _r2_raw(F.col("_r2")))
    )


def _all_raw() -> Column:
    """All raw events of an envelope."""
    kind = F.col("format")
    return (
        F.when(kind == "s3", F.transform("_records", lambda r: _s3_raw(r, "s3")))
        .when(kind == "rustfs", F.transform("_records", lambda r: _s3_raw(r, "rustfs")))
        .when(kind == "b2", F.transform("_b2", _b2_raw))
        .when(kind.isin("eventbridge", "gcp", "r2"), F.array(_single_raw(kind)))
    )


def _raw_at(at: Column) -> Column:
    """The raw event at a place of its envelope, without building the others."""
    kind = F.col("format")
    return (
        F.when(kind == "s3", _s3_raw(F.get("_records", at), "s3"))
        .when(kind == "rustfs", _s3_raw(F.get("_records", at), "rustfs"))
        .when(kind == "b2", _b2_raw(F.get("_b2", at)))
        .otherwise(_single_raw(kind))
    )


def parse_notifications(df: DataFrame, body: str = "body") -> DataFrame:
    """``df`` with ``format``, ``events`` (array of normalized events) and ``error``.

    Events without a key, or whose name means neither an import nor a removal, are left out. One bad event makes its
    whole notification bad, so that it can be looked at and sent again. Of ``events`` and ``error`` one is NULL.
    """
    staged = _opened(df, body).withColumn("_raw", _all_raw())
    build = lambda raw, read: F.struct(*_event(raw, read), _error(raw, read).alias("error"))
    staged = staged.withColumn("_events", F.transform("_raw", lambda raw: _once(raw, build)))
    first_error = F.get(F.filter(F.transform("_events", lambda e: e["error"]), lambda e: e.isNotNull()), 0)
    staged = staged.withColumn("error", F.coalesce("_unread", first_error))
    kept = F.filter(F.coalesce("_events", F.array()), lambda e: (e["key"] != "") & (e["action"] != "ignore"))
    staged = staged.withColumn("events", F.when(F.col("error").isNull(), kept))
    return fence(staged.select(*df.columns, "format", "events", "error"), ["format", "events", "error"])


def accepted(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The events of parsed notifications. The outer form keeps Spark from inferring a filter on the array."""
    return parsed.select(*keep, F.inline_outer("events")).where("key IS NOT NULL").drop("error")


def rejects(parsed: DataFrame) -> DataFrame:
    """The parsed notifications that have an error."""
    return parsed.where("error IS NOT NULL")


def normalize_notifications(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per event of every readable notification.

    Places of events are exploded, and the event at a place is read as plain columns that Spark compiles. A notification
    of one event is judged by that row; only those of several are built and judged as a whole before.
    """
    opened = _opened(df, body)
    kind = F.col("format")
    several = F.coalesce(F.when(kind.isin("s3", "rustfs"), F.size("_records")).when(kind == "b2", F.size("_b2")), F.lit(1))
    counted = opened.withColumn("_several", several)
    n = F.col("_several")
    bad = F.when(n > 1, F.exists(_all_raw(), lambda raw: _once(raw, _error).isNotNull())).otherwise(False)
    listed = F.when(F.col("_unread").isNull() & kind.isNotNull() & (kind != "sns") & (n > 0) & ~bad, F.sequence(F.lit(0), n - 1))
    # The outer form keeps Spark from inferring a filter on the array.
    placed = counted.withColumn("_place", F.explode_outer(listed)).where("_place IS NOT NULL")
    rows = fence(placed.select(*keep, _raw_at(F.col("_place")).alias("_raw")), ["_raw"])
    raw = F.col("_raw")
    rows = rows.withColumns({f"_{name}": value for name, value in _read(raw).items()})
    read = {name: F.col(f"_{name}") for name in ("key", "action", "at")}
    good = _error(raw, read).isNull() & (read["key"] != "") & (read["action"] != "ignore")
    return rows.where(good).select(*keep, *_event(raw, read))


def rejected_notifications(df: DataFrame, body: str = "body") -> DataFrame:
    """The notifications that could not be read, with the reason."""
    return rejects(parse_notifications(df, body)).drop("events", "format")
