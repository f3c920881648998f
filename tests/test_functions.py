from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from stowage.functions import documents as docs
from stowage.functions import events, evidence, hashing, text
from stowage.operators import fingerprints as fp


def doc(body):
    return F.parse_json(F.lit(body))


def as_json(column):
    return F.to_json(column)


@pytest.mark.parametrize(
    "value, expected", [("a", 3826002220), ("foobar", 3214735720), ("photos/2024/a.jpg", 2845495416), ("", 2166136261)]
)
def test_fnv(one, value, expected):
    assert one(hashing.fnv1a32(F.lit(value))) == expected


def test_fnv_reads_utf8_bytes(one):
    value = 2166136261
    for byte in "é/ü€".encode():
        value = ((value ^ byte) * 16777619) & 0xFFFFFFFF
    assert one(hashing.fnv1a32(F.lit("é/ü€"))) == value


def test_partition_ids(one):
    assert one(hashing.partition_id(F.lit(42), 256)) == "042/256"
    assert tuple(one(hashing.parse_partition_id(F.lit("042/256")))) == (42, 256)
    for bad in ("", "042", "abc/256", "042/256/extra", "256/256", "1/0"):
        assert one(hashing.parse_partition_id(F.lit(bad))) is None
    with pytest.raises(ValueError):
        hashing.partition_index(F.col("key"), 0)


def test_sampling(spark, one):
    scopes = spark.createDataFrame([("small",), ("large",)], "scope string")
    sizes = {r["scope"]: r["count"] for r in fp.sample_partitions(scopes, date(2026, 6, 27), 0.5).groupBy("scope").count().collect()}
    assert sizes["small"] == sizes["large"] and 90 < sizes["small"] < 166
    assert fp.sample_partitions(scopes, date(2026, 6, 27), 1.0).count() == 512
    days = [date(2026, 6, 1) + timedelta(n) for n in range(5)]
    chosen = [frozenset(r.partition_index for r in fp.sample_partitions(scopes, d, 0.1).collect()) for d in days]
    assert len(set(chosen)) > 1
    assert one(fp.should_sample(F.lit("000/256"), F.lit(1.0), days[0])) is True
    assert one(fp.should_sample(F.lit("000/256"), F.lit(0.0), days[0])) is False
    tokyo = timezone(timedelta(hours=9))
    assert fp.daily_epoch(datetime(2026, 6, 27, 15, 30, tzinfo=tokyo)) == date(2026, 6, 27)
    assert fp.daily_epoch(datetime(2026, 6, 27, 5, 30, tzinfo=tokyo)) == date(2026, 6, 26)


@pytest.mark.parametrize(
    "name, action, category, job",
    [
        ("ObjectCreated:Put", "import", "created", "import_objects"),
        ("s3:ObjectRemoved:Delete", "remove", "removed", "remove_objects"),
        ("ObjectTagging:Put", "ignore", "metadata_changed", "refresh_objects"),
        ("ObjectAcl:Put", "ignore", "metadata_changed", "refresh_objects"),
        ("Object Created", "import", "other", None),
        ("OBJECT_FINALIZE", "import", "other", None),
        ("b2:ObjectCreated:Upload", "import", "other", None),
        ("DeleteObject", "remove", "other", None),
        ("SomethingElse", "ignore", "other", None),
    ],
)
def test_event_names(one, name, action, category, job):
    c = F.lit(name)
    assert one(events.event_action(c), events.event_category(c), events.event_job_type(c)) == (action, category, job)


def test_unified_job_type(one):
    assert one(events.event_job_type(F.lit("OBJECT_DELETE"), unified=True)) == "remove_objects"


@pytest.mark.parametrize("raw, key", [("photos%2Fa.jpg", "photos/a.jpg"), ("a+b%20c", "a b c"), ("a%zz", None), ("a%2", None)])
def test_decode_key(one, raw, key):
    assert one(events.decode_key(F.lit(raw))) == key


def test_decode_payload(one):
    assert one(as_json(events.decode_payload(F.lit(" eyJzaXplIjoiNSJ9 ")))) == '{"size":"5"}'
    assert one(events.decode_payload(F.lit("%%"))) is None and one(events.decode_payload(F.lit("b29wcw=="))) is None


def test_dedupe_key(one):
    at = F.lit("2026-06-26T01:00:00.1200Z").cast("timestamp")
    args = [F.lit(x) for x in ("bucket", "ObjectCreated:Put", "a.jpg")]
    assert one(hashing.dedupe_key(*args, F.lit("e1"), at)) == "bucket:ObjectCreated:Put:a.jpg:e1"
    import hashlib

    expected = hashlib.sha256(b"bucket|ObjectCreated:Put|a.jpg|2026-06-26T01:00:00.12Z").hexdigest()
    assert one(hashing.dedupe_key(*args, F.lit(""), at)) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2026-06-26T01:00:00Z", "2026-06-26T01:00:00Z"),
        ("2026-06-26T01:00:00.5+09:00", "2026-06-25T16:00:00.5Z"),
        ("2026-06-26 01:00:00", None),
        ("2026-06-26", None),
        ("2026-13-40T01:00:00Z", None),
    ],
)
def test_rfc3339(one, value, expected):
    assert one(text.format_rfc3339_nano(text.parse_rfc3339(F.lit(value)))) == expected


@pytest.mark.parametrize(
    "value", ["Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994"]
)
def test_http_dates(one, value):
    assert one(text.format_rfc3339(text.parse_http_date(F.lit(value)))) == "1994-11-06T08:49:37Z"


def test_numbers_and_flags(one):
    assert one(text.parse_integer(F.lit("+12")), text.parse_integer(F.lit(" 12")), text.parse_integer(F.lit("1.0"))) == (12, None, None)
    assert one(text.parse_boolean(F.lit("T")), text.parse_boolean(F.lit("0")), text.parse_boolean(F.lit("yes"))) == (True, False, None)


def test_case_insensitive_lookup(one):
    headers = F.create_map(F.lit("X-Team"), F.lit(" red "))
    assert one(text.get_ci(headers, "x-team")) == "red"
    assert one(text.get_ci(headers, "x-other")) is None


def test_attribute_reads(one):
    d = doc('{"a": {"b.c": "no", "0": "key", "n": null}, "l": ["x", "y"], "t": true, "o": {"k": 1}}')
    assert one(docs.attr_text(d, "a.0")) == "key"
    assert one(docs.attr_text(d, "l.1")) == "y"
    assert one(docs.attr_text(d, "a.n"), docs.attr_text(d, "missing.path"), docs.attr_text(d, "t")) == (None, None, "true")
    assert one(docs.attr_text(d, "o")) == '{"k":1}'
    quoted = doc('{"it\'s": {"{odd,}": 5}}')
    assert one(docs.attr(quoted, "it's.{odd,}", "integer")) == 5


def test_strict_and_lenient_casts(one):
    bad = doc('{"size": "abc"}')
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(docs.attr(bad, "size", "integer"))
    assert one(docs.attr(bad, "size", "integer", strict=False)) is None


@pytest.mark.parametrize(
    "body, kind",
    [
        ("5", "integer"), ("5.0", "integer"), ("5.5", "float"), ("1e3", "integer"), ("true", "boolean"), ('"x"', "string"),
        ('"2026-06-26T01:00:00Z"', "timestamp"), ('"2026-06-26"', "string"), ("[1]", "unknown"), ("{}", "unknown"), ("null", None),
    ],
)
def test_infer_type(one, body, kind):
    assert one(docs.infer_type(doc(body))) == kind


@pytest.mark.parametrize(
    "left, right, result",
    [
        ("integer", "integer", "integer"), ("integer", "float", "float"), ("float", "integer", "float"),
        ("string", "integer", "conflict"), ("unknown", "string", "string"), ("boolean", "unknown", "boolean"),
    ],
)
def test_widen(one, left, right, result):
    assert one(docs.widen_pair(F.lit(left), F.lit(right))) == result
    assert one(docs.widen_types(F.array(F.lit(left), F.lit(right)))) == result


def test_set_and_delete_paths(one):
    d = doc('{"user": {"a": 1, "b": {"c": 2}}, "x": 3}')
    assert one(as_json(docs.set_path(d, "user.a.deep", F.lit("v")))) == '{"user":{"a":{"deep":"v"},"b":{"c":2}},"x":3}'
    assert one(as_json(docs.set_path(d, "new.leaf", F.lit(7)))) == '{"new":{"leaf":7},"user":{"a":1,"b":{"c":2}},"x":3}'
    assert one(as_json(docs.delete_path(d, "user.b.c"))) == '{"user":{"a":1},"x":3}'
    assert one(as_json(docs.delete_path(d, "user.zzz.q"))) == '{"user":{"a":1,"b":{"c":2}},"x":3}'
    assert one(as_json(docs.delete_path(doc('{"a":{"b":{"c":1}}}'), "a.b.c"))) == "{}"


def test_merge_attributes(one):
    old = doc('{"core":{"object_id":"o1","first_seen_at":"T1","last_seen_at":"T1"},"upstream":{"etag":"a","size":1},"user":{"score":9}}')
    new = docs.with_core(doc('{"upstream":{"etag":"b"}}'), F.lit("o2"), F.lit("T2"))
    merged = one(as_json(docs.merge_attributes(old, new, F.lit("o1"))))
    assert merged == (
        '{"core":{"first_seen_at":"T1","last_seen_at":"T2","object_id":"o1"},"upstream":{"etag":"b"},"user":{"score":9}}'
    )


def test_evidence_documents(one):
    facts = [F.lit("e"), F.lit(0), F.lit("2026-01-01T00:00:00Z"), F.lit("")]
    assert one(as_json(evidence.listed_attributes(*facts))) == '{"upstream":{"etag":"e","last_modified":"2026-01-01T00:00:00Z"}}'
    captured = doc('{"upstream":{"etag":"old","size":4,"s3":{"version_id":"v"}},"user":{}}')
    over = [F.lit("e"), F.lit(0), F.lit(""), F.lit("GLACIER")]
    assert one(as_json(evidence.overlay_evidence(captured, *over))) == (
        '{"upstream":{"etag":"e","s3":{"storage_class":"GLACIER","version_id":"v"},"size":4},"user":{}}'
    )


def test_path_prefixes(one):
    assert one(docs.path_prefixes(F.lit("a.b.c"))) == ["a", "a.b"]
    assert one(docs.path_prefixes(F.lit("a"))) == []
