import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stowage.functions import documents as docs
from stowage.sources.contents import hash_contents
from stowage.sources.heads import CaptureRule, attributes_from_head, capture_attributes, platform_rules, validate_rules
from stowage.sources.listing import listing_complete, parse_pages, read_listing
from stowage.sources.notifications import normalize_notifications, parse_notifications, rejected_notifications

CREATED, REMOVED = "2026-06-26T01:00:00Z", "2026-06-26T01:05:00Z"


def record(name, key, source="aws:s3", size=434234, time=CREATED, etag="e1", **extra):
    return {
        "eventSource": source, "awsRegion": "us-east-1", "eventName": name, "eventTime": time,
        "s3": {"bucket": {"name": "bkt", "arn": "arn:aws:s3:::bkt"}, "object": {"key": key, "size": size, "eTag": etag}}, **extra,
    }


def aws(name="ObjectCreated:Put", key="photos%2Fa.jpg", **kw):
    return {"Records": [record(name, key, **kw)]}


def gcp(kind, key, time, data=None):
    message = {"attributes": {"eventType": kind, "bucketId": "bkt", "objectId": key, "eventTime": time, "objectGeneration": "77"}}
    if data is not None:
        message["data"] = base64.b64encode(json.dumps(data).encode()).decode()
    return {"message": message}


def b2(kind, key, size, millis, event_id):
    return {"events": [{"eventId": event_id, "eventTimestamp": millis, "eventType": kind, "bucketName": "bkt", "objectName": key, "objectSize": size}]}


def r2(kind, key, time, size=0, etag=""):
    return {"action": kind, "bucket": "bkt", "eventTime": time, "object": {"key": key, "size": size, "eTag": etag}}


BRIDGE = {"detail-type": "Object Created", "time": CREATED, "region": "us-east-1",
          "detail": {"bucket": {"name": "bkt"}, "object": {"key": "photos/a.jpg", "size": 434234, "etag": "e1", "version-id": "v1"}}}
RUSTFS = {"responseElements": {"X-RustFS-Deployment-Id": " dep-1 "}}

# name: (body, upstream, action, key, has etag, size, time, event id)
FIXTURES = {
    "aws_created": (aws(), "aws", "import", "photos/a.jpg", True, 434234, CREATED, ""),
    "aws_removed": (aws("ObjectRemoved:Delete", "photos/b.jpg", size=0, time=REMOVED, etag=""), "aws", "remove", "photos/b.jpg", False, 0, REMOVED, ""),
    "sns_created": ({"Type": "Notification", "Message": json.dumps(aws())}, "aws", "import", "photos/a.jpg", True, 434234, CREATED, ""),
    "eventbridge": (BRIDGE, "aws", "import", "photos/a.jpg", True, 434234, CREATED, ""),
    "b2_created": (b2("b2:ObjectCreated:Upload", "photos/a.jpg", 434234, 1719393309123, "ba9a"), "b2", "import", "photos/a.jpg", False, 434234, "2024-06-26T09:15:09.123Z", "ba9a"),
    "b2_removed": (b2("b2:ObjectDeleted:Delete", "photos/b.jpg", 0, 1719393609123, "c1a2"), "b2", "remove", "photos/b.jpg", False, 0, "2024-06-26T09:20:09.123Z", "c1a2"),
    "gcp_created": (gcp("OBJECT_FINALIZE", "photos/a.jpg", CREATED, {"size": "434234", "md5Hash": "m"}), "gcp", "import", "photos/a.jpg", True, 434234, CREATED, ""),
    "gcp_removed": (gcp("OBJECT_DELETE", "photos/b.jpg", REMOVED), "gcp", "remove", "photos/b.jpg", False, 0, REMOVED, ""),
    "r2_created": (r2("PutObject", "photos/a.jpg", CREATED, 434234, "e1"), "r2", "import", "photos/a.jpg", True, 434234, CREATED, ""),
    "r2_removed": (r2("DeleteObject", "photos/b.jpg", REMOVED), "r2", "remove", "photos/b.jpg", False, 0, REMOVED, ""),
    "rustfs_created": (aws(source="rustfs:s3", **RUSTFS), "rustfs", "import", "photos/a.jpg", True, 434234, CREATED, ""),
    "rustfs_removed": (aws("ObjectRemoved:Delete", "photos/b.jpg", source="rustfs:s3", size=0, time=REMOVED, etag=""), "rustfs", "remove", "photos/b.jpg", False, 0, REMOVED, ""),
    "rustfs_legacy": ({"records": [record("s3:ObjectCreated:Put", "a+b.jpg", "minio:s3")]}, "rustfs", "import", "a b.jpg", True, 434234, CREATED, ""),
    "minio": (aws(source="minio:s3"), "aws", "import", "photos/a.jpg", True, 434234, CREATED, ""),
    "wrapped_twice": ({"body": {"transport": "q", "body": aws()}}, "aws", "import", "photos/a.jpg", True, 434234, CREATED, ""),
    "wrapped_deep": ({"body": {"body": {"body": {"body": {"body": aws()}}}}}, "aws", "import", "photos/a.jpg", True, 434234, CREATED, ""),
    "wrapped_sns": ({"body": {"Type": "Notification", "Message": json.dumps({"body": BRIDGE})}}, "aws", "import", "photos/a.jpg", True, 434234, CREATED, ""),
}
REJECTED = {
    "no json": "{oops", "a list": "[1]", "nothing": None, "unknown": {"hello": 1}, "no message": {"Type": "Notification", "Message": " "},
    "odd topic": {"Type": "Other"}, "no time": aws(time=""), "odd time": aws(time="yesterday"), "odd key": aws(key="a%zz"),
    "odd data": gcp("OBJECT_FINALIZE", "k", CREATED) | {"message": {**gcp("OBJECT_FINALIZE", "k", CREATED)["message"], "data": "%%"}},
    "odd size": gcp("OBJECT_FINALIZE", "k", CREATED, {"size": "many"}), "shape": {"Records": "x"},
    "second bad": {"Records": [record("ObjectCreated:Put", "a"), record("ObjectCreated:Put", "b", time="")]},
}
SILENT = {
    "tagging": aws("ObjectTagging:Put"), "empty key": aws(key=""), "subscribe": {"Type": "SubscriptionConfirmation"}, "no records": {"Records": []},
    "null records": {"Records": None}, "ignored time": aws("ObjectTagging:Put", time=""), "gcp other": gcp("OBJECT_ARCHIVE", "k", ""), "r2 no key": r2("PutObject", "", ""),
}


def frame(spark, cases):
    rows = [(n, b if b is None or isinstance(b, str) else json.dumps(b)) for n, b in cases.items()]
    return spark.createDataFrame(rows, "name string, body string")


def test_notifications(spark):
    rows = normalize_notifications(frame(spark, {n: f[0] for n, f in FIXTURES.items()}), keep=("name",))
    rows = rows.withColumn("time", F.regexp_replace(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS"), r"\.000$", "")).collect()
    seen = {r.name: (r.upstream, r.action, r.key, r.etag != "", r.size, r.time + "Z", r.event_id) for r in rows}
    assert seen == {n: f[1:] for n, f in FIXTURES.items()}
    extra = {r.name: r for r in rows}
    assert extra["rustfs_created"].deployment_id == "dep-1" and extra["eventbridge"].version_id == "v1"
    assert extra["gcp_created"].version_id == "77" and extra["aws_created"].bucket_arn == "arn:aws:s3:::bkt"
    assert all(r.bucket_name == "bkt" for r in rows)


def test_rejected_and_silent(spark):
    bad = frame(spark, REJECTED)
    assert {r.name for r in rejected_notifications(bad).collect()} == set(REJECTED)
    assert normalize_notifications(bad).count() == 0
    quiet = frame(spark, SILENT)
    assert normalize_notifications(quiet).count() == 0 and rejected_notifications(quiet).count() == 0
    assert parse_notifications(quiet).where("events IS NULL").count() == 0


PAGE = """<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><IsTruncated> TRUE </IsTruncated>
<NextContinuationToken>tok</NextContinuationToken>
<Contents><Key>a b/é.txt</Key><ETag>"x" </ETag><Size> 5 </Size><LastModified>2026-01-01T00:00:00.000Z</LastModified><StorageClass>STANDARD</StorageClass></Contents>
<Contents><Key>c</Key><ETag>y</ETag><Size>0</Size><LastModified>2026-01-01T09:00:00+09:00</LastModified></Contents></ListBucketResult>"""


def test_listing_pages(spark):
    cases = [
        ("b", "good", "aws", 200, PAGE), ("b", "last", "r2", 200, "<ListBucketResult><IsTruncated>false</IsTruncated></ListBucketResult>"),
        ("c", "size", "aws", 200, PAGE.replace(" 5 ", "big")), ("c", "time", "aws", 200, PAGE.replace("2026-01-01T00:00:00.000Z", "soon")),
        ("c", "denied", "gcp", 403, "<Error><Code>AccessDenied</Code><Message>no</Message></Error>"), ("c", "odd", "ftp", 200, PAGE),
        ("d", "more", "b2", 200, PAGE),
    ]
    pages = spark.createDataFrame(cases, "bucket_id string, name string, upstream string, status int, body string")
    parsed = {r.name: r for r in parse_pages(pages).collect()}
    assert parsed["good"].is_truncated and parsed["good"].next_continuation_token == "tok" and parsed["good"].error is None
    assert parsed["denied"].error == "status 403: AccessDenied no"
    assert all(parsed[n].error for n in ("size", "time", "denied", "odd"))
    rows = read_listing(pages.where("bucket_id = 'b'")).orderBy("key").collect()
    assert [(r.key, r.etag, r.size, r.storage_class) for r in rows] == [("a b/é.txt", '"x"', 5, "STANDARD"), ("c", "y", 0, "")]
    assert rows[0].last_modified == rows[1].last_modified
    assert {r.bucket_id: r.complete for r in listing_complete(pages).collect()} == {"b": True, "c": False, "d": False}


def test_heads(spark):
    base = [["ETag", '"x"'], ["Content-Length", "5"], ["Last-Modified", "Fri, 26 Jun 2026 01:00:00 GMT"], ["X-AMZ-META-Team", "a"], ["x-amz-meta-team", "b"],
            ["x-amz-storage-class", "IA"], ["x-goog-generation", "9"], ["x-backblaze-live-read-enabled", "1"], ["x-goog-hash", "h1"], ["X-Goog-Hash", "h2"]]
    cases = [(p, p, base) for p in ("aws", "r2", "rustfs", "b2", "gcp")] + [
        ("ftp", "ftp", base), ("length", "aws", [["content-length", "x"]]), ("date", "aws", [["last-modified", "x"]]), ("flag", "b2", [["x-backblaze-live-read-enabled", "maybe"]]), ("none", "aws", [])]
    rows = attributes_from_head(spark.createDataFrame(cases, "name string, upstream string, headers array<array<string>>"))
    seen = {r.name: r for r in rows.select("name", "error", F.to_json("attributes").alias("doc")).collect()}
    common = {"etag": '"x"', "size": 5, "last_modified": "2026-06-26T01:00:00Z", "metadata": {"team": "b"}}
    s3 = {"s3": {"storage_class": "IA"}}
    for name, more in (("aws", s3), ("r2", s3), ("rustfs", s3), ("b2", s3 | {"b2": {"live_read_enabled": True}}), ("gcp", {"gcp": {"generation": "9", "hash": ["h1", "h2"]}})):
        assert json.loads(seen[name].doc) == {"upstream": common | more}
    assert all(seen[n].error and seen[n].doc is None for n in ("ftp", "length", "date", "flag"))
    assert seen["none"].doc == '{"upstream":{}}'


def test_capture(spark):
    full = {"ETag": "e", "ContentLength": "5", "LastModified": "2026-01-01T00:00:00Z", "BucketKeyEnabled": "true", "PartsCount": "x", "DeleteMarker": "false", "StorageClass": ""}
    heads = spark.createDataFrame(
        [("full", full, {"X-Team": "t"}, {"k": "v"}, {"r": "4"}), ("short", {"ETag": "e"}, {}, {}, {}), ("wrong", full | {"ContentLength": "big"}, {}, {}, {})],
        "name string, fields map<string,string>, response_headers map<string,string>, metadata map<string,string>, tags map<string,string>",
    )
    rules = [*platform_rules(), CaptureRule("upstream.my.team", "response_header", "x-team"), CaptureRule("upstream.metadata.rank", "tag_key", "r", "integer", capture_source="tagging"),
             CaptureRule("upstream.my.gone", "sdk_field", "Nothing"), CaptureRule("upstream.my.off", "metadata_key", "k", enabled=False)]
    rows = {r.name: r for r in capture_attributes(heads, rules).select("name", "error", F.to_json("attributes").alias("doc")).collect()}
    assert json.loads(rows["full"].doc) == {"upstream": {
        "etag": "e", "size": 5, "last_modified": "2026-01-01T00:00:00Z", "metadata": {"k": "v", "rank": 4}, "my": {"team": "t"}, "s3": {"bucket_key_enabled": True}, "tag": {"r": "4"}}}
    assert rows["short"].error == "upstream.size is missing" and rows["wrong"].error == "upstream.size does not fit its type"
    assert len(platform_rules()) == 34


@pytest.mark.parametrize(
    "path, kind, ref, origin, good",
    [("upstream.a.b", "response_header", "X-A", "user", True), ("user.a", "tag_key", "a", "user", False), ("upstream.", "tag_key", "a", "user", False),
     ("upstream.a..b", "tag_key", "a", "user", False), ("upstream.a.", "tag_key", "a", "user", False), ("", "tag_key", "a", "user", False), ("upstream.a", "sdk_field", "ETag", "user", False),
     ("upstream.a", "sdk_field", "ETag", "platform", True), ("upstream.a", "metadata_all", "k", "user", False), ("upstream.a", "metadata_all", "*", "user", True),
     ("upstream.a", "tag_key", " ", "user", False), ("upstream.a", "tag_key", "a..b", "user", False), ("upstream.a", "eval", "a", "user", False)],
)
def test_rule_checks(spark, path, kind, ref, origin, good):
    rules = spark.createDataFrame([(path, kind, ref, origin)], "attribute_path string, extractor_type string, extractor_ref string, origin string")
    assert (validate_rules(rules).first().error is None) == good


def test_file_hashes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    row = hash_contents(spark, str(tmp_path / "*.bin")).first()
    assert (row.content_sha256, row.bytes_read) == (hashlib.sha256(b"abc").hexdigest(), 3)
    assert docs.split_path("a..b.") == ["a", "b"]
