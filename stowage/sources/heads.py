"""Metadata capture: response headers, user metadata and tags to nested ``upstream`` documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stowage.functions.documents import coerce, empty_map, variant_object
from stowage.functions.text import format_rfc3339, get_ci, parse_boolean, parse_http_date, parse_integer
from stowage.sources.fence import fence
from stowage.sources.listing import PROVIDERS

METADATA_PREFIX = "x-amz-meta-"

# Header name and the attribute it becomes, by section of the document.
COMMON_HEADERS = {
    "accept-ranges": "accept_ranges",
    "cache-control": "cache_control",
    "content-type": "content_type",
    "content-disposition": "content_disposition",
    "content-encoding": "content_encoding",
    "content-language": "content_language",
}
S3_HEADERS = {
    "x-amz-storage-class": "storage_class",
    "x-amz-version-id": "version_id",
    "x-amz-server-side-encryption": "server_side_encryption",
    "x-amz-server-side-encryption-aws-kms-key-id": "sse_kms_key_id",
    "x-amz-server-side-encryption-customer-algorithm": "sse_customer_algorithm",
    "x-amz-server-side-encryption-customer-key-md5": "sse_customer_key_md5",
    "x-amz-server-side-encryption-bucket-key-enabled": "bucket_key_enabled",
    "x-amz-checksum-crc32": "checksum_crc32",
    "x-amz-checksum-crc32c": "checksum_crc32c",
    "x-amz-checksum-sha1": "checksum_sha1",
    "x-amz-checksum-sha256": "checksum_sha256",
    "x-amz-object-lock-mode": "object_lock_mode",
    "x-amz-object-lock-legal-hold": "object_lock_legal_hold_status",
    "x-amz-object-lock-retain-until-date": "object_lock_retain_until_date",
    "x-amz-expiration": "expiration",
    "x-amz-website-redirect-location": "website_redirect_location",
    "x-amz-replication-status": "replication_status",
    "x-amz-archive-status": "archive_status",
}
GCP_HEADERS = {
    "x-goog-generation": "generation",
    "x-goog-metageneration": "metageneration",
    "x-goog-stored-content-encoding": "stored_content_encoding",
    "x-goog-storage-class": "storage_class",
}

# Platform capture rules that copy one response field each, as (path below upstream., field, type).
PLATFORM_FIELDS = (
    ("etag", "ETag", "string"),
    ("size", "ContentLength", "integer"),
    ("last_modified", "LastModified", "timestamp"),
    ("header.accept_ranges", "AcceptRanges", "string"),
    ("header.cache_control", "CacheControl", "string"),
    ("header.content_type", "ContentType", "string"),
    ("header.content_disposition", "ContentDisposition", "string"),
    ("header.content_encoding", "ContentEncoding", "string"),
    ("header.content_language", "ContentLanguage", "string"),
    ("s3.storage_class", "StorageClass", "string"),
    ("s3.version_id", "VersionId", "string"),
    ("s3.server_side_encryption", "ServerSideEncryption", "string"),
    ("s3.sse_kms_key_id", "SSEKMSKeyId", "string"),
    ("s3.sse_customer_algorithm", "SSECustomerAlgorithm", "string"),
    ("s3.sse_customer_key_md5", "SSECustomerKeyMD5", "string"),
    ("s3.website_redirect_location", "WebsiteRedirectLocation", "string"),
    ("s3.expiration", "Expiration", "string"),
    ("s3.checksum_crc32", "ChecksumCRC32", "string"),
    ("s3.checksum_crc32c", "ChecksumCRC32C", "string"),
    ("s3.checksum_crc64nvme", "ChecksumCRC64NVME", "string"),
    ("s3.checksum_sha1", "ChecksumSHA1", "string"),
    ("s3.checksum_sha256", "ChecksumSHA256", "string"),
    ("s3.checksum_sha512", "ChecksumSHA512", "string"),
    ("s3.checksum_md5", "ChecksumMD5", "string"),
    ("s3.bucket_key_enabled", "BucketKeyEnabled", "boolean"),
    ("s3.archive_status", "ArchiveStatus", "string"),
    ("s3.replication_status", "ReplicationStatus", "string"),
    ("s3.object_lock_mode", "ObjectLockMode", "string"),
    ("s3.object_lock_legal_hold_status", "ObjectLockLegalHoldStatus", "string"),
    ("s3.object_lock_retain_until_date", "ObjectLockRetainUntilDate", "timestamp"),
    ("s3.parts_count", "PartsCount", "integer"),
    ("s3.delete_marker", "DeleteMarker", "boolean"),
)
REQUIRED_FIELDS = ("ETag", "ContentLength", "LastModified")
# Fields that are absent when empty rather than present and empty.
EMPTY_MEANS_ABSENT = (
    "StorageClass",
    "ServerSideEncryption",
    "ArchiveStatus",
    "ReplicationStatus",
    "ObjectLockMode",
    "ObjectLockLegalHoldStatus",
)


@dataclass(frozen=True)
class CaptureRule:
    attribute_path: str
    extractor_type: str
    extractor_ref: str
    value_type: str = "string"
    category: str = "optional"
    capture_source: str = "head"
    origin: str = "user"
    enabled: bool = True


def platform_rules() -> list[CaptureRule]:
    """The rules every catalog has: one per response field, plus all metadata and all tags."""
    rules = [
        CaptureRule(
            f"upstream.{path}", "sdk_field", field, kind,
            "required" if field in REQUIRED_FIELDS else "optional", origin="platform",
        )
        for path, field, kind in PLATFORM_FIELDS
    ]
    rules.append(CaptureRule("upstream.metadata", "metadata_all", "*", origin="platform"))
    rules.append(CaptureRule("upstream.tag", "tagging_all", "*", capture_source="tagging", origin="platform"))
    return rules


def strip_prefix(pairs: Column, prefix: str) -> Column:
    """Map of the lower-cased names that start with ``prefix``, without it. The last value of a name wins."""
    found = F.transform(
        F.filter(pairs, lambda p: F.startswith(F.lower(p[0]), F.lit(prefix))),
        lambda p: F.struct(F.substring(F.lower(p[0]), len(prefix) + 1, 1 << 30).alias("key"), p[1].alias("value")),
    )
    last_first = F.reverse(found)
    names = F.transform(last_first, lambda e: e["key"])
    latest = F.filter(last_first, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return F.map_from_entries(latest)


def attributes_from_head(heads: DataFrame) -> DataFrame:
    """``heads`` (upstream, headers as name/value pairs, …) with ``attributes`` and ``error``.

    The first value of a header counts. A length, date, flag or size that cannot be read makes the row an error.
    """
    rows = heads.withColumn("_names", F.transform("headers", lambda p: F.lower(p[0])))

    def first(name: str) -> Column:
        at = F.array_position("_names", F.lit(name)).cast("int")
        return F.when(at > 0, F.get("headers", at - 1)[1])

    def section(headers: dict[str, str], extra: dict[str, Column] | None = None) -> Column:
        return variant_object({a: first(h) for h, a in headers.items()} | (extra or {}))

    provider = F.col("upstream")
    length, modified = first("content-length"), first("last-modified")
    live, part = first("x-backblaze-live-read-enabled"), first("x-backblaze-live-read-part-size")
    stored = first("x-goog-stored-content-length")
    hashes = F.transform(
        F.filter("headers", lambda p: F.lower(p[0]) == "x-goog-hash"), lambda p: p[1]
    )
    goog_hash = F.when(F.size(hashes) > 0, hashes)
    sections = {
        "etag": first("etag"),
        "size": parse_integer(length),
        "last_modified": format_rfc3339(parse_http_date(modified)),
        "header": section(COMMON_HEADERS),
        "metadata": variant_object({}, strip_prefix(F.col("headers"), METADATA_PREFIX)),
        "s3": F.when(provider != "gcp", section(S3_HEADERS)),
        "b2": F.when(
            provider == "b2",
            variant_object({"live_read_enabled": parse_boolean(live), "live_read_part_size": parse_integer(part)}),
        ),
        "gcp": F.when(
            provider == "gcp",
            section(GCP_HEADERS, {"stored_content_length": parse_integer(stored), "hash": goog_hash}),
        ),
    }
    upstream = F.coalesce(variant_object(sections), F.to_variant_object(empty_map()))

    def bad(raw: Column, read: Column, name: str, when: Column | None = None) -> Column:
        wrong = raw.isNotNull() & read.isNull()
        return F.when(wrong if when is None else wrong & when, f"{name} is malformed")

    error = F.coalesce(
        F.when(~provider.isin(*PROVIDERS), F.concat(F.lit("unsupported upstream "), provider)),
        bad(length, parse_integer(length), "content-length"),
        bad(modified, parse_http_date(modified), "last-modified"),
        bad(live, parse_boolean(live), "x-backblaze-live-read-enabled", provider == "b2"),
        bad(part, parse_integer(part), "x-backblaze-live-read-part-size", provider == "b2"),
        bad(stored, parse_integer(stored), "x-goog-stored-content-length", provider == "gcp"),
    )
    document = F.to_variant_object(F.create_map(F.lit("upstream"), upstream))
    read = rows.withColumn("error", error).withColumn("attributes", F.when(F.col("error").isNull(), document))
    return fence(read.drop("_names"), ["error", "attributes"])


def _field(name: str) -> Column:
    value = F.get(F.map_values(F.map_filter("fields", lambda k, _: k == name)), 0)
    if name in EMPTY_MEANS_ABSENT:
        return F.when(value != "", value)
    return F.when(F.lower(value) == "true", value) if name == "DeleteMarker" else value


def _captured(rule: CaptureRule) -> Column:
    """Raw text a rule finds, or a map for the rules that take everything; NULL where it finds nothing."""
    kind, ref = rule.extractor_type, rule.extractor_ref
    known = {f for _, f, _ in PLATFORM_FIELDS}
    if kind == "sdk_field":
        return _field(ref) if ref in known else F.lit(None).cast("string")
    if kind == "response_header":
        value = get_ci(F.col("response_headers"), ref)
        return F.when(value != "", value)
    if kind in ("metadata_key", "tag_key"):
        source = "metadata" if kind == "metadata_key" else "tags"
        return F.get(F.map_values(F.map_filter(source, lambda k, _: k == ref)), 0)
    source = "metadata" if kind == "metadata_all" else "tags"
    return F.when(F.size(F.col(source)) > 0, F.col(source))


def capture_attributes(heads: DataFrame, rules: Sequence[CaptureRule]) -> DataFrame:
    """``heads`` with ``attributes`` built by the rules, and ``error`` where a required one finds nothing usable.

    ``heads`` has fields, response_headers, metadata and tags, each a map of strings. The rules become one projection.
    """
    errors, tree, whole = [], {}, {}
    for rule in rules:
        if not rule.enabled:
            continue
        found = _captured(rule)
        if rule.extractor_type in ("metadata_all", "tagging_all"):
            name = "metadata" if rule.extractor_type == "metadata_all" else "tag"
            whole[name], value = found, None
            tree.pop(name, None)
        else:
            value = coerce(found, rule.value_type)
            _place(tree, rule.attribute_path.removeprefix("upstream.").split("."), value)
        if rule.category == "required":
            errors.append(F.when(found.isNull(), f"{rule.attribute_path} is missing"))
            if value is not None:
                errors.append(F.when(value.isNull(), f"{rule.attribute_path} does not fit its type"))
    nothing = F.to_variant_object(empty_map())
    upstream = F.coalesce(_tree(tree, whole), nothing)
    error = F.coalesce(*errors) if errors else F.lit(None).cast("string")
    document = F.to_variant_object(F.create_map(F.lit("upstream"), upstream))
    captured = heads.withColumn("error", error).withColumn("attributes", F.when(F.col("error").isNull(), document))
    return fence(captured, ["error", "attributes"])


def _place(tree: dict, steps: list[str], value: Column) -> None:
    """Put a value into the tree of sections; a later rule lies over an earlier one at the same place."""
    node = tree
    for step in steps[:-1]:
        below = node.get(step)
        if not isinstance(below, dict):
            below = {} if below is None else {None: below}
            node[step] = below
        node = below
    earlier = node.get(steps[-1])
    if isinstance(earlier, Column):
        value = F.coalesce(value, earlier)
    elif isinstance(earlier, dict):
        value = F.coalesce(value, _tree(earlier, {}))
    node[steps[-1]] = value


def _tree(tree: dict, whole: dict) -> Column:
    children, plain = {}, tree.get(None)
    for name in dict.fromkeys([*whole, *[k for k in tree if k is not None]]):
        node = tree.get(name)
        if name in whole:
            below = node.items() if isinstance(node, dict) else ()
            inner = {k: _tree(v, {}) if isinstance(v, dict) else v for k, v in below}
            children[name] = variant_object(inner, whole[name])
        else:
            children[name] = _tree(node, {}) if isinstance(node, dict) else node
    built = variant_object(children)
    return built if plain is None else F.coalesce(built, plain)


def validate_rules(rules: DataFrame) -> DataFrame:
    """Rule rows with an ``error``: what keeps a user's capture rule from being accepted."""
    path, kind, ref = F.trim("attribute_path"), F.col("extractor_type"), F.trim("extractor_ref")
    rest = F.substring(path, len("upstream.") + 1, 1 << 30)
    by_name = kind.isin("response_header", "metadata_key", "tag_key")
    error = (
        F.when(path == "", "attribute_path is required")
        .when(~path.startswith("upstream."), "attribute_path must start with upstream.")
        .when(path.contains(".."), "attribute_path must not contain ..")
        .when(rest == "", "attribute_path must name a field")
        .when(rest.startswith(".") | rest.endswith("."), "attribute_path has an empty segment")
        .when(ref == "", "extractor_ref is required")
        .when((kind == "sdk_field") & (F.col("origin") == "user"), "sdk_field is for platform rules only")
        .when(by_name & ref.contains(".."), "extractor_ref must not contain ..")
        .when(kind.isin("metadata_all", "tagging_all") & (ref != "*"), "extractor_ref must be *")
        .when(
            ~kind.isin("sdk_field", "response_header", "metadata_key", "tag_key", "metadata_all", "tagging_all"),
            "unsupported extractor_type",
        )
    )
    shown = F.when(kind == "response_header", F.lower(ref)).otherwise(ref)
    return rules.withColumns({"attribute_path": path, "extractor_ref": shown, "error": error})
