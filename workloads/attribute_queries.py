"""Documents and their types: capture, listing pages, flattening, the attribute catalog, edits."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from stowage.functions import documents as docs
from stowage.functions import evidence as ev
from stowage.functions import text
from stowage.operators import attributes as ops
from stowage.plans.observe import observe_catalog
from stowage.sources.heads import CaptureRule, attributes_from_head, capture_attributes, platform_rules, validate_rules
from stowage.sources.listing import listing_complete, parse_pages, read_listing
from workloads import views as v
from workloads.registry import query
from workloads.search_queries import ntz

AT = datetime(2024, 2, 1, tzinfo=timezone.utc)
PATHS = {
    "core.object_id": "id",
    "core.first_seen_at": "last_modified",
    "core.last_seen_at": "last_modified",
    "upstream.etag": "etag",
    "upstream.size": "size",
    "upstream.last_modified": "last_modified",
    "upstream.header.content_type": "content_type",
    "upstream.s3.storage_class": "storage_class",
    "user.quality": "quality",
    "user.toxic": "toxic",
}
LEAVES = "leaves AS (" + " UNION ALL ".join(
    f"SELECT id, '{p}' AS path, CAST({c} AS VARCHAR) AS value FROM objects WHERE {c} IS NOT NULL" for p, c in PATHS.items()
) + ")"
TYPED = """CASE WHEN path IN ('upstream.size', 'user.quality', 'user.toxic') THEN 'integer'
    WHEN path IN ('core.first_seen_at', 'core.last_seen_at', 'upstream.last_modified') THEN 'timestamp' ELSE 'string' END"""


@query("flatten", v.with_views(v.OBJECTS, LEAVES) + f"SELECT id, path, value, {TYPED} AS value_type FROM leaves")
def flatten(spark, d):
    return ops.flatten(v.bare_objects(spark, d), keep=("id",)).select(
        "id", F.array_join("segments", ".").alias("path"), F.try_variant_get("value", "$", "string").alias("value"),
        docs.infer_type(F.col("value")).alias("value_type"),
    )


def _event_documents(spark, d):
    """Event properties and values as documents of mixed types: whole and broken numbers, flags, times, lists."""
    rows = v.table(spark, d, "events")
    kind = F.col("event_type")
    return rows.select(
        "event_id",
        F.to_variant_object(
            F.struct(
                F.parse_json("props").alias("props"),
                F.when(kind == "click", F.floor("value").cast("bigint").cast("variant"))
                .when(kind == "view", F.col("value").cast("variant"))
                .alias("amount"),
                F.when(kind == "error", F.col("value").cast("variant")).otherwise(F.col("event_type").cast("variant")).alias("mixed"),
                F.struct(
                    F.when(kind == "signup", F.lit(True)).alias("flag"),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
                    F.array("event_type").alias("tags"),
                ).alias("seen"),
            )
        ).alias("attributes"),
    )


WHOLE = "CASE WHEN value = floor(value) THEN 'integer' ELSE 'float' END"


def observed_sql(name: str, where: str = "true") -> str:
    """The catalog of the event documents: every leaf's type, and the parents, folded by path."""
    return f"""{name}_leaves AS (
      SELECT 'props.k' AS path, 'integer' AS kind FROM events WHERE {where}
      UNION ALL SELECT 'amount', CASE WHEN event_type = 'click' THEN 'integer' ELSE {WHOLE} END FROM events
        WHERE event_type IN ('click', 'view') AND {where}
      UNION ALL SELECT 'mixed', CASE WHEN event_type = 'error' THEN {WHOLE} ELSE 'string' END FROM events WHERE {where}
      UNION ALL SELECT 'seen.flag', 'boolean' FROM events WHERE event_type = 'signup' AND {where}
      UNION ALL SELECT unnest(['seen.at', 'seen.tags']), unnest(['timestamp', 'unknown']) FROM events WHERE {where}),
    {name}_all AS (SELECT * FROM {name}_leaves UNION ALL SELECT split_part(path, '.', 1), 'unknown' FROM {name}_leaves WHERE path LIKE '%.%'),
    {name} AS (SELECT path, CASE count(DISTINCT kind) FILTER (kind <> 'unknown') WHEN 0 THEN 'unknown'
        WHEN 1 THEN max(kind) FILTER (kind <> 'unknown')
        ELSE CASE WHEN bool_and(kind IN ('integer', 'float', 'unknown')) THEN 'float' ELSE 'conflict' END END AS value_type
      FROM {name}_all GROUP BY path)"""


@query("observe_attributes", f"WITH {observed_sql('observed')} SELECT * FROM observed")
def observe_attributes(spark, d):
    return ops.observe_attributes(_event_documents(spark, d))


@query("infer_types", """SELECT event_id, CASE WHEN event_type = 'click' OR event_type = 'view' AND value = floor(value) THEN 'integer'
    WHEN event_type = 'view' THEN 'float' END AS amount, CASE WHEN event_type <> 'error' THEN 'string' WHEN value = floor(value)
    THEN 'integer' ELSE 'float' END AS mixed, 'timestamp' AS at, 'unknown' AS tags FROM events""")
def infer_types(spark, d):
    def kind(path):
        return docs.infer_type(docs.attr_value(F.col("attributes"), path)).alias(path.split(".")[-1])

    return _event_documents(spark, d).select("event_id", *[kind(p) for p in ("amount", "mixed", "seen.at", "seen.tags")])


@query("widen_types", """SELECT lang, CASE WHEN bool_or(n_chars % 2 = 1) AND bool_or(n_chars % 2 = 0) THEN 'float'
    WHEN bool_or(n_chars % 2 = 0) THEN 'integer' ELSE 'float' END AS numbers,
    CASE WHEN bool_or(n_chars > 15000) THEN 'conflict' ELSE 'integer' END AS mixed FROM documents GROUP BY lang""")
def widen_types(spark, d):
    numbers = F.when(F.pmod("n_chars", F.lit(2)) == 0, "integer").otherwise("float")
    mixed = F.when(F.col("n_chars") > 15000, "string").otherwise("integer")
    sets = v.table(spark, d, "documents").groupBy("lang").agg(
        F.collect_set(numbers).alias("numbers"), F.collect_set(mixed).alias("mixed")
    )
    # A group of strings alone would be a string; every language here has short documents too.
    return sets.select("lang", docs.widen_types(F.col("numbers")).alias("numbers"), docs.widen_types(F.col("mixed")).alias("mixed"))


def _click_catalog(spark, d):
    """The catalog as the click events alone left it, with one path registered by hand."""
    clicks = _event_documents(spark, d).join(v.table(spark, d, "events").where("event_type = 'click'"), "event_id", "left_semi")
    by_hand = F.col("path") == "props.k"
    return ops.observe_attributes(clicks).select(
        "path",
        F.when(by_hand, "string").otherwise(F.col("value_type")).alias("value_type"),
        F.when(by_hand, "registered").otherwise("observed").alias("source"),
    )


_NUMERIC = "IN ('integer', 'float')"
_WIDENED = f"""CASE WHEN k.path IS NULL THEN o.value_type WHEN o.path IS NULL OR k.source = 'registered' OR k.value_type = o.value_type
    THEN k.value_type WHEN k.value_type = 'unknown' THEN o.value_type WHEN o.value_type = 'unknown' THEN k.value_type
    WHEN k.value_type {_NUMERIC} AND o.value_type {_NUMERIC} THEN 'float' ELSE 'conflict' END"""


@query(
    "merge_catalog",
    f"WITH {observed_sql('clicks', 'event_type = ' + chr(39) + 'click' + chr(39))}, {observed_sql('observed')}"
    + f""", known AS (SELECT path, CASE WHEN path = 'props.k' THEN 'string' ELSE value_type END AS value_type,
      CASE WHEN path = 'props.k' THEN 'registered' ELSE 'observed' END AS source FROM clicks),
    joined AS (SELECT coalesce(k.path, o.path) AS path, k.value_type AS old, {_WIDENED} AS new, coalesce(k.source, 'observed') AS source
      FROM known k FULL JOIN observed o ON o.path = k.path)
    SELECT path, CASE WHEN new = 'conflict' THEN old ELSE new END AS value_type, source, new = 'conflict' AS conflict FROM joined""",
)
def merge_catalog(spark, d):
    return ops.merge_catalog(_click_catalog(spark, d), ops.observe_attributes(_event_documents(spark, d)))


OBJECT_TYPES = f"types AS (SELECT DISTINCT path, {TYPED} AS value_type FROM leaves)"
_UP = "regexp_replace(path, '\\.[^.]+$', '')"
PARENTS = f"near AS (SELECT DISTINCT {_UP} AS path FROM leaves), parents AS (SELECT path FROM near UNION SELECT {_UP} FROM near)"
ALL_TYPES = "all_types AS (SELECT path, value_type FROM types UNION ALL SELECT path, 'unknown' FROM parents)"


@query("observe_catalog", v.with_views(v.OBJECTS, LEAVES, OBJECT_TYPES, PARENTS, ALL_TYPES) + """SELECT path,
    CASE WHEN path = 'upstream.size' THEN 'string' ELSE value_type END AS value_type,
    CASE WHEN path = 'upstream.etag' THEN 'builtin' ELSE 'observed' END AS source, path = 'upstream.size' AS conflict FROM all_types
    UNION ALL SELECT 'extracted.pages', 'integer', 'registered', false""")
def observed_catalog(spark, d):
    """Into a catalog that knows some paths: one as it is, one built in, one that nothing shows, and one of another type."""
    known = [
        ("user.quality", "integer", "observed"), ("upstream.etag", "string", "builtin"),
        ("extracted.pages", "integer", "registered"), ("upstream.size", "string", "observed"),
    ]
    catalog = spark.createDataFrame(known, "path string, value_type string, source string")
    merged, conflicts = observe_catalog(v.bare_objects(spark, d), catalog)
    clash = conflicts.select("path", F.lit(True).alias("_clash"))
    return merged.join(clash, "path", "left").select("path", "value_type", "source", F.coalesce("_clash", F.lit(False)).alias("conflict"))


def _object_catalog(spark, d):
    """What the objects' documents show, with the core paths registered as plain strings."""
    core = F.col("path").startswith("core.")
    return ops.observe_attributes(v.bare_objects(spark, d)).select(
        "path",
        F.when(core, "string").otherwise(F.col("value_type")).alias("value_type"),
        F.when(core, "registered").otherwise("observed").alias("source"),
    )


@query(
    "seed_catalog",
    v.with_views(v.OBJECTS, LEAVES, OBJECT_TYPES, PARENTS, ALL_TYPES)
    + """SELECT path, value_type, CASE WHEN starts_with(path, 'core.') THEN 'builtin' ELSE 'observed' END AS source FROM all_types
    UNION ALL SELECT 'upstream.s3.version_id', 'string', 'builtin' UNION ALL SELECT 'extracted.content_sha256', 'string', 'registered'""",
)
def seed_catalog(spark, d):
    return ops.seed_catalog(_object_catalog(spark, d))


@query(
    "merge_attributes",
    v.with_views(v.OBJECTS) + """SELECT id, CAST(size + 1 AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS etag, quality,
    last_modified AS first_seen_at, '2024-02-01T00:00:00Z' AS last_seen_at FROM objects""",
)
def merge_attributes(spark, d):
    o = v.objects(spark, d)
    bare = F.to_variant_object(F.struct(F.struct((F.col("size") + 1).alias("size")).alias("upstream")))
    new = o.withColumn("new", docs.with_core(bare, F.lit("other"), F.lit("2024-02-01T00:00:00Z")))
    merged = new.select("id", docs.merge_attributes(F.col("attributes"), F.col("new"), F.col("id")).alias("doc"))
    doc = F.col("doc")
    return merged.select(
        docs.attr_text(doc, "core.object_id").alias("id"), docs.attr(doc, "upstream.size", "integer").alias("size"),
        docs.attr_text(doc, "upstream.etag").alias("etag"), docs.attr(doc, "user.quality", "integer").alias("quality"),
        docs.attr_text(doc, "core.first_seen_at").alias("first_seen_at"), docs.attr_text(doc, "core.last_seen_at").alias("last_seen_at"),
    )


@query(
    "path_edits",
    v.with_views(v.OBJECTS) + """SELECT id, bucket_id AS team, CAST(size AS VARCHAR) AS deep, toxic IS NULL AND quality IS NULL AS bare,
    true AS header_gone, etag FROM objects""",
)
def path_edits(spark, d):
    """Set below a number that becomes an object, set a new branch, and delete a leaf together with its parent."""
    o = v.objects(spark, d)
    doc = docs.set_path(F.col("attributes"), "user.review.team", F.col("bucket_id"))
    o = o.withColumn("attributes", doc)
    o = o.withColumn("attributes", docs.set_path(F.col("attributes"), "user.review.team.size", F.col("size")))
    o = o.withColumn("kept", docs.set_path(F.col("attributes"), "user.review.team", F.col("bucket_id")))
    o = o.withColumn("less", docs.delete_path(F.col("attributes"), "upstream.header.content_type"))
    return o.select(
        "id",
        docs.attr_text(F.col("kept"), "user.review.team").alias("team"),
        docs.attr_text(F.col("attributes"), "user.review.team.size").alias("deep"),
        (docs.attr_text(F.col("less"), "user.quality").isNull() & docs.attr_text(F.col("less"), "user.toxic").isNull()).alias("bare"),
        docs.attr_value(F.col("less"), "upstream.header").isNull().alias("header_gone"),
        docs.attr_text(F.col("less"), "upstream.etag").alias("etag"),
    )


def _edits(spark, d):
    """For every labelled object: a score, a nested note, the removal of its quality; toxic ones also break a rule."""
    o = v.objects(spark, d)
    toxic, quality = docs.attr_text(F.col("attributes"), "user.toxic"), docs.attr_text(F.col("attributes"), "user.quality")

    def edit(op, path, value, provenance):
        return F.struct(
            F.lit(op).alias("op"), F.lit(path).alias("path"), value.cast("variant").alias("value"), F.lit(provenance).alias("provenance")
        )

    nothing = F.lit(None).cast("string")
    common = [edit("set", "user.score", F.col("size"), "user_1"), edit("set", "user.note.by", F.col("bucket_id"), "user_2"),
              edit("delete", "user.quality", nothing, None), edit("delete", "user.missing.leaf", nothing, None)]
    bad = edit("set", "upstream.etag", F.lit("x"), "user_3")
    clash = edit("set", "user.level", F.lit("high"), "user_4")
    edits = F.array(*common)
    edits = F.when(toxic == "1", F.concat(edits, F.array(bad))).when(
        F.col("storage_class") == "GLACIER", F.concat(edits, F.array(clash))).otherwise(edits)
    return o.where(quality.isNotNull()).select("id", F.inline(edits))


def _edit_catalog(spark, d):
    """The objects' catalog, with the toxic flag's type standing for a level that nobody has set yet."""
    path = F.when(F.col("path") == "user.toxic", "user.level").otherwise(F.col("path"))
    return _object_catalog(spark, d).withColumn("path", path)


def _mutated(spark, d):
    stamp = F.lit("2024-02-01T00:00:00Z").cast("timestamp")
    return ops.mutate_attributes(v.objects(spark, d), _edits(spark, d), _edit_catalog(spark, d), stamp)


_GOOD = "(quality IS NOT NULL AND toxic <> 1 AND coalesce(storage_class, '') <> 'GLACIER')"


@query(
    "mutate_attributes",
    v.with_views(v.OBJECTS) + f"""SELECT id, etag, content_type, storage_class, toxic, CASE WHEN {_GOOD} THEN NULL ELSE quality END AS quality,
    CASE WHEN {_GOOD} THEN size END AS score, CASE WHEN {_GOOD} THEN bucket_id END AS note_by,
    CASE WHEN {_GOOD} THEN 'user_1' END AS score_by, CASE WHEN {_GOOD} THEN TIMESTAMP '2024-02-01' ELSE updated_at END AS updated_at
    FROM objects""",
)
def mutate_attributes(spark, d):
    doc = F.col("attributes")
    return _mutated(spark, d)[0].select(
        "id", docs.attr_text(doc, "upstream.etag").alias("etag"), docs.attr_text(doc, "upstream.header.content_type").alias("content_type"),
        docs.attr_text(doc, "upstream.s3.storage_class").alias("storage_class"), docs.attr(doc, "user.toxic", "integer").alias("toxic"),
        docs.attr(doc, "user.quality", "integer").alias("quality"), docs.attr(doc, "user.score", "integer").alias("score"),
        docs.attr_text(doc, "user.note.by").alias("note_by"), F.col("attribute_provenance")["user.score"].alias("score_by"), ntz("updated_at"),
    )


@query(
    "rejected_edits",
    v.with_views(v.OBJECTS) + f""", bad AS (SELECT id, toxic FROM objects WHERE quality IS NOT NULL AND NOT {_GOOD})
    SELECT id, path, error FROM bad, (VALUES ('user.score'), ('user.note.by'), ('user.quality'), ('user.missing.leaf')) t(path),
      (SELECT CAST(NULL AS VARCHAR) AS error)
    UNION ALL SELECT id, CASE WHEN toxic = 1 THEN 'upstream.etag' ELSE 'user.level' END,
      CASE WHEN toxic = 1 THEN 'path is outside the namespace' ELSE 'type conflict' END FROM bad""",
)
def rejected_edits(spark, d):
    return _mutated(spark, d)[1].select("id", "path", "error")


def _pages(spark, d):
    """One saved page per object; those labelled toxic came back as an error, the newest end their listing."""
    o = v.objects(spark, d)
    toxic = docs.attr_text(F.col("attributes"), "user.toxic") == "1"
    entry = F.concat(
        F.lit("<Contents><Key>"), F.col("key"), F.lit("</Key><ETag> &quot;"), F.col("etag"), F.lit("&quot; </ETag><Size>"),
        F.col("size").cast("string"), F.lit("</Size><LastModified>"), F.regexp_replace("last_modified", "Z$", ".000Z"),
        F.lit("</LastModified>"),
        F.coalesce(F.concat(F.lit("<StorageClass>"), F.col("storage_class"), F.lit("</StorageClass>")), F.lit("")), F.lit("</Contents>"),
    )
    more = F.when(F.col("size") > 1000, "true").otherwise("false")
    page = F.concat(
        F.lit('<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><IsTruncated>'), more,
        F.lit("</IsTruncated><NextContinuationToken>"), F.col("id"), F.lit("</NextContinuationToken>"), entry, F.lit("</ListBucketResult>"),
    )
    failure = F.lit("<Error><Code>SlowDown</Code><Message>later</Message></Error>")
    return o.select(
        "bucket_id", "id", F.lit("aws").alias("upstream"), F.when(toxic, 503).otherwise(200).alias("status"),
        F.when(toxic, failure).otherwise(page).alias("body"),
    )


@query(
    "read_listing",
    v.with_views(v.OBJECTS) + """SELECT bucket_id, key, '"' || etag || '"' AS etag, size, created_at AS last_modified,
    coalesce(storage_class, '') AS storage_class FROM objects WHERE coalesce(toxic, 0) <> 1""",
)
def listed(spark, d):
    return read_listing(_pages(spark, d), ("bucket_id",)).withColumn("last_modified", ntz("last_modified"))


@query(
    "listing_pages",
    v.with_views(v.OBJECTS) + """SELECT id, CASE WHEN toxic = 1 THEN 'status 503: SlowDown later' END AS error,
    coalesce(toxic, 0) <> 1 AND size > 1000 AS is_truncated, CASE WHEN toxic = 1 THEN '' ELSE id END AS next_continuation_token FROM objects""",
)
def listing_pages(spark, d):
    return parse_pages(_pages(spark, d)).select("id", "error", "is_truncated", "next_continuation_token")


@query(
    "listing_complete",
    v.with_views(v.OBJECTS) + """SELECT bucket_id, count(*) FILTER (toxic = 1) = 0
    AND bool_or(toxic = 1 OR size <= 1000) AS complete FROM objects GROUP BY bucket_id""",
)
def complete(spark, d):
    return listing_complete(_pages(spark, d))


def _heads(spark, d):
    """Response headers of every object, in the mixed case servers use, from four providers."""
    o = v.objects(spark, d)
    lang = F.split_part("key", F.lit("/"), F.lit(1))
    provider = F.when(lang == "en", "aws").when(lang == "fr", "b2").when(lang == "de", "gcp").otherwise("rustfs")
    http_date = F.date_format("created_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")

    def pair(name, value):
        return F.array(F.lit(name), value)

    headers = F.array(
        pair("ETag", F.col("etag")), pair("Content-Length", F.col("size").cast("string")), pair("Last-Modified", http_date),
        pair("Content-Type", F.col("content_type")), pair("Content-Type", F.lit("text/second")),
        pair("X-Amz-Meta-Owner", F.lit("first")), pair("x-amz-meta-owner", F.col("bucket_id")),
        pair("x-amz-storage-class", F.coalesce("storage_class", F.lit("NONE"))), pair("X-Goog-Hash", F.lit("crc32c=a")),
        pair("x-goog-hash", F.lit("md5=b")), pair("X-Backblaze-Live-Read-Enabled", F.lit("t")),
    )
    broken = F.when(F.col("storage_class").isNull(), F.concat(headers, F.array(pair("x-goog-stored-content-length", F.lit("many")))))
    return o.select("id", provider.alias("upstream"), F.coalesce(broken, headers).alias("headers"))


@query(
    "attributes_from_head",
    v.with_views(v.OBJECTS) + """, h AS (SELECT *, split_part(key, '/', 1) AS lang, split_part(key, '/', 1) = 'de' AND storage_class IS NULL AS bad FROM objects)
    SELECT id, CASE WHEN bad THEN 'x-goog-stored-content-length is malformed' END AS error, CASE WHEN NOT bad THEN etag END AS etag,
    CASE WHEN NOT bad THEN size END AS size, CASE WHEN NOT bad THEN last_modified END AS last_modified,
    CASE WHEN NOT bad THEN content_type END AS content_type, CASE WHEN NOT bad THEN bucket_id END AS owner,
    CASE WHEN lang <> 'de' THEN coalesce(storage_class, 'NONE') END AS storage_class, CASE WHEN lang = 'fr' THEN 'true' END AS live_read,
    CASE WHEN lang = 'de' AND NOT bad THEN '["crc32c=a","md5=b"]' END AS goog_hash FROM h""",
)
def from_head(spark, d):
    doc = F.col("attributes")
    return attributes_from_head(_heads(spark, d)).select(
        "id", "error", docs.attr_text(doc, "upstream.etag").alias("etag"), docs.attr(doc, "upstream.size", "integer").alias("size"),
        docs.attr_text(doc, "upstream.last_modified").alias("last_modified"),
        docs.attr_text(doc, "upstream.header.content_type").alias("content_type"),
        docs.attr_text(doc, "upstream.metadata.owner").alias("owner"), docs.attr_text(doc, "upstream.s3.storage_class").alias("storage_class"),
        docs.attr_text(doc, "upstream.b2.live_read_enabled").alias("live_read"), docs.attr_text(doc, "upstream.gcp.hash").alias("goog_hash"),
    )


RULES = [
    *platform_rules(),
    CaptureRule("upstream.custom.origin", "response_header", "X-Origin"),
    CaptureRule("upstream.custom.team", "metadata_key", "team"),
    CaptureRule("upstream.custom.rank", "tag_key", "rank", "integer", capture_source="tagging"),
    CaptureRule("upstream.custom.off", "metadata_key", "team", enabled=False),
]


@query(
    "capture_attributes",
    v.with_views(v.OBJECTS) + """SELECT id, CASE WHEN toxic = 1 THEN 'upstream.etag is missing' END AS error,
    CASE WHEN coalesce(toxic, 0) <> 1 THEN size END AS size, CASE WHEN coalesce(toxic, 0) <> 1 THEN storage_class END AS storage_class,
    CASE WHEN coalesce(toxic, 0) <> 1 THEN 'edge' END AS origin, CASE WHEN coalesce(toxic, 0) <> 1 THEN bucket_id END AS team,
    CASE WHEN coalesce(toxic, 0) <> 1 AND quality IS NOT NULL THEN quality END AS rank,
    CASE WHEN coalesce(toxic, 0) <> 1 THEN bucket_id END AS meta_team, coalesce(toxic, 0) = 1 OR quality IS NOT NULL AS tagged FROM objects""",
)
def capture(spark, d):
    o = v.objects(spark, d)
    toxic = F.coalesce(docs.attr_text(F.col("attributes"), "user.toxic"), F.lit("0")) == "1"
    quality = docs.attr_text(F.col("attributes"), "user.quality")
    fields = F.create_map(
        F.lit("ETag"), F.when(~toxic, F.col("etag")), F.lit("ContentLength"), F.col("size").cast("string"), F.lit("LastModified"),
        F.col("last_modified"), F.lit("StorageClass"), F.coalesce("storage_class", F.lit("")), F.lit("DeleteMarker"), F.lit("false"),
    )
    heads = o.select(
        "id",
        F.map_filter(fields, lambda _, x: x.isNotNull()).alias("fields"),
        F.create_map(F.lit("x-ORIGIN"), F.lit(" edge ")).alias("response_headers"),
        F.create_map(F.lit("team"), F.col("bucket_id")).alias("metadata"),
        F.when(quality.isNotNull(), F.create_map(F.lit("rank"), quality)).otherwise(F.create_map(F.lit("rank"), F.lit("none"))).alias("tags"),
    )
    doc = F.col("attributes")
    return capture_attributes(heads, RULES).select(
        "id", "error", docs.attr(doc, "upstream.size", "integer").alias("size"), docs.attr_text(doc, "upstream.s3.storage_class").alias("storage_class"),
        docs.attr_text(doc, "upstream.custom.origin").alias("origin"), docs.attr_text(doc, "upstream.custom.team").alias("team"),
        docs.attr(doc, "upstream.custom.rank", "integer").alias("rank"), docs.attr_text(doc, "upstream.metadata.team").alias("meta_team"),
        (doc.isNull() | (docs.attr_text(doc, "upstream.tag.rank") != "none")).alias("tagged"),
    )


@query(
    "validate_rules",
    """SELECT o_orderkey AS rule_id, CASE WHEN o_orderstatus = 'P' THEN 'attribute_path must start with upstream.'
    WHEN o_orderpriority = '1-URGENT' THEN 'sdk_field is for platform rules only' WHEN o_orderpriority = '2-HIGH' THEN 'extractor_ref must be *'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'unsupported extractor_type' END AS error,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'x-team' ELSE 'X-Team' END AS extractor_ref FROM orders""",
)
def validated(spark, d):
    priority = F.col("o_orderpriority")
    kind = (
        F.when(priority == "1-URGENT", "sdk_field").when(priority == "2-HIGH", "metadata_all").when(priority == "3-MEDIUM", "script")
        .when(priority == "5-LOW", "response_header").otherwise("tag_key")
    )
    path = F.when(F.col("o_orderstatus") == "P", "user.team").otherwise(" upstream.team ")
    rules = v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("rule_id"), path.alias("attribute_path"), kind.alias("extractor_type"),
        F.lit(" X-Team").alias("extractor_ref"), F.lit("user").alias("origin"),
    )
    return validate_rules(rules).select("rule_id", "error", "extractor_ref")


@query(
    "listing_evidence",
    v.with_views(v.OBJECTS) + """SELECT id, etag, size, last_modified, coalesce(storage_class, '') AS storage_class, '' || etag AS small_etag,
    CASE WHEN size <> 0 THEN size END AS small_size, 'kept' AS captured FROM objects""",
)
def listing_evidence(spark, d):
    """Evidence read from documents, as a minimal document, and laid over a captured one."""
    o = v.bare_objects(spark, d)
    rows = o.select("id", *[F.coalesce(c, F.lit("")).alias(n) if n == "storage_class" else c.alias(n) for n, c in ev.evidence(o).items()])
    facts = [F.col(n) for n in ("etag", "size", "last_modified", "storage_class")]
    captured = F.to_variant_object(F.struct(F.struct(F.lit("old").alias("etag"), F.lit("kept").alias("note")).alias("upstream")))
    rows = rows.withColumns({"small": ev.listed_attributes(*facts), "over": ev.overlay_evidence(captured, *facts)})
    return rows.select(
        "id", docs.attr_text(F.col("over"), "upstream.etag").alias("etag"), docs.attr(F.col("over"), "upstream.size", "integer").alias("size"),
        docs.attr_text(F.col("over"), "upstream.last_modified").alias("last_modified"),
        F.coalesce(docs.attr_text(F.col("over"), "upstream.s3.storage_class"), F.lit("")).alias("storage_class"),
        docs.attr_text(F.col("small"), "upstream.etag").alias("small_etag"), docs.attr(F.col("small"), "upstream.size", "integer").alias("small_size"),
        docs.attr_text(F.col("over"), "upstream.note").alias("captured"),
    )


@query("time_texts", """SELECT event_id, ts AS parsed, date_trunc('millisecond', ts) AS from_millis, date_trunc('second', ts) AS http FROM events""")
def time_texts(spark, d):
    rows = v.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    rows = rows.select(
        "event_id", text.parse_rfc3339(text.format_rfc3339_nano(F.col("at"))).alias("parsed"), text.from_millis(F.unix_millis("at")).alias("from_millis"),
        text.parse_http_date(F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).alias("http"),
    )
    return rows.select("event_id", *[ntz(c) for c in ("parsed", "from_millis", "http")])
