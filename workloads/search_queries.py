"""Search, predicates, ordering, relations and collections."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from stowage.operators import objects as object_ops
from stowage.operators import ordering, predicates as p, relations as rel
from stowage.plans.search import collection_members, saved_predicate, search
from workloads import views as v
from workloads.registry import query

TYPES = {
    "upstream.size": "integer",
    "upstream.last_modified": "timestamp",
    "upstream.header.content_type": "string",
    "core.first_seen_at": "timestamp",
    "user.quality": "integer",
    "user.toxic": "integer",
}
ROW = ["id", "bucket_id", "key"]


def ntz(name: str):
    return F.col(name).cast("timestamp_ntz").alias(name)


@query(
    "search_newest_text",
    v.with_views(v.OBJECTS)
    + """SELECT id, bucket_id, key, size, created_at FROM objects
    WHERE size >= 1000 AND content_type LIKE 'text/%' ORDER BY created_at DESC NULLS FIRST, id LIMIT 100""",
)
def search_newest_text(spark, d):
    found = search(
        v.objects(spark, d),
        lambda o: (o.attr("upstream.size") >= 1000) & o.attr("upstream.header.content_type").like("text/%"),
        lambda o: [o.field("created_at").desc(), o.field("id")],
        limit=100,
        catalog=TYPES,
    )
    return found.select(*ROW, "size", ntz("created_at"))


@query(
    "search_document_only",
    v.with_views(v.OBJECTS)
    + """SELECT id, bucket_id, key FROM objects WHERE size >= 1000 AND content_type LIKE 'text/%'
    ORDER BY size DESC NULLS FIRST, id LIMIT 100""",
)
def search_document_only(spark, d):
    """The same search where the document is all there is: no promoted columns."""
    return search(
        v.bare_objects(spark, d),
        lambda o: (o.attr("upstream.size") >= 1000) & o.attr("upstream.header.content_type").like("text/%"),
        lambda o: [o.attr("upstream.size").desc(), o.field("id")],
        limit=100,
        catalog=TYPES,
    ).select(*ROW)


@query(
    "read_objects",
    v.with_views(v.OBJECTS)
    + """SELECT id, bucket_id, key, created_at, updated_at, etag, size, last_modified, content_type, storage_class,
    CAST(quality AS VARCHAR) AS quality, 'job_import' AS provenance FROM objects""",
)
def read_objects(spark, d):
    o = v.bare_objects(spark, d)
    f = p.ObjectFields(o)
    return o.select(
        *ROW,
        ntz("created_at"),
        ntz("updated_at"),
        f.attr("upstream.etag").column.alias("etag"),
        f.attr("upstream.size").cast("integer").column.alias("size"),
        f.attr("upstream.last_modified").column.alias("last_modified"),
        f.attr("upstream.header.content_type").column.alias("content_type"),
        f.attr("upstream.s3.storage_class").column.alias("storage_class"),
        f.attr("user.quality").column.alias("quality"),
        F.col("attribute_provenance")["upstream"].alias("provenance"),
    )


def _where(name, sql, where, catalog=TYPES):
    """Register one predicate as an uncapped search over all objects."""

    @query(name, v.with_views(v.OBJECTS) + f"SELECT id, bucket_id, key FROM objects WHERE {sql}")
    def run(spark, d):
        return search(v.bare_objects(spark, d), where, catalog=catalog).select(*ROW)


_where("field_equals", "bucket_id = 'src3'", lambda o: o.field("bucket_id") == "src3")
_where("attribute_text", "CAST(size AS VARCHAR) = '380' OR last_modified = '2024-01-01T00:37:00Z'",
       lambda o: (o.attr("upstream.size") == "380") | (o.attr("upstream.last_modified") == "2024-01-01T00:37:00Z"), {})
_where("attribute_typed", "size = 380 OR quality = 1",
       lambda o: (o.attr("upstream.size") == 380) | (o.attr("user.quality") == 1))
_where("attribute_cast", "CAST(size AS DOUBLE) > 999.5 AND created_at < TIMESTAMP '2024-01-01 06:00:00'",
       lambda o: (o.attr("upstream.size").cast("double") > 999.5)
       & (o.attr("upstream.last_modified").cast("timestamptz") < p.ts("2024-01-01T06:00:00Z")), {})
_where("timestamp_literals",
       "created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-01 05:30:00'",
       lambda o: (o.attr("upstream.last_modified") >= p.ts("2024-01-01"))
       & (o.field("created_at") < p.ts("2024-01-01T07:00:00+01:30")))
_where("comparisons",
       "size > 100 AND size <= 5000 AND size <> 416 AND created_at > TIMESTAMP '2024-01-01 01:00:00' AND quality < 1.5",
       lambda o: (o.attr("upstream.size") > 100) & (o.attr("upstream.size") <= 5000) & (o.attr("upstream.size") != 416)
       & (o.field("created_at") > p.ts("2024-01-01T01:00:00Z")) & (o.attr("user.quality") < 1.5))
_where("like", "key LIKE 'en/%1.txt'", lambda o: o.field("key").like("en/%1.txt"))
_where("ilike", "key ILIKE 'EN/_7.TXT'", lambda o: o.field("key").ilike("EN/_7.TXT"))
_where("value_list", "bucket_id IN ('src1', 'src2', 'src5') AND size IN (380, 416, 3866, 1000)",
       lambda o: o.field("bucket_id").isin("src1", "src2", "src5") & o.attr("upstream.size").isin(380, 416, 3866, 1000))
_where("between", "size BETWEEN 500 AND 1500.5", lambda o: o.attr("upstream.size").between(500, 1500.5))
_where("null_tests", "storage_class IS NULL AND quality IS NOT NULL",
       lambda o: o.attr("upstream.s3.storage_class").is_null() & o.attr("user.quality").is_not_null())
_where("boolean_tree", "NOT (size < 1000) AND (quality = 1 OR toxic = 0) OR bucket_id = 'src0'",
       lambda o: (~(o.attr("upstream.size") < 1000) & ((o.attr("user.quality") == 1) | (o.attr("user.toxic") == 0)))
       | (o.field("bucket_id") == "src0"))
_where("time_arithmetic",
       "created_at > TIMESTAMP '2024-01-15' - INTERVAL 14 DAY AND created_at + INTERVAL 2 HOUR < TIMESTAMP '2024-01-01 12:00:00'",
       lambda o: (o.attr("upstream.last_modified") > p.now(v.NOW) - p.interval("2 weeks"))
       & (o.field("created_at") + p.interval("2 hours") < p.ts("2024-01-01T12:00:00Z")))


@query(
    "in_bucket",
    v.with_views(v.OBJECTS, v.BUCKETS)
    + "SELECT id, bucket_id, key FROM objects WHERE bucket_id = (SELECT id FROM buckets WHERE name = 'bucket-src4')",
)
def in_bucket(spark, d):
    inside = p.in_bucket(v.buckets(spark, d), "bucket-src4")
    return search(v.objects(spark, d), inside).select(*ROW)


def _scope(name, sql, scope):
    @query(name, v.with_views(v.OBJECTS) + f"SELECT id, bucket_id, key FROM objects WHERE {sql}")
    def run(spark, d):
        o = v.objects(spark, d)
        return search(o, scope=scope(o)).select(*ROW)


_scope("scope_bucket", "bucket_id = 'src2'", lambda o: p.scope("src2"))
_scope("scope_prefix", "starts_with(key, 'en/1')", lambda o: p.scope(prefixes=p.join_prefix("en/", "/1")))
_scope("scope_lists", "bucket_id IN ('src1', 'src7') AND (starts_with(key, 'en/') OR starts_with(key, 'fr/2'))",
       lambda o: p.scope(["src1", "src7"], ["en/", "fr/2"]))
_scope("key_contains", "key ILIKE '%N/1_%'", lambda o: p.key_contains("N/1_"))
_scope("content_type", "content_type = 'text/en'", lambda o: p.content_type_is(o, "text/en"))



def fnv_sql(text: str) -> str:
    """FNV-1a over an ASCII column in the oracle's SQL."""
    return (
        f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length({text}) + 1),"
        f" lambda pos: ord(substr({text}, CAST(pos AS INT), 1))::BIGINT)),"
        " lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
    )


_scope("in_partition", f"{fnv_sql('key')} % 16 = 5", lambda o: p.in_partition(16, 5))


@query(
    "order_nulls",
    v.with_views(v.OBJECTS)
    + """SELECT id, quality, storage_class FROM objects
    ORDER BY storage_class ASC NULLS LAST, quality DESC NULLS FIRST, id LIMIT 250""",
)
def order_nulls(spark, d):
    found = search(
        v.objects(spark, d),
        order_by=lambda o: [o.attr("upstream.s3.storage_class"), o.attr("user.quality").desc(), o.field("id")],
        limit=250,
        catalog=TYPES,
    )
    return found.select("id", p.ObjectFields(found, TYPES).attr("user.quality").column.alias("quality"), "storage_class")


@query(
    "limit_cap",
    v.with_views(v.OBJECTS) + "SELECT id FROM objects ORDER BY id LIMIT 5000",
)
def limit_cap(spark, d):
    return search(v.objects(spark, d), order_by=[F.col("id").asc_nulls_last()], limit=5000).select("id")


@query(
    "offset_page",
    v.with_views(v.OBJECTS) + "SELECT id, size FROM objects ORDER BY size DESC NULLS FIRST, id LIMIT 50 OFFSET 75",
)
def offset_page(spark, d):
    return search(
        v.objects(spark, d),
        order_by=lambda o: [o.attr("upstream.size").desc(), o.field("id")],
        limit=50,
        offset=75,
        catalog=TYPES,
    ).select("id", "size")


@query(
    "list_objects",
    v.with_views(v.OBJECTS)
    + """SELECT id, bucket_id, key FROM objects WHERE bucket_id = 'src1' AND starts_with(key, 'en/')
    AND content_type = 'text/en' AND key ILIKE '%1%' ORDER BY bucket_id, key""",
)
def list_objects(spark, d):
    return ordering.list_objects(
        v.objects(spark, d), bucket_id="src1", prefix="en/", content_type="text/en", key_contains="1"
    ).select(*ROW)


@query(
    "list_objects_after",
    v.with_views(v.OBJECTS)
    + """SELECT id, bucket_id, key FROM objects WHERE bucket_id > 'src1' OR bucket_id = 'src1' AND key > 'en/5'
    ORDER BY bucket_id, key LIMIT 60""",
)
def list_objects_after(spark, d):
    return ordering.list_objects(v.objects(spark, d), 60, after=("src1", "en/5")).select(*ROW)


@query("count_in_scope", v.with_views(v.OBJECTS) + "SELECT count(*) AS object_count FROM objects WHERE starts_with(key, 'en/')")
def count_in_scope(spark, d):
    return object_ops.count_in_scope(v.objects(spark, d), p.scope(prefixes="en/"))


@query(
    "rows_for_keys",
    v.with_views(v.CATALOG, v.LISTING)
    + "SELECT id, bucket_id, key FROM catalog WHERE bucket_id = 'src3' AND key IN (SELECT key FROM listing)",
)
def rows_for_keys(spark, d):
    keys = v.listing(spark, d).where("bucket_id = 'src3'").select("key")
    return object_ops.rows_for_keys(v.catalog(spark, d), "src3", keys).select(*ROW)


def _related(name, sql, direction, lacking=False):
    @query(name, v.with_views(v.OBJECTS, v.RELATIONS) + f"SELECT id, bucket_id, key FROM objects o WHERE {sql}")
    def run(spark, d):
        apply = rel.lacks_relation if lacking else rel.has_relation
        return apply(v.objects(spark, d), v.relations(spark, d), "derived_from", direction).select(*ROW)


_EDGE = "(SELECT 1 FROM relations r WHERE r.relation_type = 'derived_from' AND {})"
_OUT, _IN = "r.source_object_id = o.id", "r.target_object_id = o.id"
_related("has_relation_out", "EXISTS " + _EDGE.format(_OUT), "out")
_related("has_relation_in", "EXISTS " + _EDGE.format(_IN), "in")
_related("has_relation_any", "EXISTS " + _EDGE.format(f"({_OUT} OR {_IN})"), "any")
_related("lacks_relation", "NOT EXISTS " + _EDGE.format(_OUT), "out", lacking=True)


@query(
    "relation_in_tree",
    v.with_views(v.OBJECTS, v.RELATIONS)
    + f"""SELECT id, bucket_id, key FROM objects o WHERE (size > 2000 AND NOT EXISTS {_EDGE.format(_OUT)})
    OR EXISTS {_EDGE.format(_IN)}""",
)
def relation_in_tree(spark, d):
    edges = v.relations(spark, d)
    out = rel.relation_exists(edges, "derived_from", "out")
    into = rel.relation_exists(edges, "derived_from", "in")
    return search(
        v.objects(spark, d), lambda o: ((o.attr("upstream.size") > 2000) & ~out) | into, catalog=TYPES
    ).select(*ROW)


@query(
    "relation_types",
    v.with_views(v.RELATIONS) + "SELECT DISTINCT relation_type FROM relations ORDER BY relation_type",
)
def relation_types(spark, d):
    return rel.relation_types(v.relations(spark, d))


@query(
    "collection_members",
    v.with_views(v.OBJECTS)
    + """SELECT 'large' AS collection_id, id AS object_id FROM objects WHERE size >= 2000
    UNION ALL SELECT 'good', id FROM objects WHERE quality = 1
    UNION ALL SELECT 'glacier', id FROM objects WHERE storage_class = 'GLACIER'
    UNION ALL SELECT 'english', id FROM objects WHERE key LIKE 'en/%'""",
)
def members(spark, d):
    saved = [
        saved_predicate("large", lambda o: o.attr("upstream.size") >= 2000),
        saved_predicate("good", lambda o: o.attr("user.quality") == 1),
        saved_predicate("glacier", "storage_class = 'GLACIER'"),
        saved_predicate("english", F.col("key").like("en/%")),
    ]
    return collection_members(v.objects(spark, d), saved, TYPES)


AT = datetime(2024, 2, 1, tzinfo=timezone.utc)


def _edge_columns(df):
    return df.select(
        "source_object_id", "target_object_id", "relation_type", F.col("attributes")["toxic"].alias("toxic"),
        "created_by_run_id", ntz("created_at"), ntz("updated_at"),
    )


@query(
    "upsert_relations",
    v.with_views(v.RELATIONS)
    + """, incoming AS (
      SELECT source_object_id, CASE WHEN toxic = '1' THEN source_object_id ELSE target_object_id END AS target_object_id,
             'duplicate' AS relation_type, 'new' AS toxic FROM relations WHERE relation_type = 'derived_from'
    ), fresh AS (SELECT * FROM incoming WHERE source_object_id <> target_object_id)
    SELECT coalesce(o.source_object_id, f.source_object_id) AS source_object_id,
           coalesce(o.target_object_id, f.target_object_id) AS target_object_id,
           coalesce(o.relation_type, f.relation_type) AS relation_type, coalesce(f.toxic, o.toxic) AS toxic,
           CASE WHEN f.toxic IS NULL THEN o.created_by_run_id ELSE 'run_new' END AS created_by_run_id,
           coalesce(o.created_at, TIMESTAMP '2024-02-01') AS created_at,
           CASE WHEN f.toxic IS NULL THEN o.updated_at ELSE TIMESTAMP '2024-02-01' END AS updated_at
    FROM relations o FULL JOIN fresh f ON o.source_object_id = f.source_object_id
         AND o.target_object_id = f.target_object_id AND o.relation_type = f.relation_type""",
)
def upsert_relations(spark, d):
    stored = v.relations(spark, d)
    stamp = F.lit("2024-02-01T00:00:00Z").cast("timestamp")
    looped = F.when(F.col("attributes")["toxic"] == "1", F.col("source_object_id")).otherwise(F.col("target_object_id"))
    incoming = stored.where("relation_type = 'derived_from'").select(
        "source_object_id",
        looped.alias("target_object_id"),
        F.lit("").alias("relation_type"),
        F.create_map(F.lit("toxic"), F.lit("new")).alias("attributes"),
        F.lit("run_new").alias("created_by_run_id"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )
    return _edge_columns(rel.upsert_relations(stored, incoming))


_BETWEEN = """relation_type = 'duplicate' AND source_object_id IN (SELECT id FROM objects WHERE content_type = 'text/en')
    AND target_object_id IN (SELECT id FROM objects WHERE content_type = 'text/en')"""


@query("duplicate_relations_between", v.with_views(v.OBJECTS, v.RELATIONS) + f"SELECT * FROM relations WHERE {_BETWEEN}")
def duplicate_relations_between(spark, d):
    ids = v.objects(spark, d).where("content_type = 'text/en'").select("id")
    return _edge_columns(rel.duplicate_relations_between(v.relations(spark, d), ids))


@query("drop_duplicate_relations", v.with_views(v.OBJECTS, v.RELATIONS) + f"SELECT * FROM relations WHERE NOT ({_BETWEEN})")
def drop_duplicate_relations(spark, d):
    ids = v.objects(spark, d).where("content_type = 'text/en'").select("id")
    return _edge_columns(rel.drop_duplicate_relations(v.relations(spark, d), ids))
