"""Listings as chains of pages, what an incomplete one may do to the catalog, scopes that are tables, and hashes of files.

The listing is cut into pages of ten keys, linked by their cursors. Buckets differ by what happened to their pages: of every
five, one lost its second page, one its last, one got an error for its first, and one read its second page twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from stowage.operators import reconcile as diff
from stowage.operators.scopes import in_scope
from stowage.operators.skew import number_within
from stowage.plans.collections import indexed_members
from stowage.plans.reconcile import reconcile
from stowage.plans.verify import verify
from stowage.session import scratch_path
from stowage.sources.contents import hash_contents
from stowage.sources.listing import listing_chains, once_per_key, read_listing
from workloads import views as v
from workloads.catalog_queries import AT, DAY, IMPORTS, PRINTS, REFRESHES, REMOVALS, plan_columns
from workloads.registry import query

PAGE_KEYS = 10


def _kind():
    """What happened to the pages of a bucket."""
    return F.substring("bucket_id", 4, 9).cast("int") % 5


def listed(pages):
    return once_per_key(read_listing(pages, ("bucket_id",)))


def _element(name, value):
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def saved_pages(spark, d):
    """(bucket_id, upstream, status, body) of the pages as they were saved, repeated and failed ones too."""
    entry = F.concat(
        _element("Key", F.col("key")), _element("ETag", F.col("etag")), _element("Size", F.col("size").cast("string")),
        _element("LastModified", F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(_element("StorageClass", F.col("storage_class")), F.lit("")),
    )
    placed = number_within(v.listing(spark, d), ["bucket_id"], ["key"], "n").withColumn("page", F.floor((F.col("n") - 1) / PAGE_KEYS))
    numbered = F.struct("n", _element("Contents", entry).alias("entry"))
    # A page has at most PAGE_KEYS keys.
    contents = F.array_join(F.transform(F.array_sort(F.collect_list(numbered)), lambda e: e["entry"]), "")
    pages = placed.groupBy("bucket_id", "page").agg(contents.alias("contents"))
    sizes = placed.groupBy("bucket_id").agg((F.max("page") + 1).alias("pages"))
    pages = pages.join(sizes, "bucket_id")
    cursor = lambda n: F.concat("bucket_id", F.lit("~"), n.cast("string"))
    more = F.col("page") < F.col("pages") - 1
    body = F.concat(
        F.lit('<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">'),
        F.when(F.col("page") > 0, _element("ContinuationToken", cursor(F.col("page")))).otherwise(""),
        _element("IsTruncated", more.cast("string")),
        F.when(more, _element("NextContinuationToken", cursor(F.col("page") + 1))).otherwise(""),
        F.col("contents"), F.lit("</ListBucketResult>"),
    )
    failed = (_kind() == 3) & (F.col("page") == 0)
    lost = ((_kind() == 1) & (F.col("page") == 1)) | ((_kind() == 2) & ~more)
    copies = F.when(lost, 0).when((_kind() == 4) & (F.col("page") == 1), 2).otherwise(1)
    return pages.select(
        "bucket_id", F.lit("aws").alias("upstream"), F.when(failed, 503).otherwise(200).alias("status"),
        F.when(failed, "<Error><Code>SlowDown</Code></Error>").otherwise(body).alias("body"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


SAVED = f"""whole AS (
  SELECT *, (row_number() OVER (PARTITION BY bucket_id ORDER BY key) - 1) // {PAGE_KEYS} AS page,
         (count(*) OVER (PARTITION BY bucket_id) + {PAGE_KEYS - 1}) // {PAGE_KEYS} AS pages,
         CAST(substr(bucket_id, 4) AS INT) % 5 AS kind FROM everything),
fates AS (
  SELECT *, kind = 3 AND page = 0 AS failed, (kind = 1 AND page = 1) OR (kind = 2 AND page = pages - 1) AS lost,
         kind = 4 AND page = 1 AS twice FROM whole),
saved AS (SELECT * FROM fates WHERE NOT lost),
listing AS (SELECT bucket_id, key, etag, size, last_modified, storage_class FROM saved WHERE NOT failed),
chains AS (
  SELECT bucket_id, count(DISTINCT page) FILTER (NOT failed) AS pages,
         count(DISTINCT page) + coalesce(max(CASE WHEN twice THEN 1 END), 0) AS pages_read,
         count(DISTINCT page) FILTER (failed) AS pages_failed,
         CASE WHEN bool_or(failed) THEN 'a page failed' WHEN min(page) > 0 THEN 'no first page'
              WHEN count(DISTINCT page) < max(pages) THEN 'the chain does not reach an end' END AS reason
  FROM saved GROUP BY bucket_id),
sure AS (SELECT bucket_id FROM chains WHERE reason IS NULL)"""
CUT = v.with_views(v.CATALOG, v.LISTING.replace("listing AS", "everything AS"), SAVED)
# Two pages of one listing fail together at most once, so counting them does not see the repeated one twice.
CHAINS = "SELECT bucket_id, pages, CAST(pages_read AS BIGINT) AS pages_read, pages_failed, reason IS NULL AS complete, reason FROM chains"


@query("listing_chains", f"{CUT} {CHAINS}")
def chains(spark, d):
    return listing_chains(saved_pages(spark, d)).drop("prefix")


ALLOWED = f"SELECT * FROM ({REMOVALS}) WHERE bucket_id IN (SELECT bucket_id FROM sure)"


@query("plan_lost_pages", f"{CUT} {IMPORTS} UNION ALL {REFRESHES} UNION ALL {ALLOWED}")
def plan_lost_pages(spark, d):
    """A bucket that lost a page plans imports and refreshes from the others, and no removals."""
    pages = saved_pages(spark, d)
    return plan_columns(diff.plan_mutations(listed(pages), v.catalog(spark, d), listing_chains(pages)))


@query(
    "reconcile_lost_pages",
    f"""{CUT} SELECT coalesce(c.bucket_id, l.bucket_id) AS bucket_id, coalesce(c.key, l.key) AS key,
    l.key IS NOT NULL AS listed FROM listing l FULL JOIN catalog c ON c.bucket_id = l.bucket_id AND c.key = l.key
    WHERE l.key IS NOT NULL OR c.bucket_id NOT IN (SELECT bucket_id FROM sure)""",
)
def reconcile_lost_pages(spark, d):
    """The new catalog has what was listed, and all that a cut listing does not show."""
    pages = saved_pages(spark, d)
    listing = listed(pages)
    snapshot = reconcile(v.catalog(spark, d), listing, AT, complete=listing_chains(pages), run_id="sync_1").snapshot
    seen = listing.select("bucket_id", "key", F.lit(True).alias("listed"))
    return snapshot.select("bucket_id", "key").join(seen, ["bucket_id", "key"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


@query(
    "verify_lost_pages",
    PRINTS.replace(v.with_views(v.CATALOG, v.LISTING), CUT) + """SELECT d.bucket_id, CAST(sum(local_count) AS BIGINT) AS object_count,
    CAST(sum(upstream_count) AS BIGINT) AS objects_listed, s.bucket_id IS NOT NULL AS listing_complete,
    CAST(256 AS BIGINT) AS partitions_sampled, count(*) AS partitions_scanned,
    count(*) FILTER (drift_at <> '' AND s.bucket_id IS NOT NULL) AS partitions_mismatched,
    CASE WHEN s.bucket_id IS NOT NULL THEN CASE WHEN count(*) FILTER (drift_at <> '') > 0 THEN 'needs_sync' ELSE 'healthy' END END AS status
    FROM drifts d LEFT JOIN sure s ON s.bucket_id = d.bucket_id GROUP BY d.bucket_id, s.bucket_id""",
)
def verify_lost_pages(spark, d):
    """Buckets of complete listings get a status, whatever happened to the others."""
    pages = saved_pages(spark, d)
    return verify(v.catalog(spark, d), listed(pages), DAY, complete=listing_chains(pages)).buckets


@query(
    "scope_tables",
    v.with_views(v.OBJECTS) + """, prefixes AS (SELECT d.lang || '/' || substr(CAST(d.doc_id AS VARCHAR), 1, 1 + l.quality) AS prefix
      FROM labels l JOIN documents d ON d.doc_id = l.doc_id), wanted AS (SELECT DISTINCT source AS bucket_id FROM documents WHERE doc_id % 3 = 0)
    SELECT id, bucket_id, key FROM objects o WHERE bucket_id IN (SELECT bucket_id FROM wanted)
      AND EXISTS (SELECT 1 FROM prefixes p WHERE starts_with(o.key, p.prefix))""",
)
def scope_tables(spark, d):
    """A prefix for every labelled document, some of them within others."""
    labelled = v.table(spark, d, "labels").join(v.table(spark, d, "documents"), "doc_id")
    short = F.col("doc_id").cast("string").substr(F.lit(1), F.lit(1) + F.col("quality"))
    prefixes = labelled.select(F.concat("lang", F.lit("/"), short).alias("prefix"))
    wanted = v.table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("source").alias("bucket_id"))
    return in_scope(v.objects(spark, d), wanted, prefixes).select("id", "bucket_id", "key")


@query(
    "hash_files",
    """SELECT doc_id // 100 AS part, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS content_sha256,
    CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes_read, CAST(NULL AS VARCHAR) AS error FROM documents GROUP BY 1""",
)
def hash_files(spark, d):
    """The texts in files of a hundred documents; those above 64 kB are read in ranges."""
    folder = scratch_path(spark, "contents")
    texts = v.table(spark, d, "documents").select("text", F.expr("doc_id div 100").alias("part"), "doc_id")
    texts.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id").write.partitionBy("part").text(folder)
    hashed = hash_contents(spark, f"{folder}/part=*/*.txt", whole_bytes=1 << 16)
    part = F.regexp_extract("path", r"/part=(\d+)/", 1).cast("bigint")
    return hashed.select(part.alias("part"), "content_sha256", "bytes_read", "error")


@query(
    "collection_index",
    v.with_views(v.OBJECTS) + """, saved AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
    SELECT 'near_' || s.doc_id AS collection_id, o.id AS object_id FROM saved s JOIN objects o ON o.size >= s.n_chars * 0.875 AND o.size < s.n_chars * 1.125
      AND o.storage_class = 'STANDARD'
    UNION ALL SELECT 'same_' || s.doc_id, o.id FROM saved s JOIN objects o ON o.bucket_id = s.source AND o.size > s.n_chars
    UNION ALL SELECT 'below_' || s.doc_id, o.id FROM saved s JOIN objects o ON starts_with(o.key, s.lang || '/' || substr(CAST(s.doc_id AS VARCHAR), 1, 2))
      AND o.storage_class IS NULL
    UNION ALL SELECT 'other_' || s.doc_id, o.id FROM saved s JOIN objects o ON s.toxic = 1 AND o.bucket_id <> s.source AND o.size <= s.n_chars""",
)
def collection_index(spark, d):
    """Four predicates for each labelled document, by size, bucket and key; the fourth for the toxic ones."""
    saved = v.table(spark, d, "labels").join(v.table(spark, d, "documents"), "doc_id")
    none, number = F.lit(None).cast("string"), lambda c: c.cast("double")
    name = lambda kind: F.concat(F.lit(f"{kind}_"), F.col("doc_id"))

    def terms(kind, *of, where="true"):
        for path, op, text, value in of:
            yield saved.where(where).select(
                name(kind).alias("collection_id"), F.lit(path).alias("path"), F.lit(op).alias("op"), text.alias("text"), number(value).alias("number")
            )

    size, empty = "upstream.size", F.lit(None)
    parts = [
        *terms("near", (size, ">=", none, F.col("n_chars") * 0.875), (size, "<", none, F.col("n_chars") * 1.125), ("upstream.s3.storage_class", "=", F.lit("STANDARD"), empty)),
        *terms("same", ("bucket_id", "=", F.col("source"), empty), (size, ">", none, F.col("n_chars"))),
        *terms("below", ("key", "prefix", F.concat("lang", F.lit("/"), F.col("doc_id").cast("string").substr(1, 2)), empty),
               ("upstream.s3.storage_class", "is null", none, empty)),
        *terms("other", ("bucket_id", "!=", F.col("source"), empty), (size, "<=", none, F.col("n_chars")), where="toxic = 1"),
    ]
    return indexed_members(v.objects(spark, d), reduce(lambda a, b: a.unionByName(b), parts), {size: "integer"})
