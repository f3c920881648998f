"""Writes, reconcile, verification and duplicate detection."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from stowage.functions import documents as docs
from stowage.functions import evidence as ev
from stowage.functions import hashing
from stowage.operators import duplicates as dup
from stowage.operators import fingerprints as fp
from stowage.operators import objects as object_ops
from stowage.operators import reconcile as diff
from stowage.operators.predicates import scope
from stowage.plans.duplicates import apply_hashes, detect_duplicates
from stowage.plans.reconcile import reconcile
from stowage.plans.verify import in_drifted_partitions, verify
from stowage.session import scratch_path
from stowage.sources.tables import read_objects, write_objects
from workloads import views as v
from workloads.registry import query
from workloads.search_queries import fnv_sql, ntz

AT = datetime(2024, 2, 1, tzinfo=timezone.utc)
DAY = date(2024, 2, 1)
CHANGED = """(c.etag IS DISTINCT FROM l.etag OR c.size <> l.size OR c.last_modified <> l.last_modified
    OR coalesce(c.storage_class, '') <> coalesce(l.storage_class, ''))"""


def plan_columns(df):
    return df.select(
        "action", "bucket_id", "id", "key", *[F.coalesce(n, F.lit("")).alias(n) for n in ("etag", "last_modified", "storage_class")],
        F.coalesce("size", F.lit(0)).alias("size"),
    )


_SELECT = "'{}' AS action, {}.bucket_id, {} AS id, {}.key, l.etag, l.size, l.last_modified, coalesce(l.storage_class, '') AS storage_class"
IMPORTS = f"SELECT {_SELECT.format('import', 'l', chr(39) * 2, 'l')} FROM listing l ANTI JOIN catalog c ON c.bucket_id = l.bucket_id AND c.key = l.key"
REFRESHES = f"SELECT {_SELECT.format('refresh', 'l', 'c.id', 'l')} FROM listing l JOIN catalog c ON c.bucket_id = l.bucket_id AND c.key = l.key WHERE {CHANGED}"
REMOVALS = """SELECT 'remove' AS action, c.bucket_id, c.id, c.key, '' AS etag, 0 AS size, '' AS last_modified,
    '' AS storage_class FROM catalog c ANTI JOIN listing l ON c.bucket_id = l.bucket_id AND c.key = l.key"""
SIDES = v.with_views(v.CATALOG, v.LISTING)


@query("plan_imports", SIDES + IMPORTS)
def plan_imports(spark, d):
    return plan_columns(diff.plan_imports(v.listing(spark, d), v.catalog(spark, d)))


@query("plan_refreshes", SIDES + REFRESHES)
def plan_refreshes(spark, d):
    return plan_columns(diff.plan_refreshes(v.listing(spark, d), v.catalog(spark, d)))


@query("plan_removals", SIDES + f"SELECT id, bucket_id, key FROM ({REMOVALS}) WHERE starts_with(key, 'en/')")
def plan_removals(spark, d):
    return diff.plan_removals(v.listing(spark, d), v.catalog(spark, d), scope(prefixes="en/")).select("id", "bucket_id", "key")


@query("plan_mutations", SIDES + f"{IMPORTS} UNION ALL {REFRESHES} UNION ALL {REMOVALS}")
def plan_mutations(spark, d):
    return plan_columns(diff.plan_mutations(v.listing(spark, d), v.catalog(spark, d)))


@query("plan_incomplete_listing", SIDES + f"{IMPORTS} UNION ALL {REFRESHES}")
def plan_incomplete_listing(spark, d):
    return plan_columns(diff.plan_mutations(v.listing(spark, d), v.catalog(spark, d), complete=False))


@query(
    "plan_counts",
    SIDES + f"""SELECT count(*) FILTER (action = 'import') AS import_objects_count,
    count(*) FILTER (action = 'refresh') AS refresh_objects_count, count(*) FILTER (action = 'remove') AS remove_objects_count
    FROM ({IMPORTS} UNION ALL {REFRESHES} UNION ALL {REMOVALS})""",
)
def plan_counts(spark, d):
    return diff.plan_counts(diff.plan_mutations(v.listing(spark, d), v.catalog(spark, d)))


NEW_ID = "'object_' || md5(l.bucket_id || chr(0) || l.key)"
SNAPSHOT = f"""SELECT coalesce(c.id, {NEW_ID}) AS id, l.bucket_id, l.key, l.etag, l.size, l.last_modified,
      l.storage_class, CASE WHEN c.id IS NULL OR {CHANGED} THEN NULL ELSE c.content_type END AS content_type, c.quality,
      CASE WHEN c.id IS NULL OR {CHANGED} THEN TIMESTAMP '2024-02-01' ELSE c.updated_at END AS updated_at,
      coalesce(c.created_at, TIMESTAMP '2024-02-01') AS created_at,
      coalesce(c.last_modified, '2024-02-01T00:00:00Z') AS first_seen_at,
      CASE WHEN c.id IS NULL OR {CHANGED} THEN 'sync_1' ELSE 'job_import' END AS provenance
    FROM listing l LEFT JOIN catalog c ON c.bucket_id = l.bucket_id AND c.key = l.key"""


def snapshot_columns(df, *more):
    document = F.col("attributes")
    return df.select(
        "id", "bucket_id", "key", "etag", "size", "last_modified", "storage_class", "content_type",
        docs.attr(document, "user.quality", "integer").alias("quality"),
        docs.attr_text(document, "core.first_seen_at").alias("first_seen_at"),
        ntz("created_at"), ntz("updated_at"), F.col("attribute_provenance")["upstream"].alias("provenance"), *more,
    )


@query("reconcile", SIDES + SNAPSHOT)
def reconciled(spark, d):
    """Old catalog and listing to the new snapshot. Refreshed documents lose what the listing does not show."""
    return snapshot_columns(reconcile(v.catalog(spark, d), v.listing(spark, d), AT, run_id="sync_1").snapshot)


@query("reconcile_counts", SIDES + f"""SELECT count(*) FILTER (action = 'import') AS import_objects_count,
    count(*) FILTER (action = 'refresh') AS refresh_objects_count, count(*) FILTER (action = 'remove') AS remove_objects_count
    FROM ({IMPORTS} UNION ALL {REFRESHES} UNION ALL {REMOVALS}) WHERE bucket_id = 'src1' AND starts_with(key, 'en/')""")
def reconcile_counts(spark, d):
    return reconcile(v.catalog(spark, d), v.listing(spark, d), AT, bucket_id="src1", prefix="en/").counts


@query(
    "reconcile_partition",
    SIDES + f"SELECT * FROM ({IMPORTS} UNION ALL {REFRESHES} UNION ALL {REMOVALS}) WHERE {fnv_sql('key')} % 8 = 3",
)
def reconcile_partition(spark, d):
    return plan_columns(reconcile(v.catalog(spark, d), v.listing(spark, d), AT, partition=(8, 3)).plan)


@query("reconcile_with_heads", SIDES + SNAPSHOT.replace("THEN NULL ELSE c.content_type", "THEN 'text/' || split_part(l.key, '/', 1) ELSE c.content_type"))
def reconcile_with_heads(spark, d):
    listing = v.listing(spark, d)
    header = F.struct(F.concat(F.lit("text/"), F.split_part("key", F.lit("/"), F.lit(1))).alias("content_type"))
    head = F.to_variant_object(F.struct(F.struct(header.alias("header")).alias("upstream")))
    heads = listing.select("bucket_id", "key", head.alias("attributes"))
    return snapshot_columns(reconcile(v.catalog(spark, d), listing, AT, heads=heads, run_id="sync_1").snapshot)


@query(
    "upsert_objects",
    SIDES + f"""SELECT coalesce(c.id, {NEW_ID}) AS id, coalesce(l.bucket_id, c.bucket_id) AS bucket_id,
      coalesce(l.key, c.key) AS key, coalesce(l.etag, c.etag) AS etag, coalesce(l.size, c.size) AS size,
      coalesce(l.last_modified, c.last_modified) AS last_modified,
      CASE WHEN l.key IS NULL THEN c.storage_class ELSE l.storage_class END AS storage_class,
      CASE WHEN l.key IS NULL THEN c.content_type END AS content_type, c.quality,
      coalesce(c.last_modified, '2024-02-01T00:00:00Z') AS first_seen_at,
      CASE WHEN l.key IS NULL THEN c.last_modified ELSE '2024-02-01T00:00:00Z' END AS last_seen_at,
      CASE WHEN l.key IS NULL THEN c.updated_at ELSE TIMESTAMP '2024-02-01' END AS updated_at,
      coalesce(c.created_at, TIMESTAMP '2024-02-01') AS created_at,
      CASE WHEN l.key IS NULL THEN 'job_import' ELSE 'run_2' END AS provenance
    FROM listing l FULL JOIN catalog c ON c.bucket_id = l.bucket_id AND c.key = l.key""",
)
def upsert_objects(spark, d):
    """Every listed key twice: the higher ordinal, with the right etag, wins."""
    listed = ev.listed_evidence(v.listing(spark, d))
    document = ev.listed_attributes(
        F.when(F.col("ordinal") == 1, "stale").otherwise(F.col("etag")), F.col("size"), F.col("last_modified"), F.col("storage_class")
    )
    batch = listed.withColumn("ordinal", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "bucket_id", "key", "ordinal", document.alias("attributes"),
        F.create_map(F.lit("upstream"), F.concat(F.lit("run_"), F.col("ordinal").cast("string"))).alias("attribute_provenance"),
    )
    result = object_ops.upsert_objects(v.catalog(spark, d), batch, AT)
    return snapshot_columns(result, docs.attr_text(F.col("attributes"), "core.last_seen_at").alias("last_seen_at"))


def _removals(spark, d):
    """Removal requests for everything toxic; those for unlabelled quality come without an id."""
    o = v.objects(spark, d)
    toxic = docs.attr_text(F.col("attributes"), "user.toxic")
    good = docs.attr_text(F.col("attributes"), "user.quality")
    return o.where(toxic == "1").select(F.when(good == "1", F.col("id")).otherwise("").alias("id"))


@query(
    "stored_snapshot",
    v.with_views(v.OBJECTS) + """SELECT id, bucket_id, key, etag, size, last_modified, content_type, storage_class FROM objects
    WHERE starts_with(key, 'en/') AND size > 300""",
)
def stored_snapshot(spark, d):
    """Objects written as a snapshot and read back through its promoted columns."""
    path = scratch_path(spark, "snapshot")
    write_objects(v.bare_objects(spark, d), path)
    stored = read_objects(spark, path).where(scope(prefixes="en/") & (F.col("size") > 300))
    return stored.select("id", "bucket_id", "key", "etag", "size", "last_modified", "content_type", "storage_class")


@query("delete_objects", v.with_views(v.CATALOG) + "SELECT id, bucket_id, key FROM catalog WHERE NOT coalesce(toxic = 1 AND quality = 1, false)")
def delete_objects(spark, d):
    return object_ops.delete_objects(v.catalog(spark, d), _removals(spark, d)).select("id", "bucket_id", "key")


@query(
    "deletion_counts",
    v.with_views(v.CATALOG) + """SELECT CAST((SELECT count(*) FROM catalog WHERE toxic = 1 AND quality = 1) AS BIGINT) AS objects_deleted,
    CAST((SELECT count(*) FROM objects WHERE toxic = 1 AND quality <> 1) AS BIGINT) AS objects_skipped""",
)
def deletion_counts(spark, d):
    return object_ops.deletion_counts(v.catalog(spark, d), _removals(spark, d))


@query(
    "delete_unseen",
    v.with_views(v.OBJECTS) + """SELECT id, bucket_id, key FROM objects WHERE NOT (bucket_id = 'src1'
    AND starts_with(key, 'en/') AND created_at < TIMESTAMP '2024-01-01 08:00:00')""",
)
def delete_unseen(spark, d):
    before = datetime(2024, 1, 1, 8, tzinfo=timezone.utc)
    return object_ops.delete_unseen(v.objects(spark, d), "src1", before, "en/").select("id", "bucket_id", "key")


@query("fnv1a32", v.with_views(v.OBJECTS) + f"""SELECT id, {fnv_sql('key')} AS hash, CAST({fnv_sql('key')} % 256 AS INTEGER) AS partition_index,
    lpad(CAST({fnv_sql('key')} % 256 AS VARCHAR), 3, '0') || '/256' AS partition_id, {fnv_sql('key')} % 256 AS parsed_index FROM objects""")
def fnv1a32(spark, d):
    index = hashing.partition_index(F.col("key"))
    label = hashing.partition_id(index)
    return v.objects(spark, d).select(
        "id", hashing.fnv1a32(F.col("key")).alias("hash"), index.alias("partition_index"), label.alias("partition_id"),
        hashing.parse_partition_id(label)["index"].alias("parsed_index"),
    )


FINGERPRINTS = f"""SELECT bucket_id, CAST({fnv_sql('key')} % 256 AS INTEGER) AS partition_index, count(*) AS object_count,
    CAST(sum(size) AS BIGINT) AS bytes FROM {{}} GROUP BY ALL"""


@query("fingerprints", v.with_views(v.CATALOG) + FINGERPRINTS.format("catalog"))
def fingerprints(spark, d):
    return fp.fingerprints(v.catalog(spark, d), by=["bucket_id"])


PRINTS = v.with_views(
    v.CATALOG, v.LISTING, f"cat AS ({FINGERPRINTS.format('catalog')})", f"up AS ({FINGERPRINTS.format('listing')})",
    """compared AS (SELECT coalesce(c.bucket_id, u.bucket_id) AS bucket_id,
      coalesce(c.partition_index, u.partition_index) AS partition_index,
      coalesce(c.object_count, 0) AS local_count, coalesce(c.bytes, 0) AS local_bytes,
      coalesce(u.object_count, 0) AS upstream_count, coalesce(u.bytes, 0) AS upstream_bytes
      FROM cat c FULL JOIN up u ON c.bucket_id = u.bucket_id AND c.partition_index = u.partition_index)""",
    """drifts AS (SELECT *, CASE WHEN local_count <> upstream_count THEN 'count' WHEN local_bytes <> upstream_bytes THEN 'bytes'
      ELSE '' END AS drift_at FROM compared)""",
)


@query("compare_fingerprints", PRINTS + "SELECT * FROM drifts")
def compare_fingerprints(spark, d):
    local = fp.fingerprints(v.catalog(spark, d), by=["bucket_id"])
    return fp.compare_fingerprints(local, fp.fingerprints(v.listing(spark, d), by=["bucket_id"]), ["bucket_id"])


SAMPLED = f"""{fnv_sql("(lpad(CAST(partition_index AS VARCHAR), 3, '0') || '/256' || '2024-02-01')")} % 10000 < 2500"""


@query(
    "sample_partitions",
    f"""WITH scopes AS (SELECT o_orderpriority AS bucket_id, count(*) AS object_count FROM orders GROUP BY 1),
    all_parts AS (SELECT *, CAST(unnest(range(256)) AS INTEGER) AS partition_index FROM scopes)
    SELECT bucket_id, object_count, partition_index, lpad(CAST(partition_index AS VARCHAR), 3, '0') || '/256' AS partition_id
    FROM all_parts WHERE {SAMPLED}""",
)
def sample_partitions(spark, d):
    """A quarter of the partitions, as asked for."""
    scopes = v.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("bucket_id")).agg(F.count(F.lit(1)).alias("object_count"))
    return fp.sample_partitions(scopes, DAY, 0.25)


@query("verify_sampled", PRINTS + f"""SELECT bucket_id, lpad(CAST(partition_index AS VARCHAR), 3, '0') || '/256' AS partition_id,
    partition_index, local_count, local_bytes, upstream_count, upstream_bytes, drift_at FROM drifts WHERE {SAMPLED}""")
def verify_sampled(spark, d):
    return verify(v.catalog(spark, d), v.listing(spark, d), DAY, rate=0.25).partitions


@query("verify_partitions", PRINTS + """SELECT bucket_id, lpad(CAST(partition_index AS VARCHAR), 3, '0') || '/256' AS partition_id,
    partition_index, local_count, local_bytes, upstream_count, upstream_bytes, drift_at FROM drifts""")
def verify_partitions(spark, d):
    return verify(v.catalog(spark, d), v.listing(spark, d), DAY).partitions


@query("verify_buckets", PRINTS + """SELECT bucket_id, CAST(sum(local_count) AS BIGINT) AS object_count,
    CAST(sum(upstream_count) AS BIGINT) AS objects_listed, true AS listing_complete, CAST(256 AS BIGINT) AS partitions_sampled,
    count(*) AS partitions_scanned, count(*) FILTER (drift_at <> '') AS partitions_mismatched,
    CASE WHEN count(*) FILTER (drift_at <> '') > 0 THEN 'needs_sync' ELSE 'healthy' END AS status FROM drifts GROUP BY bucket_id""")
def verify_buckets(spark, d):
    return verify(v.catalog(spark, d), v.listing(spark, d), DAY).buckets


@query("reconcile_drifted", PRINTS + f""", bad AS (SELECT bucket_id, partition_index FROM drifts WHERE drift_at <> ''),
    planned AS ({IMPORTS} UNION ALL {REFRESHES} UNION ALL {REMOVALS})
    SELECT p.* FROM planned p SEMI JOIN bad b ON p.bucket_id = b.bucket_id AND {fnv_sql('p.key')} % 256 = b.partition_index""")
def reconcile_drifted(spark, d):
    """What verification leads to: a reconcile of the drifted partitions alone."""
    catalog, listing = v.catalog(spark, d), v.listing(spark, d)
    report = verify(catalog, listing, DAY).partitions
    return plan_columns(diff.plan_mutations(in_drifted_partitions(listing, report), in_drifted_partitions(catalog, report)))


GROUPS = """grp AS (SELECT etag, size, count(*) AS member_count FROM objects GROUP BY ALL HAVING count(*) > 1)"""


@query("duplicate_groups", v.with_views(v.OBJECTS, GROUPS) + "SELECT * FROM grp")
def duplicate_groups(spark, d):
    return dup.duplicate_groups(dup.candidates(v.objects(spark, d)))


@query("duplicate_members", v.with_views(v.OBJECTS, GROUPS) + """SELECT etag, size, id, bucket_id, key, member_count
    FROM objects JOIN grp USING (etag, size) ORDER BY etag, size, id""")
def duplicate_members(spark, d):
    rows = dup.duplicate_members(dup.candidates(v.objects(spark, d)))
    return rows.select("etag", "size", "id", "bucket_id", "key", "member_count").orderBy("etag", "size", "id")


SHAPE = "bucket_id || '/' || content_type || '/' || coalesce(storage_class, '')"


@query("content_hashes", """SELECT source AS bucket_id, lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS key, sha256(text) AS content_sha256,
    CAST(octet_length(encode(text)) AS BIGINT) AS bytes_read FROM documents""")
def content_hashes(spark, d):
    return v.contents(spark, d)


@query("group_original", v.with_views(v.OBJECTS) + f"""SELECT {SHAPE} AS shape, arg_min(id, (created_at, id)) AS original_id, count(*) AS member_count
    FROM objects GROUP BY 1""")
def group_original(spark, d):
    shape = F.concat_ws("/", "bucket_id", "content_type", F.coalesce("storage_class", F.lit(""))).alias("shape")
    return v.objects(spark, d).groupBy(shape).agg(
        dup.group_original(F.col("last_modified"), F.col("id")).alias("original_id"), F.count(F.lit(1)).alias("member_count")
    )


HASHED = """members AS (SELECT o.*, sha256(text) AS sha FROM objects o JOIN grp USING (etag, size)),
  verified AS (SELECT etag, size, count(*) AS member_count, arg_min(id, (created_at, id)) AS original_id, min(sha) AS content_sha256
    FROM members GROUP BY ALL HAVING min(sha) = max(sha))"""


@query("verified_groups", v.with_views(v.OBJECTS, GROUPS, HASHED) + "SELECT * FROM verified")
def verified_groups(spark, d):
    members = dup.duplicate_members(dup.candidates(v.objects(spark, d))).drop("member_count")
    hashed = members.join(v.contents(spark, d), ["bucket_id", "key"]).withColumnRenamed("content_sha256", "sha256")
    return dup.verified_groups(hashed)


def _relations(spark, d):
    """Relations, and a duplicate between each object and the first with its etag and size, be it right or not."""
    stored = v.relations(spark, d)
    rows = v.objects(spark, d).select("id", "etag", "size", "bucket_id")
    firsts = rows.groupBy("etag", "size").agg(F.min("id").alias("source_object_id"))
    stamp = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    guessed = rows.join(firsts, ["etag", "size"]).where("id <> source_object_id").select(
        "source_object_id", F.col("id").alias("target_object_id"), F.lit("duplicate").alias("relation_type"),
        F.create_map().cast("map<string,string>").alias("attributes"), F.lit("run_old").alias("created_by_run_id"),
        stamp.alias("created_at"), stamp.alias("updated_at"),
    )
    edge = ["source_object_id", "target_object_id", "relation_type"]
    return stored.unionByName(guessed.join(stored.select(*edge), edge, "left_anti"))


def _detected(spark, d):
    return detect_duplicates(v.hashed_objects(spark, d), v.raw_contents(spark, d), _relations(spark, d), "run_1", AT)


NUMBER = "CAST(substr(o.id, 8) AS BIGINT)"
READ = f"""members AS (SELECT o.*, {NUMBER} % 3 = 0 AND o.size > 0 AS stored, {NUMBER} % 7 = 1 AS changed,
    sha256(CASE WHEN {NUMBER} % 7 = 1 AND NOT ({NUMBER} % 3 = 0 AND o.size > 0) THEN text || '!' ELSE text END) AS sha
    FROM objects o JOIN grp USING (etag, size)),
  verified AS (SELECT etag, size, count(*) AS member_count, arg_min(id, (created_at, id)) AS original_id, min(sha) AS content_sha256
    FROM members GROUP BY ALL HAVING min(sha) = max(sha)),
  mismatched AS (SELECT etag, size FROM members GROUP BY ALL HAVING min(sha) <> max(sha))"""
EDGES = """edges AS (SELECT v.original_id AS source_object_id, m.id AS target_object_id, v.content_sha256, v.etag,
    CAST(v.size AS VARCHAR) AS size FROM members m JOIN verified v USING (etag, size) WHERE m.id <> v.original_id)"""
GUESSED = """guessed AS (SELECT source_object_id, target_object_id, relation_type FROM relations
    UNION SELECT min(id) OVER (PARTITION BY etag, size), id, 'duplicate' FROM objects),
  known AS (SELECT * FROM guessed WHERE source_object_id <> target_object_id),
  broken AS (SELECT k.* FROM known k JOIN members s ON s.id = k.source_object_id JOIN members t ON t.id = k.target_object_id
    SEMI JOIN mismatched m ON m.etag = s.etag AND m.size = s.size
    WHERE k.relation_type = 'duplicate' AND s.etag = t.etag AND s.size = t.size)"""
DETECTED = v.with_views(v.OBJECTS, GROUPS, READ, EDGES, v.RELATIONS, GUESSED)


@query("detect_duplicates", DETECTED + "SELECT *, 'duplicate' AS relation_type, 'run_1' AS created_by_run_id FROM edges")
def duplicate_edges(spark, d):
    facts = [F.col("attributes")[n].alias(n) for n in ("content_sha256", "etag", "size")]
    return _detected(spark, d).edges.select(
        "source_object_id", "target_object_id", *facts, "relation_type", "created_by_run_id"
    )


@query("duplicate_relations", DETECTED + """SELECT source_object_id, target_object_id, relation_type FROM known
    ANTI JOIN broken USING (source_object_id, target_object_id, relation_type)
    UNION SELECT source_object_id, target_object_id, 'duplicate' FROM edges""")
def duplicate_relations(spark, d):
    """Relations after detection: those inside a group whose contents differ are gone."""
    return _detected(spark, d).relations.select("source_object_id", "target_object_id", "relation_type")


@query("duplicate_counts", DETECTED + """SELECT (SELECT count(*) FROM grp) AS candidate_groups,
    (SELECT count(*) FROM verified) AS verified_groups, (SELECT count(*) FROM edges) AS relations_created,
    (SELECT count(*) FROM members WHERE NOT stored) AS objects_hashed,
    (SELECT CAST(sum(octet_length(encode(text)) + CAST(changed AS BIGINT)) AS BIGINT) FROM members WHERE NOT stored) AS bytes_hashed,
    (SELECT count(*) FROM broken) AS relations_removed""")
def duplicate_counts(spark, d):
    return _detected(spark, d).counts


@query("broken_relations", DETECTED + "SELECT * FROM broken")
def broken_relations(spark, d):
    return _detected(spark, d).broken.select("source_object_id", "target_object_id", "relation_type")


@query("cached_hashes", v.with_views(v.OBJECTS, GROUPS, READ) + f"""SELECT o.id,
    coalesce(m.sha, CASE WHEN {NUMBER} % 3 = 0 THEN sha256(o.text) END) AS content_sha256,
    CASE WHEN m.id IS NULL OR m.stored THEN NULL ELSE 'run_1' END AS provenance FROM objects o LEFT JOIN members m ON m.id = o.id""")
def cached_hashes(spark, d):
    """Stored hashes, and those read once kept beside them."""
    objects = v.hashed_objects(spark, d)
    kept = apply_hashes(v.objects(spark, d), _detected(spark, d).hashes, "run_1")
    stored = objects.select("id", F.col("content_sha256").alias("stored"))
    return kept.join(stored, "id").select(
        "id", F.coalesce("content_sha256", "stored").alias("content_sha256"), F.col("attribute_provenance")["extracted"].alias("provenance")
    )
