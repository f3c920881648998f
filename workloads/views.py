"""Catalog views over the test tables, and the same views as SQL for the oracle.

Documents play the stored objects, events the change feed, orders and lineitems the job runs. Two sides differ on
purpose: the catalog has not seen the newest objects, and the listing lacks the objects labelled toxic and shows those
labelled low quality one byte longer.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowage.session import configure

SYNCED_AT = "2024-01-01 12:00:00"
NOW = datetime(2024, 1, 15, tzinfo=timezone.utc)
JOBS_NOW = datetime(1999, 1, 1, tzinfo=timezone.utc)
LINE_KEY = ["l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _modified() -> Column:
    # Minutes spread over the first days of January.
    return F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("doc_id") * 37, F.lit(1000)) * 60)


def _modified_text() -> Column:
    return F.date_format(_modified(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _storage_class() -> Column:
    third = F.pmod("doc_id", F.lit(3))
    return F.when(third == 0, "STANDARD").when(third == 1, "GLACIER")


def _object_id(doc_id: Column) -> Column:
    return F.concat(F.lit("object_"), F.lpad(doc_id.cast("string"), 10, "0"))


def _key() -> Column:
    return F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    upstream = F.struct(
        F.col("n_chars").alias("size"),
        F.md5("text").alias("etag"),
        _modified_text().alias("last_modified"),
        F.struct(F.concat(F.lit("text/"), "lang").alias("content_type")).alias("header"),
        F.struct(_storage_class().alias("storage_class")).alias("s3"),
    )
    core = F.struct(
        _object_id(F.col("doc_id")).alias("object_id"),
        _modified_text().alias("first_seen_at"),
        _modified_text().alias("last_seen_at"),
    )
    user = F.struct("quality", "toxic")
    document = F.struct(core.alias("core"), upstream.alias("upstream"), user.alias("user"))
    return rows.select(
        _object_id(F.col("doc_id")).alias("id"),
        F.col("source").alias("bucket_id"),
        _key().alias("key"),
        F.to_variant_object(document).alias("attributes"),
        F.create_map(F.lit("upstream"), F.lit("job_import")).alias("attribute_provenance"),
        _modified().alias("created_at"),
        _modified().alias("updated_at"),
        F.md5("text").alias("etag"),
        F.col("n_chars").alias("size"),
        _modified_text().alias("last_modified"),
        F.concat(F.lit("text/"), "lang").alias("content_type"),
        _storage_class().alias("storage_class"),
        F.lit(None).cast("string").alias("content_sha256"),
    )


def bare_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with nothing but the document to read attributes from."""
    from stowage.schema import OBJECT_COLUMNS

    return objects(spark, sf_dir).select(*OBJECT_COLUMNS)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).where(F.col("created_at") < F.lit(f"{SYNCED_AT}Z").cast("timestamp"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).where(F.coalesce("toxic", F.lit(0)) != 1)
    longer = F.when(F.col("quality") == 0, 1).otherwise(0)
    return rows.select(
        F.col("source").alias("bucket_id"),
        _key().alias("key"),
        F.md5("text").alias("etag"),
        (F.col("n_chars") + longer).alias("size"),
        _modified().alias("last_modified"),
        _storage_class().alias("storage_class"),
    )


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.col("source")
    return table(spark, sf_dir, "documents").select("source").distinct().select(
        source.alias("id"), F.concat(F.lit("bucket-"), source).alias("name")
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.sources.contents import hash_column

    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("bucket_id"), _key().alias("key"), "text")
    return hash_column(rows, F.col("text")).drop("text")


def raw_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents to be hashed. Every seventh differs from what its etag says."""
    rows = table(spark, sf_dir, "documents")
    changed = F.when(F.pmod("doc_id", F.lit(7)) == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return rows.select(F.col("source").alias("bucket_id"), _key().alias("key"), changed.alias("content"))


def hashed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of which every third has a stored hash."""
    known = table(spark, sf_dir, "documents").where(F.pmod("doc_id", F.lit(3)) == 0)
    stored = known.select(_object_id(F.col("doc_id")).alias("id"), F.sha2("text", 256).alias("_stored"))
    rows = objects(spark, sf_dir).join(stored, "id", "left")
    return rows.withColumn("content_sha256", F.col("_stored")).drop("_stored")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """derived_from: a document labelled good quality to the next one; duplicate: to the one after that."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", "toxic")
    ids = table(spark, sf_dir, "documents").select("doc_id")
    stamp = F.lit("2024-01-01T00:00:00Z").cast("timestamp")

    def edges(step: int, kind: str) -> DataFrame:
        target = ids.select(F.col("doc_id").alias("target"))
        return good.withColumn("target", F.col("doc_id") + step).join(target, "target", "left_semi").select(
            _object_id(F.col("doc_id")).alias("source_object_id"),
            _object_id(F.col("target")).alias("target_object_id"),
            F.lit(kind).alias("relation_type"),
            F.create_map(F.lit("toxic"), F.col("toxic").cast("string")).alias("attributes"),
            F.lit("run_old").alias("created_by_run_id"),
            stamp.alias("created_at"),
            stamp.alias("updated_at"),
        )

    return edges(1, "derived_from").unionByName(edges(2, "duplicate"))


def _event_name() -> Column:
    names = {
        "purchase": "ObjectCreated:Put",
        "signup": "s3:ObjectCreated:CompleteMultipartUpload",
        "error": "ObjectRemoved:Delete",
        "click": "ObjectTagging:Put",
        "view": "OBJECT_FINALIZE",
    }
    chain = F.when(F.lit(False), "")
    for kind, name in names.items():
        chain = chain.when(F.col("event_type") == kind, name)
    return chain


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _event_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id",
        F.concat(F.lit("src"), F.pmod("user_id", F.lit(20)).cast("string")).alias("bucket_id"),
        _event_name().alias("event_name"),
        F.concat(F.lit("en/"), F.get_json_object("props", "$.k"), F.lit(".txt")).alias("object_key"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.col("value").alias("value"),
    )


def upstream_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """The inbox: every event pending, with its dedupe key."""
    from stowage.functions.hashing import dedupe_key
    from stowage.schema import STORED_EVENT

    rows = _event_columns(event_stream(spark, sf_dir) if stream else table(spark, sf_dir, "events"))
    key = dedupe_key(*[F.col(c) for c in ("bucket_id", "event_name", "object_key")], F.lit(""), F.col("received_at"))
    columns = {
        "id": F.concat(F.lit("upevt_"), F.lpad(F.col("event_id").cast("string"), 10, "0")),
        "envelope": F.lit("{}"),
        "dedupe_key": key,
        "transport": F.lit("stream"),
        "state": F.lit("pending"),
        "error_message": F.lit(None).cast("string"),
        "event_time": F.col("received_at"),
        "processed_at": F.lit(None).cast("timestamp"),
    }
    return rows.select(*[columns.get(n, F.col(n)).alias(n) for n in STORED_EVENT.fieldNames()])


def raw_notifications(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Every event as the JSON body one of seven providers would send, chosen by the event's number."""
    rows = _event_columns(event_stream(spark, sf_dir) if stream else table(spark, sf_dir, "events"))
    rows = rows.withColumn("size", F.floor(F.col("value") * 100).cast("bigint"))
    time = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    size_text = F.col("size").cast("string")
    record = F.struct(
        F.lit("aws:s3").alias("eventSource"),
        F.lit("eu-west-1").alias("awsRegion"),
        time.alias("eventTime"),
        F.col("event_name").alias("eventName"),
        F.struct(
            F.struct(F.col("bucket_id").alias("name"), F.concat(F.lit("arn:"), "bucket_id").alias("arn")).alias("bucket"),
            F.struct(
                F.replace("object_key", F.lit("/"), F.lit("%2F")).alias("key"), "size", F.md5("object_key").alias("eTag")
            ).alias("object"),
        ).alias("s3"),
    )
    aws = F.to_json(F.struct(F.array(record).alias("Records")))
    sns = F.to_json(F.struct(F.lit("Notification").alias("Type"), aws.alias("Message")))
    wrapped = F.concat(F.lit('{"transport":"queue","body":'), aws, F.lit("}"))
    answered = F.create_map(F.lit("X-RustFS-Deployment-Id"), F.concat(F.lit("dep-"), "bucket_id")).alias("responseElements")
    fields = [record[n].alias(n) for n in ("eventSource", "awsRegion", "eventTime", "eventName", "s3")]
    rustfs = F.to_json(F.struct(F.array(F.struct(*fields, answered)).alias("records")))
    detail = F.struct(
        F.struct(F.col("bucket_id").alias("name")).alias("bucket"),
        F.struct(F.col("object_key").alias("key"), "size", F.md5("object_key").alias("etag")).alias("object"),
    )
    bridge = F.to_json(
        F.struct(
            F.col("event_name").alias("detail-type"), time.alias("time"), F.lit("eu-west-1").alias("region"),
            detail.alias("detail"),
        )
    )
    b2 = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.col("event_id").cast("string").alias("eventId"),
                    F.unix_millis("received_at").alias("eventTimestamp"),
                    F.col("event_name").alias("eventType"),
                    F.col("bucket_id").alias("bucketName"),
                    F.col("object_key").alias("objectName"),
                    F.col("size").alias("objectSize"),
                )
            ).alias("events")
        )
    )
    data = F.base64(
        F.to_json(F.struct(size_text.alias("size"), F.md5("object_key").alias("md5Hash"))).cast("binary")
    )
    gcp = F.to_json(
        F.struct(
            F.struct(
                F.create_map(
                    F.lit("eventType"), F.col("event_name"), F.lit("eventTime"), time, F.lit("bucketId"), F.col("bucket_id"),
                    F.lit("objectId"), F.col("object_key"),
                ).alias("attributes"),
                data.alias("data"),
            ).alias("message")
        )
    )
    kind, body = F.pmod("event_id", F.lit(7)), F.when(F.lit(False), "")
    for number, envelope in enumerate((aws, sns, wrapped, bridge, b2, gcp, rustfs)):
        body = body.when(kind == number, envelope)
    return rows.select("event_id", "bucket_id", "received_at", body.alias("body"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as root syncs of their customer's bucket, lineitems as the import, refresh and remove jobs below them."""
    from stowage.schema import JOB_RUN

    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    none = F.lit(None)
    root_id = F.concat(F.lit("job_"), F.col("o_orderkey").cast("string"))
    status = F.col("o_orderstatus")
    state = F.when(status == "F", "succeeded").when(status == "O", "running").otherwise("pending")
    priority = F.col("o_orderpriority")
    progress = F.struct(
        F.when(priority == "1-URGENT", "listing").alias("phase"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("objects_listed"),
        F.when(priority == "2-HIGH", F.lit(5)).otherwise(F.lit(0)).alias("import_objects_count"),
    )
    result = F.struct(
        F.lit(7).alias("import_objects_count"),
        F.when(status == "F", F.lit(3)).otherwise(F.lit(0)).alias("refresh_objects_count"),
        (status == "O").alias("await_children"),
    )
    created = F.col("o_orderdate").cast("timestamp")
    roots = orders.select(
        root_id.alias("id"),
        root_id.alias("trace_id"),
        F.lit("sync_bucket").alias("type"),
        F.when((status == "F") & (priority == "5-LOW"), "failed").otherwise(state).alias("state"),
        F.lit("user").alias("requested_by_type"),
        F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("requested_by_id"),
        F.lit("bucket").alias("target_type"),
        F.concat(F.lit("bucket_"), F.col("o_custkey").cast("string")).alias("target_id"),
        F.to_variant_object(F.struct(F.lit("").alias("scope_prefix"))).alias("input"),
        F.to_variant_object(result).alias("result"),
        F.to_variant_object(progress).alias("progress"),
        F.when(status == "O", "worker").alias("locked_by"),
        F.when(status == "F", created).alias("finished_at"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )
    parent = F.concat(F.lit("job_"), F.col("l_orderkey").cast("string"))
    flag, quantity = F.col("l_returnflag"), F.col("l_quantity").cast("int")
    kind = F.when(flag == "A", "import_objects").when(flag == "N", "refresh_objects").otherwise("remove_objects")
    item_state = (
        F.when(F.col("l_linestatus") == "F", "succeeded")
        .when(quantity > 40, "failed")
        .when(quantity > 20, "running")
        .otherwise("pending")
    )
    counter = {"A": "objects_imported", "N": "objects_refreshed", "R": "objects_deleted"}
    counted = F.struct(
        *[F.when(flag == f, quantity.cast("string")).otherwise("").alias(name) for f, name in counter.items()]
    )
    batch = F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda n: F.struct(n.cast("string").alias("key")))
    shipped = F.col("l_shipdate").cast("timestamp")
    children = items.select(
        F.concat(parent, F.lit("_"), F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in LINE_KEY]))).alias("id"),
        parent.alias("trace_id"),
        kind.alias("type"),
        item_state.alias("state"),
        F.lit("job").alias("requested_by_type"),
        parent.alias("requested_by_id"),
        F.lit("bucket").alias("target_type"),
        F.concat(F.lit("bucket_"), F.col("l_suppkey").cast("string")).alias("target_id"),
        F.to_variant_object(F.struct(batch.alias("objects"))).alias("input"),
        F.to_variant_object(counted).alias("result"),
        none.cast("variant").alias("progress"),
        F.when(item_state == "running", "worker").alias("locked_by"),
        F.when(item_state.isin("succeeded", "failed"), shipped).alias("finished_at"),
        shipped.alias("created_at"),
        shipped.alias("updated_at"),
    )
    return roots.unionByName(children).select(*JOB_RUN.fieldNames())


def turn_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as jobs, each requested by the turn before it."""
    name = lambda turn: F.concat_ws("_", F.lit("turn"), F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        name(turn).alias("id"),
        F.lit(None).cast("string").alias("trace_id"),
        F.when(turn > 0, "job").otherwise("user").alias("requested_by_type"),
        F.when(turn > 0, name(turn - 1)).alias("requested_by_id"),
    )


# The same views for the oracle. Attribute documents are never compared, only what is read from them.
OBJECTS = """
objects AS (
  SELECT 'object_' || lpad(CAST(d.doc_id AS VARCHAR), 10, '0') AS id, d.source AS bucket_id,
         d.lang || '/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS key,
         TIMESTAMP '2024-01-01' + to_minutes((d.doc_id * 37) % 1000) AS created_at,
         TIMESTAMP '2024-01-01' + to_minutes((d.doc_id * 37) % 1000) AS updated_at,
         md5(d.text) AS etag, d.n_chars AS size,
         strftime(TIMESTAMP '2024-01-01' + to_minutes((d.doc_id * 37) % 1000), '%Y-%m-%dT%H:%M:%SZ') AS last_modified,
         'text/' || d.lang AS content_type,
         CASE d.doc_id % 3 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'GLACIER' END AS storage_class,
         CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic, d.doc_id, d.text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""
CATALOG = OBJECTS + f""",
catalog AS (SELECT * FROM objects WHERE created_at < TIMESTAMP '{SYNCED_AT}')"""
LISTING = """
listing AS (
  SELECT bucket_id, key, etag, size + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS size, last_modified, storage_class
  FROM objects WHERE coalesce(toxic, 0) <> 1
)"""
BUCKETS = "buckets AS (SELECT DISTINCT source AS id, 'bucket-' || source AS name FROM documents)"
RELATIONS = """
relations AS (
  SELECT 'object_' || lpad(CAST(l.doc_id AS VARCHAR), 10, '0') AS source_object_id,
         'object_' || lpad(CAST(d.doc_id AS VARCHAR), 10, '0') AS target_object_id,
         CASE d.doc_id - l.doc_id WHEN 1 THEN 'derived_from' ELSE 'duplicate' END AS relation_type,
         CAST(l.toxic AS VARCHAR) AS toxic, 'run_old' AS created_by_run_id,
         TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id + 1 OR d.doc_id = l.doc_id + 2
  WHERE l.quality = 1
)"""
EVENT_NAME = """CASE event_type WHEN 'purchase' THEN 'ObjectCreated:Put'
    WHEN 'signup' THEN 's3:ObjectCreated:CompleteMultipartUpload' WHEN 'error' THEN 'ObjectRemoved:Delete'
    WHEN 'click' THEN 'ObjectTagging:Put' WHEN 'view' THEN 'OBJECT_FINALIZE' END"""
EVENTS = f"""
inbox AS (
  SELECT 'upevt_' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS id, event_id,
         'src' || CAST(user_id % 20 AS VARCHAR) AS bucket_id, {EVENT_NAME} AS event_name,
         'en/' || json_extract_string(props, '$.k') || '.txt' AS object_key, ts AS received_at, value
  FROM events
)"""
CATEGORY = """CASE WHEN event_name LIKE 'ObjectCreated:%' OR event_name LIKE 's3:ObjectCreated:%' THEN 'created'
    WHEN event_name LIKE 'ObjectRemoved:%' OR event_name LIKE 's3:ObjectRemoved:%' THEN 'removed'
    WHEN event_name LIKE '%Tagging%' OR event_name LIKE 'ObjectAcl:%' THEN 'metadata_changed' ELSE 'other' END"""
JOBS = """
jobs AS (
  SELECT 'job_' || CAST(o_orderkey AS VARCHAR) AS id, 'job_' || CAST(o_orderkey AS VARCHAR) AS trace_id,
         'sync_bucket' AS type,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'succeeded'
              WHEN o_orderstatus = 'O' THEN 'running' ELSE 'pending' END AS state,
         'user' AS requested_by_type, 'user_' || CAST(o_custkey AS VARCHAR) AS requested_by_id,
         'bucket' AS target_type, 'bucket_' || CAST(o_custkey AS VARCHAR) AS target_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'listing' ELSE '' END AS phase,
         CAST(floor(o_totalprice / 1000) AS BIGINT) AS objects_listed,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 5 ELSE 7 END AS import_planned,
         CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 0 END AS refresh_planned,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 5 ELSE 0 END AS progress_import,
         o_orderstatus = 'O' AS await_children, 0 AS quantity, 0 AS n_objects,
         CASE WHEN o_orderstatus = 'O' THEN 'worker' END AS locked_by,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS finished_at, o_orderdate AS created_at,
         o_orderdate AS updated_at
  FROM orders
  UNION ALL
  SELECT 'job_' || CAST(l_orderkey AS VARCHAR) || '_' || md5(concat_ws('|', l_partkey, l_suppkey, l_linenumber,
           strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'))), 'job_' || CAST(l_orderkey AS VARCHAR),
         CASE l_returnflag WHEN 'A' THEN 'import_objects' WHEN 'N' THEN 'refresh_objects' ELSE 'remove_objects' END,
         CASE WHEN l_linestatus = 'F' THEN 'succeeded' WHEN l_quantity > 40 THEN 'failed'
              WHEN l_quantity > 20 THEN 'running' ELSE 'pending' END,
         'job', 'job_' || CAST(l_orderkey AS VARCHAR), 'bucket', 'bucket_' || CAST(l_suppkey AS VARCHAR),
         '', 0, 0, 0, 0, false, CAST(l_quantity AS INT), l_linenumber,
         CASE WHEN l_linestatus <> 'F' AND l_quantity > 20 AND l_quantity <= 40 THEN 'worker' END,
         CASE WHEN l_linestatus = 'F' OR l_quantity > 40 THEN l_shipdate END, l_shipdate, l_shipdate
  FROM lineitem
)"""


def with_views(*views: str) -> str:
    return "WITH " + ", ".join(views)
