"""Catalog tables on shared storage: Parquet, partitioned by bucket, by a hash of the key, or bucketed by the key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowage.operators.objects import KEY, with_promoted
from stowage.schema import OBJECT_COLUMNS, PROMOTED

# Parts of a table by a hash of bucket and key.
KEY_PARTS = 64
PART = "key_part"


def key_part() -> Column:
    """The part that a row's bucket and key fall into."""
    return F.pmod(F.xxhash64(*KEY), F.lit(KEY_PARTS)).cast("int").alias(PART)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows. Documents stored as JSON text are parsed; promoted columns are kept where the table has them."""
    rows = spark.read.parquet(path)
    if rows.schema["attributes"].dataType.simpleString() == "string":
        rows = rows.withColumn("attributes", F.parse_json("attributes"))
    promoted = [name for name, _ in PROMOTED.values() if name in rows.columns]
    return rows.select(*OBJECT_COLUMNS, *promoted)


def write_objects(objects: DataFrame, path: str) -> None:
    """A snapshot with its promoted columns, one folder per bucket, sorted by key inside each file.

    Range partitioning by (bucket, key) cuts a large bucket into many files, and the sort lets a key prefix or an exact
    key skip row groups by their minima and maxima. ``path`` must be new: a snapshot is never written over its source.
    """
    rows = with_promoted(objects.select(*OBJECT_COLUMNS))
    arranged = rows.repartitionByRange("bucket_id", "key").sortWithinPartitions("bucket_id", "key")
    arranged.write.mode("errorifexists").partitionBy("bucket_id").parquet(path)


def replace_buckets(objects: DataFrame, path: str, buckets: Iterable[str]) -> None:
    """Replace whole buckets of a stored snapshot; the others stay as they are.

    ``objects`` must not read from ``path``; write a change to a new path first where it does.
    """
    rows = with_promoted(objects.select(*OBJECT_COLUMNS)).where(F.col("bucket_id").isin(list(buckets)))
    arranged = rows.repartitionByRange("bucket_id", "key").sortWithinPartitions("bucket_id", "key")
    arranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_id").parquet(path)


def write_object_parts(objects: DataFrame, path: str) -> None:
    """A snapshot in parts by a hash of bucket and key, sorted inside each, for readers that look up some keys."""
    rows = with_promoted(objects.select(*OBJECT_COLUMNS)).withColumn(PART, key_part())
    rows.repartition(PART).sortWithinPartitions(PART, *KEY).write.mode("errorifexists").partitionBy(PART).parquet(path)


def read_object_parts(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows with their part, so that a filter on it reads the files of that part alone."""
    rows = spark.read.parquet(path).withColumn(PART, F.col(PART).cast("int"))
    return rows.select(*OBJECT_COLUMNS, *[name for name, _ in PROMOTED.values()], PART)


def _layout(path: str) -> str:
    return f"{path}/_layout"


def write_bucketed(objects: DataFrame, table: str, path: str, buckets: int, arrange: bool = True) -> DataFrame:
    """A snapshot in ``buckets`` files by a hash of bucket and key, sorted inside each, as the external table ``table``.

    Joins by bucket and key read it without a shuffle, and bring the other side to it. What such a join has made of a
    table of as many buckets already stands in them: ``arrange=False`` then writes it as it stands, each task its bucket.
    ``path`` must be new. A session that has not written the table finds it by :func:`open_bucketed`.
    """
    rows = with_promoted(objects.select(*OBJECT_COLUMNS))
    if arrange:
        rows = rows.repartition(buckets, *KEY)
    written = rows.write.format("parquet").mode("errorifexists").option("path", path)
    written.bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(table)
    spark = objects.sparkSession
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(_layout(path))
    return spark.table(table)


def open_bucketed(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The rows of a bucketed snapshot, whose table is declared if the session's catalog does not have it."""
    if not spark.catalog.tableExists(table):
        buckets = spark.read.json(_layout(path)).first()["buckets"]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        keys = ", ".join(KEY)
        place = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(table)
