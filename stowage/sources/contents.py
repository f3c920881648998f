"""Content hashes of stored files of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowage.functions.hashing import sha256_hex
from stowage.session import ship_package

# Files up to this size are one value in Spark; larger ones are read in ranges.
WHOLE_BYTES = 32 << 20
# Bytes of a range, which is what a task holds of a large file.
RANGE_BYTES = 8 << 20

HASHED = "path string, content_sha256 string, bytes_read bigint, error string"
CHANGED = "content changed while it was read"


def list_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """(path, length, modificationTime) of the files, but for empty ones, which Spark does not list; no content is read."""
    return spark.read.format("binaryFile").load(path_glob).select("path", "length", "modificationTime")


def _opened(path: str):
    """An Arrow file system and the file's place in it, for a path as Spark writes it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def digest_file(path: str, range_bytes: int = RANGE_BYTES) -> tuple[str, int]:
    """SHA-256 and size of one file, range by range; memory does not grow with the file."""
    files, place = _opened(path)
    digest, read = hashlib.sha256(), 0
    with files.open_input_stream(place) as stream:
        while part := stream.read(range_bytes):
            digest.update(part)
            read += len(part)
    return digest.hexdigest(), read


def hash_listed(listed: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, content_sha256, bytes_read, error) of listed files (path, length), each read in ranges and never held whole.

    A file that has another size than the one listed has changed and gets an error in place of a hash, as does one that
    cannot be read; neither fails the others. Executors must reach the files by their paths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist()):
                try:
                    found, read = digest_file(path, range_bytes)
                    row = (path, found, read, None) if read == length else (path, None, read, CHANGED)
                except OSError as error:
                    row = (path, None, 0, str(error))
                yield pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(row, _TYPES)], _NAMES)

    ship_package(listed.sparkSession)
    # A few large files are as many tasks.
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("path", "length").repartition(4 * tasks, "path").mapInArrow(run, HASHED)


_NAMES = [part.split()[0] for part in HASHED.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string()]


def hash_contents(spark: SparkSession, path_glob: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, content_sha256, bytes_read, error) for every file.

    The content never leaves its task. Files of up to ``whole_bytes`` are values that Spark hashes; larger ones are read in
    ranges, so there is no size that is too large.
    """
    files = spark.read.format("binaryFile").load(path_glob)
    small = files.where(F.col("length") <= whole_bytes).select(
        "path",
        sha256_hex(F.col("content")).alias("content_sha256"),
        F.col("length").alias("bytes_read"),
        F.lit(None).cast("string").alias("error"),
    )
    return small.unionByName(hash_listed(list_files(spark, path_glob).where(F.col("length") > whole_bytes)))


def hash_column(rows: DataFrame, content: Column) -> DataFrame:
    """``rows`` with content_sha256 and bytes_read of contents that are a column."""
    binary = content.cast("binary")
    return rows.withColumns({"content_sha256": sha256_hex(binary), "bytes_read": F.octet_length(binary).cast("bigint")})
