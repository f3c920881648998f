"""Session settings the jobs rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A split hot key is worth one more exchange after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Merging two maps keeps the entries of the second.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Documents are written with their common paths as Parquet columns, and a read of a path reads its column alone.
    "spark.sql.variant.writeShredding.enabled": "true",
    "spark.sql.variant.inferShreddingSchema": "true",
    "spark.sql.variant.pushVariantIntoScan": "true",
    # Bucket ids that look like numbers must stay strings.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else created."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one disk, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    current = getattr(spark, "_stowage_shared_dir", None)
    if current is None:
        current = tempfile.mkdtemp(prefix="stowage-")
        spark._stowage_shared_dir = current
    return current


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. It is removed when the driver's process ends, as results may read it so long."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(remove_scratch)
    _SCRATCH.append((spark, path))
    return path


def remove_scratch() -> None:
    """Remove what this process has written below the shared folder. Whatever cannot be reached any more is left."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        with contextlib.suppress(Exception):
            remove_folder(spark, path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would, for functions that run there."""
    context = spark.sparkContext
    if getattr(context, "_stowage_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # The driver serves this file to the executors for as long as the application runs.
    folder = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{root.name}_package.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, file.relative_to(root.parent))
    context.addPyFile(archive)
    context._stowage_shipped = True


def child_numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the folders ``name=n`` below ``path``, in order; none if there is no such path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    named = [status.getPath().getName().partition("=") for status in files.listStatus(target)]
    return sorted(int(number) for start, _, number in named if start == name)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files, so a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, "lineage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as files in the shared folder that go with the ``with`` block, for batches of a stream, which never ends.

    Held in memory instead, large partitions filled a heap of 1800 MB. Likely cause, not profiled: what does not fit is sent
    to disk as one stream of objects, which keeps hold of its last hundred column batches, and no pool of memory counts them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        with contextlib.suppress(Exception):
            remove_folder(spark, path)
