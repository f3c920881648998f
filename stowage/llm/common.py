"""Helpers of the text operators: word splitting, bounded slices of Arrow batches, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowage.session import cut_lineage, scratch_path

__all__ = ["cut_lineage", "fresh", "hashed_share", "read_table", "scratch_path", "ship", "slices", "text_rows"]

# Characters of text that a Python worker takes apart at once.
SLICE_CHARS = 2_000_000


# Rows of an Arrow batch. Texts are large, and a task holds a batch on both sides of its Python worker.
BATCH_ROWS = 1_000


def ship(spark: SparkSession, batch_rows: int = BATCH_ROWS) -> SparkSession:
    """Send this package to the executors once per application, as ``--py-files`` would, and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    context = spark.sparkContext
    if getattr(context, "_stowage_shipped", False):
        return spark
    root = Path(__file__).resolve().parents[1]
    # The driver serves this file to the executors for as long as the application runs.
    folder = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{root.name}_package.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, file.relative_to(root.parent))
    context.addPyFile(archive)
    context._stowage_shipped = True
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_share(key: Column, wanted: int, of: int) -> Column:
    """Whether a row is among about ``wanted`` of ``of`` rows, by a hash of ``key`` and so the same ones at every run."""
    steps = 1 << 30
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(steps)) < min(steps, -(-steps * wanted // max(of, 1)))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text alone, a null text as the empty one, so that no other column of ``docs`` can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fresh(name: str, columns: Sequence[str]) -> str:
    """A column name that none of ``columns`` has, whatever their case."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(texts: Sequence[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``chars`` characters together, so that what a worker holds is bounded."""
    first, held = 0, 0
    for at, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield first, at + 1
            first, held = at + 1, 0
    if first < len(texts):
        yield first, len(texts)
