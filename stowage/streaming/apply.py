"""Micro-batch processing of the inbox: resolve, coalesce, batch, and record the outcome of every event.

What earlier batches made of an object is kept in parts by a hash of bucket and key. Of each part there is a base, the last
mutation of every key up to some batch, and the mutations of the few batches after it, each batch in a folder of its own. A
small table per batch names the base and the later batches of every part, the high-water mark of what is known. A batch
reads the parts its keys fall into and no others; the batch that finds too many later ones writes a new base. Nothing that
an earlier batch has named is changed, so a batch that is run again reads and writes the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stowage.operators.events import (
    BATCH_SIZE,
    MUTATION,
    batch_mutations,
    coalesce_mutations,
    event_outcomes,
    known_objects,
    resolve_events,
)
from stowage.schema import INBOX
from stowage.session import child_numbers, remove_folder, written
from stowage.sources.tables import KEY_PARTS, PART, key_part

APPLY = "apply_batch"
# Batches after a part's base until the next one that touches the part writes a new base.
MAX_LATER = 8


def inbox_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The inbox as a stream of its files, oldest first."""
    reader = spark.readStream.schema(INBOX)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


# What processing reads of an event, and what is kept of it once it is resolved. Envelopes stay where they are.
READ = ["id", "bucket_id", "event_name", "object_key", "received_at", "state"]
RESOLVED = ["id", "bucket_id", "object_key", "received_at", "job_type", "object_id", "skip_reason"]


@contextmanager
def process_events(
    events: DataFrame, buckets: DataFrame, objects: DataFrame, size: int = BATCH_SIZE, unified: bool = False
) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(mutations cut into batches, outcome per event) for a set of pending events.

    Events are resolved once, and coalesced once, for all that is made of them inside the ``with`` block.
    """
    pending = events.where("state = 'pending'")
    with written(resolve_events(pending, buckets, objects, unified).select(*RESOLVED)) as resolved:
        with written(coalesce_mutations(resolved)) as coalesced:
            yield batch_mutations(coalesced, size), event_outcomes(resolved)


def stream_apply(
    events: DataFrame,
    buckets: Callable[[], DataFrame],
    objects: Callable[[], DataFrame],
    output: str,
    checkpoint: str,
    size: int = BATCH_SIZE,
    available_now: bool = False,
    unified: bool = False,
) -> StreamingQuery:
    """Start processing a stream of inbox rows.

    ``buckets`` and ``objects`` are read anew for each micro-batch, and a batch sees what the mutations of earlier ones
    make of ``objects``. Of a catalog stored by :func:`stowage.sources.tables.write_object_parts` only the parts that the
    batch's keys fall into are read. Mutations and outcomes go to folders named after the batch, which a repeated batch
    replaces.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with written(batch.select(*READ)) as rows:
            state = read_state(spark, output, batch_id - 1)
            keys = rows.select("bucket_id", F.col("object_key").alias("key")).distinct()
            # At most KEY_PARTS numbers.
            parts = [row[0] for row in keys.select(key_part()).distinct().collect()]
            earlier = last_mutations(part_files(spark, output, state, parts)).join(keys, MUTATION, "left_semi")
            now = objects()
            if PART in now.columns:
                now = now.where(F.col(PART).isin(parts))
            known = known_objects(now.join(keys, MUTATION, "left_semi"), earlier)
            with process_events(rows, buckets(), known, size, unified) as (mutations, outcomes):
                # A part of a batch is one file.
                placed = mutations.withColumn(PART, key_part()).repartition(PART)
                placed.write.mode("overwrite").partitionBy(PART).parquet(f"{output}/mutations/{APPLY}={batch_id}")
                outcomes.write.mode("overwrite").parquet(f"{output}/outcomes/{APPLY}={batch_id}")
            write_state(spark, output, state, batch_id)

    create_output(events.sparkSession, output)
    writer = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


MUTATIONS = (
    "bucket_id string, key string, job_type string, object_id string, event_count bigint, first_received_at timestamp, "
    "first_event_id string, batch_no bigint, position int"
)
STORED = f"{MUTATIONS}, {PART} int, {APPLY} bigint"

# Of each part: the batch up to which the base goes, or none, and the batches after it that have mutations of the part.
State = dict[int, tuple[int | None, list[int]]]


def create_output(spark: SparkSession, output: str) -> None:
    """An empty table of mutations, so that the first batch finds it."""
    spark.createDataFrame([], MUTATIONS).write.mode("ignore").parquet(f"{output}/mutations/{APPLY}=-1/{PART}=0")


def read_state(spark: SparkSession, output: str, upto: int) -> State:
    """The state that the last batch up to ``upto`` has left; a row per part."""
    written = [n for n in child_numbers(spark, f"{output}/state", APPLY) if n <= upto]
    if not written:
        return {}
    rows = spark.read.schema(f"{PART} int, base bigint, later array<bigint>").parquet(f"{output}/state/{APPLY}={max(written)}")
    return {row[PART]: (row["base"], list(row["later"])) for row in rows.collect()}


def write_state(spark: SparkSession, output: str, before: State, batch_id: int) -> None:
    """Write new bases where they are due and the state after ``batch_id``, and remove what no state needs any more.

    The state is written last: a batch that ends before it has left nothing that another reads.
    """
    touched = child_numbers(spark, f"{output}/mutations/{APPLY}={batch_id}", PART)
    state = before | {part: (base, [*later, batch_id]) for part in touched for base, later in [before.get(part, (None, []))]}
    due = [part for part in touched if len(state[part][1]) > MAX_LATER]
    if due:
        whole = last_mutations(part_files(spark, output, state, due), whole=True).withColumn(PART, key_part())
        whole.repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(f"{output}/bases/{APPLY}={batch_id}")
        state |= {part: (batch_id, []) for part in due}
    rows = [(part, base, later) for part, (base, later) in sorted(state.items())]
    written = spark.createDataFrame(rows, f"{PART} int, base bigint, later array<bigint>").coalesce(1)
    written.write.mode("overwrite").parquet(f"{output}/state/{APPLY}={batch_id}")
    # The batch before may be read again, by a repeated run of this one.
    used = {base for base, _ in [*before.values(), *state.values()]}
    for folder, keep in (("state", {batch_id - 1, batch_id}), ("bases", used)):
        for old in child_numbers(spark, f"{output}/{folder}", APPLY):
            if old < batch_id and old not in keep:
                remove_folder(spark, f"{output}/{folder}/{APPLY}={old}")


def part_files(spark: SparkSession, output: str, state: State, parts: list[int]) -> DataFrame:
    """The stored mutations of some parts: of each its base and the batches after it. Other files are not opened."""
    found = spark.createDataFrame([], STORED)
    bases = [f"{output}/bases/{APPLY}={state[p][0]}/{PART}={p}" for p in parts if p in state and state[p][0] is not None]
    later = [f"{output}/mutations/{APPLY}={batch}/{PART}={p}" for p in parts if p in state for batch in state[p][1]]
    for folder, paths in (("bases", bases), ("mutations", later)):
        if paths:
            rows = spark.read.schema(STORED).option("basePath", f"{output}/{folder}").parquet(*paths)
            found = found.unionByName(rows)
    return found


def last_mutations(rows: DataFrame, whole: bool = False) -> DataFrame:
    """The last mutation per key; a later batch overrules an earlier one, and a base stands for all up to its batch."""
    rest = ["job_type", "object_id"]
    if whole:
        rest += ["event_count", "first_received_at", "first_event_id", "batch_no", "position"]
    last = F.max_by(F.struct(*rest), F.struct(APPLY, "first_received_at", "first_event_id"))
    return rows.groupBy(*MUTATION).agg(last.alias("_last")).select(*MUTATION, "_last.*")


def latest_mutations(spark: SparkSession, output: str, before: int | None = None) -> DataFrame:
    """The last mutation per key over all batches, or those before one."""
    state = read_state(spark, output, before - 1 if before is not None else 1 << 62)
    return last_mutations(part_files(spark, output, state, list(range(KEY_PARTS))))
