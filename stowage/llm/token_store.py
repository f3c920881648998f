"""Token ids in files: frequency-ranked ids in a byte-aligned code with separate control bytes.

An id is stored as its rank by frequency in the whole corpus, in one to four little-endian bytes. The number of bytes,
less one, is two bits in a control stream of its own, four ids to a byte, so a reader finds all lengths by one table
lookup per control byte. A file holds blocks of whole documents in ascending order of id; a Parquet row is a block:

    shard, block        place of the block; shards, and the blocks of a shard, follow the order of the documents
    first               ids of the shard before the block
    doc_id, n_ids       ids of the block's documents, in order, and how many token ids each has
    control, data       the two streams of the block

``ranks`` beside the blocks has the token id of each rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.llm.common import scratch_path, text_rows
from stowage.llm.tokens import encoder

# Ids of a shard, of which a shard has more once there are very many.
SHARD_IDS = 1 << 23
MOST_SHARDS = 1 << 15
BLOCK_IDS = 1 << 19

BLOCKS = "shard int, block int, first long, doc_id array<long>, n_ids array<long>, control binary, data binary"
READ = "doc_id long, start long, n_tokens long, ids binary"

# Of each control byte: the lengths of its four codes, and their sum.
_LENGTHS = np.array([[(byte >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for byte in range(256)], dtype=np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype(np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    lengths = extra.astype(np.int64) + 1
    ends = np.cumsum(lengths)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    starts = ends - lengths
    data[starts] = ranks & 0xFF
    for byte in (1, 2, 3):
        longer = np.flatnonzero(extra >= byte)
        data[starts[longer] + byte] = ranks[longer] >> np.uint32(8 * byte) & 0xFF
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks behind the two streams."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    starts = np.cumsum(lengths) - lengths
    ranks = raw[starts].astype(np.uint32)
    for byte in (1, 2, 3):
        longer = np.flatnonzero(lengths > byte)
        ranks[longer] |= raw[starts[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return ranks


ENCODED = "row_id long, doc_id long, ids binary, counts binary"


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Each document's ids, the end id included, as little-endian integers of the narrowest type that holds them.

    A task's last row has how often the task met each id, as 64-bit integers, and nothing else.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(path)
        end = np.array([end_id], dtype=codes.id_type).tobytes()
        row_id = TaskContext.get().partitionId() << 40
        met = np.zeros(max(codes.size, end_id + 1), dtype=np.int64)

        def rows(*columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(columns), ["row_id", "doc_id", "ids", "counts"])

        for batch in batches:
            ids = [one + end for one in codes.ids(batch["text"].to_pylist())]
            met += np.bincount(np.frombuffer(b"".join(ids), dtype=codes.id_type), minlength=len(met))
            numbers = pa.array(np.arange(row_id, row_id + len(ids)), pa.int64())
            row_id += len(ids)
            yield rows(numbers, batch["doc_id"], pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary()))
        yield rows(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([met.tobytes()], pa.binary()))

    return docs.mapInArrow(encode, ENCODED)


def token_counts(stored: DataFrame) -> DataFrame:
    """(token_id, n) over all documents of ``encoded``: one row per entry of the vocabulary that occurs.

    Each task adds up the counts that it reads, so at most a vocabulary's worth of rows leaves it.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for one in batch["counts"]:
                met = np.frombuffer(one.as_buffer(), dtype="<i8")
                total = met if total is None else total + met
        if total is not None:
            (seen,) = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token_id", "n"])

    counts = stored.select("counts").where("counts IS NOT NULL")
    return counts.mapInArrow(add, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of all documents below ``folder`` in ascending order of document id; return ``folder``.

    A null or empty text is the end id alone. A null id comes first; rows of equal id keep the order of the input.
    An empty table gives files without rows.
    """
    spark = docs.sparkSession
    codes = encoder(path)
    scratch = scratch_path(spark, "encoded")
    # Ids do not repeat as values of a column do, so no dictionary is tried.
    encoded(text_rows(docs, id_col, text_col), path, end_id).write.option("parquet.enable.dictionary", "false").parquet(scratch)
    stored = spark.read.schema(ENCODED).parquet(scratch)
    ids = stored.where("row_id IS NOT NULL").drop("counts")
    width, vocabulary = codes.id_type.itemsize, max(codes.size, end_id + 1)
    # At most one row per entry of the vocabulary, whatever the corpus.
    counted = [(r["token_id"], r["n"]) for r in token_counts(stored).collect()]
    by_rank = [token for token, _ in sorted(counted, key=lambda pair: (-pair[1], pair[0]))]
    total = sum(n for _, n in counted)
    ranks = [(rank, token) for rank, token in enumerate(by_rank)]
    spark.createDataFrame(ranks, "rank long, token_id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(vocabulary, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        n_held = 0

        def closed() -> pa.RecordBatch:
            control, data = encode_ranks(shared.value[np.concatenate(held)])
            row = {"shard": shard, "block": block, "first": first, "doc_id": doc_ids, "n_ids": [len(x) for x in held], "control": control, "data": data}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))

        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["ids"]):
                doc_ids.append(doc_id)
                held.append(np.frombuffer(raw.as_py(), dtype=f"<u{width}"))
                n_held += len(held[-1])
                if n_held >= BLOCK_IDS:
                    yield closed()
                    block, first, doc_ids, held, n_held = block + 1, first + n_held, [], [], 0
        if held:
            yield closed()

    shards = min(MOST_SHARDS, max(1, -(-total // SHARD_IDS)))
    ordered = ids.repartitionByRange(shards, "doc_id", "row_id").sortWithinPartitions("doc_id", "row_id")
    ordered.select("doc_id", "ids").mapInArrow(blocks, BLOCKS).write.parquet(f"{folder}/blocks")
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the files: id, ids of all documents before it, number of ids, and the ids as 32-bit integers."""
    stored = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    token_of = np.array([r["token_id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], dtype="<u4")
    shared = spark.sparkContext.broadcast(token_of)
    # One row per shard, that is per file.
    in_block = F.aggregate("n_ids", F.lit(0).cast("long"), lambda total, n: total + n)
    sizes = {r["shard"]: r["n"] for r in stored.groupBy("shard").agg(F.sum(in_block).alias("n")).collect()}
    before, total = {}, 0
    for shard in sorted(sizes):
        before[shard] = total
        total += sizes[shard]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, _, first, doc_ids, n_ids, control, data = (column[row].as_py() for column in batch.columns)
                counts = np.array(n_ids, dtype=np.int64)
                ends = np.cumsum(counts)
                ids = shared.value[decode_ranks(control, data, int(ends[-1]))]
                starts = before[shard] + first + ends - counts
                raw = [ids[end - n : end].tobytes() for end, n in zip(ends.tolist(), n_ids)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return stored.mapInArrow(read, READ)


def checksums(read: DataFrame) -> DataFrame:
    """The rows of ``read_tokens`` with the CRC-32 of their ids in place of the ids."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
