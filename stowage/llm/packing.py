"""Documents packed into sequences of a fixed size by bounded-space online best fit.

Each task keeps a fixed number of open sequences in a bitset keyed by their free space. A piece goes to the open sequence
with the least space that still holds it; when too many are open, the fullest is closed. Only lengths move, not ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stowage.llm.common import cut_lineage, text_rows
from stowage.llm.tokens import encoder

SEQUENCE_TOKENS = 4096
OPEN_SEQUENCES = 1024
# Tokens that one packing task takes: 4096 sequences of the usual size. The few sequences that a task leaves part-full
# are a share of its work that does not depend on the size of the corpus.
TASK_TOKENS = 1 << 24

PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenSequences:
    """Open sequences by free space; bit f of ``bits`` is set where some open sequence has f tokens free."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.bits, self.by_free, self.n_open, self.started = 0, {}, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that takes a piece of ``length``, and the offset there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.started
            self.started += 1
        self._put(free - length, sequence)
        if self.n_open > self.most_open:
            self._take((self.bits & -self.bits).bit_length() - 1)
        return sequence, self.capacity - free

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        sequence = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return sequence

    def _put(self, free: int, sequence: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(sequence)
            self.bits |= 1 << free
            self.n_open += 1


def pieces_of(docs: DataFrame, path: str, end_id: int = 1, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """The pieces of each document: all its ids and ``end_id``, cut only where they exceed ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(path)
        end = np.array([end_id], dtype=codes.id_type).tobytes()
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), codes.ids(batch["text"].to_pylist())):
                ids = np.frombuffer(raw + end, dtype=codes.id_type).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    out.append((row_id, doc_id, piece, start, len(part), zlib.crc32(part)))
                    row_id += 1
            if out:
                names = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return docs.mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, most_open: int = OPEN_SEQUENCES) -> DataFrame:
    """Give each row of ``pieces`` a sequence and an offset. ``row_id`` deals the rows out evenly and orders them."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_TOKENS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = OpenSequences(capacity, most_open)
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = [sequences.place(length) for length in batch["length"].to_pylist()]
            kept = [batch[name] for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
            at = [pa.array([first + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept, *at], names)

    # The hash order is a shuffled one: large and small pieces arrive mixed, so small ones fill what large ones leave.
    order = F.xxhash64("row_id")
    dealt = pieces.repartition(tasks, "row_id").sortWithinPartitions(order, "row_id")
    return dealt.mapInArrow(place, PACKED)


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int = 1,
    capacity: int = SEQUENCE_TOKENS,
    most_open: int = OPEN_SEQUENCES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of each document with its sequence and offset.

    A null or empty text is the end id alone. Repeated rows are packed once each, also with equal or null ids. Texts of
    any length are cut into pieces of ``capacity``. An empty table gives an empty table.
    """
    pieces = cut_lineage(pieces_of(text_rows(docs, id_col, text_col), path, end_id, capacity))
    return pack(pieces, capacity, most_open)
