"""Token counts of whole texts by a two-tier lookup in the map, without moving any pre-token occurrence.

Tier one is a compact table of the lengths of frequent pre-tokens, broadcast once; tier two is what each worker has
encoded so far. The table only saves work: a pre-token that is in neither tier is encoded by the library itself.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.llm.common import cut_lineage, slices, text_rows
from stowage.llm.tokens import REMEMBERED, encoder

# Entries of the broadcast table, and candidates that each task names for it. With at most 64 characters an entry the
# table is below 20 MB whatever the corpus.
TABLE_ENTRIES = 65_536
CANDIDATES_PER_TASK = 16_384
ENTRY_CHARS = 64

COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def frequent_pieces(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> list[str]:
    """The pieces that occur most in all of ``docs``, by bounded candidate lists of each task.

    A task that meets very many distinct pieces forgets its rarest ones; that can only leave a piece to tier two.
    """

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        cut = encoder(path)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for first, end in slices(texts):
                for text in texts[first:end]:
                    found.update(cut.pieces(text))
                if len(found) > REMEMBERED:
                    found = Counter(dict(found.most_common(REMEMBERED // 4)))
        top = [(piece, n) for piece, n in found.most_common(CANDIDATES_PER_TASK) if len(piece) <= ENTRY_CHARS]
        if top:
            yield pa.RecordBatch.from_pydict({"piece": [p for p, _ in top], "n": [n for _, n in top]})

    named = cut_lineage(docs.mapInArrow(candidates, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")))
    total = named.agg(F.sum("n")).first()[0] or 0
    # No more than 16 times as many pieces can have so large a share, however many candidates there are.
    large = named.where(F.col("n") >= total // (16 * entries))
    return large.orderBy(F.desc("n"), "piece").limit(entries).toArrow()["piece"].to_pylist()


class LengthTable:
    """Token lengths of frequent pieces: their UTF-8 bytes in one block, and two small arrays."""

    def __init__(self, pieces: list[str], lengths: list[int]):
        kept = [(piece, n) for piece, n in zip(pieces, lengths) if n < 1 << 16]
        raw = [piece.encode() for piece, _ in kept]
        self.key = uuid.uuid4().hex
        self.block = b"".join(raw)
        self.ends = np.cumsum([len(one) for one in raw], dtype=np.uint32)
        self.lengths = np.array([n for _, n in kept], dtype=np.uint16)

    def open(self) -> dict[str, int]:
        starts = [0, *self.ends.tolist()]
        return {self.block[a:b].decode(): n for a, b, n in zip(starts, starts[1:], self.lengths.tolist())}


_OPENED: dict[str, dict[str, int]] = {}
_MISSES: dict[str, dict[str, int]] = {}


def _tier_one(shared) -> dict[str, int]:
    """The broadcast table as a dictionary, opened once per worker process."""
    key = shared.value.key
    if key not in _OPENED:
        _OPENED.clear()
        _OPENED[key] = shared.value.open()
    return _OPENED[key]


def count_tokens(
    spark: SparkSession, docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens as the library counts them, and whether they exceed ``limit``.

    A null or empty text has no tokens. Repeated rows and null ids stay one row each; a special string in a text is a
    special token, as is the library's default. An empty table gives an empty table.
    """
    rows = text_rows(docs, id_col, text_col)
    frequent = frequent_pieces(rows.select("text"), path)
    lengths = [len(ids) for ids in encoder(path).encode(frequent)]
    shared = spark.sparkContext.broadcast(LengthTable(frequent, lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known, seen = encoder(path), _tier_one(shared), _MISSES.setdefault(path, {})
        for batch in batches:
            texts = batch["text"].to_pylist()
            counts: list[int] = []
            for first, end in slices(texts):
                taken = [cut.pieces(text) for text in texts[first:end]]
                missed = set().union(*taken).difference(known)
                if len(seen) + len(missed) > REMEMBERED:
                    # What this slice has again is likely to come again.
                    again = {piece: seen[piece] for piece in missed if piece in seen}
                    seen.clear()
                    seen.update(again)
                new = list(missed.difference(seen))
                seen.update(zip(new, (len(ids) // cut.id_type.itemsize for ids in cut.encode_new(new))))
                for pieces in taken:
                    found = list(map(known.get, pieces))
                    if None in found:
                        found = [seen[p] if n is None else n for p, n in zip(pieces, found)]
                    counts.append(sum(found))
            n_bytes = [len(text) if text.isascii() else len(text.encode()) for text in texts]
            columns = [batch["doc_id"], pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64())]
            over = pa.array([n > limit for n in counts], pa.bool_())
            yield pa.RecordBatch.from_arrays([*columns, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, COUNTED)
