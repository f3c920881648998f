"""SimHash near-duplicates: a binary trie self-join over fingerprints under a budget of differing bits.

Two fingerprints that differ in at most e bits agree wholly in one of e + 1 blocks of bits. For each block the
fingerprints are turned so that the block stands first, dealt out by it, and sorted: the sorted array is the trie, a node
being a range of it. Node pairs are walked level by level in numpy, a pair of opposite children costs one bit, and pairs
beyond the budget are dropped, as are pairs whose elements are all known to be connected already. Equal fingerprints are
one element. A task passes on only as many links as it takes to connect what it found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from stowage.llm.common import cut_lineage, fresh, text_rows
from stowage.llm.components import connected_components, merge
from stowage.llm.shingle_join import common_shingles, hot_shingles, prefix, shingles, similar_links, sketch

BITS = 64
# Node pairs walked at once; more are halved and walked in turn.
FRONTIER = 1 << 15
# Element pairs of a node pair from which they are compared directly.
LEAF_PAIRS = 16
# Elements of whole groups that a task joins at once.
TASK_ELEMENTS = 1 << 15


def simhash(text: str, words: int = 4) -> int:
    """The fingerprint of a text as an unsigned integer; zero for a text without words."""
    return _majority(shingles(text, words))


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, bits): the fingerprint of each text as a signed long."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(text.as_py(), words) for text in batch["text"]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "bits"])

    return docs.mapInArrow(count, "doc_id long, bits long")


def blocks(max_bits: int) -> list[tuple[int, int]]:
    """First bit and width of each of the blocks, from the highest bit."""
    edges = [BITS * i // (max_bits + 1) for i in range(max_bits + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def trie_links(turned: np.ndarray, starts: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that connect all pairs of one group within ``max_bits`` of each other.

    ``turned`` is sorted within each group, groups begin at ``starts``, and no value is twice in a group.
    """
    n = len(turned)
    label = np.arange(n)
    firsts, seconds = [], []

    def link(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        near = np.bitwise_count(turned[i] ^ turned[j]) <= max_bits
        i, j = i[near], j[near]
        if len(i):
            used, label = merge(label, i, j)
            firsts.append(i[used])
            seconds.append(j[used])

    ends = np.append(starts[1:], n)
    # Neighbours in the order of the trie are the likeliest links; the more is connected, the more is dropped later.
    group_of = np.repeat(np.arange(len(starts)), ends - starts)
    here = np.flatnonzero(group_of[1:] == group_of[:-1])
    link(here, here + 1)

    many = ends - starts > 1
    roots = (starts[many], ends[many], starts[many], ends[many], np.zeros(int(many.sum()), dtype=np.int64))
    stack = [(0, roots)]
    counted, changes = None, None
    while stack:
        depth, pairs = stack.pop()
        if len(pairs[0]) > FRONTIER:
            half = len(pairs[0]) // 2
            stack += [(depth, tuple(x[:half] for x in pairs)), (depth, tuple(x[half:] for x in pairs))]
            continue
        a0, a1, b0, b1, spent = pairs
        # A pair of nodes whose elements all have one label has nothing to add.
        if counted is not label:
            counted, changes = label, np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        one = (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (label[a0] == label[b0])
        a0, a1, b0, b1, spent = (x[~one] for x in (a0, a1, b0, b1, spent))
        few = (a1 - a0) * (b1 - b0) <= LEAF_PAIRS
        if few.any():
            link(*_element_pairs(a0[few], a1[few], b0[few], b1[few]))
        a0, a1, b0, b1, spent = (x[~few] for x in (a0, a1, b0, b1, spent))
        if not len(a0) or depth == BITS:
            continue
        bit = (turned >> np.uint64(BITS - 1 - depth) & np.uint64(1)).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(bit)])
        a_mid, b_mid = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        children = [
            (a0, a_mid, b0, b_mid, spent),
            (a_mid, a1, b_mid, b1, spent),
            (a0, a_mid, b_mid, b1, spent + 1),
            tuple(x[~same] for x in (a_mid, a1, b0, b_mid, spent + 1)),
        ]
        below = [np.concatenate(x) for x in zip(*children)]
        useful = (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= max_bits)
        useful &= (below[0] != below[2]) | (below[1] - below[0] > 1)
        stack.append((depth + 1, tuple(x[useful] for x in below)))
    empty = np.empty(0, dtype=np.int64)
    return np.concatenate([empty, *firsts]), np.concatenate([empty, *seconds])


def _element_pairs(a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray]:
    """All element pairs of node pairs, each pair of a node with itself once."""
    width = b1 - b0
    count = (a1 - a0) * width
    node = np.repeat(np.arange(len(a0)), count)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    i, j = a0[node] + step // width[node], b0[node] + step % width[node]
    once = i < j
    return i[once], j[once]


def links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links (a, b) between the distinct ``bits`` of ``prints``, as many as connect all within ``max_bits``."""
    cuts = blocks(max_bits)
    whole = F.col("bits")
    turns = []
    for block, (first, width) in enumerate(cuts):
        turned = whole if first == 0 else F.shiftleft(whole, first).bitwiseOR(F.shiftrightunsigned(whole, BITS - first))
        key = F.shiftrightunsigned(turned, BITS - width) if width < BITS else turned
        turns.append(F.struct(F.lit(block).alias("block"), key.alias("key"), turned.alias("turned")))
    dealt = prints.select("bits", F.explode(F.array(*turns)).alias("at")).select("bits", "at.*")
    # Signed longs of one group share their highest bit, so they sort as unsigned ones do.
    grouped = dealt.repartition("block", "key").sortWithinPartitions("block", "key", "turned")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n_held = 0

        def flush(rows: list[np.ndarray]) -> pa.RecordBatch:
            bits, block, key, turned = rows
            changed = (block[1:] != block[:-1]) | (key[1:] != key[:-1])
            starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            i, j = trie_links(turned.view(np.uint64), starts, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(bits[i]), pa.array(bits[j])], ["a", "b"])

        for batch in batches:
            held.append([batch[name].to_numpy() for name in ("bits", "block", "key", "turned")])
            n_held += batch.num_rows
            if n_held >= TASK_ELEMENTS:
                rows = [np.concatenate(x) for x in zip(*held)]
                # The last group may go on in the next batch.
                last = (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
                cut = len(last) - int(last.sum())
                if cut:
                    yield flush([x[:cut] for x in rows])
                held, n_held = [[x[cut:] for x in rows]], len(last) - cut
        if n_held:
            yield flush([np.concatenate(x) for x in zip(*held)])

    return grouped.mapInArrow(join, "a long, b long")


def groups(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(bits, root) of distinct ``bits``: the root is one fingerprint of all that links lead to."""
    found = connected_components(links(distinct, max_bits))
    rooted = distinct.select("bits").join(found.withColumnRenamed("node", "bits"), "bits", "left")
    return cut_lineage(rooted.select("bits", F.coalesce("component", "bits").alias("root")))


def near_duplicates(
    docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its fingerprint and the smallest id that links of at most ``max_bits`` bits lead to.

    A null or empty text has the fingerprint zero, which is linked like any other. Repeated rows stay. A row with a null
    id gets the smallest id of its component, which is null where no row has one. An empty table gives an empty table.
    """
    prints = cut_lineage(fingerprints(text_rows(docs, id_col, text_col), words))
    distinct = cut_lineage(prints.groupBy("bits").agg(F.min("doc_id").alias("lowest")))
    rooted = groups(distinct, max_bits)
    smallest = rooted.join(distinct, "bits").groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = cut_lineage(rooted.join(cut_lineage(smallest), "root").select("bits", "component_id"))
    hexed = F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint")
    return prints.join(named, "bits").select("doc_id", hexed, "component_id")


def placed(docs: DataFrame, file: str, at: str) -> DataFrame:
    """``docs`` with the file that a row is stored in and its place there, which never change.

    A table that is read from Parquet files has both; any other is written first, as what it gives might differ the next time.
    """
    try:
        place = docs.metadataColumn("_metadata")
        named = docs.withColumns({file: F.md5(place["file_path"].cast("binary")), at: place["row_index"]})
        named.schema  # noqa: B018
        return named
    except AnalysisException:
        return placed(cut_lineage(docs), file, at)


def keep_one(docs: DataFrame, words: int, max_bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, all its columns as they are: the one of the smallest id.

    Near-duplicates are linked by a Jaccard similarity of their sets of shingles of at least 4/5, and by nothing else:
    fingerprints within ``max_bits`` of each other name likely pairs, the prefixes of the sets name all others, and a pair
    is linked if its texts are similar. Null ids come last; of several rows of that id one stays, the same at every run
    over the same files. A null text is empty, and texts without words are one group. Texts are compared whole. An empty
    table gives an empty table.
    """
    file, at = fresh("file", docs.columns), fresh("at", docs.columns)
    stored = placed(docs, file, at)
    rows = stored.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(file).alias("file"), F.col(at).alias("at"))
    sampled = common_shingles(rows, words)
    common = docs.sparkSession.sparkContext.broadcast(sampled)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = []
            for text in batch["text"]:
                hashes = shingles(text.as_py(), words)
                distinct = np.unique(hashes)
                # Signed, as columns are.
                signed = int(np.uint64(_majority(hashes)).astype(np.int64))
                found.append((signed, xxhash.xxh3_128_digest(distinct.tobytes()), len(distinct), sketch(distinct), prefix(distinct, common.value).view(np.int64)))
            prints, digests, sizes, sketches, prefixes = zip(*found) if found else [()] * 5
            numbers = pa.array(np.arange(first, first + batch.num_rows))
            first += batch.num_rows
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]), pa.int32())
            values = pa.array(np.concatenate([np.empty(0, dtype=np.int64), *prefixes]))
            columns = [numbers, batch["id"], batch["file"], batch["at"], pa.array(prints, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(ends, values)]
            yield pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in MEASURED.split(", ")])

    # Narrow: no text, and rows get their numbers here, by which they go until the end.
    measured = cut_lineage(rows.mapInArrow(measure, MEASURED))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "file", "at")
    # Equal sets are one element, known by the row that would stay of them. Its sketch and prefix go with it, so that they
    # are dealt out once and looked up by no join.
    first = F.min_by(F.struct("row", "bits", "n", "file", "at", "sketch", "prefix"), order)
    sets = cut_lineage(measured.groupBy("digest").agg(F.min(order).alias("first"), first.alias("of")).select("of.*", "first"))
    sketches = sets.select("row", "n", "sketch")
    distinct = cut_lineage(sets.groupBy("bits").agg(F.min("row").alias("row")))
    equal = sets.select("bits", F.col("row").alias("b")).join(distinct.withColumnRenamed("row", "a"), "bits").where("a != b").select("a", "b")
    ends = links(distinct, max_bits)
    for end in ("a", "b"):
        ends = ends.join(distinct.select(F.col("bits").alias(end), F.col("row").alias(f"row_{end}")), end)
    near = equal.unionByName(ends.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")))

    def texts(needed: DataFrame) -> DataFrame:
        named = cut_lineage(sets.join(needed, "row").select("row", "file", "at"))
        return rows.select("file", "at", "text").join(named, ["file", "at"]).select("row", "text")

    found = connected_components(similar_links(sets.select("row", "prefix"), near, sketches, texts, words, hot_shingles(sampled)))
    rooted = sets.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("component", "row"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.file").alias(file), F.col("first.at").alias(at))
    # The kept rows grow with the documents, so they are merged at every size and never broadcast.
    return stored.join(cut_lineage(kept).hint("merge"), [file, at], "left_semi").select(*docs.columns)


MEASURED = "row long, id long, file string, at long, bits long, digest binary, n long, sketch binary, prefix array<long>"
