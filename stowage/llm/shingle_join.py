"""Pairs of documents whose shingle sets are similar: an exact self-join by prefixes.

Two sets of a Jaccard similarity of 4/5 or more share at least four fifths of the larger one. So with the shingles of each
set in one global order, their prefixes of n - ceil(4n/5) + 1 shingles have one in common, and no pair is missed. Any order
will do; shingles that a sample of the documents shows to be common come last, which only makes groups smaller. A shingle
is known by its 64-bit hash.

Prefixes are dealt out and sorted once, as pairs of shingle and row, and only shingles met twice go on. Documents of one
group are compared with its first one, what that connects is one component, and then the pairs of a group that are in
different components are compared: first as many as connect, by their sketches, all that may be similar, and then, in
the components which that gives, all pairs that are left. Before any text moves, a pair must pass by its sketches: the parity of the set's hashes
in some bits for each of them. Every bit in which two sketches differ is a shingle that only one set has, so a pair
with too many of them is not similar, without exception. Most pairs of a group have little more in common than its shingle
and fail by short sketches already, so the long ones are sent only for rows of which some pair passes by the short ones.
What is left, nearly all of it similar, is decided on the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stowage.llm.common import cut_lineage, hashed_share
from stowage.llm.components import connected_components, merge

SEED = 42
# Jaccard similarity from which two sets are similar, as a fraction.
SHARED, OF = 4, 5
# Documents sampled for the order of shingles, the share of a text looked at, and common shingles at most.
ORDER_DOCUMENTS, ORDER_CHARS, ORDER_SHINGLES = 2_000, 20_000, 50_000
# Bits of a sketch for each hash, at least. At four of them nearly all pairs of a similarity below 0.78 are told apart.
SKETCH_BITS = 4
# A shingle of one sampled document in so many is hot.
HOT = 100


def shingles(text: str, words: int) -> np.ndarray:
    """Hashes of all shingles in their order, repeated ones too; a shorter text is one shingle, no words are none."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(found) <= words:
        parts = [b" ".join(found)]
    else:
        parts = map(b" ".join, zip(*(found[i:] for i in range(words))))
    return np.array([xxhash.xxh64_intdigest(part, SEED) for part in parts], dtype=np.uint64)


def similar(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sets of sorted distinct hashes have a Jaccard similarity of at least ``SHARED / OF``."""
    if OF * min(len(one), len(two)) < SHARED * max(len(one), len(two)):
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return OF * both >= SHARED * (len(one) + len(two) - both)


def common_shingles(docs: DataFrame, words: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles met in several sampled documents, and in how many. They decide an order and no result.

    Tasks take the sampled texts apart and count, so at most ``ORDER_SHINGLES`` numbers reach the driver.
    """
    total = docs.count()
    short = F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, ORDER_CHARS).alias("text")
    rows = docs.select(short).where(hashed_share(F.col("text"), ORDER_DOCUMENTS, total)).limit(2 * ORDER_DOCUMENTS)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, dtype=np.uint64), *(np.unique(shingles(text.as_py(), words)) for text in batch["text"])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    counted = rows.mapInArrow(hashes, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    several = counted.orderBy(F.desc("met"), "shingle").limit(ORDER_SHINGLES).toArrow()
    known, met = several["shingle"].to_numpy().view(np.uint64), several["met"].to_numpy()
    order = np.argsort(known)
    return known[order], met[order]


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles, in the global order, of a set of sorted distinct hashes."""
    known, met = common
    times = np.zeros(len(hashes), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        times = np.where(known[at] == hashes, met[at], 0)
    n = len(hashes)
    return hashes[np.argsort(times, kind="stable")][: n - -(-SHARED * n // OF) + 1 if n else 0]


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of a set of distinct hashes by their lowest bits: ``SKETCH_BITS`` bits for each of them, rounded up."""
    bits = max(64, SKETCH_BITS << (max(len(hashes), 1) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def short_sketches(sketches: DataFrame) -> DataFrame:
    """``sketches`` (row, n, sketch) with sketches of a bit for each hash, rounded up: those of the same sets, folded."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [_folded(np.frombuffer(s, dtype=np.uint8)[None, :], max(8, len(s) // SKETCH_BITS)).tobytes() for s in batch["sketch"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["n"], pa.array(short, pa.binary())], ["row", "n", "sketch"])

    return sketches.select("row", "n", "sketch").mapInArrow(fold, "row long, n long, sketch binary")


def _folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Sketches, a row each, as the shorter ones of ``size`` bytes that the same sets have."""
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def possible(n: np.ndarray, other_n: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes may be similar, of which at least ``apart`` elements are in one alone."""
    least = np.maximum(apart, np.abs(n - other_n))
    return (OF - SHARED) * (n + other_n) >= (OF + SHARED) * least


def hot_shingles(common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shingles that one sampled document in ``HOT`` has, whose groups are not brought together."""
    known, met = common
    return known[met >= max(2, ORDER_DOCUMENTS // HOT)]


def shared_shingles(prefixes: DataFrame, hot: np.ndarray = np.empty(0, dtype=np.uint64)) -> DataFrame:
    """(shingle, row, pivot) of each shingle that several ``prefixes`` (row, prefix) have; the pivot is its first row.

    ``hot`` shingles are in a large part of all rows. How a shingle is treated decides about time and about no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last group of a batch goes on in the next one. Of a group met once so far its row is held back.
        last, pivot, held = None, 0, False
        for batch in batches:
            shingle, row = (batch[name].to_numpy() for name in ("shingle", "row"))
            if not len(shingle):
                continue
            starts = np.concatenate([[last is None or shingle[0] != last], shingle[1:] != shingle[:-1]])
            at = np.flatnonzero(starts)
            firsts = np.maximum.accumulate(np.where(starts, np.arange(len(shingle)), -1))
            pivots = np.where(firsts >= 0, row[np.maximum(firsts, 0)], pivot)
            sizes = np.diff(np.append(at, len(shingle)))
            several = ~starts
            several[at[sizes > 1]] = True
            out = [shingle[several], row[several], pivots[several]]
            if held and not starts[0]:
                out = [np.concatenate([[value], one]) for value, one in zip((last, pivot, pivot), out)]
            held = len(at) > 0 and len(shingle) - at[-1] == 1
            last, pivot = shingle[-1], pivots[-1]
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()) for one in out], ["shingle", "row", "pivot"])

    entries = prefixes.select(F.explode("prefix").alias("shingle"), "row")
    if not len(hot):
        dealt = entries.repartition("shingle").sortWithinPartitions("shingle", "row")
        return dealt.mapInArrow(run, "shingle long, row long, pivot long")
    # At most ORDER_SHINGLES numbers. Their entries stay where they are; only their first rows are reduced.
    named = F.broadcast(prefixes.sparkSession.createDataFrame([(int(h),) for h in hot.view(np.int64)], "shingle long"))
    dealt = entries.join(named, "shingle", "left_anti").repartition("shingle").sortWithinPartitions("shingle", "row")
    spread = entries.join(named, "shingle", "left_semi")
    firsts = cut_lineage(spread.groupBy("shingle").agg(F.min("row").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
    found = spread.join(F.broadcast(firsts), "shingle").select("shingle", "row", "pivot")
    return dealt.mapInArrow(run, "shingle long, row long, pivot long").unionByName(found)


def surviving(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that may be similar by their ``sketches`` (row, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, other_n = (batch[name].to_numpy() for name in ("n", "n_2"))
            apart = np.zeros(batch.num_rows, dtype=np.int64)
            near = np.flatnonzero(possible(n, other_n, apart))
            one, two = batch["sketch"].take(pa.array(near)).to_pylist(), batch["sketch_2"].take(pa.array(near)).to_pylist()
            for at, x, y in zip(near.tolist(), one, two):
                apart[at] = _differing(x, y)
            yield batch.select(["a", "b"]).filter(pa.array(possible(n, other_n, apart)))

    first = sketches.select(F.col("row").alias("a"), "n", "sketch")
    second = sketches.select(F.col("row").alias("b"), F.col("n").alias("n_2"), F.col("sketch").alias("sketch_2"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "n", "n_2", "sketch", "sketch_2").mapInArrow(run, "a long, b long")


def _differing(one: bytes, two: bytes) -> int:
    size = min(len(one), len(two))
    x, y = (_folded(np.frombuffer(s, dtype=np.uint8)[None, :], size) for s in (one, two))
    return int(np.bitwise_count(x ^ y).sum())


# Pairs of one row that a task decides with one copy of its text.
PART_PAIRS = 2_000


def verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int) -> DataFrame:
    """The ``pairs`` (a, b) whose texts are similar; ``texts`` gives (row, text) of some rows (row).

    The pairs of one row stand together, after the row's own text, so a text is sent once for itself and once for each
    pair in which it is the second.
    """
    named = cut_lineage(pairs)
    needed = named.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    held = cut_lineage(texts(needed))
    none = F.lit(None).cast("long")
    # A row with very many pairs is dealt out, its own text to each part of them.
    parts = cut_lineage(named.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART_PAIRS).cast("int").alias("parts")))
    first = held.join(parts.withColumnRenamed("a", "row"), "row").select(
        F.col("row").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), none.alias("b"), "text"
    )
    salted = named.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    second = salted.join(held.withColumnRenamed("row", "b"), "b").select("a", "part", "b", "text")
    dealt = first.unionByName(second).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for batch in batches:
            keep = []
            for b, text in zip(batch["b"].to_pylist(), batch["text"]):
                found = np.unique(shingles(text.as_py(), words))
                if b is None:
                    one = found
                keep.append(b is not None and similar(one, found))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut_lineage(dealt.select("a", "b", "text").mapInArrow(decide, "a long, b long"))


# Rows of a group that are compared with as many others at once, and rows of a group that are one side of a task's work.
BLOCK = 512
CHUNK_ROWS = 1 << 15


Side = tuple[np.ndarray, np.ndarray, np.ndarray, list]


def _ordered(side: Side) -> Side:
    row, component, n, sketches = side
    order = np.argsort(n, kind="stable")
    return row[order], component[order], n[order], [np.frombuffer(sketches[at], dtype=np.uint8) for at in order.tolist()]


def _crossing(
    one: Side, two: Side | None = None, spanning: bool = False, ends: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that are in different components and may be similar, block by block: those of one side, or of a row of
    one side and a row of the other.

    With ``spanning`` components that a pair may connect count as one from then on, so that there are no more pairs than
    it takes to connect them, the likeliest first. With ``ends`` pairs of which both rows are in an earlier pair are left out,
    so that every row of any pair is in one. Rows are in order of size, so a block meets those blocks only whose sets are
    neither too small nor too large for it.
    """
    row, component, n, kept = _ordered(one)
    other_row, other_component, other_n, other_kept = (row, component, n, kept) if two is None else _ordered(two)
    # Components by number, and what is one of them by now.
    distinct, number = np.unique(np.concatenate([component, other_component]), return_inverse=True)
    own, other_own, label = number[: len(row)], number[len(row) :], np.arange(len(distinct))
    met = np.zeros(len(row), dtype=bool)
    other_met = met if two is None else np.zeros(len(other_row), dtype=bool)
    for first in range(0, len(row), BLOCK):
        here = slice(first, min(first + BLOCK, len(row)))
        for second in range(first if two is None else 0, len(other_row), BLOCK):
            there = slice(second, min(second + BLOCK, len(other_row)))
            if SHARED * other_n[second] > OF * n[here][-1]:
                break
            if SHARED * n[first] > OF * other_n[there][-1]:
                continue
            mine, theirs = label[own[here]], label[other_own[there]]
            if (mine[0] == mine).all() and (mine[0] == theirs).all():
                continue
            apart = mine[:, None] != theirs[None, :]
            if ends:
                apart &= ~(met[here][:, None] & other_met[there][None, :])
            apart &= possible(n[here][:, None], other_n[there][None, :], np.zeros((1, 1), dtype=np.int64))
            if two is None:
                apart &= np.arange(here.start, here.stop)[:, None] < np.arange(there.start, there.stop)[None, :]
            i, j = np.nonzero(apart)
            differing = np.zeros(len(i), dtype=np.int64)
            sizes = np.array([len(s) for s in kept[here]])[i]
            other_sizes = np.array([len(s) for s in other_kept[there]])[j]
            for size in np.unique(np.stack([sizes, other_sizes]), axis=1).T.tolist() if len(i) else []:
                (of,) = np.nonzero((sizes == size[0]) & (other_sizes == size[1]))
                for part in np.array_split(of, max(1, len(of) * max(size) >> 24)):
                    x = _folded(np.stack([kept[here][k] for k in i[part].tolist()]), min(size))
                    y = _folded(np.stack([other_kept[there][k] for k in j[part].tolist()]), min(size))
                    differing[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(possible(n[here][i], other_n[there][j], differing))
            if spanning and len(near):
                near = near[np.argsort(differing[near] / (n[here][i[near]] + other_n[there][j[near]]), kind="stable")]
                used, label = merge(label, own[here][i[near]], other_own[there][j[near]])
                near = near[used]
            if ends:
                met[here][i[near]] = True
                other_met[there][j[near]] = True
            yield row[here][i[near]], other_row[there][j[near]]


def mixed_groups(labelled: DataFrame) -> DataFrame:
    """(shingle, main, others, mains) of the groups of several components, one for all groups of the same rows.

    ``main`` is the largest component of a group that is more than a block, ``others`` and ``mains`` the chunks of the rows
    outside and inside of it. Rows are known to be the same by their number, the least and the greatest of them and 128 bits
    of hashes; a row is in a group once, and of one component.
    """
    counted = labelled.groupBy("shingle", "component").agg(
        F.count(F.lit(1)).alias("k"), F.min("row").alias("low"), F.max("row").alias("high"),
        F.bit_xor(F.xxhash64("row")).alias("one"), F.bit_xor(F.xxhash64(F.lit("rows"), "row")).alias("two"),
    )
    largest = F.max_by(F.struct("component", "k"), F.struct("k", "component"))
    groups = counted.groupBy("shingle").agg(
        F.sum("k").alias("m"), F.count(F.lit(1)).alias("components"), largest.alias("largest"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"),
    ).where("components > 1")
    once = groups.groupBy("m", "low", "high", "one", "two").agg(F.min("shingle").alias("shingle"), F.min("largest").alias("largest"))
    several, chunks = F.col("m") > BLOCK, lambda rows: F.ceil(rows / CHUNK_ROWS).cast("int")
    return once.select(
        "shingle", F.when(several, F.col("largest.component")).alias("main"),
        chunks(F.col("m") - F.when(several, F.col("largest.k")).otherwise(0)).alias("others"), chunks(F.col("largest.k")).alias("mains"),
    )


# What a piece of work is known by.
PIECE = ["shingle", "kind", "one", "two"]


def pieces(labelled: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows of the groups of several components with their sketches, dealt out and sorted by pieces of work of a bounded size.

    ``labelled`` has (shingle, row, component). Of a group, most rows are in its largest component as a rule, and are not
    compared with each other. The others are cut into chunks, as is the largest component, and a task compares a chunk of
    others with itself, with another such chunk, or with one of the largest component, block by block. So a group of any
    size is many pieces of work of a bounded size. A group of a block or less is one piece. Documents that share a shingle
    share many as a rule, so the same rows are many groups, of which one is compared.
    """
    mixed = cut_lineage(mixed_groups(labelled))
    placed = labelled.join(mixed, "shingle").withColumn("in_main", F.coalesce(F.col("component") == F.col("main"), F.lit(False)))
    own = F.pmod(F.xxhash64("row"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    others, mains = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(0), F.col("mains") - 1)
    item = lambda kind, one, two: F.struct(F.lit(kind).alias("kind"), one.alias("one"), two.alias("two"))
    of_main = F.transform(others, lambda chunk: item("main", chunk, F.col("own")))
    of_other = F.concat(
        F.transform(others, lambda chunk: item("others", F.least(chunk, F.col("own")), F.greatest(chunk, F.col("own")))),
        F.when(F.col("main").isNotNull(), F.transform(mains, lambda chunk: item("main", F.col("own"), chunk))).otherwise(F.array()),
    )
    items = placed.withColumn("own", own).join(sketches, "row").withColumn("item", F.explode(F.when(F.col("in_main"), of_main).otherwise(of_other)))
    # The side of a row in its item: 0 for the first chunk.
    side = F.when(F.col("item.kind") == "main", F.col("in_main").cast("int")).otherwise((F.col("own") != F.col("item.one")).cast("int"))
    flat = items.select("shingle", "item.*", side.alias("side"), "row", "component", "n", "sketch")
    return flat.repartition(*PIECE).sortWithinPartitions(*PIECE)


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Side, Side | None]]:
    """Shingle and both sides of each of the ``pieces``; no second one where a chunk is compared with itself."""

    def sides(held: list[pa.RecordBatch]) -> tuple[int, Side, Side | None]:
        whole = pa.Table.from_batches(held).combine_chunks()
        side, row, component, n = (whole[name].to_numpy() for name in ("side", "row", "component", "n"))
        sketches = whole["sketch"].to_pylist()
        found = []
        for which in (0, 1):
            (at,) = np.nonzero(side == which)
            found.append((row[at], component[at], n[at], [sketches[k] for k in at.tolist()]))
        alone = whole["kind"][0].as_py() == "others" and whole["one"][0].as_py() == whole["two"][0].as_py()
        return whole["shingle"][0].as_py(), found[0], None if alone else found[1]

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch[name].to_pylist() for name in PIECE]
        places = list(zip(*columns))
        edges = [0, *[at for at in range(1, len(places)) if places[at] != places[at - 1]], len(places)]
        for first, end in zip(edges, edges[1:]):
            if first == end:
                continue
            if held and places[first] != last:
                yield sides(held)
                held = []
            last = places[first]
            held.append(batch.slice(first, end - first))
    if held:
        yield sides(held)


def promising(labelled: DataFrame, short: DataFrame) -> DataFrame:
    """(shingle, row): of each group, the rows in some pair of different components that may be similar by ``short``
    sketches. Of groups of the same rows one is named. No pair that may be similar by longer sketches is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, one, two in _sides(batches):
            found = [part for pair in _crossing(one, two, ends=True) for part in pair]
            rows = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *found]))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shingle)), pa.array(rows)], ["shingle", "row"])

    return cut_lineage(pieces(labelled, short).mapInArrow(run, "shingle long, row long").distinct())


def crossing_pairs(labelled: DataFrame, sketches: DataFrame, spanning: bool = False) -> DataFrame:
    """Distinct pairs (a, b) that share a shingle, are in different components and may be similar; with ``spanning`` as
    many of each piece of work as connect what all of them connect. Only pairs that pass by their sketches leave a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, one, two in _sides(batches):
            for a, b in _crossing(one, two, spanning):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return pieces(labelled, sketches).mapInArrow(run, "a long, b long").distinct()


def similar_links(
    prefixes: DataFrame, near: DataFrame, sketches: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, hot: np.ndarray
) -> DataFrame:
    """Links (a, b), each between similar documents, that connect all similar ones.

    ``prefixes`` has (row, prefix) of each distinct set and ``sketches`` (row, n, sketch), ``near`` pairs (a, b) that are
    likely to be similar, ``texts`` gives (row, text) of some rows (row), and ``hot`` are shingles of very many rows.
    """
    shared = cut_lineage(shared_shingles(prefixes, hot))
    stars = shared.where("row <> pivot").select(F.col("pivot").alias("a"), F.col("row").alias("b"))
    likely = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    short = cut_lineage(short_sketches(sketches))
    hopeful = cut_lineage(surviving(stars.unionByName(likely).distinct(), short))
    tried = cut_lineage(surviving(hopeful, sketches))
    links = verified(tried, texts, words)

    def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
        labels = connected_components(links).select(F.col("node").alias("row"), "component")
        return cut_lineage(members.join(labels, "row", "left").withColumn("component", F.coalesce("component", "row")))

    # Components only grow, so what has no promising pair across them now has none later.
    members = promising(labelled(shared.drop("pivot"), links), short)
    # Two large components of similar rows have very many pairs, of which a few connect them.
    few = cut_lineage(crossing_pairs(labelled(members, links), sketches, spanning=True).join(tried, ["a", "b"], "left_anti"))
    links, tried = cut_lineage(links.unionByName(verified(few, texts, words))), tried.unionByName(few)
    rest = crossing_pairs(labelled(members, links), sketches).join(tried, ["a", "b"], "left_anti")
    return links.unionByName(verified(rest, texts, words))
