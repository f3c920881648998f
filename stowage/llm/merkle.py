"""A Merkle manifest of a dataset: a root over all rows, a proof for each of them, and the check of what is presented.

A row's leaf is the hash of its fields. The leaves of a source, in order of id, are reduced by sixteen until one node is
left, the subroot; the subroots, in order of source, are reduced likewise to the root. A superblock is a subtree of three
levels, at most 4096 nodes, and the unit of work: on the way up it sends one node to the layer above, on the way down it
gets the outer nodes that its rows' proofs need, a few kilobytes. The leaves and their outer nodes are cogrouped by
superblock, and one function reduces the leaves locally, joins the proofs and folds them. A source with very many rows is
many superblocks, so no group grows with it, and each layer is 4096 times smaller than the one below.

Digests are hashed as lower-case hex text, and kept as 32 bytes between the steps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stowage.llm.common import cut_lineage
from stowage.operators.skew import number_within

FAN = 16
# Levels of a superblock, which starts from 4096 nodes at most.
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = "tree long, at long, n long, node binary"
OUTER = "tree long, at long, node binary, shape binary, others binary, subroot binary, root binary"
PROVED = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

_DIGITS = 64


def hashed(data: bytes) -> bytes:
    """SHA-256 as hex text."""
    return sha256(data).hexdigest().encode()


def leaf_hash(fields: Sequence[Column]) -> Column:
    """The hash of a row's fields: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value as text."""

    def part(field: Column) -> Column:
        text = field.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[part(field) for field in fields]).cast("binary"), 256)


def steps_of(n: int, height: int = HEIGHT) -> int:
    """Levels that a superblock of a tree of ``n`` nodes is reduced by: all of them, or up to where one node is left."""
    steps = 0
    while n > 1 and steps < height:
        n, steps = -(-n // FAN), steps + 1
    return steps


def climb(nodes: list[bytes], steps: int) -> list[list[bytes]]:
    """The nodes of each level, the given ones first; sixteen consecutive ones, or what is left at the end, become one."""
    levels = [nodes]
    for _ in range(steps):
        below = levels[-1]
        levels.append([hashed(b"".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def proofs(levels: list[list[bytes]], shape: bytes, others: bytes) -> list[tuple[bytes, bytes]]:
    """Of each node of the lowest level: how many siblings stand before and after it at each level, and the siblings.

    ``shape`` and ``others`` are those of the superblock itself, which follow on those inside it.
    """
    above = [(shape, others)]
    for level in reversed(levels[:-1]):
        here = []
        for at, _ in enumerate(level):
            first = at - at % FAN
            run = level[first : first + FAN]
            inside = bytes((at - first, len(run) - 1 - (at - first)))
            siblings = b"".join(run[: at - first]) + b"".join(run[at - first + 1 :])
            outer_shape, outer = above[at // FAN]
            here.append((inside + outer_shape, siblings + outer))
        above = here
    return above


def fold(node: bytes, shape: bytes, others: bytes) -> bytes:
    """The root that a node and its siblings lead to."""
    at = 0
    for before, after in zip(shape[::2], shape[1::2]):
        middle, end = at + before * _DIGITS, at + (before + after) * _DIGITS
        node = hashed(others[at:middle] + node + others[middle:end])
        at = end
    return node


def _levels(rows: pd.DataFrame, height: int) -> tuple[pd.DataFrame, list[list[bytes]]]:
    rows = rows.sort_values("at", kind="stable")
    return rows, climb([bytes(node).hex().encode() for node in rows["node"]], steps_of(int(rows["n"].iloc[0]), height))


def _given(outer: pd.DataFrame) -> tuple[bytes, ...]:
    return tuple(None if (value := outer[name].iloc[0]) is None else bytes(value) for name in ("shape", "others", "subroot", "root"))


class Superblocks:
    """The work on superblocks of ``height`` levels: up, one node each; down, what their nodes need of the others."""

    def __init__(self, height: int = HEIGHT):
        self.height, self.size = height, FAN**height

    def grouped(self, nodes: DataFrame):
        return nodes.withColumn("block", F.floor(F.col("at") / self.size)).groupBy("tree", "block")

    def beside(self, nodes: DataFrame, outer: DataFrame):
        """Superblocks cogrouped with the outer nodes of each."""
        given = outer.select("tree", F.col("at").alias("block"), "shape", "others", "subroot", "root")
        return self.grouped(nodes).cogroup(given.groupBy("tree", "block"))

    def layers(self, lowest: DataFrame, largest: int) -> list[DataFrame]:
        """The layers of all trees, of ``largest`` nodes at most, the last of them the trees' roots."""
        height, size = self.height, self.size

        def shrink(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows, levels = _levels(rows, height)
            ((top,),) = levels[-1:]
            n = -(-int(rows["n"].iloc[0]) // size)
            return pd.DataFrame({"tree": [int(key[0])], "at": [int(key[1])], "n": [n], "node": [bytes.fromhex(top.decode())]})

        found, n = [lowest], largest
        while len(found) == 1 or n > 1:
            found.append(cut_lineage(self.grouped(found[-1]).applyInPandas(shrink, NODES)))
            n = -(-n // size)
        return found

    def descend(self, nodes: DataFrame, outer: DataFrame) -> DataFrame:
        """Each node with its proof, as the outer nodes of the superblock below it."""
        height = self.height

        def join(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
            rows, levels = _levels(rows, height)
            shape, others, subroot, root = _given(outer)
            shapes, siblings = zip(*proofs(levels, shape, others))
            named = {name: rows[name].tolist() for name in ("tree", "at", "node")}
            return pd.DataFrame({**named, "shape": shapes, "others": siblings, "subroot": [subroot] * len(rows), "root": [root] * len(rows)})

        return cut_lineage(self.beside(nodes, outer).applyInPandas(join, OUTER))

    def settle(self, leaves: DataFrame, outer: DataFrame) -> DataFrame:
        """Each leaf with the hash of its proof, and the root that its claim folds to."""
        height = self.height

        def check(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
            rows, levels = _levels(rows, height)
            shape, others, subroot, root = _given(outer)
            out = []
            for doc_id, claim, leaf, (places, siblings) in zip(rows["doc_id"], rows["claim"], levels[0], proofs(levels, shape, others)):
                folded = fold(leaf if claim is None else bytes(claim).hex().encode(), places, siblings)
                out.append((doc_id, leaf.decode(), subroot.hex(), root.hex(), hashed(siblings).decode(), folded.decode(), folded.decode() == root.hex()))
            return pd.DataFrame(out, columns=[part.split()[0] for part in PROVED.split(", ")])

        return self.beside(leaves, outer).applyInPandas(check, PROVED)


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    presented: Mapping[str, Column] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    height: int = HEIGHT,
) -> DataFrame:
    """One row per row of ``docs``: its leaf, subroot and root, the hash of its proof, the root that the presented row
    folds to with this proof, and whether that is the root.

    ``presented`` has, for some of the ``fields``, the value to be checked in place of the stored one. Leaves of a source
    are in order of id, null ids first; rows of one id are in order of their leaves, and equal rows are leaves of their
    own, one after another. A null source is a source, before all others; an empty text is a value of no bytes, and a
    null one is not. Texts may be of any length, as only their hashes leave the first step. A single row is leaf, subroot
    and root at once, with a proof of nothing. Other columns, whatever their names, are not read. An empty table gives an
    empty table.
    """
    blocks = Superblocks(height)
    own = leaf_hash([F.col(name) for name in fields])
    claim = F.lit(None).cast("binary")
    if presented:
        claim = F.unhex(leaf_hash([presented.get(name, F.col(name)) for name in fields]))
    hashes = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.unhex(own).alias("node"), claim.alias("claim")
    )
    # Only a claim that differs is carried on. The tie tells equal rows apart, and is written with them.
    differs = F.when(F.col("claim") != F.col("node"), F.col("claim"))
    stored = cut_lineage(hashes.withColumn("claim", differs).withColumn("tie", F.monotonically_increasing_id()))
    sources = cut_lineage(number_within(stored.groupBy("source").agg(F.count(F.lit(1)).alias("n")), [], ["source"], "place"))
    size = sources.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("largest")).first()
    named = sources.select(F.col("source").alias("of"), (F.col("place") - 1).cast("long").alias("tree"), "n")
    treed = stored.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("source", "of")
    placed = number_within(treed, ["tree"], ["doc_id", "node", "tie"], "place")
    leaves = cut_lineage(placed.select(F.col("doc_id").cast("string").alias("doc_id"), "tree", (F.col("place") - 1).cast("long").alias("at"), "n", "node", "claim"))

    *inner, subroots = blocks.layers(leaves, size["largest"] or 0)
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(size["sources"]).cast("long").alias("n"), "node")
    *upper, root = blocks.layers(tops, size["sources"])

    nothing = F.lit(b"")
    outer = root.select("tree", "at", nothing.alias("shape"), nothing.alias("others"), F.lit(None).cast("binary").alias("subroot"), F.col("node").alias("root"))
    for layer in reversed(upper):
        outer = blocks.descend(layer, outer)
    # From the tree of sources to the trees of their rows.
    outer = outer.withColumns({"tree": F.col("at"), "at": F.lit(0).cast("long"), "subroot": F.col("node")})
    for layer in reversed(inner[1:]):
        outer = blocks.descend(layer, outer)
    return blocks.settle(inner[0], outer).withColumn("doc_id", F.col("doc_id").cast("long"))


def lowered_where_divisible(id_col: str = "doc_id", text_col: str = "text", by: int = 5) -> Column:
    """The text with A-Z in lower case where ``by`` divides the CRC-32 of the id as text, else the text as it is."""
    upper = "".join(map(chr, range(65, 91)))
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % by == 0
    return F.when(chosen, F.translate(F.col(text_col), upper, upper.lower())).otherwise(F.col(text_col))
