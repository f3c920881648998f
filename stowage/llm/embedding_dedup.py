"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside them, one kept row per group.

Cells are fitted on a bounded sample; every vector is then indexed. A vector is put into every cell whose centroid is
almost as near as the nearest one, so that near pairs on the border of two cells still meet; a pair that meets in several
cells counts in the first of them. A cell above the block size is cut into blocks and each pair of blocks is an item of
its own, so no task takes a whole cell. Equal vectors are one element with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.llm.common import cut_lineage, hashed_share
from stowage.llm.components import connected_components, merge

# Vectors that the cells are fitted on, taken by the order of a hash. 16 MB at 64 dimensions.
SAMPLE = 32_768
# Vectors a cell is meant to hold, and the most cells: their centroids are broadcast, 4 MB at 64 dimensions.
CELL_ROWS = 256
MOST_CELLS = 8_192
ITERATIONS = 8
# How much less near than the nearest a centroid may be for its cell to take the vector too.
MARGIN = 0.08
BLOCK_ROWS = 2_048


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_cells(sample: np.ndarray, cells: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Unit centroids by spherical k-means; starts from evenly spaced rows, and a cell left empty keeps its centroid."""
    points = unit(sample)
    centroids = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(np.int64)]
    for _ in range(iterations):
        home = np.concatenate([(points[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(points), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def assign(vectors: DataFrame, centroids: dict[int, tuple[int, np.ndarray]], margin: float) -> DataFrame:
    """A row per vector and cell that takes it; ``cells`` has all the vector's cells, ascending.

    ``centroids`` has, by length of a vector, the number of the first cell and the cells' centroids.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def alike(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Parts of vectors of one length."""
        lengths = pc.list_value_length(batch["vector"])
        for width in pc.unique(lengths):
            same = batch.filter(pc.equal(lengths, width))
            yield from (same.slice(start, 2048) for start in range(0, same.num_rows, 2048))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in alike(batch):
                width = len(part["vector"][0])
                first, middles = shared.value[width]
                points = unit(part["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                near = points @ middles.T
                rows, cells = np.nonzero(near >= near.max(axis=1, keepdims=True) - margin)
                cells = cells + first
                ends = np.cumsum(np.bincount(rows, minlength=len(points)))
                of_row = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(cells, pa.int32()))
                raw = pa.array([one.tobytes() for one in points], pa.binary())
                taken = pa.array(rows)
                columns = [part["node"].take(taken), part["copies"].take(taken), raw.take(taken), of_row.take(taken)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.int32()), *columns], ["cell", "node", "copies", "unit", "cells"]
                )

    return vectors.mapInArrow(place, "cell int, node long, copies long, unit binary, cells array<int>")


def _first_in(cell: int, cells: np.ndarray, i: np.ndarray, others: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pair's vectors share no cell before ``cell``. Cells are padded with -1 and -2."""
    first = np.ones(len(i), dtype=bool)
    for a in range(cells.shape[1]):
        mine = cells[i, a]
        earlier = (mine >= 0) & (mine < cell)
        for b in range(others.shape[1]):
            first &= ~(earlier & (mine == others[j, b]))
    return first


def compare(items: DataFrame, threshold: float) -> DataFrame:
    """Links found in each (cell, one, other): (a, null, copies linked to a) and (a, b, null) to connect what is linked."""

    def padded(rows: list, fill: int) -> np.ndarray:
        out = np.full((len(rows), max(map(len, rows))), fill, dtype=np.int32)
        for at, row in enumerate(rows):
            out[at, : len(row)] = row
        return out

    def item(key: tuple, rows: list[tuple]) -> pa.RecordBatch | None:
        cell, one, other = key
        block = np.array([r[0] for r in rows])
        node = np.array([r[1] for r in rows], dtype=np.int64)
        copies = np.array([r[2] for r in rows], dtype=np.int64)
        # The vectors of a cell have one length.
        points = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.float64).reshape(len(rows), -1)
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == other)
        linked = np.zeros(len(rows), dtype=np.int64)
        label = np.arange(len(rows))
        edges_a, edges_b = [], []
        mine, others = padded([r[4] for r in rows], -1), padded([r[4] for r in rows], -2)
        for start in range(0, len(left), 512):
            some = left[start : start + 512]
            i, j = np.nonzero(points[some] @ points[right].T >= threshold)
            i, j = some[i], right[j]
            if one == other:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            # Two cells may both find a pair; only the first that they share counts it.
            kept = _first_in(cell, mine, i, others, j)
            i, j = i[kept], j[kept]
            linked += np.bincount(i, weights=copies[j], minlength=len(rows)).astype(np.int64)
            linked += np.bincount(j, weights=copies[i], minlength=len(rows)).astype(np.int64)
            used, label = merge(label, i, j)
            edges_a.append(i[used])
            edges_b.append(j[used])
        (seen,) = np.nonzero(linked)
        if not len(seen):
            return None
        a, b = np.concatenate(edges_a), np.concatenate(edges_b)
        columns = [
            pa.array(np.concatenate([node[seen], node[a]])),
            pa.concat_arrays([pa.nulls(len(seen), pa.int64()), pa.array(node[b])]),
            pa.concat_arrays([pa.array(linked[seen]), pa.nulls(len(a), pa.int64())]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for cell, one, other, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if (cell, one, other) != key:
                    if rows and (found := item(key, rows)) is not None:
                        yield found
                    key, rows = (cell, one, other), []
                rows.append(row)
        if rows and (found := item(key, rows)) is not None:
            yield found

    order = ["cell", "one", "other"]
    dealt = items.select(*order, "block", "node", "copies", "unit", "cells").repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "a long, b long, linked long")


def near_duplicates(
    spark: SparkSession,
    embeddings: DataFrame,
    threshold: float = 0.9,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    margin: float = MARGIN,
) -> DataFrame:
    """One row per vector: vectors linked to it, the smallest id that links lead to, and whether it is that one.

    Vectors that are null, zero, or hold a null or a non-finite component link with nothing, nor does a row with a null id,
    whose component is null and which is not kept. Vectors of different lengths have no cosine and do not link; each length
    has cells of its own, fitted one length after another, so lengths should be few. Rows with equal vectors are linked.
    Rows that share an id are one node for components. A vector as near to two centroids is in both cells, and a pair
    counts in the first cell that it shares. Other columns, whatever their names, are not read. An empty table gives an
    empty table.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    distinct = cut_lineage(usable.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    # A row per length.
    lengths = distinct.groupBy(F.size("vector").alias("width")).count().orderBy("width").collect()
    if not lengths:
        alone = F.lit(0).cast("long").alias("n_links")
        return rows.select("vec_id", alone, F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    centroids, first = {}, 0
    for width, n_distinct in lengths:
        cells = min(MOST_CELLS, max(1, -(-n_distinct // cell_rows)))
        some = distinct.where((F.size("vector") == width) & hashed_share(F.col("node"), 2 * SAMPLE, n_distinct))
        sample = some.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
        centroids[width] = first, fit_cells(sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), cells)
        first += len(centroids[width][1])
    placed = cut_lineage(assign(distinct, centroids, margin))

    # A row per cell, of which there are at most MOST_CELLS for a length.
    cuts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("cuts"))
    block = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    blocked = placed.join(F.broadcast(cuts), "cell").withColumn("block", block)
    paired = blocked.withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    items = paired.withColumn("one", F.least("block", "beside")).withColumn("other", F.greatest("block", "beside"))
    found = cut_lineage(compare(items, threshold))

    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    groups = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    known = distinct.select("vector", "node", "copies").join(counts, "node", "left").join(groups, "node", "left")
    links = (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links")
    known = cut_lineage(known.select("vector", links, F.coalesce("component", "node").alias("component")))
    # The key is null, and so meets nothing, where a vector links with nothing.
    key = F.when(F.col("vec_id").isNotNull() & finite, F.col("vector"))
    joined = rows.withColumn("vector", key).join(known, "vector", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
