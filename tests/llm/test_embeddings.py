"""Embedding links against all pairs."""

import numpy as np

from stowage.llm.embedding_dedup import near_duplicates


def brute(ids, vectors, threshold=0.9):
    usable = [i for i, v in enumerate(vectors) if ids[i] is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i in range(len(ids))}
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in usable:
        for b in usable:
            if a < b:
                x, y = np.array(vectors[a], dtype=float), np.array(vectors[b], dtype=float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    ra, rb = find(a), find(b)
                    parent[max(ra, rb)] = min(ra, rb)
    lowest = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            lowest[find(i)] = min(lowest.get(find(i), ids[i]), ids[i])
    return [(ids[i], links[i], c := lowest.get(find(i)), c is not None and c == ids[i]) for i in range(len(ids))]


def make(n_clusters, per, noise, seed, dim=16):
    random = np.random.default_rng(seed)
    rows = []
    for _ in range(n_clusters):
        centre = random.normal(size=dim)
        rows += [(centre + noise * random.normal(size=dim)).astype(np.float32).tolist() for _ in range(per)]
    rows += [random.normal(size=dim).astype(np.float32).tolist() for _ in range(200)]
    return rows


def test_links_and_components(spark):
    vectors = make(12, 25, 0.05, 1) + make(4, 10, 0.15, 2)
    vectors += [vectors[0]] * 7 + [[2 * x for x in vectors[1]]]
    ids = list(range(1000, 1000 + len(vectors)))
    table = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, label int").repartition(4)
    # Small cells and blocks, so that pairs meet across cells and blocks.
    found = near_duplicates(spark, table, cell_rows=60, block_rows=16)
    assert sorted(map(tuple, found.collect())) == sorted(brute(ids, vectors))


def test_recall_of_pairs_near_the_threshold(spark):
    random = np.random.default_rng(5)
    rows = []
    for at in range(0, 1600, 2):
        a = random.normal(size=64)
        a /= np.linalg.norm(a)
        b = random.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        cosine = random.uniform(0.905, 0.93)
        rows += [(at, a.tolist()), (at + 1, (cosine * a + np.sqrt(1 - cosine**2) * b).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = near_duplicates(spark, table, cell_rows=32).collect()
    assert sum(r["n_links"] for r in found) >= 0.95 * len(rows)


def test_vectors_of_several_lengths(spark):
    vectors = make(5, 12, 0.05, 3, 8) + make(4, 10, 0.05, 4, 12) + make(1, 3, 0.05, 5, 5)[:3]
    random = np.random.default_rng(6)
    vectors = [vectors[i] for i in random.permutation(len(vectors))]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(3)
    found = near_duplicates(spark, table, cell_rows=40, block_rows=16)
    assert sorted(map(tuple, found.collect())) == sorted(alike(vectors))


def alike(vectors):
    """``brute`` for each length by itself."""
    out = []
    for width in {len(v) for v in vectors}:
        ids = [i for i, v in enumerate(vectors) if len(v) == width]
        out += brute(ids, [vectors[i] for i in ids])
    return out


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
        (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0]), (10, []), (11, [1.0, -0.0]),
    ]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, node long, copies long")
    found = sorted(map(str, map(tuple, near_duplicates(spark, table).collect())))
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (11, 3, 1, False)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)] + [(None, 0, None, False)]
    assert found == sorted(map(str, want))
    assert near_duplicates(spark, table.where("false")).collect() == []
