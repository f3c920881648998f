"""The manifest against a plain reduction of each source, and proofs against roots."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from stowage.llm import merkle as M

FIELDS = M.FIELDS


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, **changed):
    values = [changed.get(name, row[name]) for name in FIELDS]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def reduced(nodes):
    """The root of some nodes, and each node's siblings by level with its place among them."""
    paths, place, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for path, at in zip(paths, place):
            first = at // 16 * 16
            run = level[first : first + 16]
            path.append((run[: at - first], run[at - first + 1 :]))
        level = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        place = [at // 16 for at in place]
    return level[0], paths


def plain(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row["source"], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        ordered = sorted(sources[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append((ordered, *reduced([leaf(r) for r in ordered])))
    root, outer = reduced([subroot for _, subroot, _ in trees])
    out = []
    for (ordered, subroot, paths), above in zip(trees, outer):
        for row, path in zip(ordered, paths):
            tampered = row["doc_id"] is not None and crc32(str(row["doc_id"]).encode()) % 5 == 0
            node = leaf(row, text=lowered(row["text"])) if tampered else leaf(row)
            for before, after in path + above:
                node = h("".join(before) + node + "".join(after))
            siblings = "".join("".join(before) + "".join(after) for before, after in path + above)
            out.append((row["doc_id"], leaf(row), subroot, root, h(siblings), node, node == root))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in M.manifest(docs, presented={"text": M.lowered_where_divisible()}).collect()), key=str)


def test_documents(documents):
    assert found(documents) == plain([r.asDict() for r in documents.collect()])


def test_edge_cases(edge, none):
    assert found(edge) == plain([r.asDict() for r in edge.collect()])
    out = M.manifest(none)
    assert out.collect() == [] and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_single_row(edge):
    ((row),) = found(edge.where("doc_id = 9"))
    assert row[1] == row[2] == row[3] and row[4] == h("")


# One node over and under a superblock, one node alone in its last run, and sources over a superblock of their own.
@pytest.mark.parametrize("sizes", [[4095, 4096, 4097, 1, 16, 17], [9000, 300], [1] * 40])
def test_many_superblocks(spark, sizes):
    rows = [(f"s{s:02}" if s else None, i * len(sizes) + s, f"Text {i}") for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(6).cast("long").alias("n_chars")
    )
    assert found(docs.repartition(5)) == plain([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("height", [1, 2])
def test_small_superblocks_nest(spark, height):
    """Four layers of small superblocks and three of sources give what two large ones give."""
    rows = [(i, f"s{i % 3 if i < 2000 else i}", f"T{i}") for i in range(2300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.lit(2)})
    got = M.manifest(docs, presented={"text": M.lowered_where_divisible()}, height=height).collect()
    assert sorted(map(tuple, got), key=str) == plain([r.asDict() for r in docs.collect()])


def test_steps():
    assert [M.steps_of(n) for n in (0, 1, 2, 16, 17, 256, 257, 4096, 4097, 10**9)] == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3]


def test_presented_rows_are_told_apart(spark, documents):
    changed = documents.orderBy("doc_id").limit(30).withColumn("said", F.when(F.col("doc_id") % 2 == 0, F.lit("other")).otherwise(F.col("lang")))
    out = {r["doc_id"]: r["verified"] for r in M.manifest(changed, presented={"lang": F.col("said")}).collect()}
    assert out == {i: i % 2 == 1 for i in out}
