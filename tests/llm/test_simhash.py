"""SimHash fingerprints and links against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from stowage.llm import simhash as S
from stowage.llm.components import connected_components
from stowage.llm.queries import QUERIES

from .conftest import EDGE_TEXTS, SF_DIR


def fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, max_bits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= max_bits) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_documents(spark, texts):
    ids = sorted(texts)
    prints = [fingerprint(texts[i]) for i in ids]
    group = dict(zip(ids, components(prints, 4)))
    found = QUERIES["op10_simhash"](spark, SF_DIR).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == [
        (i, f"{p:016x}", ids[group[i]]) for i, p in zip(ids, prints)
    ]


def test_edge_cases(edge, none):
    found = [tuple(r) for r in S.near_duplicates(edge).collect()]
    prints = [fingerprint(t or "") for _, t in EDGE_TEXTS]
    group = components(prints, 4)
    lowest = [min((EDGE_TEXTS[j][0] for j in range(len(prints)) if group[j] == g and EDGE_TEXTS[j][0] is not None), default=None) for g in group]
    want = [(i, f"{p:016x}", low) for (i, _), p, low in zip(EDGE_TEXTS, prints, lowest)]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert S.near_duplicates(none).collect() == []


@pytest.mark.parametrize("max_bits", [0, 2, 4, 6])
def test_trie_finds_what_all_pairs_connect(spark, max_bits):
    random = np.random.default_rng(max_bits)
    bases = random.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in random.choice(64, random.integers(0, 9), replace=False)) for _ in range(600)], dtype=np.uint64)
    values = np.unique(bases[random.integers(0, 40, 600)] ^ flips)
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "bits long")
    found = {r["node"]: r["component"] for r in connected_components(S.links(table, max_bits)).collect()}
    want = components(values.tolist(), max_bits)
    signed = values.view(np.int64).tolist()
    got = [found.get(v, v) for v in signed]
    pairs = lambda groups: {tuple(np.flatnonzero([h == g for h in groups])) for g in groups}
    assert pairs(got) == pairs(want)


def test_one_of_each_group_stays(spark, edge, none):
    kept = S.keep_one(edge, 4, 4)
    assert kept.columns == edge.columns
    # Texts without words are one group; the row without an id is alone.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "5", "6", "8", "9", "None"]
    assert S.keep_one(none, 4, 4).collect() == []


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    ring = [(i, 900 + (i + 1 - 900) % 30) for i in range(900, 930)]
    links = spark.createDataFrame([*chain, *star, *ring, (7, 7), (3, 2), (2, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {i: 900 for i in range(900, 930)} | {2: 2, 3: 2}
    assert found == want
