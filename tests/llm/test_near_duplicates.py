"""The near-duplicate stage against the Jaccard similarity of all pairs."""

import re

import corpus_pipeline as C
import numpy as np

from stowage.llm import shingle_join as J, simhash as S

from .conftest import SF_DIR


def shingle_set(text, k=C.WORDS):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def groups(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            two = sets[j]
            if 5 * min(len(one), len(two)) >= 4 * max(len(one), len(two)) and 5 * len(one & two) >= 4 * len(one | two):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(random, n, word):
    return " ".join(np.where(np.arange(n) == n // 2, word, random))


def test_planted_edits_and_templates(spark):
    random, texts = np.random.default_rng(3), []
    # One word replaced in the middle: similarities of 0.80 to 0.95.
    for n in (50, 100, 200):
        for base in range(40):
            words = np.array([f"w{x}" for x in random.integers(0, 5000, n)])
            texts += [" ".join(words), edited(words, n, f"new{base}")]
    # Pages of one template, at similarities below and about 0.8.
    words = np.array([f"t{x}" for x in random.integers(0, 5000, 300)])
    for page in range(150):
        own = words.copy()
        length = int(random.integers(20, 70))
        own[100 : 100 + length] = [f"p{page}x{i}" for i in range(length)]
        texts.append(" ".join(own))
    # Near copies of one text, a chain of edits, and equal sets.
    words = np.array([f"c{x}" for x in random.integers(0, 5000, 120)])
    for copy in range(150):
        own = words.copy()
        own[random.integers(0, 120, 2)] = f"edit{copy}"
        texts.append(" ".join(own))
    for step in range(30):
        words[4 * step] = f"step{step}"
        texts.append(" ".join(words))
    texts += [texts[0].upper(), "", " \n", "a b", "A  b"]
    ids = random.permutation(len(texts)).tolist()
    rows = sorted((i, text, "en", "s", len(text)) for i, text in zip(ids, texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    found = groups([shingle_set(r[1]) for r in rows])
    kept = sorted(r["doc_id"] for r in C.drop_near_duplicates(spark, docs, SF_DIR).collect())
    assert kept == [r[0] for at, r in enumerate(rows) if found[at] == at]


def test_near_fingerprints_alone_drop_nothing(spark):
    random = np.random.default_rng(5)
    rows = [(i, " ".join(f"u{x}" for x in random.integers(0, 5000, 60))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Unrelated fingerprints differ in about 32 bits, so the trie links all of these.
    assert sorted(r["doc_id"] for r in S.keep_one(docs, C.WORDS, 48).collect()) == list(range(12))


def test_sketches_never_lose_a_similar_pair():
    """The bound holds for all pairs, and few pairs that are not similar pass it."""
    random, passed, far = np.random.default_rng(7), 0, 0
    for n in (1, 2, 5, 9, 40, 130, 700):
        for _ in range(60):
            whole = random.integers(0, 1 << 63, 2 * n + 40, dtype=np.uint64)
            one = np.unique(whole[:n])
            two = np.unique(np.concatenate([one[int(random.integers(0, n // 3 + 1)) :], whole[n : n + int(random.integers(0, n // 4 + 2))]]))
            if not len(two):
                continue
            least = J._differing(J.sketch(one), J.sketch(two))
            apart = len(np.setxor1d(one, two))
            may = bool(J.possible(np.array([len(one)]), np.array([len(two)]), np.array([least]))[0])
            assert least <= apart and (may or not J.similar(one, two))
            assert bool(J.possible(np.array([len(one)]), np.array([len(two)]), np.array([apart]))[0]) == J.similar(one, two)
            other = np.unique(whole[n : 2 * n])
            far += 1
            passed += bool(J.possible(np.array([n]), np.array([len(other)]), np.array([J._differing(J.sketch(one), J.sketch(other))]))[0])
    assert passed < far / 4


def test_shared_shingles_over_batches(spark):
    """Groups that go over the ends of Arrow batches, and such as are met once."""
    random = np.random.default_rng(8)
    lists = [sorted(set(random.integers(0, 60, int(random.integers(0, 9))).tolist())) for _ in range(100)] + [[1000 + i] for i in range(50)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for row, found in enumerate(lists):
        for shingle in found:
            want.setdefault(shingle, []).append(row)
    expected = sorted((shingle, row, min(rows)) for shingle, rows in want.items() if len(rows) > 1 for row in rows)
    for size in (1, 2, 3, 7, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        prefixes = spark.createDataFrame(list(enumerate(lists)), "row long, prefix array<long>").repartition(3)
        assert sorted(map(tuple, J.shared_shingles(prefixes).collect())) == expected
    for hot in ([3, 4, 1001], list(range(60))):
        assert sorted(map(tuple, J.shared_shingles(prefixes, np.array(hot, dtype=np.uint64)).collect())) == expected
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_crossing_pairs_by_blocks(monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 5)
    random = np.random.default_rng(9)
    sets = [np.unique(random.integers(0, 1 << 63, int(random.integers(3, 400)), dtype=np.uint64)) for _ in range(20)]
    sets += [np.unique(np.concatenate([s[1:], random.integers(0, 1 << 63, 1, dtype=np.uint64)])) for s in sets]
    component = np.arange(40) % 7
    side = lambda at: (at, component[at], np.array([len(sets[i]) for i in at]), [J.sketch(sets[i]) for i in at])
    pairs = lambda *sides: {tuple(sorted(p)) for a, b in J._crossing(*sides) for p in zip(a.tolist(), b.tolist())}
    found = pairs(side(np.arange(40)))
    one, two = np.arange(0, 40, 3), np.array([i for i in range(40) if i % 3])
    assert pairs(side(one)) | pairs(side(two)) | pairs(side(one), side(two)) == found
    wanted = {(i, j) for j in range(40) for i in range(j) if component[i] != component[j] and J.similar(sets[i], sets[j])}
    assert wanted <= found and all(component[i] != component[j] for i, j in found) and len(wanted) > 5


def test_crossing_pairs_of_large_groups_are_cut(spark, monkeypatch):
    """Chunks of three rows give the pairs that one chunk gives."""
    random = np.random.default_rng(10)
    base = random.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[int(random.integers(0, 8)) :], random.integers(0, 1 << 63, int(random.integers(0, 6)), dtype=np.uint64)])) for _ in range(30)]
    rows = [(shingle, row, 0 if row < 17 else row % 5) for shingle in range(3) for row in range(30) if (row + shingle) % 4]
    labelled = spark.createDataFrame(rows, "shingle long, row long, component long")
    sketches = spark.createDataFrame([(i, len(s), bytearray(J.sketch(s))) for i, s in enumerate(sets)], "row long, n long, sketch binary")
    whole = sorted(map(tuple, J.crossing_pairs(labelled, sketches).collect()))
    component = {row: c for _, row, c in rows}
    together = {(min(a, b), max(a, b)) for s in range(3) for _, a, _ in [r for r in rows if r[0] == s] for _, b, _ in [r for r in rows if r[0] == s]}
    similar = {(a, b) for a, b in together if a < b and component[a] != component[b] and J.similar(sets[a], sets[b])}
    assert similar <= set(whole) and all(component[a] != component[b] and a < b for a, b in whole) and similar
    # As many as connect what all connect, and not more than that of each piece of work.
    few = sorted(map(tuple, J.crossing_pairs(labelled, sketches, spanning=True).collect()))
    assert set(few) <= set(whole) and joined(few, component) == joined(whole, component) and len(few) < len(whole)
    monkeypatch.setattr(J, "CHUNK_ROWS", 3)
    assert sorted(map(tuple, J.crossing_pairs(labelled, sketches).collect())) == whole
    assert joined(map(tuple, J.crossing_pairs(labelled, sketches, spanning=True).collect()), component) == joined(whole, component)


def joined(pairs, component):
    """The components that pairs connect."""
    root = {c: c for c in component.values()}
    for a, b in pairs:
        one, two = root[component[a]], root[component[b]]
        root = {c: min(one, two) if r in (one, two) else r for c, r in root.items()}
    return root


def test_groups_of_the_same_rows_are_compared_once(spark):
    """Rows that share many shingles are many groups; one of them gives all pairs, and no sketch moves for the others."""
    rows = [(shingle, row, row // 3) for shingle in range(40) for row in range(6)] + [(99, row, row // 3) for row in (1, 4, 7)] + [(98, 0, 0), (98, 1, 0)]
    labelled = spark.createDataFrame(rows, "shingle long, row long, component long")
    kept = {(r.shingle, r.main, r.others) for r in J.mixed_groups(labelled).collect()}
    assert kept == {(0, None, 1), (99, None, 1)}
    same = np.arange(50, dtype=np.uint64)
    sketches = spark.createDataFrame([(row, 50, bytearray(J.sketch(same))) for row in range(8)], "row long, n long, sketch binary")
    pairs = {tuple(p) for p in J.crossing_pairs(labelled, sketches).collect()}
    assert pairs == {(a, b) for a in range(3) for b in range(3, 6)} | {(1, 7), (4, 7)}


def test_largest_components_are_a_side_of_their_own(spark, monkeypatch):
    """Groups of more than a block, cut into chunks inside and outside of their largest component, give the pairs of whole ones."""
    same = J.sketch(np.arange(50, dtype=np.uint64))
    labelled = spark.createDataFrame([(s, row, 0 if row < 20 else row) for s in (1, 2) for row in range(26)], "shingle long, row long, component long")
    sketches = spark.createDataFrame([(row, 50, bytearray(same)) for row in range(26)], "row long, n long, sketch binary")
    want = {(a, b) for b in range(20, 26) for a in range(b)}
    assert {tuple(p) for p in J.crossing_pairs(labelled, sketches).collect()} == want
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "CHUNK_ROWS", 3)
    assert [(r.main, r.others, r.mains) for r in J.mixed_groups(labelled).collect()] == [(0, 2, 7)]
    assert {tuple(p) for p in J.crossing_pairs(labelled, sketches).collect()} == want


def test_rows_without_a_possible_pair_get_no_long_sketch(spark):
    random = np.random.default_rng(5)
    sets = [np.unique(random.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(40)]
    # Two near copies, which are in components of their own.
    sets.append(np.unique(np.concatenate([sets[0][:-10], random.integers(0, 2**63, 10, dtype=np.uint64)])))
    rows = [(at, len(one), J.sketch(one)) for at, one in enumerate(sets)]
    sketches = spark.createDataFrame(rows, "row long, n long, sketch binary")
    labelled = spark.createDataFrame([(7, at, at) for at in range(len(sets))], "shingle long, row long, component long")
    short = J.short_sketches(sketches)
    assert max(len(row["sketch"]) for row in short.collect()) * J.SKETCH_BITS == max(len(sketch) for _, _, sketch in rows)
    members = J.promising(labelled, short)
    assert sorted(row["row"] for row in members.collect()) == [0, 40]
    for spanning in (False, True):
        found = J.crossing_pairs(labelled.join(members, ["shingle", "row"]), sketches, spanning).collect()
        assert [tuple(row) for row in found] == [tuple(row) for row in J.crossing_pairs(labelled, sketches, spanning).collect()] == [(0, 40)]


def test_ends_name_every_row_of_a_pair():
    random = np.random.default_rng(6)
    base = random.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[random.permutation(200)[:keep]], random.integers(0, 2**63, 200 - keep, dtype=np.uint64)])) for keep in random.integers(100, 200, 1500)]
    side = lambda at: (at, at % 400, np.array([len(sets[k]) for k in at]), [J.sketch(sets[k]) for k in at])
    one, two = side(np.arange(0, 1500, 2)), side(np.arange(1, 1500, 2))
    for other in (None, two):
        rows = [{int(x) for pair in J._crossing(one, other, ends=ends) for part in pair for x in part} for ends in (False, True)]
        assert rows[0] == rows[1] and 0 < len(rows[0]) < 1500


def test_common_shingles_are_counted_in_tasks(spark, monkeypatch):
    # The driver takes no text apart.
    monkeypatch.setattr(J, "Counter", None, raising=False)
    docs = spark.createDataFrame([(f"a b c d e f {at % 3}",) for at in range(9)] + [(None,), ("",)], "text string")
    known, met = J.common_shingles(docs, 3)
    counts = {}
    for at in range(9):
        for h in np.unique(J.shingles(f"a b c d e f {at % 3}", 3)).tolist():
            counts[h] = counts.get(h, 0) + 1
    assert known.tolist() == sorted(counts) and met.tolist() == [counts[h] for h in sorted(counts)]
    assert [len(part) for part in J.common_shingles(docs.limit(0), 3)] == [0, 0]
