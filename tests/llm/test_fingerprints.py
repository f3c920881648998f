"""MinHash fingerprints: exact edits, and estimates against true similarity."""

import hashlib
from statistics import mean

from stowage.llm.fingerprints import compare_edited
from stowage.llm.queries import QUERIES

from .conftest import EDGE_TEXTS, SF_DIR


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_documents(spark, texts):
    order = sorted(texts, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]]))
    rows = {r["doc_id"]: r for r in QUERIES["op6_fingerprints"](spark, SF_DIR).collect()}
    assert sorted(rows) == sorted(texts)
    misses = []
    for doc_id, row in rows.items():
        text, other = texts[doc_id], texts[after[doc_id]]
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        misses.append(row["near_edited"] - jaccard(text, edited))
        assert abs(row["near_next"] - jaccard(text, other)) < 0.2
    assert abs(mean(misses)) < 0.02 and mean(map(abs, misses)) < 0.06 and max(map(abs, misses)) < 0.25
    assert len({rows[i]["fingerprint"] for i in rows}) == len(set(texts.values()))
    by_text = {}
    for doc_id, text in texts.items():
        assert by_text.setdefault(text, rows[doc_id]["fingerprint"]) == rows[doc_id]["fingerprint"]


def test_no_python_on_the_path(spark, documents):
    plan = compare_edited(spark, documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "BroadcastNestedLoop", "Cartesian"))


def test_edge_cases(spark, edge, none):
    rows = compare_edited(spark, edge).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in EDGE_TEXTS)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["fingerprint"] == by_id[3]["fingerprint"] == by_id[4]["fingerprint"] == ""
    # The next of 3 is 2, both without words; that of 4 is 3.
    assert by_id[3]["near_next"] == 1.0 and by_id[3]["n_chars"] == 0 and by_id[8]["near_next"] == 0.0
    assert by_id[1]["fingerprint"] == by_id[7]["fingerprint"]
    assert compare_edited(spark, none).collect() == []
    (alone,) = compare_edited(spark, edge.where("doc_id = 7")).collect()
    assert alone["near_next"] == 1.0


def test_ranges_with_one_id_in_many_rows(spark):
    rows = [(5, f"text number {i} of five") for i in range(40)] + [(i, f"other text {i}") for i in range(100, 140)]
    found = compare_edited(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 80
