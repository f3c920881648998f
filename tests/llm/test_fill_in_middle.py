"""The transformation against regular expressions over code points, its index against counting, and exact round trips."""

import re
from hashlib import sha256

import numpy as np
from hypothesis import given, strategies as st

from stowage.llm import fill_in_middle as X

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, units=None):
    text = text or ""
    found = UNITS.findall(text) if units is None else units
    n = len(found)
    digits = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def key(row):
    return str(row)


def test_documents(documents):
    rows = documents.collect()
    assert sorted(map(tuple, X.transform(documents).collect()), key=key) == sorted((plain(r["doc_id"], r["text"]) for r in rows), key=key)
    restored = {r["doc_id"]: (r["form"], r["restored"]) for r in X.restore(X.transform(documents)).collect()}
    assert {i: text for i, (_, text) in restored.items()} == {r["doc_id"]: r["text"] for r in rows}
    assert {form for form, _ in restored.values()} == {"plain", "spm", "psm"}


def test_code_points_as_units(documents):
    want = sorted((plain(r["doc_id"], r["text"], list(r["text"])) for r in documents.collect()), key=key)
    assert sorted(map(tuple, X.transform(documents, unit="char").collect()), key=key) == want


def test_edge_cases(edge, none):
    rows = edge.collect()
    assert sorted(map(tuple, X.transform(edge).collect()), key=key) == sorted((plain(r["doc_id"], r["text"]) for r in rows), key=key)
    restored = X.restore(X.transform(edge)).collect()
    assert sorted(r["restored"] for r in restored) == sorted(r["text"] or "" for r in rows)
    out = X.restore(X.transform(none))
    assert out.collect() == [] and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]


TEXTS = st.text(alphabet=st.sampled_from("ab <>PSM\n\t\x0b é€😀 "), max_size=40)


@given(TEXTS, st.integers(0, 500))
def test_every_text_comes_back(text, doc_id):
    n, form, prefix, middle, output = X.rearranged(text.encode(), X.draws(42, doc_id), "word", 100, 50)
    assert X.rebuilt(output, form) == text.encode()
    assert n == len(UNITS.findall(text))
    if form != "plain":
        parts = UNITS.findall(text)
        h1, h2, *_ = X.draws(42, doc_id)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        assert (prefix, middle) == (len("".join(parts[:a])), len("".join(parts[a:b])))


@given(TEXTS)
def test_index(text):
    raw = text.encode()
    index = X.Exceptions(np.frombuffer(raw, dtype=np.uint8))
    ends = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    chars = np.arange(len(text) + 1)
    assert index.n_chars == len(text)
    assert index.to_chars(ends).tolist() == chars.tolist() and index.to_bytes(chars).tolist() == ends.tolist()
    # Only characters of several bytes are in it.
    assert len(index.at) == sum(len(c.encode()) > 1 for c in text)


def test_a_very_long_text(spark):
    text = "é word\n" * 300_000
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    rows = X.restore(X.transform(docs)).collect()
    assert all(r["restored"] == text for r in rows)
    assert sorted((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) for r in rows) == sorted(plain(i, text)[:5] for i in range(6))
