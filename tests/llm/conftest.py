from __future__ import annotations

import os

import pytest

SF_DIR = "/root/testdata/sf0.001"

# Extra columns bear names that operators use for columns of their own.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, size long, bits long, row_id long, "
    "fingerprint string, n_tokens long, range int, copy int, `next_text` string, rate double, component_id long"
)


def _row(doc_id, text, source="s1", lang="en"):
    return (doc_id, text, lang, source, len(text) if text is not None else None, 1.0, 2, 3, 4, "f", 5, 6, 7, "n", 8.0, 9)


EDGE_TEXTS = [
    (1, "one two three four five six seven eight"),
    (1, "one two three four five six seven eight"),
    (2, ""),
    (3, None),
    (None, "a text without an id +1 (988) 555-2485"),
    (4, " \n\t "),
    (5, "word " * 30_000),
    (6, "É ß ñandú\n\nline\x0bfeed <|endoftext|> done, the end."),
    (7, "one two three four five six seven eight"),
    (8, "x" * 20_000 + "1" * 20_000),
    (9, "mail a.b@c-d.example.com or 10.0.0.1, 4111 1111 1111 1111."),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows and clashing names."""
    sources = ["s1", "s1", None, "s2", "s2", None, "s3", "s1", "s2", "s3", "é"]
    rows = [_row(i, t, s, None if i == 2 else "en") for (i, t), s in zip(EDGE_TEXTS, sources)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {row["doc_id"]: row["text"] or "" for row in documents.collect()}
