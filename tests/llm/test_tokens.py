"""Token ids, counts, packing and files against the library itself."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from stowage.llm.packing import OpenSequences, pack_documents
from stowage.llm.queries import QUERIES
from stowage.llm.token_counts import LengthTable, count_tokens
from stowage.llm.token_store import checksums, decode_ranks, encode_ranks, read_tokens, write_tokens
from stowage.llm.tokens import BYTE_BPE, WORD_BPE, encoder
from stowage.session import scratch_path

from .conftest import EDGE_TEXTS, SF_DIR


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE_BPE)


def whole(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r.,'sabAÉßœ́1٣Σς中<|>!-\x1c\xa0", max_size=60))
def test_pieces_give_the_ids_of_the_whole_text(word, byte, text):
    for path, tokenizer in ((WORD_BPE, word), (BYTE_BPE, byte)):
        codes = encoder(path)
        assert np.frombuffer(codes.ids([text])[0], dtype=codes.id_type).tolist() == whole(tokenizer, text)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "x\n <|endoftext|>", "A,B. c, d.\nE's", "<|ENDOFTEXT|>, x", "it's I'LL we'd", "İ ΑΣ σς,"])
def test_special_strings_and_contractions(word, byte, text):
    for path, tokenizer in ((WORD_BPE, word), (BYTE_BPE, byte)):
        codes = encoder(path)
        assert np.frombuffer(codes.ids([text])[0], dtype=codes.id_type).tolist() == whole(tokenizer, text)


def test_length_table_opens_to_what_it_was_made_of():
    assert LengthTable([" a", "é", "", "long" * 9], [1, 2, 0, 3]).open() == {" a": 1, "é": 2, "": 0, "long" * 9: 3}


def test_counts(spark, documents, texts, byte):
    for row in QUERIES["op5_token_counts"](spark, SF_DIR).collect():
        text = texts[row["doc_id"]]
        n = len(whole(byte, text))
        assert tuple(row)[1:] == (len(text.encode()), n, n > 512)


def test_counts_of_edge_cases(spark, edge, none, byte):
    found = sorted(tuple(map(str, row)) for row in count_tokens(spark, edge, BYTE_BPE).collect())
    counted = [(i, len((t or "").encode()), len(whole(byte, t or ""))) for i, t in EDGE_TEXTS]
    assert found == sorted(tuple(map(str, (*c, c[2] > 512))) for c in counted)
    assert count_tokens(spark, none, BYTE_BPE).collect() == []


def check_packing(rows, ids_of):
    """Every document is there once, cut only where it must be, and sequences have no gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        by_doc[row["doc_id"]].append(row)
        by_sequence[row["sequence_id"]].append((row["offset"], row["length"]))
    for doc_id, ids in ids_of.items():
        pieces = sorted(by_doc[doc_id], key=lambda r: (r["piece"], r["sequence_id"]))
        copies = len(pieces) * 4096 // max(1, -(-len(ids) // 4096) * 4096)
        want = [(at, start, ids[start : start + 4096]) for at, start in enumerate(range(0, len(ids), 4096)) for _ in range(copies)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces] == [(a, s, len(x), crc(x)) for a, s, x in want]
    for placed in by_sequence.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 4096
    return len(by_sequence)


def test_packing(spark, texts, word):
    ids_of = {i: [*whole(word, t), 1] for i, t in texts.items()}
    rows = QUERIES["op2_best_fit_packing"](spark, SF_DIR).collect()
    n = check_packing(rows, ids_of)
    assert len(rows) == sum(-(-len(x) // 4096) for x in ids_of.values())
    assert n <= -(-sum(map(len, ids_of.values())) // 4096) * 1.03 + 1


def test_packing_of_edge_cases(edge, none, word):
    rows = pack_documents(edge, WORD_BPE).collect()
    ids_of = {i: [*whole(word, t or ""), 1] for i, t in EDGE_TEXTS}
    check_packing(rows, ids_of)
    assert sum(r["length"] for r in rows) == sum(len([*whole(word, t or ""), 1]) for _, t in EDGE_TEXTS)
    assert pack_documents(none, WORD_BPE).collect() == []


def test_open_sequences_are_bounded_and_best_fit():
    sequences = OpenSequences(100, 2)
    assert [sequences.place(n) for n in (60, 70, 30, 80)] == [(0, 0), (1, 0), (1, 70), (2, 0)]
    # The third open one made the fullest close: 2 with 20 free stays shut out, 0 with 40 free is still open.
    assert sequences.n_open == 2 and sequences.place(40) == (0, 60)
    random.seed(3)
    sizes = [random.randint(1, 100) for _ in range(3000)]
    tight = OpenSequences(100, 64)
    placed = defaultdict(int)
    for n in sizes:
        at, offset = tight.place(n)
        assert placed[at] == offset and offset + n <= 100
        placed[at] += n
        assert tight.n_open <= 64
    assert len(placed) <= sum(sizes) / 100 * 1.05


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_codes_round_trip(ranks):
    control, data = encode_ranks(np.array(ranks, dtype=np.uint32))
    assert decode_ranks(control, data, len(ranks)).tolist() == ranks


def test_store(spark, texts, word):
    start = 0
    found = {r["doc_id"]: r for r in QUERIES["op4_token_store"](spark, SF_DIR).collect()}
    assert len(found) == len(texts)
    for doc_id in sorted(texts):
        ids = [*whole(word, texts[doc_id]), 1]
        assert tuple(found[doc_id])[1:] == (start, len(ids), crc(ids))
        start += len(ids)


def test_store_of_edge_cases(spark, edge, none, word):
    rows = read_tokens(spark, write_tokens(edge, WORD_BPE, scratch_path(spark, "t"))).collect()
    assert sorted(bytes(r["ids"]) for r in rows) == sorted(struct.pack(f"<{len(x)}I", *x) for x in ([*whole(word, t or ""), 1] for _, t in EDGE_TEXTS))
    order = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r["start"] for r in order] == [sum(x["n_tokens"] for x in order[:i]) for i in range(len(order))]
    assert checksums(read_tokens(spark, write_tokens(none, WORD_BPE, scratch_path(spark, "t")))).collect() == []
