"""Fill-in-the-middle: a text is cut in three and put together anew, with the middle last.

Cuts fall between units, which are words with the white space before them, or single code points. White space is ASCII, so
units are found in the bytes. A sparse index holds the multibyte characters alone: where each begins and how many bytes it
has beyond the first. A binary search in it turns byte cuts into code points or code points into byte cuts; between two of
its entries, and for a text without any, that is plain arithmetic. No text is decoded and none is copied per character.

The forms: ``plain``, the text as it is; ``psm``, ``<P>prefix<S>suffix<M>middle``; ``spm``, ``<S>suffix<P>prefix<M>middle``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stowage.llm.common import text_rows

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
# Percent of the texts that are cut, and of those, put together with the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 50, 80

# Bytes of texts that a worker puts together at once.
PART_BYTES = 8_000_000

_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Exceptions:
    """The multibyte characters of a UTF-8 text: first bytes, and all excess bytes up to each."""

    def __init__(self, raw: np.ndarray):
        self.n_bytes = len(raw)
        lead = np.flatnonzero(raw >= 0xC0)
        first = raw[lead]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.at = lead
        self.excess = np.concatenate([[0], np.cumsum(excess)])
        # Where the same characters stand, counted in code points.
        self.char_at = lead - self.excess[:-1]

    @property
    def n_chars(self) -> int:
        return self.n_bytes - int(self.excess[-1])

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each byte cut; a cut is between two characters."""
        return cuts - self.excess[np.searchsorted(self.at, cuts, side="left")]

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before each cut given in code points."""
        return cuts + self.excess[np.searchsorted(self.char_at, cuts, side="left")]


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Where words end; white space belongs to the word after it, and at the end of the text it is a unit of its own."""
    if not len(raw):
        return np.empty(0, dtype=np.int64)
    white = _WHITE[raw]
    return np.append(np.flatnonzero(white[1:] & ~white[:-1]) + 1, len(raw))


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four numbers that seed and id decide; a null id is the empty text."""
    digits = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in range(0, 32, 8))


def rearranged(text: bytes, drawn: tuple[int, ...], unit: str, cut_percent: int, suffix_first_percent: int):
    """(n, form, prefix_chars, middle_chars, output) of one text; the lengths are None for a plain one."""
    raw = np.frombuffer(text, dtype=np.uint8)
    index = None
    if unit == "word":
        ends = unit_ends(raw)
        n = len(ends)
    else:
        index = Exceptions(raw)
        n = index.n_chars
    h1, h2, h3, h4 = drawn
    if not text or h3 % 100 >= cut_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    units = np.array(sorted((h1 % (n + 1), h2 % (n + 1))), dtype=np.int64)
    if unit == "word":
        cuts = np.where(units > 0, ends[units - 1], 0)
        index = Exceptions(raw)
        chars = index.to_chars(cuts)
    else:
        chars, cuts = units, index.to_bytes(units)
    first, second = cuts.tolist()
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    lengths = int(chars[0]), int(chars[1] - chars[0])
    if h4 % 100 < suffix_first_percent:
        return n, "spm", *lengths, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", *lengths, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def rebuilt(output: bytes, form: str) -> bytes:
    """The text behind an output. A mark cannot begin inside a part, so the first of each kind is the one that was set."""
    if form == "plain":
        return output
    middle = output.index(MIDDLE)
    if form == "psm":
        suffix = output.index(SUFFIX)
        return output[len(PREFIX) : suffix] + output[middle + len(MIDDLE) :] + output[suffix + len(SUFFIX) : middle]
    prefix = output.index(PREFIX)
    return output[prefix + len(PREFIX) : middle] + output[middle + len(MIDDLE) :] + output[len(SUFFIX) : prefix]


def parts(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some megabytes of the column ``name``, or of one row."""
    for batch in batches:
        sizes = pc.binary_length(batch[name]).to_numpy(zero_copy_only=False)
        whole = np.cumsum(sizes) // PART_BYTES
        edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(whole)) + 1, [batch.num_rows]]))
        for first, end in zip(edges.tolist(), edges.tolist()[1:]):
            yield batch.slice(first, end - first)


def transform(
    docs: DataFrame,
    unit: str = "word",
    seed: int = SEED,
    cut_percent: int = CUT_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row; ``unit`` is ``word`` or ``char``.

    The id and the seed alone decide the draws, so reruns agree and rows of one id and text have one result. A null text
    is empty; an empty text, and one that holds a mark, is plain, with null lengths. A null id draws as an empty one.
    Parts may be empty. Texts of any length are cut whole, one at a time. Other columns, whatever their names, are not
    read. An empty table gives an empty table.
    """
    if unit not in ("word", "char"):
        raise ValueError("unit must be word or char")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            found = [
                rearranged(text.as_buffer().to_pybytes(), draws(seed, doc_id), unit, cut_percent, suffix_first_percent)
                for doc_id, text in zip(part["doc_id"].to_pylist(), pc.cast(part["text"], pa.binary()))
            ]
            n, form, prefix, middle, output = zip(*found)
            columns = [
                part["doc_id"],
                pa.array(n, pa.int64()),
                pa.array(form, pa.string()),
                pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()),
                pa.array(output, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return text_rows(docs, id_col, text_col).mapInArrow(run, schema)


def restore(transformed: DataFrame) -> DataFrame:
    """``transformed`` with ``restored``, the exact text rebuilt from ``output`` and ``form`` and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "output"):
            forms = part["form"].to_pylist()
            texts = [rebuilt(output.as_buffer().to_pybytes(), form) for output, form in zip(pc.cast(part["output"], pa.binary()), forms)]
            restored = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, restored], [*part.schema.names, "restored"])

    schema = ", ".join(f"{name} {kind}" for name, kind in [*transformed.dtypes, ("restored", "string")])
    return transformed.mapInArrow(run, schema)
