"""A hidden Markov language model: Baum-Welch over partitions, and exact likelihoods by the scaled forward recursion.

Every word of the training documents is counted. The most frequent words have emissions of their own; all others,
unseen words included, emit the class of their surface (length and last letter), and within a class a word has its
smoothed share of the class. So the model is a distribution over word sequences with an end, and the hidden states learn
what kinds of words follow each other. Every pass of the training goes over all training documents, until the likelihood
rises by little; each task adds up its expected counts, and only those sums move.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowage.llm.common import cut_lineage, slices, text_rows

STATES = 8
# Words with emissions of their own: with their states 1.3 MB of model, which is broadcast.
FREQUENT = 20_000
# Words whose counts are broadcast, some 10 MB; the counts of all others reach the documents by a join.
COMMON = 200_000
# Training ends with the pass that finds the log-likelihood raised by less than this share of it.
GAIN = 3e-4
SEED = 11
# Pseudo-counts of transitions and emissions.
SMOOTH = 0.01
# Tokens whose states are held at once in a task, and distinct words a task counts before it passes them on.
BATCH_TOKENS = 500_000
# Sequences side by side, about, below which a stored batch goes on up to twice as many tokens, as each step has a cost.
WIDE = 512
COUNTED = 300_000

# Bytes of a word that counts and broadcasts hold.
LONGEST = 64
# Tokens that are sorted by the length of their texts before they are cut into batches.
SORTED_TOKENS = 4_000_000

END = 0
_LENGTHS, _LETTERS = 12, 28
CLASSES = _LENGTHS * _LETTERS


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8; very long ones by :func:`short`."""
    words = text.encode().lower().split()
    return words if max(map(len, words), default=0) <= LONGEST else [word if len(word) <= LONGEST else short(word) for word in words]


def short(word: bytes) -> bytes:
    """A word of more than ``LONGEST`` bytes by its beginning, a 128-bit hash of it and its last byte, in as many bytes."""
    return word[: LONGEST - 17] + md5(word).digest() + word[-1:]


def surface_class(word: bytes) -> int:
    """The class of a word by its length in bytes and its last byte if that is a letter."""
    last = word[-1] - 97
    letter = last if 0 <= last < 26 else 26 if word[-1] >= 128 else 27
    return min(len(word) - 1, _LENGTHS - 1) * _LETTERS + letter


def held_out(id_column: Column) -> Column:
    """CRC-32 of the id as text, modulo 5, is 1. A document with a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 1, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all of ``docs``; a task passes on its sums, in parts if it meets very many words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def summed() -> pa.RecordBatch:
            columns = [pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for text in batch["text"]:
                found.update(words_of(text.as_py()))
                if len(found) > COUNTED:
                    yield summed()
                    found.clear()
        yield summed()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Symbols:
    """The frequent words' numbers; 0 is the end, frequent words follow, then the classes."""

    words: list[bytes]

    def __post_init__(self):
        self.number = {word: at + 1 for at, word in enumerate(self.words)}
        self.size = 1 + len(self.words) + CLASSES

    def of_class(self, word: bytes) -> int:
        return 1 + len(self.words) + surface_class(word)


class Numbers(dict):
    """Word to symbol. A word that is not frequent is looked up by its length and last byte; it is not remembered, as most
    such words are met once or twice and a dictionary of all of them fits no cache."""

    def __init__(self, symbols: Symbols):
        super().__init__(symbols.number)
        lengths = [bytes(length) for length in range(_LENGTHS)]
        self.classes = [[symbols.of_class(word + bytes([last])) for last in range(256)] for word in [b"", *lengths]]

    def __missing__(self, word: bytes) -> int:
        length = len(word)
        return self.classes[length if length < _LENGTHS else _LENGTHS][word[-1]]


@dataclass
class Model:
    """Start, transition and emission probabilities; emissions are a row per symbol."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


class Sums:
    """Expected counts of starts, transitions and emissions, and the log10 likelihood under the model that expects them."""

    def __init__(self, states: int, symbols: int):
        self.start = np.zeros(states)
        self.move = np.zeros((states, states))
        self.emit = np.zeros((symbols, states))
        self.likelihood = 0.0

    def model(self, unigrams: np.ndarray) -> Model:
        """The model of these counts. Emissions are smoothed towards the symbols' shares of all tokens."""
        start = (self.start + SMOOTH) / (self.start + SMOOTH).sum()
        move = self.move + SMOOTH
        emit = self.emit + SMOOTH * len(unigrams) * unigrams[:, None]
        return Model(start, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def ragged(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side: symbols by step, how many sequences reach each step, and the order, longest first."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    reach = np.bincount(lengths, minlength=lengths.max() + 1)[::-1].cumsum()[::-1][1:]
    offset = np.cumsum(reach) - reach
    flat = np.empty(int(lengths.sum()), dtype=np.int64)
    for rank, at in enumerate(order.tolist()):
        flat[offset[: lengths[at]] + rank] = sequences[at]
    return flat, reach, order


class Room:
    """Arrays that a task uses again for each batch, as pages that are new to a process take as long as the work in them."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def array(self, name: str, rows: int, *shape: int, dtype=np.float64) -> np.ndarray:
        held = self.held.get(name)
        if held is None or len(held) < rows or held.shape[1:] != shape or held.dtype != dtype:
            held = self.held[name] = np.empty((rows, *shape), dtype=dtype)
        return held[:rows]


def forward(model: Model, flat: np.ndarray, reach: np.ndarray, keep: bool = False, room: Room | None = None):
    """Log10 likelihood of each sequence, in the order of ``ragged``; with ``keep`` also the scaled states by step. What is
    returned may be overwritten by the next call with the same ``room``."""
    room = room or Room()
    states, kind = model.emit.shape[1], model.emit.dtype
    emitted = np.take(model.emit, flat, axis=0, out=room.array("emitted", len(flat), states, dtype=kind), mode="clip")
    scales = room.array("scales", len(flat), dtype=kind)
    steps = reach.tolist()
    # Without ``keep`` two steps are held, by turns.
    rows = len(flat) if keep else 2 * steps[0]
    kept = room.array("kept", rows, states, dtype=kind)
    ones = np.ones(states, dtype=kind)
    move, matmul, multiply, divide = model.move, np.matmul, np.multiply, np.divide
    at = 0
    state = None
    for step, n in enumerate(steps):
        end = at + n
        first = at if keep else step % 2 * steps[0]
        here = kept[first : first + n]
        if state is None:
            multiply(model.start, emitted[:n], out=here)
        else:
            matmul(state[:n], move, out=here)
            multiply(here, emitted[at:end], out=here)
        scale = matmul(here, ones, out=scales[at:end])
        divide(here, scale[:, None], out=here)
        state, at = here, end
    # Added up step by step, so that nothing is numbered.
    logs, total, at = np.log10(scales, out=room.array("logs", len(flat)), dtype=np.float64), np.zeros(steps[0]), 0
    for n in steps:
        total[:n] += logs[at : at + n]
        at += n
    return total, emitted, scales, kept


def expect(model: Model, sequences: list[np.ndarray], sums: Sums) -> None:
    """Add the expected counts of whole sequences to ``sums`` by the scaled forward and backward recursions."""
    flat, reach, _ = ragged(sequences)
    expect_ragged(model, flat, reach, sums)


# Tokens whose posteriors are turned to columns at once, and added up by symbol.
COUNTED_TOKENS = 1 << 16


def expect_ragged(model: Model, flat: np.ndarray, reach: np.ndarray, sums: Sums, room: Room | None = None) -> None:
    """``expect`` for sequences that stand side by side already. What is ahead becomes the posterior step by step."""
    room = room or Room()
    likelihoods, emitted, scales, ahead = forward(model, flat, reach, keep=True, room=room)
    sums.likelihood += float(likelihoods.sum())
    steps, states, kind = reach.tolist(), ahead.shape[1], ahead.dtype
    emitted /= scales[:, None]
    back_move = np.ascontiguousarray(model.move.T)
    # What pairs of states have in common at each step, of which the first has none before it.
    pairs = room.array("pairs", len(steps), states, states, dtype=kind)
    pairs[0] = 0
    # Sequences that end at a step begin their backward recursion there, at one.
    back = room.array("back", steps[0], states, dtype=kind)
    back.fill(1)
    matmul, multiply = np.matmul, np.multiply
    end = len(flat)
    for step in range(len(steps) - 1, 0, -1):
        n = steps[step]
        first = end - n
        before = first - steps[step - 1]
        weighted, behind, here = emitted[first:end], back[:n], ahead[first:end]
        multiply(weighted, behind, out=weighted)
        matmul(ahead[before : before + n].T, weighted, out=pairs[step])
        multiply(here, behind, out=here)
        matmul(weighted, back_move, out=behind)
        end = first
    ahead[:end] *= back
    sums.move += model.move * pairs.sum(axis=0, dtype=np.float64)
    sums.start += ahead[:end].sum(axis=0, dtype=np.float64)
    for first in range(0, len(flat), COUNTED_TOKENS):
        part = ahead[first : first + COUNTED_TOKENS]
        columns = room.array("columns", states, COUNTED_TOKENS)[:, : len(part)]
        columns[:] = part.T
        symbols = flat[first : first + COUNTED_TOKENS].astype(np.intp)
        for state in range(states):
            sums.emit[:, state] += np.bincount(symbols, weights=columns[state], minlength=len(sums.emit))


def sequences_of(batches: Iterator[pa.RecordBatch], numbers: Numbers) -> Iterator[tuple[pa.Array, list, list]]:
    """Ids, words and symbols of parts of about ``BATCH_TOKENS`` tokens; texts of like length stand together."""
    for batch in batches:
        batch = batch.take(pa.array(np.argsort([len(text.as_py()) for text in batch["text"]], kind="stable")))
        texts = batch["text"].to_pylist()
        for first, end in slices(texts, 6 * BATCH_TOKENS):
            words = [words_of(text) for text in texts[first:end]]
            symbols = [np.fromiter(map(numbers.__getitem__, w), dtype=np.int64, count=len(w)) for w in words]
            yield batch["doc_id"].slice(first, end - first), words, [np.append(s, END) for s in symbols]


STORED = "symbols binary, reach binary"


def store_symbols(docs: DataFrame, symbols: Symbols) -> DataFrame:
    """The symbols of all documents, once for all passes: a row per batch of texts of like length, as ``ragged`` lays
    them out, in two or four bytes a token. The texts are not split again."""
    shared = docs.sparkSession.sparkContext.broadcast(symbols)
    kind = np.dtype("<u2") if symbols.size <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(shared.value)

        def laid_out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            held.sort(key=len)
            first = n_held = 0
            for at, sequence in enumerate(held):
                n_held += len(sequence)
                wide = n_held >= min(WIDE * len(sequence), 2 * BATCH_TOKENS)
                if n_held >= BATCH_TOKENS and wide or at + 1 == len(held):
                    flat, reach, _ = ragged(held[first : at + 1])
                    raw = [flat.astype(kind).tobytes(), reach.astype("<i4").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([one], pa.binary()) for one in raw], ["symbols", "reach"])
                    first, n_held = at + 1, 0

        held: list[np.ndarray] = []
        n_held = 0
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text.as_py())
                sequence = np.empty(len(words) + 1, dtype=kind)
                sequence[:-1] = np.fromiter(map(numbers.__getitem__, words), dtype=kind, count=len(words))
                sequence[-1] = END
                held.append(sequence)
                n_held += len(sequence)
                if n_held >= SORTED_TOKENS:
                    yield from laid_out(held)
                    held, n_held = [], 0
        yield from laid_out(held)

    # The bytes are those of numbers of like size, which a dictionary of values would only copy.
    return cut_lineage(docs.select("text").mapInArrow(run, STORED))


def baum_welch(stored: DataFrame, symbols: Symbols, model: Model) -> Sums:
    """Expected counts over all documents of ``store_symbols`` under ``model``: one row per symbol and task, added up by
    Spark."""
    shared = stored.sparkSession.sparkContext.broadcast((symbols.size, model))
    states = len(model.start)
    columns = [f"s{i}" for i in range(states)]
    kind = np.dtype("<u2") if symbols.size <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, model = shared.value
        # States are scaled to one at every step, so half the digits do inside; counts are added up with all of them.
        model = Model(*(part.astype(np.float32) for part in (model.start, model.move, model.emit)))
        sums, room = Sums(states, size), Room()
        for batch in batches:
            for flat, reach in zip(batch["symbols"], batch["reach"]):
                expect_ragged(model, np.frombuffer(flat.as_buffer(), dtype=kind), np.frombuffer(reach.as_buffer(), dtype="<i4"), sums, room)
        # The rows after the symbols are the transitions, then the starts, and the last one begins with the likelihood.
        every = np.concatenate([sums.emit, sums.move, sums.start[None, :], sums.likelihood * np.eye(1, len(model.start))])
        (seen,) = np.nonzero(every.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *[pa.array(every[seen, i]) for i in range(states)]], ["row", *columns])

    schema = "row long, " + ", ".join(f"{c} double" for c in columns)
    added = stored.mapInArrow(run, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in columns])
    # A row per symbol at most, whatever the corpus.
    every = np.zeros((symbols.size + states + 2, states))
    for row in added.collect():
        every[row["row"]] = row[1:]
    sums = Sums(states, symbols.size)
    sums.emit, sums.move, sums.start = every[: symbols.size], every[symbols.size : -2], every[-2]
    sums.likelihood = float(every[-1, 0])
    return sums


def train(docs: DataFrame, symbols: Symbols, unigrams: np.ndarray, states: int = STATES) -> Model:
    """Fit the model to all documents, from a random start, until a pass raises their likelihood by less than ``GAIN``."""
    stored = store_symbols(docs, symbols)
    random = np.random.default_rng(SEED)
    move = np.full((states, states), 0.4 / states) + 0.6 * np.eye(states)
    emit = unigrams[:, None] * random.uniform(0.5, 1.5, (len(unigrams), states))
    model = Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))
    before = -np.inf
    while True:
        sums = baum_welch(stored, symbols, model)
        model = sums.model(unigrams)
        if sums.likelihood - before <= GAIN * abs(sums.likelihood):
            return model
        before = sums.likelihood


def score_documents(
    spark: SparkSession, docs: DataFrame, states: int = STATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: tokens, known tokens, the unigram base score and the model's log10 likelihood.

    Counts and training use the documents that are not held out; all are scored, whole. A null or empty text is the end
    alone. Repeated rows count as often as they stand; a null id trains. Texts of any length are scored whole, and a word
    of more than ``LONGEST`` bytes is known by a hash. Words of equal counts are ranked by their bytes. Without training
    documents the base is that of an empty vocabulary and the model knows classes only. Other columns, whatever their
    names, are not read. An empty table gives an empty table.
    """
    rows = text_rows(docs, id_col, text_col)
    training = rows.where(~held_out(F.col("doc_id")))
    counts = cut_lineage(count_words(training))
    totals = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    documents = training.count()
    distinct, tokens = totals["v"] + (documents > 0), totals["n"] + documents
    # At most COMMON rows, of no more than 16 times as many that can have so large a share of the tokens.
    large = counts.where(F.col("n") >= totals["n"] // (16 * COMMON))
    top = large.orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    common = dict(zip(top["word"].to_pylist(), top["n"].to_pylist()))
    symbols = Symbols(list(common)[:FREQUENT])

    # What the words without an emission of their own have in each class: a row per class.
    rest = counts.where(_after(top, FREQUENT))
    shares = rest.groupBy(class_column("word").alias("class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in shares:
        class_n[row["class"]], class_v[row["class"]] = row["n"], row["v"]
    mass = np.concatenate([[documents], [common[w] for w in symbols.words], class_n]) + 0.5
    unigrams = mass / mass.sum()
    model = train(training, symbols, unigrams, states)

    below = log10(tokens + 0.5 * (distinct + 1))
    within = np.log10(class_n + 0.5 * (class_v + 1))
    logs_of = {word: log10(n + 0.5) for word, n in common.items()}
    shared = spark.sparkContext.broadcast((symbols, model, logs_of, within))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, model, logs_of, within = shared.value
        numbers = Numbers(symbols)
        first_class = 1 + len(symbols.words)
        logs = np.concatenate([[0.0], [logs_of[w] for w in symbols.words], np.zeros(CLASSES)])
        inside = np.concatenate([np.zeros(first_class), within])
        row_id, room = TaskContext.get().partitionId() << 40, Room()
        for doc_ids, words, sequences in sequences_of(batches, numbers):
            flat, reach, order = ragged(sequences)
            chance = np.empty(len(sequences))
            chance[order] = forward(model, flat, reach, room=room)[0]
            base, scores, n_known, rare_words, rare_times, n_rare = [], [], [], [], [], []
            for one, sequence, likelihood in zip(words, sequences, chance.tolist()):
                classed = Counter([one[i] for i in np.flatnonzero(sequence >= first_class).tolist()])
                found = [(logs_of.get(word), times) for word, times in classed.items()]
                log = sum(value * times for value, times in found if value is not None)
                rare = [at for at, (value, _) in zip(classed.items(), found) if value is None]
                rare_words += [word for word, _ in rare]
                rare_times += [times for _, times in rare]
                n_rare.append(len(rare))
                n_known.append(len(sequence) - sum(times for _, times in rare))
                base.append(float(logs[sequence].sum()) + log)
                scores.append(likelihood + log - float(inside[sequence].sum()))
            ends = pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32())
            at = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_times, pa.int64())], ["word", "times"])
            columns = {
                "row_id": pa.array(np.arange(row_id, row_id + len(sequences))),
                "doc_id": doc_ids,
                "n_tokens": pa.array([len(s) for s in sequences], pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "base": pa.array(base, pa.float64()),
                "model": pa.array(scores, pa.float64()),
                "rare": pa.ListArray.from_arrays(ends, at),
            }
            row_id += len(sequences)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "row_id long, doc_id long, n_tokens long, n_known long, base double, model double, rare array<struct<word: binary, times: long>>"
    # Written once: the documents' own parts and their rare words are both read from here.
    scored = cut_lineage(rows.mapInArrow(run, schema))
    seen = scored.select("row_id", F.explode("rare").alias("at")).select("row_id", "at.word", "at.times")
    looked = seen.join(counts.where(_after(top, COMMON)), "word", "left")
    added = looked.groupBy("row_id").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"),
    )
    joined = scored.drop("rare").join(added, "row_id", "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    # The end is a known token if any training document has one.
    known = F.col("n_known") + F.coalesce("rare_known", F.lit(0)) - F.lit(0 if documents else 1)
    return joined.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        known.cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_logs + log10(documents + 0.5) - F.col("n_tokens") * below).alias("base_score"),
        (F.col("model") + rare_logs).alias("score"),
    )


def _after(top: pa.Table, bound: int) -> Column:
    """Whether a word comes after the first ``bound`` of ``top``, in the order by count and word."""
    if not top.num_rows:
        return F.lit(True)
    last = min(bound, top.num_rows) - 1
    word, n = top["word"][last].as_py(), top["n"][last].as_py()
    return (F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > F.lit(word)))


def class_column(word: str) -> Column:
    """``surface_class`` as a column over binary words."""
    last = F.conv(F.hex(F.substring(word, -1, 1)), 16, 10).cast("int") - 97
    letter = F.when(last.between(0, 25), last).when(last >= 31, 26).otherwise(27)
    return F.least(F.octet_length(word) - 1, F.lit(_LENGTHS - 1)) * _LETTERS + letter
