"""Toxicity by subword bags: character n-gram vectors averaged into a linear softmax, all trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 5, with word bounds), so a misspelling nobody has
labelled is still near the word it bends. A bag is a window of consecutive words, their mean taken over the width of the
window; a document scores as its most toxic window, so one insult in a very long text counts as it does in a short one.
Training picks each document's window by the model as it stands, for either label, and a calibration on documents that
were kept apart turns the best window's margin into a probability.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stowage.llm.common import slices, text_rows

# Labelled documents that the classifier is fitted on, at most, taken by the order of a hash of the id; the labelled
# rows of a corpus beyond them are left out of the fit, and nothing else is.
LABELLED = 6_000
CALIBRATION_SHARE = 0.25

BUCKETS = 1 << 17
DIMENSIONS = 8
WINDOW = 6
STRIDE = 2
EPOCHS = 16
# Steps at least, in up to six times as many epochs, for few labelled documents.
STEPS = 560
BATCH = 128
# Step sizes that are tried in turn until the calibration documents agree with the labels.
RATES = (2.0, 1.0, 0.5)
WEIGHT_RATE = 0.05
DECAY = 1e-4
SEED = 7

THRESHOLD = 0.7
REMEMBERED = 500_000
# Words whose n-grams the driver takes apart and adds up at once.
WORDS_AT_ONCE = 10_000

_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(position of the word, bucket) of every character n-gram of 3 to 5 of every word, bounds included."""
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    bare = [f"<{word.strip(_EDGES)}>" for word in words]
    codes = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    word_of = np.repeat(np.arange(len(bare)), [len(one) for one in bare])
    found_words, found = [], []
    for n in (3, 4, 5):
        if len(codes) < n:
            continue
        inside = np.flatnonzero(word_of[: len(codes) - n + 1] == word_of[n - 1 :])
        mixed = np.full(len(inside), n, dtype=np.uint64)
        for step in range(n):
            mixed = mixed * np.uint64(1_000_003) + codes[inside + step]
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
        found_words.append(word_of[inside])
        found.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
    # Words of punctuation alone have none.
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *found_words]), np.concatenate([none, *found])


def word_values(words: list[str], bucket_values: np.ndarray) -> np.ndarray:
    """The mean value of each word's n-grams; a word of punctuation alone has none and counts zero."""
    of, bucket = ngrams(words)
    count = np.bincount(of, minlength=len(words))
    return np.bincount(of, weights=bucket_values[bucket], minlength=len(words)) / np.maximum(count, 1)


def window_means(values: np.ndarray) -> np.ndarray:
    """The mean over each window, first words at every ``STRIDE``; windows are filled up with zeros."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    starts = np.arange(0, max(1, len(values) - WINDOW + STRIDE), STRIDE)
    ends = np.minimum(starts + WINDOW, len(values))
    return (sums[ends] - sums[starts]) / WINDOW


@dataclass
class Model:
    """What scoring needs: the margin of each n-gram bucket, the bias, and the calibration of the best margin."""

    bucket_values: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, values: np.ndarray) -> float:
        return float(window_means(values).max()) + self.bias

    def score(self, values: np.ndarray) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * self.margin(values) + self.shift, -40, 40))))


def words_of(text: str) -> list[str]:
    return text.lower().split()


class _Fit:
    """The joint training of n-gram vectors and softmax weights over documents as arrays of word numbers."""

    def __init__(self, texts: list[str]):
        numbers: dict[str, int] = {}
        self.docs = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], dtype=np.int32) for t in texts]
        words = list(numbers)
        numbers.clear()
        self.count, bucket = np.zeros(len(words), dtype=np.int64), []
        for start in range(0, len(words), WORDS_AT_ONCE):
            some = words[start : start + WORDS_AT_ONCE]
            a, b = ngrams(some)
            bucket.append(b[np.argsort(a, kind="stable")].astype(np.int32))
            self.count[start : start + len(some)] = np.bincount(a, minlength=len(some))
        self.bucket = np.concatenate([np.empty(0, dtype=np.int32), *bucket])
        self.first = np.cumsum(self.count) - self.count
        self.start()

    @property
    def of(self) -> np.ndarray:
        """The word of each of ``bucket``, which is made where it is asked for, as it is large."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def start(self) -> None:
        self.random = random = np.random.default_rng(SEED)
        self.vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
        self.weights = random.uniform(-0.5, 0.5, (DIMENSIONS, 2))
        self.bias = np.zeros(2)

    def values(self) -> np.ndarray:
        bucket_values = self.vectors @ (self.weights[:, 1] - self.weights[:, 0])
        summed = np.zeros(len(self.count))
        # Some words at once, as each has many n-grams and this runs on the driver.
        for start in range(0, len(summed), WORDS_AT_ONCE):
            count = self.count[start : start + WORDS_AT_ONCE]
            here = slice(self.first[start], self.first[start] + count.sum())
            of = np.repeat(np.arange(len(count)), count)
            summed[start : start + len(count)] = np.bincount(of, weights=bucket_values[self.bucket[here]], minlength=len(count))
        return summed / np.maximum(self.count, 1)

    def step(self, chosen: list[np.ndarray], labels: np.ndarray, rate: float) -> None:
        """One step of gradient descent on a batch of windows."""
        words = np.concatenate(chosen)
        doc = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
        count = self.count[words]
        entry_doc = np.repeat(doc, count)
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        bucket = self.bucket[np.repeat(self.first[words], count) + inside]
        share = np.repeat(1.0 / (np.maximum(count, 1) * WINDOW), count)[:, None]
        mean = np.zeros((len(chosen), DIMENSIONS))
        np.add.at(mean, entry_doc, self.vectors[bucket] * share)
        logits = mean @ self.weights + self.bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        wrong = odds / odds.sum(axis=1, keepdims=True)
        wrong[np.arange(len(labels)), labels] -= 1
        back = wrong @ self.weights.T
        np.add.at(self.vectors, bucket, -rate * share * back[entry_doc])
        self.weights -= WEIGHT_RATE * mean.T @ wrong
        self.bias -= WEIGHT_RATE * wrong.mean(axis=0)
        self.vectors *= 1 - DECAY

    def window(self, doc: np.ndarray, values: np.ndarray | None) -> np.ndarray:
        if not len(doc):
            return doc
        if values is None:
            start = int(self.random.integers(0, max(1, len(doc) - WINDOW + 1)))
        else:
            start = int(window_means(values[doc]).argmax()) * STRIDE
        return doc[start : start + WINDOW]


def _calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, held a little to a slope of one."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        pull = 1e-2 * (slope - 1.0)
        gradient = np.array([((p - labels) * margins).sum() + pull, (p - labels).sum() + 1e-3 * shift])
        curve = np.array([[(w * margins**2).sum() + 1e-2, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-3]])
        move = np.clip(np.linalg.solve(curve, gradient), -2, 2)
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return max(float(slope), 1e-3), float(shift)


def train(texts: list[str], labels: list[int]) -> Model:
    """A model from labelled texts; without any text, or with one label only, every text scores below the threshold."""
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return _undecided(y)
    fit = _Fit(texts)
    apart = np.zeros(len(y), dtype=bool)
    apart[fit.random.permutation(len(y))[: int(len(y) * CALIBRATION_SHARE)]] = True
    check = np.flatnonzero(apart) if len(set(y[apart].tolist())) == 2 else np.arange(len(y))
    share = y[check].mean()
    # What always answering the share of toxic documents would lose.
    blind = -(share * np.log(share) + (1 - share) * np.log(1 - share))
    best, least = None, np.inf
    with np.errstate(all="ignore"):
        for rate in RATES:
            fit.start()
            model, loss = _attempt(fit, y, np.flatnonzero(~apart), check, rate)
            if loss < least:
                best, least = model, loss
            if least < 0.5 * blind:
                break
    return best or _undecided(y)


def _undecided(y: np.ndarray) -> Model:
    """Every text scores alike, below the threshold."""
    return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, 1.0, min(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1))), 0.0))


def _attempt(fit: _Fit, y: np.ndarray, learn: np.ndarray, check: np.ndarray, rate: float) -> tuple[Model | None, float]:
    """A model at one step size, and its mean loss on the documents kept apart; infinite if it ran away."""
    epochs = min(max(EPOCHS, -(-STEPS * BATCH // max(len(learn), 1))), 6 * EPOCHS)
    for epoch in range(epochs):
        values = fit.values() if epoch >= epochs // 8 else None
        order = fit.random.permutation(learn)
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            fit.step([fit.window(fit.docs[d], values) for d in batch], y[batch], rate * (1 - epoch / epochs))
        if not np.isfinite(fit.weights).all() or np.abs(fit.weights).max() > 1e3:
            return None, np.inf
    bucket_values = (fit.vectors @ (fit.weights[:, 1] - fit.weights[:, 0])).astype(np.float32)
    model = Model(bucket_values, float(fit.bias[1] - fit.bias[0]), 1.0, 0.0)
    values = fit.values()
    margins = np.array([model.margin(values[fit.docs[d]]) for d in check])
    if not np.isfinite(margins).all():
        return None, np.inf
    model.slope, model.shift = _calibrate(margins, y[check])
    scores = 1 / (1 + np.exp(-np.clip(model.slope * margins + model.shift, -40, 40)))
    return model, float(-np.log(np.maximum(np.where(y[check] == 1, scores, 1 - scores), 1e-12)).mean())


def held_out(id_column: Column) -> Column:
    """Whether a document is held out: CRC-32 of the id as text, modulo 3, is 1. A null id is not."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    """Fit on at most ``bound`` labelled documents that are not held out, whole texts, the same ones at every run."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    picked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # At most ``bound`` ids, some hundred kilobytes.
    found = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id")
    rows = found.agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda row: row["doc_id"])
    return train([row["text"] for row in rows], [row["toxic"] for row in rows])


_VALUES: dict[str, dict[str, float]] = {}


def _scorer(spark: SparkSession, model: Model):
    """A function of texts, for use in tasks, that gives their scores; words' values are remembered per worker."""
    shared = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def scores(texts: list[str]) -> list[float]:
        model = shared.value
        if key not in _VALUES:
            _VALUES.clear()
            _VALUES[key] = {}
        known = _VALUES[key]
        out: list[float] = []
        for first, end in slices(texts):
            taken = [words_of(text) for text in texts[first:end]]
            wanted = set().union(*taken)
            if len(known) + len(wanted) > REMEMBERED:
                known.clear()
            new = list(wanted.difference(known))
            known.update(zip(new, word_values(new, model.bucket_values).tolist()))
            value = known.__getitem__
            out += [model.score(np.array(list(map(value, words)), dtype=np.float64)) for words in taken]
        return out

    return scores


def score(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of each text of ``docs``."""
    scores = _scorer(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(batch["text"].to_pylist())
            predicted = pa.array([int(s >= threshold) for s in found], pa.int32())
            columns = [batch["doc_id"], pa.array(found, pa.float64()), predicted]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def reject(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, all columns, whatever their names, as they are.

    A null text is empty, and an empty one has the score of an empty window. A row is judged by its text alone: repeated
    rows stay or go together, ids do not matter. A very long text scores as its most toxic window. An empty table gives an
    empty table.
    """
    scores = _scorer(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores([text or "" for text in batch[text_col].to_pylist()])
            yield batch.filter(pa.array([s < threshold for s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_documents(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: whether it is held out, its score, and 1 where the score reaches the threshold.

    A null or empty text has no words and gets the score of an empty window. Repeated rows score alike. Labels that are
    null or not 0 or 1 teach nothing; of several labels of one id the highest counts, of several texts the smallest. A
    null id is not held out and has no label. A very long text scores as its most toxic window, so no part of it is left
    out. Without labels of both kinds no document is toxic. Other columns, whatever their names, are not read. An empty
    table gives an empty table.
    """
    rows = text_rows(docs, id_col, text_col)
    scored = score(spark, rows, learn(rows, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
