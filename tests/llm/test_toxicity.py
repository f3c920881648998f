"""Toxicity on planted words, spellings nobody labelled, and edge cases."""

import math
import random
import zlib

import numpy as np
import pytest

from stowage.llm import toxicity as T
from stowage.llm.queries import QUERIES

from .conftest import EDGE_TEXTS, SF_DIR

CLEAN = [a + b for a in ("bre", "sta", "kel", "mor", "tin", "fal", "ost", "ver") for b in ("an", "ing", "el", "o", "ist", "ure", "age")]
TOXIC = ["grunkhead", "slobwit", "vexmuck"]


def text(rng, toxic, words=200):
    said = [rng.choice(CLEAN) for _ in range(words)]
    if toxic:
        for _ in range(max(1, words // 60)):
            said[rng.randrange(words)] = rng.choice(TOXIC)
    return " ".join(said)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    labels = [i % 5 == 0 for i in range(900)]
    return T.train([text(rng, y, rng.randint(20, 400)) for y in labels], [int(y) for y in labels])


def score(model, said):
    return model.score(T.word_values(T.words_of(said), model.bucket_values))


def test_held_out_accuracy(model):
    rng = random.Random(2)
    found = [(score(model, text(rng, y)) >= T.THRESHOLD, y) for y in [True] * 100 + [False] * 200]
    assert sum(p for p, y in found if y) >= 95 and sum(p for p, y in found if not y) <= 4


def test_unseen_spellings_and_long_texts(model):
    rng = random.Random(3)
    clean = [text(rng, False) for _ in range(50)]
    for word in ("grunkheads", "grunkhed", "sllobwit", "vexmucks!!"):
        assert sum(score(model, said.replace(" ", f" {word} ", 3)) > score(model, said) for said in clean) >= 49
    long = text(rng, False, 20_000)
    at = len(long) // 2
    assert score(model, long) < T.THRESHOLD <= score(model, long[:at] + " grunkhead slobwit " + long[at:])


def plain_score(model, said):
    """The score by loops over windows, words and n-grams, with Python's own integers."""
    whole = 1 << 64

    def bucket(gram):
        mixed = len(gram)
        for char in gram:
            mixed = (mixed * 1_000_003 + ord(char)) % whole
        return ((mixed ^ mixed >> 29) * 0x9E3779B97F4A7C15 % whole >> 40) % T.BUCKETS

    def value(word):
        bare = f"<{word.strip(T._EDGES)}>"
        grams = [bare[i : i + n] for n in (3, 4, 5) for i in range(len(bare) - n + 1)]
        return sum(float(model.bucket_values[bucket(g)]) for g in grams) / len(grams) if grams else 0.0

    values = [value(word) for word in said.lower().split()]
    starts = range(0, max(1, len(values) - T.WINDOW + T.STRIDE), T.STRIDE)
    margin = max(sum(values[s : s + T.WINDOW]) / T.WINDOW for s in starts) + model.bias
    return 1 / (1 + math.exp(-(model.slope * margin + model.shift)))


def test_scores_equal_plain_loops(model):
    rng = random.Random(5)
    said = [text(rng, y, n) for y in (True, False) for n in (1, 2, 5, 6, 7, 8, 9, 41, 300)]
    said += ["", "...", "a", "é 😀 ßtraße-é x", "grunkhead", "GRUNKHEAD! (slobwit)", EDGE_TEXTS[7][1]]
    for one in said:
        assert score(model, one) == pytest.approx(plain_score(model, one), rel=1e-9)


def test_the_joint_gradient_is_that_of_the_loss():
    """A step against central differences of the softmax loss over windows, in vectors, weights and bias."""
    rng = random.Random(6)
    fit = T._Fit([text(rng, i % 2 == 0, 12) for i in range(8)])
    labels = np.array([1, 0] * 4)
    chosen = [doc[: T.WINDOW] if i % 3 else doc[:2] for i, doc in enumerate(fit.docs)]

    def loss():
        total = 0.0
        for words, label in zip(chosen, labels):
            mean = np.zeros(T.DIMENSIONS)
            for word in words:
                grams = fit.bucket[fit.of == word]
                mean += fit.vectors[grams].mean(axis=0) / T.WINDOW if len(grams) else 0
            logits = mean @ fit.weights + fit.bias
            total += np.log(np.exp(logits).sum()) - logits[label]
        return total

    def slope(array, at, h=1e-5):
        old = array[at]
        array[at] = old + h
        up = loss()
        array[at] = old - h
        down = loss()
        array[at] = old
        return (up - down) / (2 * h)

    used = fit.bucket[np.isin(fit.of, np.concatenate(chosen))]
    places = [(int(used[i]), i % T.DIMENSIONS) for i in range(0, len(used), max(1, len(used) // 12))]
    vectors, weights, bias = ([slope(a, p) for p in ps] for a, ps in (
        (fit.vectors, places), (fit.weights, list(np.ndindex(fit.weights.shape))), (fit.bias, [0, 1])))
    before = fit.vectors.copy(), fit.weights.copy(), fit.bias.copy()
    fit.step(chosen, labels, 0.5)
    for place, wanted in zip(places, vectors):
        assert fit.vectors[place] == pytest.approx((before[0][place] - 0.5 * wanted) * (1 - T.DECAY), rel=1e-5, abs=1e-9)
    assert np.allclose(before[1] - fit.weights, T.WEIGHT_RATE * np.reshape(weights, fit.weights.shape), rtol=1e-5, atol=1e-9)
    assert np.allclose(before[2] - fit.bias, T.WEIGHT_RATE * np.array(bias) / len(labels), rtol=1e-5, atol=1e-9)


def test_training_agrees_with_itself():
    rng = random.Random(4)
    said = [text(rng, i % 3 == 0, 40) for i in range(60)]
    labels = [int(i % 3 == 0) for i in range(60)]
    assert score(T.train(said, labels), said[0]) == score(T.train(said, labels), said[0])


def test_query(spark, texts):
    found = QUERIES["op3_toxicity"](spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_edge_cases(spark, edge, none, model):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 1, 1), (5, 1, 0), (8, 0, 7)], "doc_id long, quality int, toxic int")
    found = T.score_documents(spark, edge, labels).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in EDGE_TEXTS)
    assert not any(r["predicted"] for r in found)
    assert T.score_documents(spark, none, labels).collect() == []
    assert len(T.score_documents(spark, edge, labels.where("false")).collect()) == len(EDGE_TEXTS)
    kept = T.reject(spark, edge, model)
    assert kept.columns == edge.columns and kept.count() == edge.count()


def test_n_grams_are_added_up_by_parts_of_the_words(monkeypatch):
    texts = ["one two three -- four", "", "five six one !!! seven eight", "nine"]
    whole = T._Fit(texts)
    monkeypatch.setattr(T, "WORDS_AT_ONCE", 2)
    parts = T._Fit(texts)
    for name in ("count", "first", "bucket"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name))
    assert np.array_equal(whole.values(), parts.values())
    words = [word for text in texts for word in text.split()]
    words = list(dict.fromkeys(words))
    assert np.allclose(parts.values(), T.word_values(words, parts.vectors @ (parts.weights[:, 1] - parts.weights[:, 0])))
    assert not len(T._Fit([""]).values())
