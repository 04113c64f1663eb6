"""Word vectors, features and scores against plain loops; calibration; the sample's bounds."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import quality


def rows_of(seed, n=150):
    r = random.Random(seed)
    good, bad = [f"w{i}" for i in range(40)], ["buy", "now", "click", "$$$", "FREE"]
    return [(" ".join(r.choice(good if y or r.random() < 0.7 else bad) for _ in range(r.randint(5, 40))), y) for i in range(n) for y in [i % 2]]


def plain_vectors(texts, window=2):
    """Random indexing, token by token."""
    streams = [quality.tokens(t) for t in texts]
    tally = {}
    for s in streams:
        for t in s:
            tally[t] = tally.get(t, 0) + 1
    kinds = ["<letters>", "<digits>", "<signs>", quality.CAPS, quality.REPEAT]
    vocabulary = [*kinds, *sorted((t for t, n in tally.items() if n >= 3 and t not in kinds), key=lambda t: (-tally[t], t))]
    index = {t: quality.index_vector(t) for t in vocabulary}
    name = lambda t: t if t in index else quality.unknown(t)
    context = {t: np.zeros(quality.DIM) for t in vocabulary}
    for s in streams:
        for i, t in enumerate(s):
            for j in range(max(0, i - window), min(len(s), i + window + 1)):
                if j != i:
                    context[name(t)] = context[name(t)] + index[name(s[j])]
    out = {}
    for t in vocabulary:
        size = math.sqrt(sum(x * x for x in context[t]))
        out[t] = context[t] / max(size, 1e-9) + index[t] / math.sqrt(6)
    return out


def test_vectors_and_scores_match_plain_loops():
    rows = rows_of(1)
    model = quality.fit(rows, epochs=60)
    plain = plain_vectors([t for i, (t, _) in enumerate(rows) if i % 5 != 4])
    assert set(model.row_of) == set(plain)
    assert all(np.allclose(model.vectors[i], plain[t]) for t, i in model.row_of.items())
    w1, b1, w2, b2 = model.layers
    for text in [t for t, _ in rows[:20]] + ["", None, "unseen 99 ?? Words", "FREE FREE now"]:
        s = quality.tokens(text or "")
        x = np.zeros(quality.DIM + 4)
        if s:
            for t in s:
                x[: quality.DIM] += plain[t if t in plain else quality.unknown(t)] / len(s)
            x[quality.DIM :] = [math.log(1 + len(s)), len(set(s)) / len(s), s.count(quality.CAPS) / len(s), s.count(quality.REPEAT) / len(s)]
        hidden = [math.tanh(sum((x[i] - model.mean[i]) / model.scale[i] * w1[i, h] for i in range(len(x))) + b1[h]) for h in range(quality.HIDDEN)]
        logit = sum(a * b for a, b in zip(hidden, w2, strict=True)) + b2
        assert math.isclose(model.scores([text])[0], 1 / (1 + math.exp(-logit / model.temperature)), rel_tol=1e-9)


def test_held_rows_feed_only_the_temperature():
    rows = rows_of(2)
    other = [("only here " * 9, 1 - y) if i % 5 == 4 else (t, y) for i, (t, y) in enumerate(rows)]
    a, b = quality.fit(rows, epochs=30), quality.fit(other, epochs=30)
    assert a.row_of == b.row_of and np.array_equal(a.vectors, b.vectors) and np.array_equal(a.layers[0], b.layers[0]) and a.temperature != b.temperature


def test_temperature_lies_inside_its_range():
    r = np.random.default_rng(3)
    truth = r.integers(0, 2, 500).astype(float)
    t, error = quality.fitted_temperature((truth * 2 - 1) * 20, truth)
    assert 0.5 < t < 20 and error < 0.05
    noisy = np.where(r.random(500) < 0.8, truth, 1 - truth)
    t, error = quality.fitted_temperature((noisy * 2 - 1) * 20, truth)
    assert 5 < t < 50 and error < 0.05


def test_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "a" * 100) for i in range(50)] + [(3, "b"), (60, "c" * 5000), (61, None)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)] + [(3, 0)], "doc_id int, quality int")
    got = quality.sample(docs, labels, F.lit(True), sample_rows=40, sample_bytes=2000)
    assert 10 < len(got) <= 40 and sum(len(t) for t, _ in got) <= 2000 and all(len(t) <= 250 for t, _ in got)
    assert len(quality.sample(docs, labels, F.lit(True))) == 52


def test_very_long_texts_are_scored_whole():
    model = quality.fit(rows_of(4), epochs=30)
    long = " ".join(f"w{i % 40}" for i in range(1_000_000))
    tail = long + " buy now click" * 400_000
    one, other = model.scores([long, tail])
    assert 0 <= other < one <= 1 and model.scores([long])[0] == one and model.features(tail)[quality.DIM] > 14
