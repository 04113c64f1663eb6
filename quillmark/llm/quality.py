"""Document quality: random-indexing word vectors, pooled per document, under a two-layer network with calibrated probabilities.

Tokens are runs of letters (lower-cased), digits or signs; a word in capitals and a word equal to the one before add a mark of
their own. In the learning sample each token of the vocabulary gets a sparse random index vector; its word vector sums the index
vectors of its neighbours within two places, scaled to unit length, plus its own index vector. A document is the mean vector of
all its tokens, those outside the vocabulary pooled by kind, with the logarithm of its length, the share of distinct tokens and
the shares of the marks. The network (tanh, then a sigmoid) is fitted by Adam with plain numpy; one temperature, fitted on part of
the sample, calibrates its probabilities.

The sample holds at most ``sample_rows`` labelled documents, those of smallest id hash, and at most ``sample_bytes`` bytes of their texts, whole texts;
a text beyond that bound is passed over. Every fifth row feeds neither the word vectors nor the network: these rows calibrate the temperature, with
smoothed targets, and give ``calibration_error``. Inputs of a score are the text alone. Null and empty texts have the features of no token and are scored like
any text; long texts are counted whole, one at a time. Equal texts and repeated rows get equal scores, each row its own; of several texts under one id the
sample takes the least, of several labels the least. Without both labels in the sample every score is the label's share. Empty tables give empty
results. Columns beyond those named are left out, whatever their names.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts

#: Bound of the learning sample, in documents.
SAMPLE_ROWS = 3000
#: Bound of the learning sample, in bytes of text.
SAMPLE_BYTES = 32_000_000
DIM = 64
VOCABULARY = 20_000
HIDDEN = 24
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
CAPS, REPEAT = "<caps>", "<repeat>"


def tokens(text: str) -> list[str]:
    """The token stream with marks, in order."""
    out, last = [], None
    for word in text.split():
        if len(word) > 1 and word.isupper():
            out.append(CAPS)
        if word == last:
            out.append(REPEAT)
        out += _TOKEN.findall(word.lower())
        last = word
    return out


def counts(text: str) -> Counter:
    """How often each token of the stream occurs, without building it."""
    words = text.split()
    out = Counter(_TOKEN.findall(text.lower()))
    out[CAPS] += sum(1 for w, up in zip(words, map(str.isupper, words), strict=True) if up and len(w) > 1)
    out[REPEAT] += sum(map(operator.eq, words, words[1:]))
    return +out


def unknown(token: str) -> str:
    """The kind that stands for a token outside the vocabulary."""
    return "<letters>" if token[0].isalpha() else "<digits>" if token[0].isdigit() else "<signs>"


def index_vector(token: str, dim: int = DIM) -> np.ndarray:
    """Sparse random index vector: six entries of +1 or -1 at places drawn from the token's hash."""
    r = np.random.default_rng(xxhash.xxh64_intdigest(token))
    out = np.zeros(dim)
    out[r.choice(dim, 6, replace=False)] = r.choice((-1.0, 1.0), 6)
    return out


@dataclass
class Classifier:
    row_of: dict
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float
    prior: float
    calibration_error: float = 0.0

    def features(self, text: str) -> np.ndarray:
        found, row_of = counts(text), self.row_of
        total = sum(found.values())
        if not total:
            return np.zeros(DIM + 4)
        weight: dict[int, int] = {}
        for t, n in found.items():
            i = row_of.get(t)
            if i is None:
                i = row_of[unknown(t)]
            weight[i] = weight.get(i, 0) + n
        at = np.fromiter(weight.keys(), np.int64, len(weight))
        n = np.fromiter(weight.values(), np.float64, len(weight))
        pooled = n @ self.vectors[at] / total
        return np.concatenate([pooled, [np.log1p(total), len(found) / total, found[CAPS] / total, found[REPEAT] / total]])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        # sums row by row, so that a text's score doesn't depend on its batch
        hidden = np.tanh(np.einsum("ij,jk->ik", (x - self.mean) / self.scale, w1) + b1)
        return np.einsum("ij,j->i", hidden, w2) + b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.prior)
        x = np.array([self.features(t or "") for t in texts]).reshape(len(texts), DIM + 4)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def word_vectors(texts: list[str], window: int = 2) -> tuple[dict, np.ndarray]:
    """Random indexing over the token streams of texts: rows of the vocabulary and their vectors. One stream is held at a time."""
    tally = Counter()
    for t in texts:
        tally.update(counts(t))
    kinds = ["<letters>", "<digits>", "<signs>", CAPS, REPEAT]
    common = sorted((t for t, n in tally.items() if n >= 3 and t not in kinds), key=lambda t: (-tally[t], t))[:VOCABULARY]
    row_of = {t: i for i, t in enumerate([*kinds, *common])}
    index = np.array([index_vector(t) for t in row_of])
    context = np.zeros_like(index)
    for text in texts:
        ids = np.array([row_of[t] if t in row_of else row_of[unknown(t)] for t in tokens(text)], np.int64)
        if len(ids) < 2:
            continue
        near = np.zeros((len(ids), index.shape[1]))
        for d in range(1, window + 1):
            near[d:] += index[ids[:-d]]
            near[:-d] += index[ids[d:]]
        order = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
        context[ids[order][starts]] += np.add.reduceat(near[order], starts, axis=0)
    size = np.linalg.norm(context, axis=1, keepdims=True)
    return row_of, context / np.maximum(size, 1e-9) + index / np.linalg.norm(index, axis=1, keepdims=True)


def fitted_temperature(logit: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """The temperature of least loss on rows that nothing learned from, and the calibration error there.

    Targets are smoothed by one row of either label, so that rows without a mistake don't push the temperature to zero.
    """
    wanted = (truth * len(truth) + 0.5) / (len(truth) + 1)

    def loss(log_t):
        z = logit / np.exp(log_t)
        return (np.logaddexp(0, z) - wanted * z).mean()

    grid = np.linspace(np.log(1e-3), np.log(1e4), 200)
    best = int(np.argmin([loss(x) for x in grid]))
    low, high = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    for _ in range(40):  # golden section
        a, b = high - 0.618 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    t = float(np.exp((low + high) / 2))
    p = 1 / (1 + np.exp(-np.clip(logit / t, -500, 500)))
    bins = np.minimum((p * 10).astype(int), 9)
    return t, float(sum(abs(p[bins == b].sum() - truth[bins == b].sum()) for b in range(10)) / len(truth))


def fit(rows: list[tuple[str, int]], epochs: int = 400, seed: int = 3) -> Classifier:
    """A classifier from (text, label) rows; every fifth row only calibrates the temperature."""
    y = np.array([r[1] for r in rows], float)
    prior = float(y.mean()) if len(y) else 0.5
    held = np.arange(len(y)) % 5 == 4
    row_of, vectors = word_vectors([t for (t, _), h in zip(rows, held, strict=True) if not h])
    model = Classifier(row_of, vectors, np.zeros(DIM + 4), np.ones(DIM + 4), None, 1.0, prior)
    if len(set(y[~held].tolist())) < 2:
        return model
    x = np.array([model.features(t) for t, _ in rows])
    model.mean, model.scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6
    z, t = (x[~held] - model.mean) / model.scale, y[~held]
    r = np.random.default_rng(seed)
    p = [r.standard_normal((z.shape[1], HIDDEN)) / np.sqrt(z.shape[1]), np.zeros(HIDDEN), r.standard_normal(HIDDEN) / np.sqrt(HIDDEN), 0.0]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, epochs + 1):
        h = np.tanh(z @ p[0] + p[1])
        q = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -500, 500)))
        d = (q - t) / len(t)
        dh = np.outer(d, p[2]) * (1 - h * h)
        grads = [z.T @ dh + 1e-3 * p[0], dh.sum(axis=0), h.T @ d + 1e-3 * p[2], d.sum()]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model.layers = tuple(p)
    if held.any():
        model.temperature, model.calibration_error = fitted_temperature(model.logits(x[held]), y[held])
    return model


def sample(docs: DataFrame, labels: DataFrame, learnable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """The bounded learning sample; ``learnable`` is a condition on the labels' id. The ids are chosen, and their texts measured, before texts are read."""
    known = labels.where(learnable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.struct(F.octet_length(text).cast("bigint").alias("bytes"), text.alias("text")).alias("row"))
    sizes = rows.select("id", F.col("row.bytes").alias("bytes")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("bytes").alias("bytes"))
    # at most sample_rows rows: a window without partition
    so_far = F.sum("bytes").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    kept = sizes.where(F.col("bytes") <= sample_bytes // 8).withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes).select("id")
    # one text an id, so that repeated rows can't make the sample grow past its bound
    got = rows.join(F.broadcast(chosen.join(kept, "id", "left_semi")), "id").groupBy("id").agg(F.min("label").alias("label"), F.min("row").alias("row")).collect()
    return [(r["row"]["text"], r["label"]) for r in sorted(got, key=lambda r: xxhash.xxh64_intdigest(str(r["id"])))]


def score(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``also``, ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY * DIM

    def make():
        trained = shared.value
        return lambda texts: {"score": trained.scores(texts)}

    return map_texts(df, id_col, text_col, "score double", make, also)
