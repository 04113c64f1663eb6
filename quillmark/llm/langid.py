"""Language identification by interpolated Kneser-Ney character models.

For each language a model of order ``ORDER`` over lower-cased characters (digits one class, white space one, other signs one) is
estimated from a bounded sample of labelled documents: absolute discounting (the discount of each order from its counts of once and
twice seen n-grams), continuation counts for the lower orders, and interpolation down to a uniform distribution. The models of up to
``TOGETHER`` languages share sorted arrays of 64-bit n-gram hashes with one row of log probabilities and of log back-off weights a language,
so that scoring a character is a binary search in its longest known n-gram; memory grows with the number of languages, not its square.

A document's score of a language is its cross-entropy per character, over the whole text, in windows of ``PIECE`` characters. The lowest wins, the
first by name on ties; the confidence is a softmax of the negated cross-entropies at a temperature fitted on rows of the sample that no model
learned from, with smoothed targets. Rejection: a text without a letter is ``und``; one whose best cross-entropy exceeds the
``reject_quantile`` quantile of that language's own held-out documents is marked ``rejected``.

The sample holds, for every language of the learnable rows, at most ``per_language`` documents (those of smallest id hash) and ``language_bytes`` bytes of
text, ``total_bytes`` over all languages. Whole texts are taken; a language whose texts all exceed its bound is learned from the beginning of the smallest. Scoring covers all of every text. Null and empty text: ``und`` with score 0. No labelled row:
every prediction is ``und``. Equal texts and repeated rows get equal predictions, each row its own; of several texts of one id, language and length the sample takes
the least, and an id with texts in several languages serves each of them. Empty tables give empty results. Columns beyond those named are left out, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts

ORDER = 4
#: Bound of the learning sample, in documents a language.
PER_LANGUAGE = 120
#: Bound of the learning sample, in bytes of text a language.
LANGUAGE_BYTES = 2_000_000
#: Bound of the whole sample, in bytes: with more than TOTAL_BYTES / LANGUAGE_BYTES languages each has an equal part of it.
TOTAL_BYTES = 64_000_000
#: Languages whose models share their arrays.
TOGETHER = 8
#: Characters that are scored at once.
PIECE = 200_000
#: The discount where no n-gram was seen once.
DISCOUNT = 0.75
REJECT_QUANTILE = 0.995
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _DIGIT, _SIGN = 1, 2, 3


def _classes() -> np.ndarray:
    """Character classes of the basic plane: letters by their lower case, and one each for space, digits and signs."""
    out = np.full(65536, _SIGN, np.uint32)
    for c in range(65536):
        s = chr(c)
        if s.isspace():
            out[c] = _SPACE
        elif s.isalpha():
            low = s.lower()
            out[c] = ord(low) + 16 if len(low) == 1 else c + 16
        elif s.isdigit():
            out[c] = _DIGIT
    return out


_TABLE: list = []


def classes_of(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 65536, _TABLE[0][np.minimum(codes, 65535)], codes + np.uint32(16))


def pieces(text: str, size: int | None = None) -> Iterator[np.ndarray]:
    """The text's character classes after a leading space, runs of space once, in pieces."""
    last = None
    for a in range(0, len(text) or 1, size or max(1, len(text))):
        out = classes_of((" " if last is None else "") + text[a : a + size if size else None])
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != _SPACE) | (out[:-1] != _SPACE)
        keep[0] = out[0] != _SPACE or last != _SPACE
        last = out[-1]
        yield out[keep]


def characters(text: str) -> np.ndarray:
    return next(pieces(text))


def hashes(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """[k]: 64-bit hash of the k + 1 characters that end at each place (meaningful from place k on)."""
    x = chars.astype(np.uint64) + np.uint64(1)
    out = [x * _MUL]
    for k in range(1, order):
        prior = np.zeros(len(x), np.uint64)
        prior[k:] = x[: len(x) - k]
        before = out[-1]
        out.append((before ^ before >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + (prior + np.uint64(7919 * k)) * _MUL)
    return out


@dataclass
class Models:
    """Models of some languages over shared arrays."""

    languages: list
    keys: list  # [k]: sorted hashes of the known n-grams of k + 1 characters
    logp: list  # [k]: (n-grams, languages)
    logb: list  # [k]: back-off weight if the n-gram is a context
    floor: np.ndarray

    def totals(self, chars: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(characters, languages): log probability of each character; ``place`` is its place in its text."""
        order, h = len(self.keys), hashes(chars, len(self.keys))
        total = np.zeros((len(chars), len(self.languages)), np.float32)
        todo = np.flatnonzero(place > 0)  # the leading space is context only
        for k in range(order - 1, -1, -1):
            can = place[todo] >= k
            at, short = todo[can], todo[~can]
            i, hit = find(self.keys[k], h[k][at])
            total[at[hit]] += self.logp[k][i[hit]]
            miss = at[~hit]
            if k and len(miss):  # the context is the n-gram of k characters that ends one before
                j, known = find(self.keys[k - 1], h[k - 1][miss - 1])
                total[miss[known]] += self.logb[k - 1][j[known]]
            elif not k:
                total[miss] += self.floor
            todo = np.concatenate([miss, short])
        return total


@dataclass
class Identifier:
    """The models of all languages, with what calibrates and rejects."""

    parts: list
    temperature: float = 1.0
    limit: np.ndarray | None = None
    calibration_error: float = 0.0

    @property
    def languages(self) -> list:
        return [x for p in self.parts for x in p.languages]

    def _sums(self, chars: np.ndarray, place: np.ndarray, starts) -> np.ndarray:
        return np.concatenate([np.add.reduceat(p.totals(chars, place), starts, axis=0, dtype=np.float64) for p in self.parts], axis=1)

    def long_entropy(self, text: str) -> np.ndarray:
        """Of one text, window by window: each sees the characters before it as context."""
        context, done, total = np.empty(0, np.uint32), 0, 0.0
        for chars in pieces(text, PIECE):
            if not len(chars):
                continue
            every = np.concatenate([context, chars])
            place = np.arange(len(every)) + done - len(context)
            total = total + self._sums(every, place, [0, len(context)] if len(context) else [0])[-1]
            done += len(chars)
            context = every[-ORDER:]
        return -total / max(done - 1, 1)

    def entropies(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): nats per character."""
        out = np.zeros((len(texts), sum(len(p.languages) for p in self.parts)))
        held, size = [], 0
        for i, t in enumerate([*texts, None]):
            if held and (t is None or size + len(t) > PIECE):
                parts = [characters(texts[j]) for j in held]
                lengths = np.array([len(p) for p in parts])
                starts = np.cumsum(lengths) - lengths
                place = np.arange(lengths.sum()) - np.repeat(starts, lengths)
                out[held] = -self._sums(np.concatenate(parts), place, starts) / np.maximum(lengths - 1, 1)[:, None]
                held, size = [], 0
            if t is not None and len(t) > PIECE:
                out[i] = self.long_entropy(t)
            elif t is not None:
                held.append(i)
                size += len(t)
        return out

    def predict(self, texts: list[str]) -> dict[str, list]:
        out = {"lang_pred": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts), "cross_entropy": [None] * len(texts), "rejected": [True] * len(texts)}
        some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not some or not self.parts:
            return out
        e, languages = self.entropies([texts[i] for i in some]), self.languages
        best = e.argmin(axis=1)
        low = e[np.arange(len(e)), best]
        p = 1 / np.exp((low[:, None] - e) / self.temperature).sum(axis=1)
        for i, b, x, q in zip(some, best.tolist(), low.tolist(), p.tolist(), strict=True):
            out["lang_pred"][i], out["score"][i], out["cross_entropy"][i] = languages[b], q, x
            out["rejected"][i] = x > self.limit[b]
        return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.searchsorted(keys, wanted)
    i[i == len(keys)] = 0
    return i, keys[i] == wanted


def discount(n: np.ndarray) -> float:
    """Absolute discount from the numbers of n-grams with count one and two."""
    once, twice = int((n == 1).sum()), int((n == 2).sum())
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else DISCOUNT


def alphabet(chars_by_language: dict[str, list[np.ndarray]]) -> int:
    """How many characters there are to predict, one for the unknown ones included."""
    seen = [np.unique(c[1:]) for cs in chars_by_language.values() for c in cs]
    return len(np.unique(np.concatenate(seen))) + 1 if seen else 1


def estimate(chars_by_language: dict[str, list[np.ndarray]], order: int = ORDER, size: int | None = None) -> Models:
    """Interpolated Kneser-Ney models of these languages over shared key arrays; ``size``: the alphabet's, if other languages share it."""
    languages = sorted(chars_by_language)
    if not languages:
        none = np.zeros((0, 0), np.float32)
        return Models([], [np.zeros(0, np.uint64)] * order, [none] * order, [none] * order, np.zeros(0, np.float32))
    counted = [{} for _ in range(order)]  # [k][language]: (keys, lower-order key, context key, count or continuation count)
    for name in languages:
        grams = [[] for _ in range(order)]
        for chars in chars_by_language[name]:
            h = hashes(chars, order)
            for k in range(order):
                at = np.arange(max(k, 1), len(chars))
                lower = h[k - 1][at] if k else np.zeros(len(at), np.uint64)
                context = h[k - 1][at - 1] if k else np.zeros(len(at), np.uint64)
                grams[k].append(np.stack([h[k][at], lower, context]))
        joined = [np.concatenate(g, axis=1) if g else np.zeros((3, 0), np.uint64) for g in grams]
        uniq = []
        for g in joined:
            keys, first, n = np.unique(g[0], return_index=True, return_counts=True)
            uniq.append([keys, g[1][first], g[2][first], n.astype(float)])
        for k in range(order - 1):  # continuation: distinct n-grams of the next order that end in this one
            keys, n = np.unique(uniq[k + 1][1], return_counts=True)
            i, hit = find(keys, uniq[k][0])
            uniq[k][3] = np.where(hit, n[i], 1).astype(float)
        for k in range(order):
            counted[k][name] = uniq[k]
    uniform = 1.0 / (size or alphabet(chars_by_language))
    keys = [np.unique(np.concatenate([counted[k][n][0] for n in languages])) for k in range(order)]
    models = Models(languages, keys, [], [], np.zeros(len(languages), np.float32))
    probs: list[np.ndarray] = []
    ctx_of, low_of = {}, {}  # [k]: context hash and lower-order row of each n-gram of k + 1 characters
    weights: list[np.ndarray] = []  # back-off weight of each known n-gram of k + 1 characters as a context
    for k in range(order):
        prob, weight = np.zeros((len(keys[k]), len(languages))), np.ones((len(keys[k]), len(languages)))
        for li, name in enumerate(languages):
            own, _, context, n = counted[k][name]
            contexts, where = np.unique(context, return_inverse=True)
            total = np.bincount(where, n, minlength=len(contexts))
            kinds = np.bincount(where, minlength=len(contexts))
            less = discount(n)
            gamma = less * kinds / np.maximum(total, 1e-9)
            if k == 0:
                base = np.full(len(keys[0]), uniform)
                g = np.full(len(keys[0]), gamma[0] if len(gamma) else 1.0)
                models.floor[li] = math.log((gamma[0] if len(gamma) else 1.0) * uniform)
            else:
                i, hit = find(contexts, ctx_of[k])
                g = np.where(hit, gamma[i] if len(gamma) else 1.0, 1.0)
                base = probs[k - 1][low_of[k], li]
                j, known = find(keys[k - 1], contexts)
                weights[k - 1][j[known], li] = gamma[known]
            prob[:, li] = g * base
            i, hit = find(keys[k], own)
            prob[i, li] += np.maximum(n - less, 0) / np.maximum(total[where], 1e-9)
        probs.append(prob)
        weights.append(weight)
        if k + 1 < order:
            every = [np.concatenate([counted[k + 1][n][c] for n in languages]) for c in range(3)]
            _, first = np.unique(every[0], return_index=True)
            ctx_of[k + 1] = every[2][first]
            low_of[k + 1] = np.searchsorted(keys[k], every[1][first])
    models.logp = [np.log(p).astype(np.float32) for p in probs]
    models.logb = [np.log(w).astype(np.float32) for w in weights]
    return models


def fitted_temperature(e: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """The temperature of least loss on rows that no model learned from, and the calibration error there.

    Targets are smoothed by one row of each other language, so that rows without a mistake don't push the temperature to zero.
    """
    n, k = e.shape
    if k < 2:
        return 1.0, 0.0
    z0 = e.min(axis=1, keepdims=True) - e
    wanted = np.full((n, k), 1 / (n + k))
    wanted[np.arange(n), truth] += n / (n + k)

    def loss(log_t):
        z = z0 / math.exp(log_t)
        return -(wanted * (z - np.logaddexp.reduce(z, axis=1, keepdims=True))).sum() / n

    grid = np.linspace(math.log(1e-5), math.log(100), 200)
    best = int(np.argmin([loss(x) for x in grid]))
    low, high = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    for _ in range(40):  # golden section
        a, b = high - 0.618 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    t = math.exp((low + high) / 2)
    sure = 1 / np.exp(z0 / t).sum(axis=1)
    right = (e.argmin(axis=1) == truth).astype(float)
    bins = np.minimum((sure * 10).astype(int), 9)
    error = sum(abs(sure[bins == b].sum() - right[bins == b].sum()) for b in range(10)) / n
    return t, float(error)


def fit(rows: list[tuple[str, str]], order: int = ORDER, reject_quantile: float = REJECT_QUANTILE, together: int = TOGETHER) -> Identifier:
    """Models from (language, text) rows; every fifth row of a language only calibrates the temperature and the rejection limits."""
    by: dict[str, list[str]] = {}
    for lang, t in rows:
        if t and _LETTER.search(t):
            by.setdefault(lang, []).append(t)
    learn = {lang: [characters(t) for i, t in enumerate(ts) if i % 5 or len(ts) < 5] for lang, ts in sorted(by.items())}
    size, names = alphabet(learn), list(learn)
    model = Identifier([estimate({x: learn[x] for x in names[i : i + together]}, order, size) for i in range(0, len(names), together)])
    model.limit = np.full(len(names), np.inf)
    check = [(lang, t) for lang, ts in by.items() if len(ts) >= 5 for i, t in enumerate(ts) if not i % 5]
    if check:
        e = model.entropies([t for _, t in check])
        truth = np.array([names.index(lang) for lang, _ in check])
        model.temperature, model.calibration_error = fitted_temperature(e, truth)
        for li in range(len(names)):
            own = e[truth == li, li]
            if len(own) >= 3:
                model.limit[li] = np.quantile(own, reject_quantile) + 3 * own.std()
    return model


def sample(
    df: DataFrame, learnable, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, language_bytes: int = LANGUAGE_BYTES, total_bytes: int = TOTAL_BYTES,
) -> list[tuple[str, str]]:
    """The bounded learning sample of every language: rows are picked by id first, so that only their texts are moved."""
    rows = df.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.octet_length(text_col).cast("bigint").alias("bytes")).distinct()
    limit = min(language_bytes, total_bytes // max(1, known.select("lang").distinct().count()))
    long = F.col("bytes") > limit
    # whole texts first; of those beyond the bound only the smallest counts, where nothing else is there
    order = Window.partitionBy("lang").orderBy(long, F.when(long, F.col("bytes")).otherwise(0), F.xxhash64("id"), "id", "bytes")
    # a top-k within each language: Spark limits the groups before the shuffle
    first = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).where(~long | (F.col("rank") == 1))
    so_far = F.sum(F.least("bytes", F.lit(limit))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("so_far", so_far).where(F.col("so_far") <= limit).select(F.col("lang").alias("_lang"), F.col("id").alias("_id"), F.col("bytes").alias("_bytes"))
    # at most per_language rows a language
    held = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(lang_col) == F.col("_lang")) & (F.octet_length(text_col) == F.col("_bytes"))
    # a character has at most four bytes
    text = F.when(F.col("_bytes") > limit, F.left(text_col, F.lit(max(1, limit // 4)))).otherwise(F.col(text_col))
    # one text a row of the choice, so that repeated rows can't make the sample grow past its bound
    got = rows.join(F.broadcast(chosen), held).groupBy("_lang", "_id", "_bytes").agg(F.min(text).alias("text")).collect()
    return [(r["_lang"], r["text"]) for r in sorted(got, key=lambda r: (r["_lang"], r["_id"] is None, r["_id"] or 0, r["_bytes"]))]


def identify(df: DataFrame, models: Identifier, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``lang_pred``, ``score``, ``cross_entropy`` (nats a character), ``rejected``."""
    shared = df.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def make():
        return shared.value.predict

    return map_texts(df, id_col, text_col, "lang_pred string, score double, cross_entropy double, rejected boolean", make, also)
