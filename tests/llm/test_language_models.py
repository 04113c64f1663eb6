"""Language models against Kneser-Ney by dictionaries; any number of languages; long texts; calibration."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from quillmark.llm import langid


class PlainKneserNey:
    """Interpolated Kneser-Ney over tuples, with the operator's character classes."""

    def __init__(self, texts, order, size):
        self.order, self.uniform = order, 1 / size
        self.count = [defaultdict(int) for _ in range(order)]
        grams = [set() for _ in range(order)]
        for chars in texts:
            for k in range(order):
                for i in range(max(k, 1), len(chars)):
                    gram = tuple(chars[i - k : i + 1])
                    grams[k].add(gram)
                    if k == order - 1:
                        self.count[k][gram] += 1
        for k in range(order - 1):
            left = defaultdict(set)
            for gram in grams[k + 1]:
                left[gram[1:]].add(gram[0])
            for gram in grams[k]:
                self.count[k][gram] = len(left[gram]) or 1
        self.less, self.total, self.kinds = [], [], []
        for k in range(order):
            n = list(self.count[k].values())
            once, twice = n.count(1), n.count(2)
            self.less.append(min(0.95, max(0.1, once / (once + 2 * twice))) if once else langid.DISCOUNT)
            total, kinds = defaultdict(int), defaultdict(int)
            for gram, c in self.count[k].items():
                total[gram[:-1]] += c
                kinds[gram[:-1]] += 1
            self.total.append(total)
            self.kinds.append(kinds)

    def p(self, gram):
        k, context = len(gram) - 1, gram[:-1]
        lower = self.p(gram[1:]) if k else self.uniform
        if context not in self.total[k]:
            return lower
        total = self.total[k][context]
        return max(self.count[k].get(gram, 0) - self.less[k], 0) / total + self.less[k] * self.kinds[k][context] / total * lower

    def entropy(self, chars):
        return -sum(math.log(self.p(tuple(chars[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(chars))) / (len(chars) - 1)


def texts_of(seed, letters, n=6):
    r = random.Random(seed)
    return [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(r.randint(3, 30))) + r.choice((" 12.", "!", "")) for _ in range(n)]


@pytest.mark.parametrize("together", [1, 2, 8])
def test_entropies_match_dictionaries(together):
    sets = {"aa": texts_of(1, "abcde"), "bb": texts_of(2, "cdefg"), "cc": texts_of(3, "aeiouß")}
    learned = {k: [langid.characters(t) for i, t in enumerate(v) if i % 5] for k, v in sets.items()}
    model = langid.fit([(k, t) for k, v in sets.items() for t in v], together=together)
    size = langid.alphabet(learned)
    plain = {k: PlainKneserNey([c.tolist() for c in v], langid.ORDER, size) for k, v in learned.items()}
    asked = texts_of(4, "abcdefgßxyz", 12) + ["a", "  b", "Ab Cd 99"]
    got = model.entropies(asked)
    for t, row in zip(asked, got, strict=True):
        assert np.allclose(row, [plain[k].entropy(langid.characters(t).tolist()) for k in model.languages], rtol=2e-5), t


def test_any_number_of_languages_is_learned():
    r = random.Random(5)
    parts = {f"l{i:02}": ["".join(r.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(4)] for i in range(70)}
    make = lambda k: " ".join(r.choice(parts[k]) for _ in range(60))
    model = langid.fit([(k, make(k)) for k in parts for _ in range(6)])
    assert model.languages == sorted(parts) and len(model.parts) == 9
    assert model.predict([make(k) for k in parts])["lang_pred"] == list(parts)


def test_long_texts_are_scored_whole(monkeypatch):
    model = langid.fit([("aa", t) for t in texts_of(6, "abcde", 10)] + [("bb", t) for t in texts_of(7, "defgh", 10)])
    long = "  ".join(texts_of(8, "abcdefgh", 400)) + "   \n x"
    whole = model.entropies([long])
    monkeypatch.setattr(langid, "PIECE", 97)
    assert np.allclose(model.entropies([long, "a", long]), np.concatenate([whole, model.entropies(["a"]), whole]), rtol=1e-6)
    monkeypatch.undo()
    assert model.predict([long * 300])["lang_pred"][0] in ("aa", "bb")


def test_temperature_lies_inside_its_range():
    r = np.random.default_rng(9)
    truth = r.integers(0, 3, 400)
    e = 2 + 0.1 * r.standard_normal((400, 3))
    e[np.arange(400), truth] -= 0.5  # no mistake to be seen
    t, error = langid.fitted_temperature(e, truth)
    assert 1e-3 < t < 1 and error < 0.05
    e[np.arange(400), truth] += 0.4  # many mistakes
    worse, error = langid.fitted_temperature(e, truth)
    assert worse > 0 and error < 0.15
    sure = 1 / np.exp((e.min(axis=1, keepdims=True) - e) / worse).sum(axis=1)
    assert abs(sure.mean() - (e.argmin(axis=1) == truth).mean()) < 0.1


def test_sample_is_bounded_in_rows_and_bytes(spark):
    rows = [(i, "a" * (10 + i % 7), "aa" if i % 2 else "bb") for i in range(100)] + [(200, "x" * 5000, "aa"), (201, None, "aa"), (202, "y", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    from pyspark.sql import functions as F

    got = langid.sample(df, F.lit(True), "doc_id", "text", "lang", per_language=20, language_bytes=150)
    for lang in ("aa", "bb"):
        mine = [t for k, t in got if k == lang]
        assert 0 < len(mine) <= 20 and sum(map(len, mine)) <= 150 and all(len(t) < 100 for t in mine)


def test_every_language_and_every_id_is_learned(spark):
    """A language of huge texts only, an id with texts in two languages, null ids, and a bound over all languages."""
    from pyspark.sql import functions as F

    rows = [(i, "a" * 50, "aa") for i in range(9)] + [(1, "b" * 60, "bb"), (None, "c" * 20, "cc"), (50, "d" * 9000, "dd"), (51, "é" * 8000, "dd"), (60, "short", "ee"), (61, "e" * 9000, "ee")]
    df = spark.createDataFrame(rows + rows[:3], "doc_id int, text string, lang string")
    got = langid.sample(df, F.lit(True), "doc_id", "text", "lang", language_bytes=400)
    by = {lang: [t for k, t in got if k == lang] for lang in "aa bb cc dd ee".split()}
    assert by == {"aa": ["a" * 50] * 8, "bb": ["b" * 60], "cc": ["c" * 20], "dd": ["d" * 100], "ee": ["short"]}
    got = langid.sample(df, F.lit(True), "doc_id", "text", "lang", total_bytes=500)
    assert {k for k, _ in got} == set(by) and all(sum(len(t.encode()) for k, t in got if k == lang) <= 100 for lang in by)
