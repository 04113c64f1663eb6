"""Counts against plain Python, the model against plain rounds of expectation-maximisation, verdicts against labels, odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.llm import quality_rules as q

DOCS = "doc_id bigint, text string, n_words string, pattern string, quality double, id int"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", 0.0, 1) for i, t in texts], DOCS).repartition(3)


def test_counts(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("a b c d é ## x|y\n \n\n".split(" ")) for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "x\x1cy z\xa0w", "<a>" * 30_000, "one two three " * 20_000, "\n".join(["same line"] * 50), "tab\tis space\x0bso\x0cis\rthis"]
    texts += [" ".join(str(r.random()) for _ in range(50_000)), texts[0], texts[0]]
    got = {x["id"]: tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for x in q.measured(frame(spark, enumerate(texts))).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def plain_model(votes):
    """Posterior of every tuple of votes (-1, 0, 1)."""
    told = [list(q.RULES.values())[j] for j in range(len(q.RULES))]
    chance = [[[x for x in told[j][side]] for j in range(len(told))] for side in (0, 1)]
    prior, n, counts = q.PRIOR, len(votes), Counter(votes)

    def good(v):
        a, b = (math.prod(chance[side][j][x + 1] for j, x in enumerate(v)) for side in (0, 1))
        return prior * a / (prior * a + (1 - prior) * b)

    for _ in range(q.ROUNDS):
        seems, weight = {v: good(v) for v in counts}, n * q.TRUST + q.LEAST
        total = sum(c * seems[v] for v, c in counts.items())
        new = []
        for side, share in ((0, q.PRIOR), (1, 1 - q.PRIOR)):
            rows = [[weight * share * told[j][side][k] + sum(c * (seems[v] if side == 0 else 1 - seems[v]) for v, c in counts.items() if v[j] + 1 == k) for k in range(3)] for j in range(len(told))]
            new.append([[x / sum(row) for x in row] for row in rows])
        chance, prior = new, (total + weight * q.PRIOR) / (n + weight)
    return {v: good(v) for v in counts}


def test_model(spark):
    r = random.Random(5)
    votes = [tuple(-1 if r.random() < p else 0 for _ in range(len(q.RULES) - 2)) + (r.choice([-1, 0, 1]), 0) for p in [0.01] * 300 + [0.3] * 60]
    number = lambda v: sum((x + 1) * 3**k for k, x in enumerate(v))
    got = {x["pattern"]: x["quality"] for x in q.fitted(spark.createDataFrame([(number(v),) for v in votes], "pattern int")).collect()}
    for v, want in plain_model(votes).items():
        assert got[number(v)] == pytest.approx(want, rel=1e-9)


def test_verdicts(spark, sf_dir):
    """Of the labelled documents that pass the base rules, good ones are kept and bad ones go."""
    got = q.judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("not base_failed").select("doc_id", "kept")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    table = {(x["label"], x["kept"]): x["count"] for x in got.join(labels, "doc_id").groupBy("label", "kept").count().collect()}
    assert table[1, True] >= 0.99 * (table[1, True] + table.get((1, False), 0)) and table.get((0, True), 0) <= 0.05 * (table.get((0, False), 0) + table.get((0, True), 0))


def test_odd_rows(spark):
    good = "This is a sentence of some length that says what others did. " + " ".join(f"Word{i} follows word{i + 1} here." for i in range(30))
    rows = [(1, good), (1, good), (None, good), (2, None), (3, ""), (4, "###$$$ %%%& " * 40), (5, "one two three " * 40), (6, good + " plus"), (7, "漢字" * 50_000)]
    got = q.judged(frame(spark, rows)).collect()
    assert len(got) == len(rows) and len({x["quality"] for x in got if x["doc_id"] == 1}) == 1
    by = {x["doc_id"]: x for x in got}
    assert by[1]["kept"] and by[None]["kept"] and not any(by[k]["kept"] for k in (2, 3, 4, 5, 7)) and all(by[k]["base_failed"] for k in (2, 3, 5, 7))
    assert q.judged(frame(spark, []).limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = q.judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
