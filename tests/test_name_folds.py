"""Names of one field folded in order: the kernel against every pair, groups over several batches, nulls."""

import random

import pytest

from quillmark.operators import matching


def plain_fold(keys):
    cur, holds = list(keys), list(range(len(keys)))
    for i in range(len(cur)):
        for j in range(i + 1, len(cur)):
            a, b = cur[i], cur[j]
            if a and b and min(len(a), len(b)) >= 5 and abs(len(a) - len(b)) == 1 and (a in b or b in a):
                s = j if len(b) > len(a) else i
                cur[i] = cur[j] = cur[s]
                holds[i] = holds[j] = holds[s]
    return [keys[h] for h in holds]


@pytest.mark.parametrize("seed", range(30))
def test_fold(seed):
    r = random.Random(seed)
    words = ["aaaaaaaaaaaa"[: r.randint(3, 12)] for _ in range(6)] + ["abcdefghij"[a : r.randint(6, 10)] for a in range(4)] + [None, ""]
    keys = [r.choice(words) for _ in range(r.randint(0, 40))]
    assert [keys[k] for k in matching.fold_names(keys)] == plain_fold(keys)


def test_many_names_take_few_steps():
    keys = ["rivierevert"[: 10 + k % 2] for k in range(50_000)]
    assert {keys[k] for k in matching.fold_names(keys)} == {"rivierevert"}


def test_operator(spark):
    rows = [(1, k, "p", "Nom", "Rivière " if k % 2 else "riviere s") for k in range(30)] + [(1, 50, None, "Nom", "rivieres"), (1, 51, None, "nom!", "Riviere"), (2, 0, "p", "", "x"), (3, 0, "p", "Nom", None)]
    df = spark.createDataFrame(rows, "doc_id int, fact_ix int, role string, label string, value string").repartition(5)
    got = {(x["doc_id"], x["fact_ix"]): (x["value"], x["corrected"]) for x in matching.reconciled_names(df).collect()}
    assert all(got[1, k] == ("riviere s", bool(k % 2)) for k in range(30)) and got[1, 51] == ("rivieres", True) and got[1, 50] == ("rivieres", False)
    assert got[3, 0] == (None, False) and (2, 0) not in got and matching.reconciled_names(df.limit(0)).count() == 0
