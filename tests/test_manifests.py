"""Walks through nested manifests against plain recursion."""

import json
import random

from quillmark.operators import manifests


def plain(value, outcome=None, found=None):
    found = [] if found is None else found
    if isinstance(value, dict):
        if outcome and isinstance(value.get("code"), str):
            found.append((outcome, value["code"], value["explanation"] if isinstance(value.get("explanation"), str) and value["explanation"] else None))
        for key, child in value.items():
            plain(child, key if key in manifests.OUTCOMES else outcome, found)
    elif isinstance(value, list):
        for child in value:
            plain(child, outcome, found)
    return found


def made(r, depth):
    if depth == 0 or r.random() < 0.2:
        return r.choice(["text", 5, None, True, 1.5, "untrusted"])
    if r.random() < 0.3:
        return [made(r, depth - 1) for _ in range(r.randint(0, 3))]
    keys = r.sample(["success", "failure", "informational", "code", "explanation", "other", "a b", "digital_source_type", "x.y"], r.randint(1, 5))
    return {k: r.choice(["c1", "c2", 7, ""]) if k in ("code", "explanation") and r.random() < 0.8 else made(r, depth - 1) for k in keys}


def test_walk(spark):
    r = random.Random(11)
    docs = [made(r, r.randint(1, 7)) for _ in range(80)]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, None), (901, "no json"), (902, "[]"), (903, '"text"')]
    walked = manifests.walked(spark.createDataFrame(rows, "doc int, j string"), "doc", "j").cache()
    got = {}
    for x in manifests.validation_statuses(walked).collect():
        got.setdefault(x["id"], []).append((x["outcome"], x["code"], x["explanation"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {i: sorted(p, key=str) for i, d in enumerate(docs) if (p := plain(d))}
    assert manifests.walked(spark.createDataFrame([], "doc int, j string"), "doc", "j").count() == 0


def test_source_types(spark):
    j = json.dumps({"a": [{"digitalSourceType": "http://b/x"}, {"Digital_Source_Type": "http://a/y", "deep": {"digitalsourcetype": "http://b/x"}}, {"digitalSourceType": 5}]})
    walked = manifests.walked(spark.createDataFrame([(1, j), (2, "{}")], "doc int, j string"), "doc", "j")
    assert [tuple(x) for x in manifests.source_types(walked).collect()] == [(1, ["http://a/y", "http://b/x"])]
