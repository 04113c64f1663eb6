"""Joins and pairs that split hot keys, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_queries import plain_components

from quillmark.llm import common, components, near_copies, rabitq, simhash


@pytest.fixture(params=[1000, 50])
def hot_rows(request, monkeypatch):
    """Without and with hot keys."""
    monkeypatch.setattr(common, "HOT_ROWS", request.param)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join(spark, how, hot_rows):
    r = random.Random(1)
    keys = [7] * 300 + [r.randrange(5000) for _ in range(2000)] + [None] * 5
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, key int").repartition(5)
    named = [(k, keys.count(k), f"n{k}") for k in sorted({k for k in keys if k is not None}) if k % 3]
    got = common.join_hot(rows, spark.createDataFrame(named, "key int, copies int, name string"), ["key"], "copies", len(keys), how)
    by = {k: n for k, _, n in named}
    want = [(i, k, by.get(k)) for i, k in enumerate(keys) if how == "left" or k in by]
    assert sorted(map(tuple, got.select("id", "key", "name").collect())) == want


def test_block_pairs(spark):
    rows = [(b, n, f"{b}{n}") for b, k in (("a", 4), ("b", 1), ("c", 2)) for n in range(k)]
    got = common.block_pairs(spark.createDataFrame(rows, "bucket string, block int, load string"), ["bucket"], ["load"])
    want = [(x == y, f"{b}{x}", f"{b}{y}") for b, k in (("a", 4), ("b", 1), ("c", 2)) for x in range(k) for y in range(x, k)]
    assert sorted(map(tuple, got.select("same", "load1", "load2").collect())) == sorted(want)


def test_hubs(spark):
    r = random.Random(2)
    edges = [(0, i) for i in range(1, 200)] + [(500, i) for i in range(150, 400)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(80)]
    got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), hub_edges=20).collect()}
    pairs = {frozenset(e) for e in edges if e[0] != e[1]}
    want = plain_components(sorted({x for e in pairs for x in e}), lambda a, b: frozenset((a, b)) in pairs)
    assert got == want


def test_links_across():
    r = np.random.default_rng(3)
    for _ in range(20):
        base = r.integers(0, 1 << 63, 12, np.uint64)
        near = lambda n: np.unique(base[r.integers(0, 12, n)] ^ (np.uint64(1) << r.integers(0, 64, n, np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, n, np.uint64)))  # noqa: B023, E731
        x, y = near(40), near(30)
        y = y[~np.isin(y, x)]
        forest = components.Forest()
        simhash.link_across(x, y, 4, forest)
        nodes = [*x.tolist(), *y.tolist()]
        mine = set(x.tolist())
        want = plain_components(nodes, lambda a, b: (a in mine) != (b in mine) and (a ^ b).bit_count() <= 4)  # noqa: B023
        groups = {}
        for n in nodes:
            groups.setdefault(want[n], set()).add(forest.find(n))
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_a_folder_is_removed(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/x")
    common.removed(spark, f"file://{tmp_path}/x")
    assert not (tmp_path / "x").exists()
    common.removed(spark, f"{tmp_path}/none")
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_one_row_for_each_key(spark, hot_rows):
    r = random.Random(4)
    keys = [(1, "x")] * 400 + [(i, "y") for i in range(300)] + [(i, "y") for i in range(0, 300, 3)]
    r.shuffle(keys)
    rows = spark.createDataFrame([((a, b), f"{a}{b}", 9) for a, b in keys], "key struct<a:int,b:string>, text string, copies int").repartition(5)
    named = [((a, b), keys.count((a, b)), a * 10) for a, b in sorted(set(keys)) if a % 2]
    got = common.one_each(rows.drop("copies"), spark.createDataFrame(named, "key struct<a:int,b:string>, copies int, more int"), "key", "copies", len(keys))
    want = [((a, b), f"{a}{b}", m) for (a, b), _, m in named]
    assert sorted(((g["key"]["a"], g["key"]["b"]), g["text"], g["more"]) for g in got.collect()) == want


@pytest.mark.parametrize("many", [1, 20_000])
def test_stars_of_frequent_fingerprints(spark, many):
    r = random.Random(5)
    named = [(i, [7 if i % 3 else 1000 + i, r.randrange(40)]) for i in range(3000)]
    edges = [(e["u"], e["v"]) for e in near_copies.stars(spark.createDataFrame(named, "fp bigint, keys array<bigint>").repartition(4), 3000, many).collect()]
    least = {}
    for fp, keys in named:
        for k in keys:
            least[k] = min(least.get(k, fp), fp)
    assert sorted(edges) == sorted((fp, least[k]) for fp, keys in named for k in keys if fp != least[k])


@pytest.mark.parametrize("across", [0, 300])
def test_code_components(across):
    """Components of near codes against plain ones, over several chunks, with chains and dense groups."""
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 63, (200, 4), np.uint64)
    code = np.concatenate([base, *[base[:40] ^ (np.uint64(1) << r.integers(0, 64, (40, 4), np.uint64)) for _ in range(9)], np.repeat(base[50:52], 60, axis=0)])
    code = code[r.permutation(len(code))]
    ids = r.permutation(10_000)[: len(code)]
    forest, limits = components.Forest(), (0.04, np.full(1025, 8), np.full(1025, 8))
    with_length = np.c_[code, np.ones((len(code), 1)).view(np.uint64)]
    rabitq.link_codes(ids, with_length, limits, forest, across)
    near = rabitq.near_codes(with_length, with_length, limits)
    full = np.bitwise_count(code[:, None] ^ code[None, :]).sum(axis=2) <= 8
    assert (near == full).all()
    if across:
        side = np.arange(len(code)) < across
        full &= side[:, None] != side[None, :]
    want = plain_components(list(range(len(code))), lambda a, b: full[a, b])
    groups = {}
    for i in range(len(code)):
        groups.setdefault(want[i], set()).add(forest.find(int(ids[i])))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)
