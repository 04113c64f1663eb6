"""Near copies against all pairs of shingle sets."""

import random

import numpy as np
import pytest
from test_llm_queries import plain_components

from quillmark.llm import near_copies


def plain_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    return not (a or b) or len(a & b) / len(a | b) >= 0.8


def edited(words, n, r):
    words = words.copy()
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def rows_with_copies():
    r = random.Random(6)
    rows = [(0, None), (1, ""), (2, "two words"), (3, "Two  words"), (4, "two other")]
    for k in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice((40, 150, 400)))]
        rows += [(100 * k + 10 + n, edited(base, round(n * len(base) / 150), r)) for n in range(6)]
    hub = [f"h{r.randrange(5000)}" for _ in range(120)]
    rows += [(9000 + i, edited(hub, r.randrange(4), r)) for i in range(60)] + [(9999, rows[10][1])]
    return rows


@pytest.mark.parametrize(("block_rows", "block_bytes"), [(1024, 8_000_000), (7, 8_000_000), (1024, 3000)])
def test_near_copies(spark, block_rows, block_bytes):
    rows = rows_with_copies()
    got = {g["doc_id"]: g["component_id"] for g in near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), block_rows=block_rows, block_bytes=block_bytes).collect()}
    sets = {i: plain_set(t) for i, t in rows}
    assert got == plain_components(sorted(sets), lambda a, b: similar(sets[a], sets[b]))
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_copies.near_copies(empty).count() == 0


def test_pipeline_stage_finds_similar_texts(spark, sf_dir):
    import corpus_pipeline as p

    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows_with_copies()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sets = {r[0]: plain_set(r[1]) for r in rows}
    want = plain_components(sorted(sets), lambda a, b: similar(sets[a], sets[b]))
    assert sorted(r["doc_id"] for r in p.simhash_near_dedup(spark, docs, sf_dir).collect()) == sorted(set(want.values()))


def sketches(sets):
    return np.array([np.frombuffer(near_copies.sketch_of(near_copies.minima_of(s)), np.uint8) for s in sets])


def test_a_shared_notice_gives_few_exact_comparisons():
    """1,500 texts of pairwise similarity about a half, and 60 near copies around 0.8 among them: all links are found, few pairs are compared."""
    r = np.random.default_rng(12)
    notice = r.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.r_[notice, r.integers(0, 1 << 63, 200).astype(np.uint64)]) for _ in range(1440)]
    for k in range(60):
        new = sets[k].copy()
        new[r.choice(len(new), 40 + k // 2, replace=False)] = r.integers(0, 1 << 63, 40 + k // 2).astype(np.uint64)
        sets.append(np.unique(new))
    exact = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(exact(sets[0], sets[1]) - 0.5) < 0.02
    forest = near_copies.Forest()
    compared = near_copies.link_sets(list(range(len(sets))), sets, sketches(sets), 0.8, forest)
    near = [k for k in range(60) if exact(sets[k], sets[1440 + k]) >= 0.8]
    assert 10 < len(near) < 60 and all(forest.find(k) == forest.find(1440 + k) for k in near)
    assert len({forest.find(i) for i in range(len(sets))}) == len(sets) - len(near)
    assert compared < 1_124_250 / 50


def test_sketches_keep_pairs_at_the_similarity():
    least, r = near_copies.least_matches(0.8), np.random.default_rng(13)
    assert 100 < least < 130
    low = 192
    for _ in range(300):
        both, own = r.integers(0, 1 << 63, 160).astype(np.uint64), r.integers(0, 1 << 63, (2, 20)).astype(np.uint64)
        a, b = sketches([np.unique(np.r_[both, own[0]]), np.unique(np.r_[both, own[1]])])
        low = min(low, int((a == b).sum()))
    assert low >= least


def test_very_long_texts(spark):
    """More shingles than one slice takes, in a near copy, a far text and a repeat."""
    r = random.Random(14)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(120_000)]
    other = [w if r.random() < 0.99 else "new" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[::-1])), (4, " ".join(words)), (5, "w")]
    got = {g["doc_id"]: g["component_id"] for g in near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}


def test_sets_are_linked_across_blocks_only():
    r = random.Random(9)
    rows = [t for _, t in rows_with_copies()][5:120]
    r.shuffle(rows)
    sets = [near_copies.shingles(t) for t in rows]
    plain, half = [plain_set(t) for t in rows], 50
    forest = near_copies.Forest()
    near_copies.link_sets(list(range(len(sets))), sets, sketches(sets), 0.8, forest, half)
    want = plain_components(list(range(len(sets))), lambda a, b: (a < half) != (b < half) and similar(plain[a], plain[b]))
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(want[i], set()).add(forest.find(i))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_candidates_hold_all_near_simhashes(spark):
    """Every pair within the radius is a candidate, whatever its min-wise fingerprints."""
    r = random.Random(10)
    prints = [r.getrandbits(63) for _ in range(30)]
    named = [(k, p, [k]) for k, p in enumerate(prints)] + [(100 + k, p ^ (1 << r.randrange(60)) ^ (1 << r.randrange(60)), [100 + k]) for k, p in enumerate(prints)]
    df = spark.createDataFrame(named, "fp bigint, print bigint, keys array<bigint>")
    edges = [(e["u"], e["v"]) for e in near_copies.candidate_links(df, len(named)).collect()]
    forest = near_copies.Forest()
    for u, v in edges:
        forest.link(u, v)
    assert all(forest.find(k) == forest.find(100 + k) for k in range(30))
