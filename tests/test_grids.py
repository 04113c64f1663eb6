"""Plans over cells against kernels over arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import grids, marks, page_objects, pixels


def cells_of(spark, masks):
    rows = [(k, int(y), int(x)) for k, m in masks.items() for y, x in np.argwhere(m)]
    return spark.createDataFrame(rows, "image string, y bigint, x bigint")


def plain_parts(mask):
    labels, n = pixels.components(mask)
    out = []
    for k in range(1, n + 1):
        ys, xs = np.nonzero(labels == k)
        out.append((k, len(ys), xs.min(), ys.min(), xs.max(), ys.max()))
    return out


def spiral(n):
    mask, y, x, dy, dx = np.zeros((n, n), bool), 0, -1, 0, 1
    for length in [n, *(k for k in range(n - 1, 1, -2) for _ in (0, 1))]:
        for _ in range(length):
            y, x = y + dy, x + dx
            mask[y, x] = True
        dy, dx = dx, -dy
    return mask


@pytest.mark.parametrize("tile", [4, 64])
def test_components(spark, tile):
    r = np.random.default_rng(1)
    masks = {f"r{k}": r.random((20, 30)) < p for k, p in enumerate((0.1, 0.3, 0.45, 0.6))} | {"spiral": spiral(25), "full": np.ones((9, 70), bool), "one": np.eye(1, dtype=bool), "cross": np.eye(40, dtype=bool) | np.eye(40, dtype=bool)[::-1]}
    cells = cells_of(spark, masks)
    cells = cells.unionByName(cells.limit(5)).unionByName(spark.createDataFrame([("r1", None, 1), ("r2", 1, None)], cells.schema))
    got = {}
    for x in grids.components(cells, "image", tile=tile).collect():
        got.setdefault(x["image"], []).append(tuple(x[c] for c in ("component", "cells", "x0", "y0", "x1", "y1")))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_parts(m) for k, m in masks.items()}
    assert grids.components(cells.limit(0), "image").count() == 0


def test_null_keys_are_one_image(spark):
    cells = spark.createDataFrame([(None, 0, 0), (None, 1, 1), (None, 5, 5), ("a", 0, 1)], "image string, y bigint, x bigint")
    got = sorted(((x["image"] or "", x["component"], x["cells"]) for x in grids.components(cells, "image").collect()))
    assert got == [("", 1, 2), ("", 2, 1), ("a", 1, 1)]


def plain_closed(mask):
    """Maximum, then minimum over a cell and those left and above it."""
    for f, edge in ((np.maximum, 0), (np.minimum, 1)):
        wide = np.pad(mask.astype(int), ((1, 0), (1, 0)), constant_values=edge)
        mask = f(f(wide[1:, 1:], wide[:-1, 1:]), f(wide[1:, :-1], wide[:-1, :-1]))
    return mask > 0


def test_blocks(spark):
    r = np.random.default_rng(2)
    images = {"a": r.random((60, 70)), "few": r.random((8, 8)), "flat": np.ones((40, 40)), "b": r.random((41, 33)) ** 4}
    images["a"][8:16, 16:40] += 3
    rows = [(k, int(y), int(x), float(v)) for k, m in images.items() for (y, x), v in np.ndenumerate(m)]
    scores = grids.block_scores(spark.createDataFrame(rows, "image string, y bigint, x bigint, value double"), "image", side=8)
    got = {(x["image"], x["y"], x["x"]): (x["energy"], x["z"]) for x in scores.collect()}
    outliers = {}
    for x in grids.outlying_blocks(scores, "image", least=2.0).collect():
        outliers.setdefault(x["image"], []).append(tuple(x[c] for c in ("component", "cells", "x0", "y0", "x1", "y1", "z")))
    for k, m in images.items():
        energy = pixels.block_percentile(m, 8)
        mad = np.median(np.abs(energy - np.median(energy)))
        z = np.zeros_like(energy) if energy.size < 9 or mad < 1e-3 else (energy - np.median(energy)) / max(1e-3, 1.4826 * mad)
        for (y, x), e in np.ndenumerate(energy):
            assert got[k, y, x] == pytest.approx((e, z[y, x]))
        grown = plain_closed(z >= 2.0)
        labels, _ = pixels.components(grown)
        want = [(*p, max(z[labels == p[0]])) for p in plain_parts(grown)]
        assert sorted(outliers.get(k, [])) == [pytest.approx(w) for w in want]
    assert outliers["a"]


def test_parting_levels(spark):
    r = np.random.default_rng(3)
    planes = {f"p{k}": np.clip(np.r_[r.normal(60, 9, 200), r.normal(180, 15, 60 * k + 1)], 0, 255).astype(np.uint8) for k in range(4)} | {"one": np.full(30, 7, np.uint8), "two": np.array([3, 3, 9], np.uint8)}
    rows = [(k, int(v)) for k, p in planes.items() for v in p] + [("p1", None)]
    got = {x["image"]: (x["level"], x["low"], x["high"]) for x in grids.parting_levels(spark.createDataFrame(rows, "image string, level int"), "image").collect()}
    want = {k: pixels.otsu(p) for k, p in planes.items() if k != "one"}
    assert got == {k: (t, int((planes[k] <= t).sum()), int((planes[k] > t).sum())) for k, t in want.items()}


def test_shifted_dice(spark):
    r = np.random.default_rng(4)
    pairs = {k: (m := r.random((48, 96)) < 0.2, np.roll(m, (k - 2, k), (0, 1)) | (r.random((48, 96)) < 0.02)) for k in range(4)} | {9: (np.zeros((48, 96), bool), np.zeros((48, 96), bool)), 8: (np.ones((48, 96), bool), r.random((48, 96)) < 0.5)}
    packed = lambda m: [int(sum(1 << int(y) for y in np.flatnonzero(m[:, x]))) for x in range(96)]
    df = spark.createDataFrame([(k, packed(a), packed(b)) for k, (a, b) in pairs.items()], "k int, a array<bigint>, b array<bigint>")
    got = {x["k"]: x["d"] for x in df.select("k", grids.shifted_dice(F.col("a"), F.col("b"), 96, 48).alias("d")).collect()}
    assert got == pytest.approx({k: pixels.shifted_dice(a, b) for k, (a, b) in pairs.items()})
    masks = grids.packed_masks(cells_of(spark, {str(k): p[0] for k, p in pairs.items() if k != 9}), "image", columns=96).collect()
    assert {int(x["image"]): x["mask"] for x in masks} == {k: packed(p[0]) for k, p in pairs.items() if k != 9}


def test_dice_of_words(spark):
    r = np.random.default_rng(5)
    pairs = {k: (r.random((8, 8)) < 0.4, r.random((8, 8)) < 0.4) for k in range(40)} | {98: (np.zeros((8, 8), bool), np.ones((8, 8), bool)), 99: (np.zeros((8, 8), bool), np.zeros((8, 8), bool))}
    packed = lambda m: [int(sum(1 << int(y) for y in np.flatnonzero(m[:, x]))) for x in range(8)]
    df = spark.createDataFrame([(k, packed(a), packed(b)) for k, (a, b) in pairs.items()], "k int, a array<bigint>, b array<bigint>")
    words = df.select("k", *[grids.mask_word(F.col(c), 8, 8).alias(c) for c in "ab"])
    got = {x["k"]: x["d"] for x in words.select("k", grids.shifted_dice_of_words(F.col("a"), F.col("b"), 8, 8).alias("d")).collect()}
    assert got == pytest.approx({k: pixels.shifted_dice(a, b) for k, (a, b) in pairs.items()})


@pytest.mark.parametrize("name", ["mark_similarity", "repeated_marks"])
def test_marks_with_empty_masks(spark, tmp_path, name):
    """Marks without a set cell keep their pairs."""
    import duckdb

    from quillmark import catalog

    r = np.random.default_rng(6)
    vectors = [[float(x) for x in r.normal(0, 0.1, 64)] for _ in range(40)] + [[-0.1] * 64, [0.0] * 64]
    vectors += [[-0.05] * 7 + [float(x) for x in r.choice([-0.1, 0.1], 57)]] * 4
    spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    want = con.execute(f"""select {', '.join(f'"{c}"' for c in df.columns)} from ({catalog.oracle_sql()[name]})""").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str) and want


def some_marks(spark, n):
    """Marks of three documents, some without a document, page, place, size or mask."""
    r = np.random.default_rng(7)
    odd = lambda k, at, x: None if k % 31 == at else x
    rows = [
        (odd(k, 1, "abc"[min(k % 40, 2)]), f"m{k}", odd(k, 2, k % 5), odd(k, 3, float("nan") if k % 31 == 4 else float(r.normal(50, 8))), odd(k, 3, float(r.normal(30, 4))),
         odd(k, 5, float("nan") if k % 31 == 6 else float("inf") if k % 31 == 7 else float(r.normal(0, 90))), odd(k, 8, float(r.normal(0, 90))), odd(k, 9, int(r.integers(-(2**63), 2**63)) if k % 31 != 10 else 0))
        for k in range(n)
    ]
    return spark.createDataFrame(rows, "doc_id string, mark_id string, page int, width double, height double, cx double, cy double, word bigint")


@pytest.mark.parametrize("block", [7, marks.BLOCK])
def test_scored_pairs(spark, block):
    """Pairs by blocks are those by cells, with the same scores; groups that batches cut, and more pairs than are compared at a time, are fine."""
    found = some_marks(spark, 300 if block == 7 else 900).cache()
    words = found.select("mark_id", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))
    near = page_objects.mark_pairs(found.where("cx is null or cx < double('inf')"), near=60.0).join(words.toDF("left", "a"), "left").join(words.toDF("right", "b"), "right")
    want = near.select("doc_id", "left", "right", "right_page", F.round(grids.shifted_dice_of_words(F.col("a"), F.col("b"), 8, 8), 9).alias("similarity")).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37" if block == 7 else "10000")
    try:
        got = sorted(map(tuple, marks.scored_pairs(found, 8, 8, near=60.0, block=block).collect()))
        assert got == sorted(map(tuple, want.collect())) and len(got) > 1000
        kept = marks.scored_pairs(found, 8, 8, near=60.0, least=0.6, best=True, block=block)
        few = sorted(map(tuple, page_objects.recurring_marks(kept, 0.6).collect()))
        assert few == sorted(map(tuple, page_objects.recurring_marks(want, 0.6).collect())) and few
        assert kept.where("similarity < 0.6").count() == 0 and marks.scored_pairs(found.limit(0), 8, 8).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        found.unpersist()
        want.unpersist()


def marks_at_one_place(spark, folder):
    """Vectors that are marks of one document, all at one place."""
    r = np.random.default_rng(8)
    rows = [(k, [-0.05] * 7 + [float(x) for x in r.choice([-0.1, 0.1], 57)], 1) for k in range(400)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")


def test_best_of_a_page_leaves_the_scorer(spark, tmp_path, monkeypatch):
    """Of the pairs of a document repeated_marks passes on the best of a mark and page, and several tasks score them."""
    from quillmark import catalog

    marks_at_one_place(spark, tmp_path)
    seen, known = [], page_objects.recurring_marks
    monkeypatch.setattr(page_objects, "recurring_marks", lambda pairs, *a, **k: (seen.append(pairs), known(pairs, *a, **k))[1])
    assert catalog.queries()["repeated_marks"](spark, str(tmp_path)).count() > 0
    per = [x["n"] for x in seen[0].groupBy(F.spark_partition_id(), "left", "right_page").agg(F.count("*").alias("n")).collect()]
    tasks = seen[0].select(F.spark_partition_id()).distinct().count()
    assert seen[0].where("similarity < 0.75").count() == 0 and max(per) <= 4 and tasks > 1


def test_marks_at_one_place_are_spread(spark, tmp_path):
    """Pairs of one document at one place come from several tasks."""
    from quillmark import catalog

    marks_at_one_place(spark, tmp_path)
    df = catalog.queries()["mark_similarity"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    n = [sum(k % 6 == p for k in range(400)) for p in range(6)]
    assert sum(x["count"] for x in df) == 400 * 400 - sum(x * x for x in n) and len(df) > 1


def test_links_only_where_tiles_meet(spark, monkeypatch):
    """What touches inside a tile is joined there; rounds over links see parts that meet at a border alone. Places before 0 and batches that cut a tile are fine."""
    r = np.random.default_rng(4)
    masks = {"m": r.random((40, 150)) < 0.4, "s": spiral(60)}
    cells, seen, known = cells_of(spark, masks), [], grids.least_reachable
    monkeypatch.setattr(grids, "least_reachable", lambda links: (seen.append(links.count()), known(links))[1])
    want = {k: plain_parts(m) for k, m in masks.items()}
    moved = cells.select("image", (F.col("y") - 70).alias("y"), (F.col("x") - 130).alias("x"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {}
        for x in grids.components(cells, "image").collect():
            got.setdefault(x["image"], []).append(tuple(x[c] for c in ("component", "cells", "x0", "y0", "x1", "y1")))
        assert {k: sorted(v) for k, v in got.items()} == want and seen[0] < 150
        got = sorted((x["image"], x["component"], x["cells"], x["x0"] + 130, x["y0"] + 70, x["x1"] + 130, x["y1"] + 70) for x in grids.components(moved, "image").collect())
        assert got == sorted((k, *p) for k, parts in want.items() for p in parts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
