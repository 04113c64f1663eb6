"""Percentiles of large groups against numpy and against Spark's aggregation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import geometry, selection


@pytest.fixture(scope="module")
def groups():
    r = np.random.default_rng(8)
    return {
        "normal": r.normal(size=3000), "same": np.full(500, 0.25), "ties": r.integers(0, 5, 2000) / 4, "wide": np.r_[-1.7e308, 1.7e308, r.normal(size=300)], "tiny": np.r_[1.0, 10.0 ** -r.integers(0, 300, 400)],
        "one": np.array([3.0]), "two": np.array([1.0, 2.0]), "neighbours": np.nextafter(1.0, 2.0) * np.ones(200) - (r.random(200) < 0.5) * 2.0**-53,
    }


def frame(spark, groups):
    rows = [(k, float(v)) for k, g in groups.items() for v in g] + [("normal", None), (None, 1.0), (None, 3.0)]
    return spark.createDataFrame(rows, "key string, value double").repartition(5)


def test_selected(spark, groups):
    ranks = [(k, i) for k, g in groups.items() for i in {0, len(g) - 1, len(g) // 2, len(g) // 3}] + [(None, 1)]
    got = selection.selected(frame(spark, groups), spark.createDataFrame(ranks, "key string, rank bigint"), "key", parts=16, least=20).collect()
    want = {(k, i): np.sort(groups[k])[i] if k else 3.0 for k, i in ranks}
    assert {(r["key"], r["rank"]): r["value"] for r in got} == want


@pytest.mark.parametrize("held", [0, 100, 10**6])
def test_percentiles(spark, groups, held):
    points = (0.1, 0.25, 0.5, 0.9, 1.0)
    got = {r["key"]: r["q"] for r in selection.percentiles(frame(spark, groups), points, "key", held=held).collect()}
    assert set(got) == {*groups, None} and got[None] == pytest.approx([1.2, 1.5, 2.0, 2.8, 3.0])
    for k, g in groups.items():
        assert got[k] == pytest.approx(np.quantile(g, points), rel=1e-12, abs=1e-300), k


def test_window_summary_of_large_groups(spark, groups):
    rows = frame(spark, groups).where("key in ('normal', 'ties', 'two') and value is not null").withColumnRenamed("value", "score")
    a, b = (sorted(map(tuple, geometry.window_summary(rows, "key", held=h).collect())) for h in (10**6, 50))
    assert [x[0] for x in a] == [x[0] for x in b] and all(x[1:] == pytest.approx(y[1:]) for x, y in zip(a, b, strict=True))
    assert geometry.window_summary(rows.limit(0), "key", held=50).count() == 0 and rows.agg(F.count("*")).first()[0] == 5002
