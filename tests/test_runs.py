"""Two-phase runs: scores before and after the branches, failures, progress, cancelling."""

import time

from pyspark.sql import functions as F

from quillmark import runs


def found(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id int, code string, risk_points double")


def test_two_phases(spark, tmp_path):
    seen = []
    run = runs.Run(spark, str(tmp_path), runs.points_by_document, lambda share, name: seen.append((round(share, 3), name)))
    first = {r["doc_id"]: r["points"] for r in run.core(found(spark, (1, "A", 5.0), (2, "B", 1.0))).collect()}
    assert first == {1: 5.0, 2: 1.0}

    def broken():
        return found(spark, (1, "X", 1.0)).select("doc_id", "code", F.raise_error(F.lit("no luck")).cast("double").alias("risk_points"))

    second = run.extend({"content": lambda: found(spark, (1, "C", 7.0), (3, "D", 2.0)), "broken": broken, "early": lambda: 1 / 0}, {"content": 2.0})
    assert {r["doc_id"]: (r["points"], r["findings"]) for r in second.collect()} == {1: (12.0, 2), 2: (1.0, 1), 3: (2.0, 1)}
    states = {r["branch"]: (r["state"], r["note"]) for r in run.branch_states().collect()}
    assert states["core"] == states["content"] == ("completed", None) and states["broken"][0] == states["early"][0] == "partial" and "ZeroDivisionError" in states["early"][1]
    assert [s for s, _ in seen] == sorted(s for s, _ in seen) and seen[-1][0] == 1.0
    again = run.extend({"content": lambda: found(spark, (1, "C", 7.0), (3, "D", 2.0))})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, second.collect()))


def test_cancelled_branches_leave_the_first_scores(spark, tmp_path):
    import threading

    run = runs.Run(spark, str(tmp_path), runs.points_by_document)
    run.core(found(spark, (1, "A", 5.0)))

    def slow():
        return spark.range(4).select(F.col("id").cast("int").alias("doc_id"), F.lit("S").alias("code"), F.expr("java_method('java.lang.Thread', 'sleep', 60000L)").isNull().cast("double").alias("risk_points"))

    threading.Timer(3, run.cancel).start()
    began = time.monotonic()
    after = run.extend({"slow": slow, "waits": slow}, side_by_side=1)
    assert time.monotonic() - began < 50 and [tuple(r) for r in after.collect()] == [(1, 5.0, 1)]
    assert {run.states[b][0] for b in ("slow", "waits")} == {"cancelled"}


def test_progress_never_falls():
    p = runs.Progress({"a": 1.0, "b": 3.0})
    assert [p.update("a", 1.0), p.update("b", 0.5), p.update("b", 0.1), p.update("a", 0.0), p.update("b", 2.0)] == [0.25, 0.625, 0.625, 0.625, 1.0]
