"""Expected results of the operators on small rows."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import authenticity, chunks, geometry, ledger, matching, pixels, scoring, tables


@pytest.mark.parametrize(
    ("findings", "score", "level"),
    [
        ([("revision_visual", f"c{i}", 60.0) for i in range(5)], 69, "review"),
        ([("revision_visual", "a", 60.0)], 60, "review"),
        ([("revision_visual", "a", 60.0), ("page_composition", "b", 45.0), ("content_consistency", "c", 30.0)], 80, "high"),
        ([("synthetic_media", "a", 45.0), ("synthetic_media", "b", 45.0)], 45, "review"),
        ([("other", "a", 90.0)], 20, "low"),
        ([("metadata", "a", 0.0)], 0, "low"),
    ],
)
def test_scores(spark, findings, score, level):
    rows = spark.createDataFrame([(1, *f) for f in findings], "doc_id int, category string, code string, risk_points double")
    got = scoring.assess_risk(rows, spark.createDataFrame([(1,), (2,)], "doc_id int")).orderBy("doc_id").collect()
    if len(findings) == 5:  # one family never reaches the high level
        assert got[0]["level"] != "high" and got[0]["score"] <= 69
    else:
        assert (got[0]["score"], got[0]["level"]) == (score, level)
    assert (got[1]["score"], got[1]["level"]) == (0, "low")


def test_empty_findings(spark):
    none = spark.createDataFrame([], "doc_id int, category string, code string, risk_points double")
    assert scoring.assess_risk(none, spark.createDataFrame([(1,)], "doc_id int")).first()["score"] == 0
    assert scoring.batch_summary(spark.createDataFrame([], "status string, level string, score int")).first()["average_score"] == 0.0


def test_curve(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)], "s double")
    assert [r[0] for r in rows.select(geometry.curve_points(F.col("s"))).collect()] == [0, 0, 1.87, 7.5, 16.88, 30, 30]


def test_ledger(spark):
    d = lambda x: None if x is None else Decimal(x)
    rows = [
        (1, 1, dt.date(2026, 1, 1), None, d("10"), d("110"), True), (1, 2, dt.date(2026, 1, 2), d("5"), None, d("105"), False),
        (1, 3, dt.date(2026, 1, 3), d("5"), None, d("100"), True), (1, 4, dt.date(2026, 1, 1), d("5"), None, d("90"), True), (1, 5, None, None, None, None, True),
    ]
    df = spark.createDataFrame(rows, "t int, row_no int, date date, debit decimal(10,2), credit decimal(10,2), balance decimal(10,2), comparable boolean")
    got = ledger.ledger_summary(ledger.replay_ledger(df, "t"), "t").first()
    assert (got["rows_checked"], got["mismatch_rows"], got["inversion_rows"], got["rows_skipped"], got["state"]) == (2, [4], [4], 1, "attention")


def test_boxes(spark):
    rows = spark.createDataFrame([([(0.0, 0.0, 10.0, 10.0), (20.0, 2.0, 30.0, 9.0), (100.0, 0.0, 110.0, 5.0), (0.0, 15.0, 5.0, 20.0)],)], "b array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = rows.select(F.inline(geometry.merged_boxes(F.col("b")))).collect()
    assert sorted((r["x0"], r["y0"], r["x1"], r["y1"]) for r in got) == [(0, 0, 30, 20), (100, 0, 110, 5)]


def test_lattice(spark):
    got = geometry.lattice(spark.createDataFrame([(1, 1536, 1536), (2, 100, 500)], "id int, width int, height int")).collect()
    assert len(got) == 25 and sum(r["is_center"] for r in got) == 1
    assert next(r for r in got if r["is_center"])["left"] == 656


def test_chunks(spark):
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 500), (1, 4, 10)], "k int, pos int, size int").withColumn("over", F.lit(10))
    got = sorted(tuple(r) for r in chunks.greedy_chunks(rows, 150, "k", "pos", "size", "over").collect())
    assert got == [(1, 1, 0, 0), (1, 2, 0, 0), (1, 3, 0, 1), (1, 3, 1, 2), (1, 3, 2, 3), (1, 3, 3, 4), (1, 4, 0, 5)]
    first = chunks.fitting_prefix(spark.createDataFrame([(1, 1, 5000), (1, 2, 1)], "k int, pos int, size int"), 3000, "k", "pos", "size").collect()
    assert [r["pos"] for r in first] == [1]


def test_html_tables():
    markup = "<table><tr><th colspan=2>A</th></tr><tr><th>x</th><th>y</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr><tr></tr></table>"
    assert tables.html_tables(markup) == [(["A / x", "A / y"], [["1", "2"], ["1", "3"]])]
    assert tables.html_tables("<p>none") == []


def test_pixels():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 1, 1]], bool)
    labels, n = pixels.components(mask)
    assert n == 3 and labels[0, 0] == labels[1, 1] and labels[0, 3] == labels[1, 3] and (labels > 0).sum() == mask.sum()
    u = np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]], bool)
    assert pixels.components(u)[1] == 1
    a = np.zeros((40, 60, 3), np.uint8)
    b = a.copy()
    b[10:20, 30:40] = 200
    share, boxes = pixels.revision_changes(a, b)
    assert share == 100 / 2400 and boxes == [(26, 8, 18, 14, 100)]
    assert pixels.revision_changes(a, a) == (0.0, [])
    m = np.zeros((10, 10), bool)
    m[2:6, 2:6] = True
    assert pixels.shifted_dice(m, np.roll(m, 2, axis=1)) == 1.0
    z = np.ones((4, 4)) + np.arange(16).reshape(4, 4) * 0.01
    z[1, 1] = 9
    assert [x[:4] for x in pixels.block_outliers(z, 6)] == [(1, 1, 1, 1)]


def test_names(spark):
    rows = spark.createDataFrame([(1, 1, "Dupont Jean"), (1, 2, "Duponnt Jean"), (1, 3, "Dupont Jeans"), (1, 4, "Other"), (2, 5, "Dupont Jean")], "g int, id int, name string")
    pairs = {(r["short_id"], r["long_id"]) for r in matching.name_pairs(rows, "g", "name", "id").collect()}
    assert pairs == {(1, 3)}  # an inserted letter inside isn't containment


def test_reconciled_names(spark):
    rows = [(1, 0, "holder", "Nom", "Dupont Jean"), (1, 1, "holder", "Nom", "Dupont Jeann"), (1, 2, "holder", "nom", "Dupont Jea"), (1, 3, "payer", "Nom", "Dupont Jean"), (2, 0, "holder", "Nom", "Alone")]
    df = spark.createDataFrame(rows, "doc_id int, fact_ix int, role string, label string, value string")
    got = {(r["doc_id"], r["fact_ix"]): (r["value"], r["corrected"]) for r in matching.reconciled_names(df).collect()}
    assert got == {(1, 0): ("Dupont Jeann", True), (1, 1): ("Dupont Jeann", False), (1, 2): ("Dupont Jea", False), (1, 3): ("Dupont Jean", False), (2, 0): ("Alone", False)}


def test_mark_mask():
    grey = np.full((60, 120), 250, np.uint8)
    grey[20:40, 30:90:2] = 10
    mask = pixels.mark_mask(grey)
    assert mask.shape == (48, 96) and 0.1 < mask.mean() < 0.6
    assert pixels.mark_mask(np.full((60, 120), 250, np.uint8)) is None and pixels.mark_mask(grey[:4, :4]) is None
    plane = np.arange(24, dtype=float).reshape(4, 6)
    assert np.allclose(pixels.area_resize(plane, 3, 2), plane.reshape(2, 2, 3, 2).mean(axis=(1, 3)))
    assert 10 <= pixels.otsu(np.array([[10] * 5 + [200] * 5], np.uint8)) < 200


def test_adapter_verdicts(spark):
    a = authenticity
    rows = spark.createDataFrame([(True, True, True, "ENTIRE_FILE", "NONE", True, None), (False, True, True, "ENTIRE_FILE", "OTHER", True, None), (True, True, False, "CONTIGUOUS", "FORM_FILLING", True, None), (True, True, None, "ENTIRE_FILE", None, False, "SuspiciousModification")], "i boolean, v boolean, t boolean, c string, m string, p boolean, d string")
    got = rows.select(a.signature_verdict(F.col("i"), F.col("v"), F.col("t"))["state"], a.post_signature_verdict(F.col("c"), F.col("m"), F.col("p"), F.col("d"))["state"]).collect()
    assert [tuple(r) for r in got] == [("clear", "clear"), ("attention", "attention"), ("indeterminate", "detected"), ("indeterminate", "attention")]
    codes = spark.createDataFrame([("valid",), ("malformed",), ("other",)], "r string").select(a.barcode_verdict(F.col("r"))["code"]).collect()
    assert [r[0] for r in codes] == ["TWO_D_DOC_SIGNATURE_VALID", "TWO_D_DOC_MALFORMED", None]
    inv = spark.createDataFrame([(True, True, True), (True, False, True), (False, None, None)], "w boolean, p boolean, x boolean").select(a.invoice_verdict(F.col("w"), F.col("p"), F.col("x"))["code"]).collect()
    assert [r[0] for r in inv] == ["FACTURX_XSD_VALID", "FACTURX_PROFILE_UNRECOGNISED", "FACTURX_XML_MALFORMED"]
    m = spark.createDataFrame([("Valid", [], ["http://x/trainedAlgorithmicMedia/"]), ("valid", ["signingCredential.untrusted"], ["digitalCapture"]), ("trusted", ["hash.mismatch"], None), (None, None, [])], "s string, f array<string>, t array<string>")
    v = a.manifest_validation(F.col("s"), F.col("f"))
    got = m.select(v, a.algorithmic_declaration(F.col("t"), v)["state"], a.algorithmic_declaration(F.col("t"), v)["trust"]).collect()
    assert [tuple(r) for r in got] == [("valid", "detected", "valid"), ("untrusted", "not_detected", "not_applicable"), ("invalidated", "indeterminate", "unknown"), ("unknown", "not_detected", "not_applicable")]
