"""Assessments follow changed findings only; files of a run appear together or not at all."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import matching, scoring
from quillmark.sources import incremental, report_files

FINDINGS = "doc_id bigint, detector string, category string, code string, risk_points double"


def made(n, seed=1):
    r = random.Random(seed)
    cats = ["metadata", "document_integrity", "page_composition"]
    return [(d, f"d{k % 3}", r.choice(cats), f"C{r.randint(0, 5)}", float(r.randint(0, 40))) for d in range(n) for k in range(r.randint(0, 4))]


def folder_files(path):
    return {d: {(f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")} for d in os.listdir(path) if d.startswith("bucket=")}


def test_only_changed_documents_are_scored(spark, tmp_path):
    path, rows = str(tmp_path / "a"), made(60)
    docs, findings = spark.range(60).withColumnRenamed("id", "doc_id"), spark.createDataFrame(rows, FINDINGS)
    stored = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("doc_id", "n_families", "score", "level").collect())
    whole = lambda f, d: sorted(tuple(r) for r in scoring.assess_risk(f, d).collect())
    assert incremental.refresh(findings, docs, path, 16)["scored"] == 60 and stored() == whole(findings, docs)
    first = folder_files(path)
    assert incremental.refresh(findings.repartition(5), docs, path, 16) == {"scored": 0, "folders": 0} and folder_files(path) == first
    # one detector's findings of three documents are exchanged
    new = spark.createDataFrame([(d, "d1", "metadata", "NEW", 33.0) for d in (3, 17, 59)], FINDINGS)
    some = findings.where("not (detector = 'd1' and doc_id in (3, 17, 59))")
    after = matching.replace_detector(some, "none", new)
    told = incremental.refresh(after, docs, path, 16)
    assert told["scored"] == 3 and told["folders"] <= 3 and stored() == whole(after, docs)
    same = [d for d, files in folder_files(path).items() if files == first.get(d)]
    assert len(same) == len(first) - told["folders"]
    # documents come and go
    fewer = docs.where("doc_id not in (4, 5)").unionByName(spark.createDataFrame([(100,)], "doc_id bigint"))
    told = incremental.refresh(after.where("doc_id not in (4, 5)"), fewer, path, 16)
    assert told["scored"] == 1 and stored() == whole(after.where("doc_id not in (4, 5)"), fewer)
    none = docs.limit(0)
    incremental.refresh(after.limit(0), none, path, 16)
    assert not any(folder_files(path).values())


def test_report_files(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("a/b", "1"), ("..", "2"), (None, "3"), ("ü x", None)], "doc_id string, report string").repartition(3)
    report_files.write_report_files(rows, path)
    files = {n: open(f"{d}/{n}", encoding="utf-8").read() for d, _, names in os.walk(path) for n in names}
    assert files == {"a%2Fb.json": "1", "%2E..json": "2", "null.json": "3", "%C3%BC x.json": ""}
    report_files.write_report_files(rows.limit(1), path, mode="overwrite")
    assert sum(len(names) for _, _, names in os.walk(path)) == 1 and not os.listdir(f"{path}/_staging")


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.range(40).repartition(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("report"))
    with pytest.raises(Exception, match="broken"):
        report_files.write_report_files(rows, path)
    visible = lambda: [n for d, _, names in os.walk(path) for n in names if "_staging" not in d]
    assert visible() == []
    report_files.write_report_files(rows.where("doc_id <> 33"), path)
    assert len(visible()) == 39
