"""Sources, sinks and the stream on temporary folders."""

import json

from pyspark.sql import functions as F

from quillmark.sources import files, sinks
from quillmark.streaming import inbox

PDF = b"%PDF-1.4\n1 0 obj\nendobj\nxref\n0 1\ntrailer\nstartxref\n24\n%%EOF\n"


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(PDF + b"2 0 obj\nendobj\nstartxref\n%d\n%%%%EOF\n" % len(PDF))
    (tmp_path / "b.pdf").write_bytes(b"no mark")
    (tmp_path / "sub" / "c.png").write_bytes(b"\x89PNG")
    (tmp_path / "d.txt").write_bytes(b"other")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.pdf", "b.pdf", "c.png"}
    assert rows["b.pdf"]["error"] == "invalid_pdf" and rows["a.pdf"]["error"] is None and rows["c.png"]["kind"] == "image"
    ends = files.revisions(files.read_documents(spark, str(tmp_path))).collect()
    assert len(ends) == 2 and sorted(r["revision"] for r in ends) == [0, 1] and sum(r["next_offset"] is None for r in ends) == 1
    assert files.unavailable(files.read_documents(spark, str(tmp_path)), "ocr").select("status").distinct().first()[0] == "unavailable"


def test_recognised_and_invoice(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "document.json").write_text(json.dumps([[{"content": "a"}]]))
    (tmp_path / "x" / "document.md").write_text("a")
    assert files.read_recognised(spark, str(tmp_path)).select("markdown").first()[0] == "a"
    xml = '<r:D xmlns:r="u"><r:ExchangedDocument><r:ID>F1</r:ID></r:ExchangedDocument><r:GrandTotalAmount>5</r:GrandTotalAmount></r:D>'
    got = files.read_invoice_headers(spark.createDataFrame([(xml,)], "xml string")).select("header.*").first()
    assert (got["invoice_id"], got["grand_total"], got["seller"]) == ("F1", "5", None)


def test_sinks(spark, tmp_path):
    summary = spark.createDataFrame([(2, 1, 1, 1, 0, 0, 5.0)], "total int, succeeded int, failed int, low_count int, review_count int, high_count int, average_score double")
    page = sinks.batch_page(summary, spark.createDataFrame([("<a>", 1)], "name string, score int"))
    assert "&lt;a&gt;" in page and "low: 1 (100%)" in page
    sinks.write_batch_csv(summary, str(tmp_path / "csv"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "csv")).first()["total"] == "2"
    assert json.loads(sinks.batch_json(summary).first()[0])["failed"] == 1


def test_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = inbox.read_inbox(spark, str(tmp_path / "in"), events.schema)
    q = inbox.score_batches(stream, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == events.count()


def test_invoice_attachments(spark):
    rows = [("Factur-X.xml", "<a/>"), ("dir/zugferd-invoice.xml", "<a/>"), ("other.xml", "<a/>"), ("factur-x.xml", ""), ("xrechnung.xml", None), ("a.pdf", "<a/>")]
    got = files.invoice_attachments(spark.createDataFrame(rows, "name string, xml string")).collect()
    assert {(r["name"], r["standard"]) for r in got} == {("Factur-X.xml", True), ("dir/zugferd-invoice.xml", True), ("other.xml", False)}
