"""The detector registry, metadata of files by their bytes, report sinks."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillmark import detectors
from quillmark.sources import metadata, sinks


def test_failing_detectors_do_not_stop_the_others(spark):
    registry = detectors.Registry()

    @registry.register("one", "docs")
    def one(tables):
        return tables["docs"].select("doc_id", F.lit("A").alias("code"), F.lit("c").alias("category"), F.lit(1.0).alias("risk_points"), F.lit(0.5).alias("confidence"))

    @registry.register("late")
    def late(tables):
        raised = F.raise_error(F.lit("broken row"))
        return spark.range(3).select(F.col("id").cast("string").alias("doc_id"), raised.cast("string").alias("code"), F.lit("c").alias("category"), F.lit(1.0).alias("risk_points"), F.lit(0.5).alias("confidence"))

    @registry.register("early")
    def early(tables):
        raise KeyError("x")

    @registry.register("absent", "files")
    def absent(tables):
        raise AssertionError

    with pytest.raises(ValueError):
        registry.register("one")(one)
    found, states = registry.run(spark, {"docs": spark.createDataFrame([("1",), ("2",)], "doc_id string")})
    assert sorted((r["doc_id"], r["code"], r["detector"]) for r in found.collect()) == [("1", "A", "one"), ("2", "A", "one")]
    got = {r["detector"]: (r["status"], r["findings"]) for r in states.collect()}
    assert got == {"one": ("completed", 2), "late": ("partial", 0), "early": ("partial", 0), "absent": ("not_applicable", 0)}
    assert "broken row" in states.where("detector = 'late'").first()["note"] or "Exception" in states.where("detector = 'late'").first()["note"]


def test_default_registry(spark):
    files = spark.createDataFrame([("1", bytearray(b"%PDF-1.4 /Type /Sig\n%%EOF tail"), [24], "D:20200102", "D:20200101")], "doc_id string, content binary, ends array<bigint>, created string, modified string")
    meta = spark.createDataFrame([("1", "Producer", "GIMP 2")], "doc_id string, key string, value string")
    seen = spark.createDataFrame([("1", "OCR_DATE_INVALID", "attention", "moderate"), ("1", "X", "clear", "weak")], "doc_id string, code string, state string, strength string")
    found, states = detectors.default_registry().run(spark, {"files": files, "metadata": meta, "observations": seen})
    assert {(r["detector"], r["code"]) for r in found.collect()} == {("pdf_structure", "PDF_DATE_CONTRADICTION"), ("pdf_structure", "PDF_TRAILING_DATA"), ("software", "PDF_SOFTWARE_PROVENANCE"), ("content", "OCR_DATE_INVALID")}
    assert {r["status"] for r in states.collect()} == {"completed"}


XMP = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="x" xmp:CreatorTool="Canva"><xmp:By><rdf:Seq><rdf:li>Ann</rdf:li></rdf:Seq></xmp:By></rdf:Description></rdf:RDF></x:xmpmeta>'


def png(*chunks):
    out = b"\x89PNG\r\n\x1a\n"
    for kind, body in (*chunks, (b"IEND", b"")):
        out += struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return out


def tiff(text):
    body = text.encode() + b"\0"
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x0131, 2, len(body), 26) + struct.pack("<I", 0) + body


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (b"%PDF-1.4 1 0 obj <</Producer (A \\(b\\) \\101c) /Title <FEFF00E9> /ModDate(D:2020)>> endobj" + XMP, [("xmp", "By", "Ann"), ("xmp", "CreatorTool", "Canva"), ("info", "ModDate", "D:2020"), ("info", "Producer", "A (b) Ac"), ("info", "Title", "é")]),
        (b"%PDF-1.5 5 0 obj <</Type /ObjStm /N 1>> stream\n" + zlib.compress(b"1 0 <</Creator (Hidden tool)>>") + b"\nendstream", [("info", "Creator", "Hidden tool")]),
        (b"%PDF-1.4 <</Producer (x)>> trailer <</Encrypt 4 0 R>>", [("file", "Encrypted", "true")]),
        (png((b"tEXt", b"parameters\0Steps: 20,\n Sampler"), (b"zTXt", b"Software\0\0" + zlib.compress(b"GIMP")), (b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + XMP)), [("xmp", "By", "Ann"), ("xmp", "CreatorTool", "Canva"), ("info", "Software", "GIMP"), ("info", "parameters", "Steps: 20, Sampler")]),
        (tiff("Adobe Photoshop"), [("exif", "Software", "Adobe Photoshop")]),
        (b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(tiff("Cam x"))) + b"Exif\0\0" + tiff("Cam x") + b"\xff\xfe\x00\x07hello\xff\xd9", [("exif", "Software", "Cam x"), ("info", "comment", "hello")]),
        (png((b"tEXt", b"a\0b"))[:17], []), (b"", []), (b"%PDF-1.4 /Title (open", [("info", "Title", "open")]),
    ],
)
def test_metadata_of_bytes(raw, want):
    assert metadata.entries_of(raw) == want


def test_metadata_rows(spark):
    files = spark.createDataFrame([("a", bytearray(png((b"tEXt", b"Software\0" + b"x" * 900)))), ("b", bytearray(b"none")), ("c", None)], "path string, content binary")
    entries = metadata.metadata_entries(files)
    assert [(r["path"], r["key"], len(r["value"])) for r in entries.collect()] == [("a", "Software", 500)]
    states = {r["path"]: r["state"] for r in metadata.metadata_states(files, entries, entries.where("key = 'Software'")).collect()}
    assert states == {"a": "detected", "b": "indeterminate", "c": "indeterminate"}


def test_reports(spark, tmp_path):
    findings = spark.createDataFrame([(1, "B", "é", 2.0, 0.5), (1, "A", "x", 9.0, 0.1)], "doc_id int, code string, title string, risk_points double, confidence double")
    scores = spark.createDataFrame([(1, 40.0, "review"), (2, 0.0, "low")], "doc_id int, score double, level string")
    states = spark.createDataFrame([(1, "d", "partial", "why")], "doc_id int, name string, status string, note string")
    sinks.write_reports(scores, findings, str(tmp_path / "r"), states)
    rows = {json.loads(r["value"])["doc_id"]: r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()}
    one = json.loads(rows[1])
    assert list(one) == sorted(one) and [f["code"] for f in one["findings"]] == ["A", "B"] and list(one["findings"][0]) == ["code", "confidence", "risk_points", "title"]
    assert "é" in rows[1] and one["detectors"] == [{"name": "d", "note": "why", "status": "partial"}] and json.loads(rows[2])["findings"] == []


def test_batch_outputs_hold_every_document(spark, tmp_path):
    summary = spark.createDataFrame([(50, 50, 0, 30, 15, 5, 5.0049)], "total int, succeeded int, failed int, low_count int, review_count int, high_count int, average_score double")
    docs = spark.createDataFrame([(f"<f{i:03}>", i % 7) for i in range(2500)], "filename string, score int").repartition(4)
    pages = sinks.batch_pages(summary, docs, ["filename"], per_page=400).orderBy("page").collect()
    text = "".join(p["html"] for p in pages)
    places = [text.index(f"&lt;f{i:03}&gt;") for i in range(0, 1000)]
    assert places == sorted(places) and sum(p["html"].count("<tr>") - 1 for p in pages) == 2500 and all(p["html"].count("<tr>") <= 401 for p in pages)
    sinks.write_batch_pages(summary, docs, ["filename"], str(tmp_path / "p"), per_page=400)
    assert len(list((tmp_path / "p").glob("page=*"))) == len(pages)
    sinks.write_batch_json(summary, docs, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j/summary")).first()["average_score"] == 5.0 and spark.read.json(str(tmp_path / "j/documents")).count() == 2500
    row = spark.createDataFrame([(["a/x.json", "b.MD", "c.png"], ["b.MD", "z"])], "a array<string>, b array<string>").select(sinks.recognition_artifacts(F.col("a")).alias("r"), sinks.distinct_artifacts(F.col("a"), F.col("b")).alias("d")).first()
    assert row["r"] == ["a/x.json", "b.MD"] and row["d"] == ["a/x.json", "b.MD", "c.png", "z"]
