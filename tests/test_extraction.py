"""Labelled identifiers, page objects and service answers on small rows."""

import json

from pyspark.sql import functions as F

from quillmark.operators import labelled, page_objects
from quillmark.sources import services

TEXT = (
    "Card number: 4111 1111 1111 1111 then credit card no 4111 1111 1111 1121. Carte bancaire 9401 XXXX XXXX 0100 00\n"
    "IBAN : LU28 0019 4006 4475 0000 BIC CCPL LU LL; SIRET: 732 829 320 00074 SIREN 404833048, TVA FR40 303 265 045; RPPS 10000668540 CKYC S12345678901234 MICR 123456789"
)


def test_labelled_identifiers(spark):
    regions = spark.createDataFrame([(1, 2, TEXT, 9), (1, 3, TEXT, 9), (2, 1, None, 9), (3, 1, "SIRET 73282932000075 MICR 12345678", 9)], "doc_id int, page int, content string, kind int")
    rows = labelled.checked_identifiers(labelled.labelled_identifiers(regions)).collect()
    got = {(r["doc_id"], r["kind"], r["value"]): (r["state"], r["page"], r["pages"]) for r in rows}
    assert got[1, "card", "4111111111111111"] == ("clear", 2, 2) and got[1, "card", "4111111111111121"][0] == "attention"
    assert got[1, "card", "9401XXXXXXXX010000"][0] == "indeterminate"
    for kind, value in (("iban", "LU280019400644750000"), ("bic", "CCPLLULL"), ("siret", "73282932000074"), ("siren", "404833048"), ("eu_vat", "FR40303265045"), ("rpps", "10000668540"), ("ckyc", "S12345678901234"), ("micr", "123456789")):
        assert got[1, kind, value][0] == "clear", (kind, got)
    assert got[3, "siret", "73282932000075"][0] == "attention" and got[3, "micr", "12345678"][0] == "detected"
    where = labelled.bank_geography(spark.createDataFrame(rows), regions).collect()
    assert [(r["doc_id"], r["country"]) for r in where] == [(1, "LU")]
    assert labelled.checked_identifiers(labelled.labelled_identifiers(regions.limit(0))).count() == 0


def test_page_objects(spark):
    schema = "doc_id int, page int, object_ix int, type string, text string, font string, embedded boolean, render_mode int, x0 double, y0 double, x1 double, y1 double, coverage double, scanner boolean"
    rows = [
        (1, 1, 1, "image", None, None, None, None, 0.0, 0.0, 100.0, 100.0, 0.9, False), (1, 1, 2, "image", None, None, None, None, 0.0, 0.0, 9.0, 9.0, 0.1, False),
        (1, 1, 3, "text", "x" * 30, "A", True, 3, 0.0, 0.0, 9.0, 9.0, None, None), (1, 2, 4, "text", "secret", "B", False, 3, 200.0, 0.0, 209.0, 9.0, None, None),
        (1, 2, 5, "text", "seen", "A", True, 0, 0.0, 0.0, 9.0, 9.0, None, None),
    ]
    objects = spark.createDataFrame(rows, schema)
    assert [(r["font"], r["uses"], r["rank"]) for r in page_objects.font_inventory(objects).orderBy("rank").collect()] == [("A", 2, 1), ("B", 1, 2)]
    assert {(r["page"], r["state"]) for r in page_objects.hidden_text(objects).collect()} == {(1, "ocr_layer"), (2, "hidden")}
    pages = spark.createDataFrame([(1, 1, 100.0, 100.0), (1, 2, 100.0, 100.0)], "doc_id int, page int, width double, height double")
    assert [(r["page"], r["n"]) for r in page_objects.outside_text(objects, pages).collect()] == [(2, 1)]
    over = page_objects.overlays(objects, spark.createDataFrame([(1, 2)], "doc_id int, revisions int")).collect()
    assert [(r["object_ix"], r["points"]) for r in over] == [(2, 35.0)]
    notes = spark.createDataFrame([(1, 1, 0, "Stamp", [0.0, 0.0, 1.0, 1.0]), (1, 1, 1, "Link", [0.0, 0.0, 1.0, 1.0]), (1, 1, 2, "Ink", [0.0])], "doc_id int, page int, annotation_ix int, subtype string, rect array<double>")
    assert [r["annotation_ix"] for r in page_objects.annotation_findings(notes).collect()] == [0]
    marks = spark.createDataFrame([(1, i, i, 50.0, 20.0, 300.0 + i, 400.0) for i in range(4)] + [(1, 9, 9, 50.0, 20.0, 900.0, 400.0)], "doc_id int, mark_id int, page int, width double, height double, cx double, cy double")
    pairs = page_objects.mark_pairs(marks)
    assert pairs.count() == 12
    got = page_objects.repeated_marks(marks, pairs.select("left", "right", F.lit(0.95).alias("similarity"))).collect()
    assert [(r["anchor"], r["members"]) for r in got] == [(0, [0, 1, 2, 3])]
    ends = spark.createDataFrame([(1, 10), (1, 30), (2, 5)], "doc_id int, end_offset int")
    assert [tuple(r) for r in page_objects.revision_transitions(ends).collect()] == [(1, 0, 10, 30)]


def test_services(spark):
    def double(payload, how):
        """A service's double: refuses the strict form, then answers by payload."""
        if how["form"] == "schema":
            raise services.Refused("no schema")
        if payload == "fail":
            raise TimeoutError("late")
        return '<think>{"no": 1}</think>' + json.dumps({"category": "facture", "model_confidence": 0.99, "language": "FR", "country": "lu", "country_evidence": "Luxembourg", "category_evidence": ["Facture"]})

    df = spark.createDataFrame([(1, "text of a document", 200), (2, "fail", 200), (3, "x", 5)], "doc_id int, text string, text_length int")
    got = services.requested(df, "doc_id", "text", double, services.settings_from({"required": ["category"], "retries": 1})).join(df.select("doc_id", "text_length"), "doc_id")
    assert {r["doc_id"]: r["error"] for r in got.collect()} == {1: None, 2: "late", 3: None}
    rows = {r["doc_id"]: r for r in services.classification(got, ("facture",)).collect()}
    assert (rows[1]["category"], rows[1]["confidence"], rows[1]["language"], rows[1]["country"]) == ("facture", 0.85, "fr", "LU")
    assert rows[2]["category"] == rows[3]["category"] == "autre" and rows[2]["confidence"] == 0.1
    assert services.settings_from({}, {"QUILLMARK_MAX_TOKENS": "5"}).max_tokens == 5
    for bad in ({"other": 1}, {"url": 3}, {"retries": True}):
        try:
            services.settings_from(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_facts_and_reviews(spark):
    regions = spark.createDataFrame([(1, "r1", 4), (1, "r2", 2)], "doc_id int, region_id string, page int")
    facts = {"facts": [{"field_code": "iban", "raw_value": "LU28", "region_ids": ["r2", "r1"]}, {"field_code": "iban", "raw_value": "LU28", "region_ids": ["r1"]}, {"field_code": "nope", "raw_value": "x", "region_ids": ["r1"]}, {"field_code": "iban", "raw_value": "y", "region_ids": ["zz"]}]}
    got = services.validated_facts(spark.createDataFrame([(1, json.dumps(facts))], "doc_id int, answer string"), regions, ("iban",)).collect()
    assert [(r["fact_ix"], r["raw_value"], r["region_id"], r["page"]) for r in got] == [(0, "LU28", "r1", 4)]
    issues = {"issues": [{"target_id": "fact-0000", "verdict": "contradicted", "explanation": "e", "correction": "LU 29"}, {"target_id": "fact-0009", "verdict": "contradicted", "explanation": "e"}, {"target_id": "fact-0000", "verdict": "contradicted", "explanation": "e", "correction": "lu-28"}]}
    reviews = services.validated_reviews(spark.createDataFrame([(1, json.dumps(issues))], "doc_id int, answer string"), spark.createDataFrame(got)).orderBy("review_ix").collect()
    assert [(r["review_ix"], r["correction"]) for r in reviews] == [(0, "LU 29"), (2, None)]
