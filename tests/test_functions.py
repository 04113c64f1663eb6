"""Expected values of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmark.functions import amounts, dates, identifiers, text


def values(spark, rows, expr, schema="v string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(expr).collect()]


def test_identifiers(spark):
    cases = {
        "siren": {"404833048": True, "404833049": False},
        "siret": {"73282932000074": True, "73282932000075": False},
        "rpps": {"10000668540": True, "10000668541": False},
        "finess": {"921234563": True, "921234564": False},
        "eu_vat": {"FR40303265045": True, "LU26375245": True, "LU26375246": False, "DE136695976": True, "DE136695978": False, "PL8567346215": True, "ZZ12": False},
        "iban": {"LU28 0019 4006 4475 0000": True, "GB82WEST12345698765432": True, "GB83WEST12345698765432": False, "SA0380000000608010167519": True},
        "bic": {"CCPLLULL": True, "PBNKDEFFXXX": True, "PBNKDEFFXX": False, "PBNKQQFF": False},
    }
    for kind, expected in cases.items():
        got = values(spark, list(expected), identifiers.VALIDATORS[kind](F.col("v"))["valid"])
        assert got == list(expected.values()), kind
    assert values(spark, [None], identifiers.iban(F.col("v"))) == [None]


def test_reasons(spark):
    assert values(spark, ["4111111111111121", "411", "4111x1111111111111"], identifiers.card_number(F.col("v"))["reasons"]) == [["invalid_checksum"], ["invalid_length"], ["invalid_format"]]
    assert values(spark, ["ZZ89370400440532013000"], identifiers.iban(F.col("v"))["reasons"])[0][0] in ("invalid_checksum", "unknown_country_or_structure")


def test_table_amounts(spark):
    cases = {"1,234.56": 1234.56, "1.234,56 EUR": 1234.56, "(12.50)": -12.5, "1,234": 1234, "1,23": 1.23, "1.234.567": 1234567, "1,2,34": 12.34, "1,2,3": None, "": None, "-": None, "abc": None}
    got = values(spark, list(cases), amounts.table_amount(F.col("v")).cast("double"))
    assert got == list(cases.values())


@pytest.mark.parametrize(
    ("raw", "language", "country", "value", "status"),
    [
        ("5.01", None, None, 5.01, "normalized"), ("1,234.56 USD", "en", "US", 1234.56, "normalized"), ("1.234,56 EUR", "fr", "LU", 1234.56, "normalized"),
        ("125,-", "fr", "LU", 125.0, "normalized"), ("2,356,45", "fr", "LU", 2356.45, "normalized"), ("+/-500", None, None, 500.0, "normalized"),
        ("+1-500", None, None, 500.0, "normalized"), ("400-500", None, None, None, "ambiguous"), ("rien", None, None, None, "raw_only"),
    ],
)
def test_fact_amounts(spark, raw, language, country, value, status):
    got = values(spark, [(raw, language, country)], amounts.fact_amount(F.col("v"), F.col("l"), F.col("c")), "v string, l string, c string")[0]
    assert (got["value"], got["status"]) == (value, status)


@pytest.mark.parametrize(
    ("raw", "language", "country", "value", "status"),
    [
        ("21,01,2025", None, None, "2025-01-21", "normalized"), ("21/01/25", "fr", "LU", "2025-01-21", "normalized"), ("1/21/25", "en", "US", "2025-01-21", "normalized"),
        ("31/12/99", "fr", "LU", "1999-12-31", "normalized"), ("01/02/25", None, None, None, "ambiguous"), ("20,7,20.93", None, None, None, "raw_only"),
        ("01/02/2025 03/04/2025", "fr", "FR", None, "ambiguous"), ("31/02/2025", "fr", "FR", None, "raw_only"),
    ],
)
def test_fact_dates(spark, raw, language, country, value, status):
    got = values(spark, [(raw, language, country)], dates.normalized_date(F.col("v"), F.col("l"), F.col("c")), "v string, l string, c string")[0]
    assert (got["value"], got["status"]) == (value, status)


def test_found_dates(spark):
    got = values(spark, ["31/02/2026 et 2030-01-05, 14-05-6789 et 03/04/2025"], dates.found_dates(F.col("v")))[0]
    assert [(r["value"], r["ambiguous"]) for r in got] == [(dt.date(2030, 1, 5), False), (None, False), (dt.date(2025, 4, 3), True)]
    assert values(spark, ["D:20260102030405+02'00'", "D:2026", "x"], dates.pdf_date(F.col("v"))) == [dt.datetime(2026, 1, 2, 3, 4, 5), dt.datetime(2026, 1, 1), None]


def test_text(spark):
    assert values(spark, ["aあb  \n\n\n\nc� "], text.sanitized(F.col("v"))) == ["ab\n\nc"]
    assert values(spark, ["Éléphant  n°5"], text.folded(F.col("v"))) == ["elephant n 5"]
    assert values(spark, ["Pensez à l'environnement avant d'imprimer", "Facture"], text.is_boilerplate(F.col("v"))) == [True, False]
    assert values(spark, ["payer 12,50 EUR à a.b@c.org le 01/02/2025"], text.abstracted(F.col("v"))) == ["payer [date ou valeur] EUR à [adresse] le [date ou valeur]"]
    assert values(spark, ["LU280019400644750000"], text.grouped_by_four(F.col("v"))) == ["LU28 0019 4006 4475 0000"]
    assert values(spark, ["Le document est frauduleux selon toute apparence ici.", "Une synthèse prudente des observations relevées ici."], text.summary_allowed(F.col("v"))) == [False, True]


def test_context_currency(spark):
    rows = [(["rien", "12 chf net"],), (["US$ 5", "EUR"],), (["XXX", "abc"],), ([],)]
    assert values(spark, rows, amounts.context_currency(F.col("v")), "v array<string>") == ["CHF", "USD", None, None]


def test_structured_values_are_counted_and_left_out(spark):
    rows = spark.createDataFrame([({"structured_fields": '["a", "b"]', "x": "1"},), ({"structured_fields": '{"a": 1}'},), ({"x": "1"},), (None,)], "e map<string,string>")
    got = [r[0] for r in rows.select(text.without_structured_values(F.col("e"))).collect()]
    assert got == [{"x": "1", "structured_field_count": "2"}, {"structured_field_count": "1"}, {"x": "1"}, None]


def test_folding_follows_compatibility_forms(spark):
    import re
    import unicodedata

    words = ["Éclair à l'ŷ", "ﬁn ﬂat oﬃce", "Ｆｕｌｌ　１２", "①② x²", "Ångström", "plain ASCII-1", "naïve é", "ĳs", None, "ß ø 漢"]
    plain = lambda v: " ".join(re.sub("[^a-zA-Z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))).lower().split())
    rows = spark.createDataFrame([(w,) for w in words], "v string").select(text.folded(F.col("v"))).collect()
    assert [r[0] for r in rows] == [None if w is None else plain(w) for w in words]
