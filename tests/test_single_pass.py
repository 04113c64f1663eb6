"""Texts are read once and by several tasks, whatever the file's groups of rows; what concerns a whole document is found on the way."""

import pytest

from quillmark import catalog
from quillmark.operators import labelled, regions, tables
from quillmark.plans import spread


@pytest.mark.parametrize("name", ["identifier_observations", "identifier_checks", "registration_numbers", "best_tables"])
def test_one_reading_by_several_tasks(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert "RepartitionByExpression" in plan.split("MapInArrow")[1]
    assert spread(spark.range(9).coalesce(1), "id").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_countries_found_on_the_way(spark):
    texts = {1: "CKYC S12345678901234 MICR 123456789 BIC CCPL LU LL", 2: "CKYC S12345678901234 account branch Luxembourg", 3: "CKYC S12345678901234 BIC CCPL LU LL BIC DEUT DE FF", 4: "BIC CCPL LU LL", 5: "account branch Luxembourg",
        6: "CKYC S12345678901234 BIC SBIN IN BB", 7: "carte bancaire 4111111111111111 carte bancaire 4111111111111112", 8: "carte bancaire 4111111111111111 carte bancaire 5555555555554444"}
    regions = spark.createDataFrame([(k, p, v) for k, v in texts.items() for p in (1, 2)], "doc_id int, page int, content string")
    checked = labelled.checked_identifiers(labelled.labelled_identifiers(regions))
    rows = lambda df: sorted(map(str, df.collect()))
    found = labelled.identifier_observations(checked, regions=regions)
    assert rows(found) == rows(labelled.identifier_observations(checked, labelled.bank_geography(checked, regions)))
    whole = ("OCR_BANKING_GEOGRAPHY_MISMATCH", "OCR_BANKING_FOREIGN_FIELD", "OCR_CARD_VALUES_CONFLICT", "OCR_CARD_MULTIPLE_VALUES")
    got = sorted((r["doc_id"], r["code"], r["value"], r["page"]) for r in found.collect() if r["code"] in whole)
    assert got == [(1, whole[0], "LU", None), (2, whole[1], "LU", None), (7, whole[2], "4111111111111111,4111111111111112", 1), (8, whole[3], "4111111111111111,5555555555554444", 1)]
    assert not {r["code"] for r in labelled.identifier_observations(checked).collect()} & set(whole[:2])


def test_best_of_equal_tables_is_the_first(spark):
    html = "<table><tr><td>a</td></tr></table><table><tr><td>b</td><td>c</td></tr></table><table><tr><td>d</td><td>e</td></tr></table>"
    cells = tables.html_cells(spark.createDataFrame([(1, html), (2, html)], "doc_id int, html string"), "doc_id", "html")
    best = tables.best_tables(cells)
    assert best.columns == cells.columns and best._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r["doc_id"], r["table_ix"], r["text"]) for r in best.where("row_ix > 0").collect()) == [(d, 1, x) for d in (1, 2) for x in "bc"]


def test_agreement_without_a_join(spark):
    left = spark.createDataFrame([(1, "a b b c"), (2, None), (3, ""), (None, "a"), (5, "x y")], "doc_id int, text string")
    right = spark.createDataFrame([(1, "b b b &lt;a"), (2, "a"), (4, "<p>a</p>"), (None, "a"), (5, "x"), (5, "y")], "doc_id int, html string")
    got = regions.token_agreement(left, right, "text", "html")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["agreement"] for r in got.collect()} == {1: 0.75, 2: 0.0, 3: 0.0, 4: 0.0, None: 0.0, 5: 1.0}
