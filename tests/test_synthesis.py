"""Written summaries with a service's double."""

import json

from quillmark.sources import services, synthesis


def service():
    def double(prompt, how):
        if "Kind of document: broken" in prompt:
            raise TimeoutError("late")
        if "Kind of document: verdict" in prompt:
            return "Ce document est clairement frauduleux et doit être refusé sans attendre."
        return "``` Une synthèse prudente des observations relevées, " + "mot " * (400 if "long" in prompt else 5) + "```"

    return double


def test_summaries(spark):
    docs = spark.createDataFrame([(1, 80, "invoice", ["b", "a", "b"], True), (2, 10, None, [], True), (3, 40, "verdict", None, False), (4, 0, "broken", [], True), (5, 0, "long", [], True)], "doc_id int, score int, category string, fields array<string>, complete boolean")
    findings = spark.createDataFrame([(1, "A", "first signal", 9.0, 0.5), (1, "A", "first signal", 3.0, 0.9), (1, "B", "second", 5.0, 0.1), (1, "C", "no points", 0.0, 1.0)], "doc_id int, code string, title string, risk_points double, confidence double")
    seen = spark.createDataFrame([(1, "O", "a wrong date", "attention", "moderate"), (1, "P", "fine", "clear", "weak")], "doc_id int, code string, title string, state string, strength string")
    got = {}
    for r in synthesis.evidence(docs, findings, seen).orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append((r["source"], r["text"]))
    assert got[1] == [("review_decision", "Review first: several active signals."), ("classification", "Kind of document: invoice."), ("active_signal", "first signal"), ("active_signal", "second"), ("laboratory", "a wrong date"), ("document_structure", "Kinds of fields: a, b.")]
    assert got[2] == [("analysis_result", synthesis.NOTHING)] and got[3][-1] == ("extraction_quality", synthesis.UNREAD)
    asked = {r["doc_id"]: r["prompt"] for r in synthesis.prompts(synthesis.evidence(docs, findings, seen), "HEAD", 12_000).collect()}
    assert asked[1].startswith("HEAD\n") and [x["source"] for x in json.loads(asked[1][5:])] == [s for s, _ in got[1]]
    rows = {r["doc_id"]: r for r in synthesis.summaries(docs, findings, seen, service(), services.settings_from({"retries": 1})).collect()}
    assert rows[1]["note"].startswith("Une synthèse prudente") and rows[1]["error"] is None
    assert (rows[3]["note"], rows[3]["error"]) == (None, "the answer was refused") and (rows[4]["note"], rows[4]["error"]) == (None, "late")
    assert len(rows[5]["note"].split()) == 180 and rows[5]["note"].endswith("mot.")
    assert synthesis.summaries(docs.limit(0), findings, seen, service(), services.settings_from({})).count() == 0
