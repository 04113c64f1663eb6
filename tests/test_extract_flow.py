"""The extraction flow with a service's double: chunks, a second pass over what was left out, checked facts and tables."""

import json
import re

from pyspark.sql import functions as F

from quillmark.sources import extraction, services

REGIONS = "doc_id int, page int, region_id string, reading_order int, label string, native_label string, bbox array<double>, content string"
TABLE = "<table><tr><th>Date</th><th>Libellé</th><th>Solde</th></tr><tr><td>1</td><td>a</td><td>5</td></tr><tr><td>2</td><td>b</td><td>6</td></tr></table>"


def service():
    """A double that workers can take along: a function inside a function."""

    def double(payload, how):
        """Answers with a fact for each region whose text has a colon; tables for those with a table; passes over regions that say ``later`` on the first pass."""
        out = {"facts": [], "tables": [], "region_dispositions": []}
        for rid, body in re.findall(r'<region id="([^"]+)"[^>]*>\n(.*?)\n</region>', payload, re.S):
            if "<table" in body:
                out["tables"].append({"title": " T ", "semantic_type": "bank_transactions", "region_ids": [rid, "zz"], "column_roles": ["balance", "nonsense"], "default_row_role": "data", "row_role_overrides": [{"row_index": 1, "role": "total"}, {"row_index": 9, "role": "total"}, {"row_index": 0, "role": "bad"}]})
            elif "later" in body and payload.count("<region") > 3:
                continue
            elif ":" in body:
                out["facts"].append({"field_code": "iban" if "iban" in body else "odd", "raw_value": body.split(":")[1], "region_ids": [rid]})
            else:
                out["region_dispositions"].append({"region_id": rid, "disposition": "context"})
        return json.dumps(out)

    return double


def test_flow(spark):
    texts = ["iban: LU1", "words", "odd: x", TABLE, "later: y iban: LU2", "iban: LU1", "please think of the environment before printing"]
    rows = [(d, 1, f"p001-r{i:03}", i, "text", "text", None, x) for d in (1, 2) for i, x in enumerate(texts)]
    regions = spark.createDataFrame(rows, REGIONS)
    prompts = extraction.chunk_prompts(regions, "HEAD", 1500).collect()
    assert len(prompts) > 2 and all(p["prompt"].startswith("HEAD\n") for p in prompts)
    settings = services.settings_from({"required": ["facts"]})
    answers = extraction.extract(regions, service(), settings, max_chars=100_000)
    assert {(r["doc_id"], r["turn"]) for r in answers.select("doc_id", "turn").collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    facts = extraction.extracted_facts(answers, regions, ("iban",)).where("doc_id = 1").orderBy("fact_ix").collect()
    assert [(f["fact_ix"], f["raw_value"], f["region_id"]) for f in facts][0] == (0, "LU1", "p001-r000") and len(facts) == len({f["raw_value"] for f in facts})
    table = extraction.extracted_tables(answers, regions, ("bank_transactions",), ("balance", "transaction_date", "description"), ("data", "total")).where("doc_id = 2").collect()
    assert len(table) == 1
    t = table[0]
    assert (t["title"], t["headers"], t["column_roles"], t["row_roles"], t["pages"]) == ("T", ["Date", "Libellé", "Solde"], ["balance", "description", "balance"], ["data", "total"], [1])
    assert t["rows"] == [["1", "a", "5"], ["2", "b", "6"]]
    got = {r["doc_id"]: (r["regions"], r["mapped"], r["disposed"]) for r in extraction.extraction_coverage(answers, regions).collect()}
    assert got == {1: (7, 5, 2), 2: (7, 5, 2)}
    assert extraction.extract(regions.limit(0), service(), settings).count() == 0
    assert extraction.extract(regions, service(), settings, retry=False).where(F.col("turn") == 2).count() == 0


def test_long_regions_are_cut(spark):
    long = "".join(chr(97 + i % 26) for i in range(5000))
    regions = spark.createDataFrame([(1, 1, "p001-r000", 0, "text", "text", None, long), (1, 1, "p001-r001", 1, "text", "text", None, "end")], REGIONS)
    prompts = [p["prompt"] for p in extraction.chunk_prompts(regions, "", 1000).orderBy("chunk").collect()]
    assert len(prompts) > 5 and long in "".join(p[1:] for p in prompts) and "end" in prompts[-1]


def counting(folder):
    """A client that leaves a file for each call, fails the first call of some prompts, and answers from the prompt alone."""

    def call(payload, how):
        import os
        import uuid

        with open(f"{folder}/{how['key']}.{uuid.uuid4().hex}", "w") as f:
            f.write(payload)
        if "fails" in payload and len([n for n in os.listdir(folder) if n.startswith(how["key"])]) < 3:
            raise TimeoutError("late")
        return json.dumps({"facts": [{"field_code": "iban", "raw_value": "LU1", "region_ids": re.findall(r'id="([^"]+)"', payload)[:1]}], "additional_fields": [], "tables": [], "region_dispositions": []})

    return call


def test_each_prompt_is_asked_once(spark, tmp_path):
    import os
    from collections import Counter

    (tmp_path / "calls").mkdir()
    calls = lambda: Counter(n.split(".")[0] for n in os.listdir(tmp_path / "calls"))
    rows = [(d, 1, f"p001-r{i:03}", i, "text", "text", None, f"text {i} of a document") for d in range(6) for i in range(3)]  # equal documents: equal prompts
    rows += [(9, 1, "p001-r000", 0, "text", "text", None, "one more text")]
    regions, kept = spark.createDataFrame(rows, REGIONS), str(tmp_path / "journal")
    settings = services.settings_from({"required": ["facts"], "retries": 0})
    answers = extraction.extract(regions, counting(str(tmp_path / "calls")), settings, max_chars=100_000, kept=kept)
    for _ in range(2):
        assert answers.where("a is not null").count() == answers.count() > 0
        extraction.extracted_facts(answers, regions, ("iban",)).collect()
    first = calls()
    assert set(first.values()) == {1} and len(first) == 3  # two different documents, and what their answers left out
    again = extraction.extract(regions, counting(str(tmp_path / "calls")), settings, max_chars=100_000, kept=kept)
    assert sorted(map(str, again.collect())) == sorted(map(str, answers.collect())) and calls() == first
    # a failed prompt is asked again by the next run, and only that one
    more = regions.unionByName(spark.createDataFrame([(10, 1, "p001-r000", 0, "text", "text", None, "this fails at first")], REGIONS))
    run = lambda: extraction.extract(more, counting(str(tmp_path / "calls")), settings, max_chars=100_000, retry=False, kept=kept).where("doc_id = 10").first()
    assert run()["error"] == "late" and run()["error"] is None and run()["a"] is not None
    assert {k: n for k, n in calls().items() if k in first} == first and sorted(calls().values()) == [1, 1, 1, 3]


def test_additional_fields(spark):
    texts = ["alpha beta gamma", "please think of the environment before printing", "delta"]
    regions = spark.createDataFrame([(1, 1 + i, f"r{i}", i, "text", "text", None, x) for i, x in enumerate(texts)], REGIONS)
    fields = [("Room", "12", ["r2", "r0", "zz"]), ("room", "12", ["r0", "r2"]), ("Room", "12", ["r0"]), ("Same", "same!", ["r0"]), ("", "x", ["r0"]), ("Foot", "note", ["r1"]), ("None", "where", ["zz"]), ("Bad", None, ["r0"])]
    answer = {"facts": [], "additional_fields": [{"raw_label": a, "raw_value": b, "region_ids": c} for a, b, c in fields], "tables": [], "region_dispositions": []}
    answers = spark.createDataFrame([(1, 1, 0, json.dumps(answer))], "doc_id int, turn int, chunk int, answer string").select("doc_id", "turn", "chunk", F.from_json("answer", extraction.ANSWER).alias("a"))
    got = [(r["field_ix"], r["raw_label"], r["raw_value"], r["region_ids"], r["page"]) for r in extraction.additional_fields(answers, regions).orderBy("field_ix").collect()]
    assert got == [(0, "Room", "12", ["r0", "r2"], 1), (2, "Room", "12", ["r0"], 1), (6, "None", "where", [], None)]
    assert extraction.additional_fields(answers.limit(0), regions).count() == 0
    assert {r["region_id"] for r in extraction.named_regions(answers).collect()} >= {"r0", "r2", "r1"}
