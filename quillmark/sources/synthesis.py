"""A short written summary of each document by a language-model service, from a bounded inventory of evidence that never holds its values.

Evidence is gathered from the checks' tables, strongest first, fitted to the service's budget as a prefix, and asked about once a document. An answer that
is too short, states a verdict or advises against a review is refused; the others are cut to a note.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillmark.functions import text as t
from quillmark.operators import chunks
from quillmark.operators.scoring import distinct_evidence
from quillmark.sources.services import ServiceSettings

RECORD_MOST = 700
#: Scores from which a review is asked for, and from which it comes first.
REVIEW, URGENT = 30, 70
SOURCES = ("review_decision", "classification", "active_signal", "laboratory", "document_structure", "extraction_quality", "analysis_result")
NOTHING = "No check found anything in particular."
UNREAD = "Some content could not be read or verified and has to be looked at in the document itself."


def evidence(documents: DataFrame, findings: DataFrame, observations: DataFrame) -> DataFrame:
    """(doc_id, place, source, text): the inventory of each document in order of its sources and, within one, of strength.

    documents: doc_id, score, category, fields (array of kinds of fields), complete (boolean). findings: doc_id, code, title, risk_points, confidence. observations:
    doc_id, code, title, state, strength. Signals without points and observations that found nothing are left out; a document without any
    record gets one that says so.
    """
    record = lambda source, order, text: F.struct(F.lit(SOURCES.index(source)).alias("rank"), order.cast("double").alias("order"), F.lit(source).alias("source"), F.left(t.collapsed(text), F.lit(RECORD_MOST)).alias("text"))
    decision = F.when(F.col("score") >= URGENT, F.lit("Review first: several active signals.")).when(F.col("score") >= REVIEW, F.lit("Review: active signals."))
    kinds = F.when(F.size("fields") > 0, F.concat(F.lit("Kinds of fields: "), F.array_join(F.array_sort(F.array_distinct("fields")), ", "), F.lit(".")))
    own = documents.select("doc_id", F.explode(F.array(
        record("review_decision", F.lit(0), decision), record("classification", F.lit(0), F.when(F.col("category").isNotNull(), F.concat(F.lit("Kind of document: "), "category", F.lit(".")))),
        record("document_structure", F.lit(0), kinds), record("extraction_quality", F.lit(0), F.when(~F.col("complete"), UNREAD)),
    )).alias("r"))
    signals = distinct_evidence(findings.where("risk_points > 0")).select("doc_id", record("active_signal", F.col("place"), F.col("title")).alias("r"))
    seen = observations.where("state = 'attention'").dropDuplicates(["doc_id", "code", "title"])
    strength = F.when(F.col("strength") == "strong", 0).when(F.col("strength") == "moderate", 1).otherwise(2)
    rows = own.unionByName(signals).unionByName(seen.select("doc_id", record("laboratory", strength, F.col("title")).alias("r"))).where(F.coalesce("r.text", F.lit("")) != "")
    rows = rows.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    none = documents.select("doc_id").join(rows.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", record("analysis_result", F.lit(0), F.lit(NOTHING)).alias("r"))
    order = Window.partitionBy("doc_id").orderBy("r.rank", "r.order", "r.text")
    return rows.unionByName(none).select("doc_id", F.row_number().over(order).alias("place"), "r.source", "r.text")


def prompts(records: DataFrame, head: str, max_chars: int) -> DataFrame:
    """(doc_id, prompt): the records that fit, as JSON after the head."""
    sized = records.withColumn("json", F.to_json(F.struct("source", "text"))).withColumn("size", F.length("json"))
    fitted = chunks.fitting_prefix(sized, max_chars, "doc_id", "place", "size")
    per = fitted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "json"))).alias("r"))
    return per.select("doc_id", F.concat(F.lit(head + "\n["), F.array_join(F.transform("r", lambda x: x["json"]), ","), F.lit("]")).alias("prompt"))


def said(df: DataFrame, id_col: str, prompt_col: str, call: Callable[[str, dict], str], settings: ServiceSettings) -> DataFrame:
    """(id, text, error): one plain text a row, with retries."""
    source = df.select(id_col, prompt_col)
    schema = T.StructType([source.schema[id_col], *T.StructType.fromDDL("text string, error string")])

    def one(prompt):
        error = "no answer"
        for _ in range(settings.retries + 1):
            try:
                return call(prompt, {"form": "text", "max_tokens": settings.max_tokens, "timeout": settings.timeout_seconds, "url": settings.url}), None
            except Exception as e:  # noqa: BLE001  whatever the client raises becomes the row's error
                error = str(e)[:240]
        return None, error

    def run(batches):
        for batch in batches:
            got = [one(p or "") for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def summaries(documents: DataFrame, findings: DataFrame, observations: DataFrame, call: Callable[[str, dict], str], settings: ServiceSettings, head: str = "", max_chars: int = 12_000) -> DataFrame:
    """(doc_id, note, error): the note of each document, null with the reason where the service failed or its answer was refused."""
    answers = said(prompts(evidence(documents, findings, observations), head, max_chars), "doc_id", "prompt", call, settings)
    cleaned = t.collapsed(F.regexp_replace("text", r"^[\s`]+|[\s`]+$", ""))
    fine = F.coalesce(t.summary_allowed(cleaned), F.lit(False))
    error = F.when(F.col("text").isNull(), F.col("error")).when(~fine, "the answer was refused")
    return answers.select("doc_id", F.when(fine, t.limited_note(cleaned)).alias("note"), error.alias("error"))
