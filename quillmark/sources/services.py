"""Service-backed operators: requests through an injected callable, and deterministic checks of what comes back.

The callable takes (payload, settings) and returns a JSON object; tests inject a double, a deployment its client. A failed request
is retried as the settings say and then becomes a row with an error: never a verdict. Checks are expressions over JSON payloads.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_THINK = re.compile(r"<think>.*?</think>", re.S)


@dataclass(frozen=True)
class ServiceSettings:
    """Settings of a service; unknown names and wrong types are refused by ``settings_from``."""

    url: str = ""
    timeout_seconds: int = 900
    max_tokens: int = 8192
    most_tokens: int = 32_768
    retries: int = 1
    required: tuple = ()


class Refused(Exception):
    """The service refuses the request's form (not its content)."""


def settings_from(values: dict, environment: dict | None = None, prefix: str = "QUILLMARK_") -> ServiceSettings:
    """Settings from a mapping, overridden by the environment."""
    known = {f.name: type(f.default) for f in fields(ServiceSettings)}
    out = {}
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"unknown setting: {name}")
        if not isinstance(value, known[name] if known[name] is not tuple else (tuple, list)) or isinstance(value, bool):
            raise ValueError(f"wrong type of setting: {name}")
        out[name] = tuple(value) if known[name] is tuple else value
    for name, kind in known.items():
        if (raw := (environment or {}).get(prefix + name.upper())) is not None and kind is not tuple:
            out[name] = kind(raw)
    return ServiceSettings(**out)


def answer_of(text: str, required: tuple = ()) -> dict | None:
    """The JSON object of an answer without its reasoning, if it holds the required keys."""
    text = _THINK.sub("", text).strip()
    start, end = text.find("{"), text.rfind("}")
    try:
        value = json.loads(text[start : end + 1]) if start >= 0 else None
    except ValueError:
        return None
    return value if isinstance(value, dict) and all(k in value for k in required) else None


def ask(call: Callable[[str, dict], str], payload: str, s: ServiceSettings) -> tuple[dict | None, str | None]:
    """(answer, error): structured form first, the loose form if that is refused, then retries with doubled tokens up to the most."""
    form, tokens, error = "schema", s.max_tokens, "no answer"
    for _ in range(s.retries + 2):
        try:
            text = call(payload, {"form": form, "max_tokens": tokens, "timeout": s.timeout_seconds, "url": s.url})
        except Refused as e:
            if form == "object":
                return None, str(e)[:240]
            form = "object"
            continue
        except Exception as e:  # noqa: BLE001  whatever the client raises becomes the row's error
            error = str(e)[:240]
            continue
        if (value := answer_of(text, s.required)) is not None:
            return value, None
        error, tokens = "answer without the required keys", min(s.most_tokens, tokens * 2)
    return None, error


def requested(df: DataFrame, id_col: str, payload_col: str, call: Callable[[str, dict], str], settings: ServiceSettings) -> DataFrame:
    """(id, answer, error): one request a row."""
    source = df.select(id_col, payload_col)
    schema = T.StructType([source.schema[id_col], *T.StructType.fromDDL("answer string, error string")])

    def run(batches):
        for batch in batches:
            got = [ask(call, p or "", settings) for p in batch.column(1).to_pylist()]
            answers = [None if a is None else json.dumps(a, ensure_ascii=False, sort_keys=True) for a, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array([e for _, e in got], pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


CLASSIFICATION = "category string, model_confidence double, ambiguous boolean, language string, country string, category_evidence array<string>, country_evidence string"
# The most confidence that a classification may keep, by what weakens it.
CAPS = {"no_evidence": 0.50, "ambiguous": 0.49, "other": 0.50, "any": 0.85}


def classification(answers: DataFrame, categories: tuple[str, ...], text_length: str = "text_length") -> DataFrame:
    """(id columns, category, confidence, language, country) from answers: id, answer, ``text_length``.

    Short texts and unknown categories become ``autre``; languages and countries must be codes, a country needs evidence.
    """
    a = F.from_json("answer", CLASSIFICATION)
    rows = answers.withColumn("a", a)
    short = (F.col(text_length) < 20) | F.col("a").isNull()
    category = F.when(~short & F.col("a.category").isin(*categories), F.col("a.category")).otherwise("autre")
    evidence = F.size(F.coalesce("a.category_evidence", F.array().cast("array<string>")))
    cap = F.least(
        F.when(evidence == 0, CAPS["no_evidence"]).otherwise(1.0), F.when(F.col("a.ambiguous"), CAPS["ambiguous"]).otherwise(1.0),
        F.when(category == "autre", CAPS["other"]).otherwise(1.0), F.lit(CAPS["any"]),
    )
    confidence = F.when(short, 0.1).otherwise(F.least(cap, F.greatest(F.lit(0.0), F.coalesce("a.model_confidence", F.lit(0.0)))))
    code = lambda c, p: F.when(c.rlike(p), c)
    country = F.when(F.trim(F.coalesce("a.country_evidence", F.lit(""))) != "", code(F.upper("a.country"), "^[A-Z]{2}$"))
    keep = [c for c in answers.columns if c not in ("answer", "error")]
    return rows.select(*keep, category.alias("category"), confidence.alias("confidence"), code(F.lower("a.language"), "^[a-z]{2}(-[a-z]{2})?$").alias("language"), country.alias("country"))


FACTS = "facts array<struct<field_code:string,role:string,raw_label:string,raw_value:string,region_ids:array<string>>>"


def validated_facts(answers: DataFrame, regions: DataFrame, field_codes: tuple[str, ...], most: int = 2000) -> DataFrame:
    """(doc_id, fact_ix, field_code, role, raw_value, region_id, page): facts of answers with known codes, a value and known regions.

    Repeats of (code, role, value) keep the first. The first region in order gives the page.
    """
    from quillmark.functions import text as t
    from quillmark.operators.scoring import first_by_key

    rows = answers.select("doc_id", F.posexplode(F.from_json("answer", FACTS)["facts"]).alias("fact_ix", "f")).where(F.col("fact_ix") < most)
    rows = rows.select("doc_id", "fact_ix", "f.field_code", F.coalesce("f.role", F.lit("unknown")).alias("role"), t.cut(F.col("f.raw_value"), 500).alias("raw_value"), F.explode("f.region_ids").alias("region_id"))
    rows = rows.where(F.col("field_code").isin(*field_codes) & F.col("raw_value").isNotNull() & ~t.is_garbage(F.col("raw_value")))
    known = rows.join(regions.select("doc_id", "region_id", "page"), ["doc_id", "region_id"])
    per = known.groupBy("doc_id", "fact_ix", "field_code", "role", "raw_value").agg(F.min(F.struct("region_id", "page")).alias("r"))
    return first_by_key(per, ["doc_id", "field_code", "role", "raw_value"], "fact_ix").select("doc_id", "fact_ix", "field_code", "role", "raw_value", "r.region_id", "r.page")


ISSUES = "issues array<struct<target_id:string,verdict:string,explanation:string,correction:string>>"
VERDICTS = ("contradicted", "unsupported", "confirmed")


def validated_reviews(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, fact_ix, review_ix, verdict, correction): issues about existing facts (``fact-0003``) with a known verdict and an explanation.

    A correction that says the same as the fact doesn't count.
    """
    from quillmark.operators.matching import comparison_key

    rows = answers.select("doc_id", F.posexplode(F.from_json("answer", ISSUES)["issues"]).alias("review_ix", "i"))
    ix = F.regexp_extract("i.target_id", r"^fact-(\d{4})$", 1).try_cast("int")
    rows = rows.select("doc_id", "review_ix", ix.alias("fact_ix"), F.col("i.verdict").alias("verdict"), F.col("i.correction").alias("correction"), F.col("i.explanation").alias("why"))
    rows = rows.where(F.col("fact_ix").isNotNull() & F.col("verdict").isin(*VERDICTS) & (F.trim(F.coalesce("why", F.lit(""))) != ""))
    both = rows.join(facts.select("doc_id", "fact_ix", "raw_value"), ["doc_id", "fact_ix"])
    real = F.col("correction").isNull() | (comparison_key(F.col("correction")) != comparison_key(F.col("raw_value")))
    return both.select("doc_id", "fact_ix", "review_ix", "verdict", F.when(real, F.col("correction")).alias("correction"))


def error_of(column: Column) -> Column:
    """An error's message as reports hold it: one line of at most 240 characters."""
    return F.left(F.regexp_replace(column, r"\s+", " "), F.lit(240))
