"""Findings to an explainable review-priority score per document, and summaries of batches.

Findings: doc_id, category, code, risk_points (further columns are kept where said). Every step is an aggregation by document, so
all of them share one shuffle key; the family caps are a literal map in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The most points that a family of signals can give.
FAMILY_CAPS = {
    "annotations": 10.0, "content_consistency": 30.0, "document_integrity": 20.0, "metadata": 15.0, "page_composition": 45.0,
    "raster_forensics": 30.0, "provenance_integrity": 20.0, "revision_history": 15.0, "revision_visual": 60.0, "synthetic_media": 45.0,
}
DEFAULT_CAP = 20.0
HIGH, REVIEW, SINGLE_FAMILY_MOST = 70, 30, 69


def family_scores(findings: DataFrame, *keys: str) -> DataFrame:
    """(keys, category, family_score): strongest code in full, the other codes at a fifth, capped."""
    by = keys or ("doc_id",)
    codes = findings.where(F.col("risk_points") > 0).groupBy(*by, "category", "code").agg(F.max("risk_points").alias("points"))
    cap = F.create_map(*[F.lit(x) for kv in FAMILY_CAPS.items() for x in kv])
    raw = F.max("points") + 0.2 * (F.sum("points") - F.max("points"))
    fam = codes.groupBy(*by, "category").agg(raw.alias("raw"))
    return fam.select(*by, "category", F.least(F.coalesce(F.try_element_at(cap, F.col("category")), F.lit(DEFAULT_CAP)), "raw").alias("family_score"))


def weighted_total(ordered: Column) -> Column:
    """Weighted sum of an array of family scores, largest first; 0 for none."""
    n = F.size(ordered)
    rest = F.aggregate(F.slice(ordered, 3, 1000), F.lit(0.0), lambda a, x: a + x)
    first, second = F.try_element_at(ordered, F.lit(1)), F.try_element_at(ordered, F.lit(2))
    return F.when(n > 0, first + 0.35 * F.coalesce(second, F.lit(0.0)) + 0.15 * rest).otherwise(0.0)


def assessed(documents: DataFrame, families: DataFrame, *keys: str) -> DataFrame:
    """Score and level for every row of ``documents`` (the keys), from its family scores."""
    by = keys or ("doc_id",)
    # the number of families is bounded by the categories of the detectors
    per = families.groupBy(*by).agg(F.sort_array(F.collect_list("family_score"), asc=False).alias("f"))
    rows = documents.select(*by).distinct().join(per, list(by), "left").withColumn("f", F.coalesce("f", F.array().cast("array<double>")))
    # bround rounds half to even; the cap comes after the coalesce, as least() skips nulls
    score = F.bround(F.least(F.lit(100.0), weighted_total(F.col("f"))), 0).cast("int")
    score = F.when(F.size("f") < 2, F.least(score, F.lit(SINGLE_FAMILY_MOST))).otherwise(score)
    rows = rows.select(*by, F.size("f").alias("n_families"), score.alias("score"))
    level = F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= REVIEW, "review").otherwise("low")
    return rows.withColumn("level", level)


def assess_risk(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, n_families, score, level) of every document, those without findings included."""
    return assessed(documents, family_scores(findings))


def cumulative_steps(findings: DataFrame, order: list[str]) -> DataFrame:
    """Score of each document after revealing the categories one by one, in the given order: (doc_id, step, score)."""
    places = F.array_position(F.array(*map(F.lit, order)), F.col("category"))
    # a finding counts in its own step and all later ones; the steps are as few as the categories
    shown = findings.withColumn("place", places).where("place > 0").withColumn("step", F.explode(F.sequence(F.col("place"), F.lit(len(order)).cast("bigint"))))
    steps = findings.select("doc_id").distinct().withColumn("step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(len(order)).cast("bigint"))))
    return assessed(steps, family_scores(shown, "doc_id", "step"), "doc_id", "step").select("doc_id", "step", "score")


def family_gauge(findings: DataFrame, documents: DataFrame, families: list[str] | None = None) -> DataFrame:
    """(doc_id, category, family_score, percent, tone) for every document and family, absent ones at zero."""
    names = families or sorted(FAMILY_CAPS)
    grid = documents.select("doc_id").distinct().withColumn("category", F.explode(F.array(*map(F.lit, names))))
    rows = grid.join(family_scores(findings), ["doc_id", "category"], "left").withColumn("family_score", F.coalesce("family_score", F.lit(0.0)))
    cap = F.create_map(*[F.lit(x) for kv in FAMILY_CAPS.items() for x in kv])
    percent = F.bround(100 * F.col("family_score") / F.coalesce(F.try_element_at(cap, F.col("category")), F.lit(DEFAULT_CAP)), 0).cast("int")
    tone = F.when(percent >= 75, "high").when(percent >= 40, "medium").when(percent > 0, "low").otherwise("none")
    return rows.select("doc_id", "category", "family_score", percent.alias("percent"), tone.alias("tone"))


def document_summary(findings: DataFrame, assessments: DataFrame, detectors: list[str]) -> DataFrame:
    """Summary row per document: counts of findings and the detectors with findings, in their fixed order."""
    place = F.array_position(F.array(*map(F.lit, detectors)), F.col("detector"))
    per = findings.groupBy("doc_id").agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("risk_points") > 0).alias("scored_findings"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(place.alias("place"), "detector"))), lambda x: x["detector"]), ",").alias("detectors"),
    )
    out = assessments.join(per, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*assessments.columns, zero("findings"), zero("scored_findings"), F.coalesce("detectors", F.lit("")).alias("detectors"))


def batch_summary(documents: DataFrame) -> DataFrame:
    """One row from (status, level, score): counts of successes by level, failures and the average score of successes."""
    fine = F.col("status") == "success"
    level = lambda name: F.count_if(fine & (F.col("level") == name)).alias(f"{name}_count")
    return documents.agg(
        F.count("*").alias("total"),
        F.count_if(fine).alias("succeeded"),
        F.count_if(~fine).alias("failed"),
        level("low"), level("review"), level("high"),
        F.coalesce(F.round(F.avg(F.when(fine, F.col("score"))), 2), F.lit(0.0)).alias("average_score"),
    )


def display_groups(findings: DataFrame) -> DataFrame:
    """(doc_id, category, code, title, points, confidence, n): findings grouped for display, the strongest one standing for them."""
    best = F.max(F.struct("risk_points", "confidence")).alias("best")
    g = findings.groupBy("doc_id", "category", "code", "title").agg(best, F.count("*").alias("n"))
    return g.select("doc_id", "category", "code", "title", F.col("best.risk_points").alias("points"), F.col("best.confidence").alias("confidence"), "n")


def top_findings(findings: DataFrame, k: int, order: list[Column], *keys: str) -> DataFrame:
    """The first k findings of each group in the given total order."""
    w = Window.partitionBy(*(keys or ("doc_id",))).orderBy(*order)
    return findings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distinct_evidence(findings: DataFrame, *text: str) -> DataFrame:
    """Findings of a document in order of points and confidence, each pair of code and text once, the strongest; ``place`` counts from 1."""
    text = text or ("title",)
    strength = [F.desc("risk_points"), F.desc("confidence"), F.col("code")]
    once = findings.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "code", *text).orderBy(*strength))).where("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*strength, *text)))


def first_by_key(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Order-preserving removal of repeats: of each key the row of the lowest position stays."""
    w = Window.partitionBy(*keys).orderBy(position)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# States from the most to the least pressing.
STATES = ("attention", "error", "indeterminate", "detected", "clear", "not_applicable")


def state_counts(observations: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, one count for each state, summary): what a group's observations came to, in numbers and in a line of text."""
    per = observations.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    said = F.concat_ws(", ", *[F.when(F.col(s) > 0, F.format_string(f"%d {s}", F.col(s))) for s in STATES])
    return per.withColumn("summary", F.concat(F.format_string("%d checks: ", F.col("total")), said))


def overall_state(observations: DataFrame, *keys: str) -> DataFrame:
    """(keys, state): the most pressing state among the observations."""
    place = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    return observations.groupBy(*(keys or ("doc_id",))).agg(F.min_by("state", place).alias("state"))


# Groups of recognised-content checks with the points of their codes.
GROUP_POINTS = {
    "identity_consistency": {
        "OCR_CARD_VALUES_CONFLICT": 18.0, "OCR_CARD_LUHN_INVALID": 6.0, "OCR_IBAN_INVALID": 6.0, "OCR_BIC_INVALID": 6.0,
        "OCR_SIREN_INVALID": 6.0, "OCR_SIRET_INVALID": 6.0, "OCR_EU_VAT_INVALID": 6.0, "OCR_RPPS_INVALID": 6.0,
        "OCR_FINESS_INVALID": 6.0, "OCR_CKYC_INVALID": 4.0, "OCR_MICR_INVALID": 4.0,
    },
    "geographic_consistency": {"OCR_BANKING_GEOGRAPHY_MISMATCH": 12.0},
    "financial_consistency": {"OCR_STATEMENT_SUMMARY_MISMATCH": 15.0, "OCR_INVOICE_TOTAL_MISMATCH": 15.0, "OCR_LEDGER_MISMATCH": 12.0},
    "date_consistency": {"OCR_DATE_INVALID": 5.0},
}
CONTENT_CAP = 30.0


def content_score(observations: DataFrame, reliability: DataFrame) -> DataFrame:
    """One content finding per document with an attention: (doc_id, code, risk_points, confidence, page, n_groups).

    observations: doc_id, check_code, code, state, page. reliability: doc_id, score, point_factor. The strongest code of each
    group counts, times the reliability factor, which is 0 unless the quality check is clear.
    """
    spark = observations.sparkSession
    dim = F.broadcast(spark.createDataFrame([(c, g, p) for g, m in GROUP_POINTS.items() for c, p in m.items()], "code string, grp string, base double"))
    clear = observations.where("check_code = 'ocr_quality'").groupBy("doc_id").agg(F.bool_or(F.col("state") == "clear").alias("clear"))
    known = observations.where("state = 'attention'").join(dim, "code", "left")
    groups = known.groupBy("doc_id", "grp").agg(F.max("base").alias("base"), F.min("page").alias("page"))
    per = groups.groupBy("doc_id").agg(
        F.sum("base").alias("base"),
        F.count("grp").alias("n_groups"),
        F.min(F.when(F.col("grp").isNotNull(), F.col("page"))).alias("known_page"),
        F.min("page").alias("any_page"),
    )
    rows = per.join(reliability, "doc_id", "left").join(clear, "doc_id", "left")
    factor = F.when(F.coalesce("clear", F.lit(False)), F.coalesce("point_factor", F.lit(0.0))).otherwise(0.0)
    points = F.round(F.least(F.lit(CONTENT_CAP), F.coalesce("base", F.lit(0.0)) * factor), 1)
    code = F.when(points > 0, "OCR_CONTENT_CONSISTENCY").when(F.col("n_groups") > 0, "OCR_CONTENT_UNSCORED").otherwise("OCR_CONTENT_DIAGNOSTIC")
    page = F.when(F.col("n_groups") > 0, F.col("known_page")).otherwise(F.col("any_page"))
    return rows.select("doc_id", code.alias("code"), points.alias("risk_points"), F.coalesce("score", F.lit(0.5)).alias("confidence"), page.alias("page"), "n_groups")
