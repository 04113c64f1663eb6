"""Dates of documents: their inventory, and what speaks against single ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import dates


def document_dates(regions: DataFrame, text_col: str = "content") -> DataFrame:
    """(doc_id, page, raw, value, ambiguous): every date occurrence in regions (doc_id, page, text); value null if it isn't in the calendar."""
    found = regions.select("doc_id", "page", F.explode(dates.found_dates(F.col(text_col))).alias("d"))
    return found.select("doc_id", "page", "d.raw", "d.value", "d.ambiguous")


def date_inventory(found: DataFrame, reference: Column) -> DataFrame:
    """(doc_id, n, invalid, future, first_date, last_date, state) of ``document_dates``; future: after the day that follows the reference,
    ambiguous dates left out."""
    future = ~F.col("ambiguous") & (F.col("value") > F.date_add(reference, 1))
    per = found.groupBy("doc_id").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("invalid"), F.count_if(F.coalesce(future, F.lit(False))).alias("future"), F.min("value").alias("first_date"), F.max("value").alias("last_date")
    )
    return per.withColumn("state", F.when(F.col("invalid") > 0, "attention").otherwise("clear"))


def date_observations(found: DataFrame, reference: Column) -> DataFrame:
    """(doc_id, page, raw, code, state, strength): invalid dates, and dates after the day that follows the reference."""
    future = F.col("value").isNotNull() & ~F.col("ambiguous") & (F.col("value") > F.date_add(reference, 1))
    code = F.when(F.col("value").isNull(), "OCR_DATE_INVALID").when(future, "OCR_DATE_IN_FUTURE")
    invalid = F.col("code") == "OCR_DATE_INVALID"
    rows = found.withColumn("code", code).where("code is not null")
    return rows.select("doc_id", "page", "raw", "code", F.when(invalid, "attention").otherwise("detected").alias("state"), F.when(invalid, "moderate").otherwise("informational").alias("strength"))
