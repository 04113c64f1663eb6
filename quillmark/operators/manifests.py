"""Nested provenance manifests as VARIANT values: validation statuses and source types at any depth.

A walk goes down level by level: each step explodes the objects and arrays that the one before has found, all documents at a time, so there are as many steps as the deepest
manifest has levels and no Python. Text that isn't JSON, null and plain values give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.storage import checkpointed

# Keys below which statuses have that outcome, and the key of source types (without underscores, in small letters).
OUTCOMES = ("success", "informational", "failure")
SOURCE_TYPE = "digitalsourcetype"


def walked(manifests: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, outcome, key, value): every value (VARIANT) inside a document's JSON, with the nearest outcome at or above its key, and its own key (null in arrays).

    Source types that are texts are leaves like any other; the whole document is a value too.
    """
    spark = manifests.sparkSession
    level = manifests.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("key"), F.try_parse_json(json_col).alias("value")).where("value is not null")
    every = level = checkpointed(level)
    while True:
        outcomes = ", ".join(f"'{o}'" for o in OUTCOMES)
        level = checkpointed(spark.sql(
            f"select n.id, case when e.key in ({outcomes}) then e.key else n.outcome end outcome, e.key, e.value from {{nodes}} n, lateral variant_explode(n.value) e", nodes=level
        ))
        if level.isEmpty():
            return every
        every = every.unionByName(level)


def _text(path: str):
    """A member that is a text; null for any other kind."""
    member = F.try_variant_get("value", path, "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get("value", path, "string"))


def validation_statuses(values: DataFrame) -> DataFrame:
    """(id, outcome, code, explanation) of ``walked`` values: objects with a code below an outcome."""
    rows = values.where("outcome is not null").select("id", "outcome", _text("$.code").alias("code"), F.nullif(_text("$.explanation"), F.lit("")).alias("explanation"))
    return rows.where("code is not null")


def source_types(values: DataFrame) -> DataFrame:
    """(id, source_types): the distinct declared source types of ``walked`` values, in order."""
    named = values.where(F.lower(F.replace("key", F.lit("_"), F.lit(""))) == SOURCE_TYPE)
    return named.select("id", _text("$").alias("t")).where("t is not null").groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("source_types"))
