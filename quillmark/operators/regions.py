"""Recognised layout regions: flattening, quality gate, agreement of two readings, reliability."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import text as t

PLACEHOLDER = "[aucun contenu textuel reconnu]"
REGION = "array<array<struct<bbox_2d:array<double>,content:string,`index`:int,label:string,native_label:string,confidence:double,score:double,probability:double,prob:double>>>"


def box(values: Column) -> Column:
    """Four numbers in [0, 1000] with positive extent, else null."""
    fine = (F.size(values) == 4) & F.forall(values, lambda v: v.between(0, 1000))
    fine = fine & (F.get(values, 2) > F.get(values, 0)) & (F.get(values, 3) > F.get(values, 1))
    return F.when(fine, values)


def flatten_regions(documents: DataFrame, json_col: str = "ocr_json") -> DataFrame:
    """Layout regions of JSON payloads: a list of pages, or an object with ``pages`` of objects with ``regions``."""
    direct = F.from_json(F.col(json_col), REGION)
    nested = F.from_json(F.col(json_col), f"pages array<struct<regions:{REGION.removeprefix('array<').removesuffix('>')}>>")
    pages = F.coalesce(F.when(F.ltrim(F.col(json_col)).startswith("["), direct), F.transform(nested["pages"], lambda p: p["regions"]))
    by_page = documents.select("doc_id", F.posexplode(pages).alias("page0", "regions"))
    rows = by_page.select("doc_id", (F.col("page0") + 1).alias("page"), F.posexplode("regions").alias("region_ix", "r"))
    label = F.coalesce(F.nullif(F.trim("r.label"), F.lit("")), F.lit("unknown"))
    native = F.coalesce(F.nullif(F.trim("r.native_label"), F.lit("")), label)
    content = t.sanitized(F.coalesce("r.content", F.lit("")))
    order = F.when(F.col("r.index") >= 0, F.col("r.index")).otherwise(F.col("region_ix"))
    return rows.select(
        "doc_id", "page", "region_ix",
        F.format_string("p%03d-r%03d", "page", "region_ix").alias("region_id"),
        order.alias("reading_order"), F.left(label, F.lit(40)).alias("label"), F.left(native, F.lit(40)).alias("native_label"),
        box(F.col("r.bbox_2d")).alias("bbox"), F.when(content == "", PLACEHOLDER).otherwise(content).alias("content"),
        native_confidence(F.col("r")).alias("confidence"),
    )


def content_values(documents: DataFrame, json_col: str = "ocr_json") -> DataFrame:
    """(doc_id, place, content): all ``content`` texts of JSON payloads of any shape, an object's own before those inside it.

    The shape isn't known, so the JSON is walked in an Arrow batch function; text that isn't JSON gives no row.
    """
    source = documents.select("doc_id", json_col)
    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL("place int, content string")])

    def walk(value):
        todo = [value]
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                if isinstance(x.get("content"), str):
                    yield x["content"]
                todo += [v for k, v in reversed(x.items()) if k != "content"]
            elif isinstance(x, list):
                todo += reversed(x)

    def run(batches):
        for batch in batches:
            at, places, texts = [], [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    found = list(walk(json.loads(raw))) if raw else []
                except (ValueError, RecursionError):
                    found = []
                at += [i] * len(found)
                places += range(len(found))
                texts += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(places, pa.int32()), pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def native_confidence(region: Column) -> Column:
    """The first usable of four keys; values above 1 are percentages."""
    def usable(name):
        v = region[name]
        v = F.when((v > 1) & (v <= 100), v / 100).otherwise(v)
        return F.when(v.between(0, 1), v)

    return F.when(region["content"].isNotNull(), F.coalesce(*[usable(n) for n in ("confidence", "score", "probability", "prob")]))


def text_regions(regions: DataFrame) -> DataFrame:
    """Regions with visible text, labels lower-cased, for the content checks."""
    label = F.lower(F.coalesce(F.nullif(F.col("label"), F.lit("unknown")), F.lit("text")))
    return regions.withColumn("label", label).where(t.trimmed(F.col("content")) != "")


def region_markup() -> Column:
    """Compact markup of a region row."""
    number = lambda v: F.regexp_replace(F.regexp_replace(F.format_string("%.2f", v), "0+$", ""), r"\.$", "")
    bbox = F.coalesce(F.array_join(F.transform("bbox", number), ","), F.lit("unknown"))
    head = F.format_string('<region id="%s" page="%d" order="%d" label="%s" native_label="%s" bbox_2d="%s">', "region_id", "page", "reading_order", "label", "native_label", bbox)
    return F.concat(head, F.lit("\n"), F.col("content"), F.lit("\n</region>"))


def quality_gate(regions: DataFrame, least_regions: int = 2, least_chars: int = 40) -> DataFrame:
    """(doc_id, pages, regions, chars, tables, state): clear with enough regions and stripped characters."""
    stripped = F.length(t.trimmed(F.col("content")))
    per = regions.groupBy("doc_id").agg(
        F.countDistinct("page").alias("pages"), F.count("*").alias("regions"), F.sum(stripped).alias("chars"), F.count_if(F.col("label") == "table").alias("tables")
    )
    state = F.when((F.col("regions") >= least_regions) & (F.col("chars") >= least_chars), "clear").otherwise("indeterminate")
    return per.withColumn("state", state)


def token_agreement(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """(doc_id, agreement): Dice coefficient of the token multisets of two readings; 0 if one side has none.

    Both sides are counted by (document, token) in one aggregation, without a join: no document's tokens meet in one task. A null id matches nothing.
    """
    # a null token stands for the document itself, so that one without tokens stays
    tokens = lambda df, c, l, r: df.select(
        "doc_id", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(t.token_list(F.col(c)), F.array().cast("array<string>")))).alias("token"), F.lit(l).alias("l"), F.lit(r).alias("r")
    )
    both = tokens(left, left_col, 1, 0).unionByName(tokens(right, right_col, 0, 1)).groupBy("doc_id", "token").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    count = lambda c: F.coalesce(F.sum(F.when(F.col("token").isNotNull(), c)), F.lit(0))
    per = both.groupBy("doc_id").agg(count(F.least("l", "r")).alias("common"), count(F.col("l")).alias("nl"), count(F.col("r")).alias("nr"))
    value = F.when(F.col("doc_id").isNotNull() & (F.col("nl") > 0) & (F.col("nr") > 0), 2.0 * F.col("common") / (F.col("nl") + F.col("nr"))).otherwise(0.0)
    return per.select("doc_id", value.alias("agreement"))


def lower_quartile(values: Column) -> Column:
    """The element at position int((n - 1) / 4) of the sorted values: an element, not an interpolation."""
    ordered = F.sort_array(values)
    return F.try_element_at(ordered, F.floor((F.size(ordered) - 1) * 0.25).cast("int") + 1)


def reliability(documents: DataFrame) -> DataFrame:
    """(doc_id, score, source, point_factor) from (doc_id, confidences array, agreement): measured trust in the reading."""
    native = F.when(F.size(F.coalesce("confidences", F.array().cast("array<double>"))) > 0, lower_quartile(F.col("confidences")))
    a = F.col("agreement")
    score = (
        F.when(native.isNotNull() & a.isNotNull(), 0.8 * native + 0.2 * a).when(native.isNotNull(), native)
        .when(a.isNotNull(), F.least(F.lit(0.8), 0.55 + 0.25 * a)).otherwise(0.5)
    )
    source = F.when(native.isNotNull(), "native_confidence").when(a.isNotNull(), "json_markdown_agreement").otherwise("no_confidence_available")
    rows = documents.select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"), source.alias("source"))
    return rows.withColumn("point_factor", F.when(F.col("score") >= 0.78, 1.0).when(F.col("score") >= 0.65, 0.75).otherwise(0.0))
