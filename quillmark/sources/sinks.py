"""Sinks: reports per document, batch tables, batch pages. Only fixed-size summaries reach the driver."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents on one batch page.
PER_PAGE = 1000


def sorted_struct(kind: T.StructType, value=None) -> Column:
    """A struct's fields in order of their names, at every depth; of the row itself where no value is given."""
    at = (lambda n: F.col(f"`{n}`")) if value is None else (lambda n: value[n])

    def ordered(kind, v):
        if isinstance(kind, T.StructType):
            return F.when(v.isNotNull(), sorted_struct(kind, v))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(v, lambda x: sorted_struct(kind.elementType, x))
        return v

    return F.struct(*[ordered(f.dataType, at(f.name)).alias(f.name) for f in sorted(kind, key=lambda f: f.name)])


def reports(assessments: DataFrame, findings: DataFrame, detectors: DataFrame | None = None) -> DataFrame:
    """(doc_id, report): a JSON object per document with sorted keys: the assessment, all fields of its findings, the strongest first, and the
    detectors' states without their findings."""
    names = [c for c in findings.columns if c != "doc_id"]
    order = [F.desc("risk_points"), F.desc("confidence")] if {"risk_points", "confidence"} <= set(names) else []
    ranked = findings.withColumn("_n", F.monotonically_increasing_id())
    item = F.struct(*[(-F.coalesce(F.col(c), F.lit(0.0))).alias(f"_{c}") for c in ("risk_points", "confidence")], F.col("_n"), F.struct(*names).alias("f")) if order else F.struct("_n", F.struct(*names).alias("f"))
    per = ranked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["f"]).alias("findings"))
    rows = assessments.join(per, "doc_id", "left").withColumn("findings", F.coalesce("findings", F.array().cast(per.schema["findings"].dataType)))
    if detectors is not None:
        kept = [c for c in detectors.columns if c not in ("doc_id", "findings")]
        rows = rows.join(detectors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("detectors")), "doc_id", "left")
    return rows.select("doc_id", F.to_json(sorted_struct(rows.schema), {"ignoreNullFields": "false"}).alias("report"))


def write_reports(assessments: DataFrame, findings: DataFrame, path: str, detectors: DataFrame | None = None) -> None:
    """One JSON line per document."""
    reports(assessments, findings, detectors).select(F.col("report").alias("value")).write.mode("overwrite").text(path)


def write_batch_csv(summary: DataFrame, path: str) -> None:
    """The batch table with semicolons and a header; a part file per partition, as one file would pass through one task."""
    summary.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def batch_json(summary: DataFrame) -> DataFrame:
    """The one-row batch summary as JSON text."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("json"))


def write_batch_json(summary: DataFrame, documents: DataFrame, path: str) -> None:
    """The summary (one row, its average to two places) under ``summary``, and one JSON line a document under ``documents``."""
    rounded = [F.round(c, 2).alias(c) if c.startswith("average") or c.endswith("seconds") else F.col(c) for c in summary.columns]
    summary.select(*rounded).write.mode("overwrite").json(f"{path}/summary")
    documents.select(F.to_json(sorted_struct(documents.schema)).alias("value")).write.mode("overwrite").text(f"{path}/documents")


def _page(shares: str, head: str, body: list[str]) -> str:
    return f"<!doctype html><meta charset=utf-8><title>Batch</title><ul>{shares}</ul><table><tr>{head}</tr>{''.join(body)}</table>"


def batch_pages(summary: DataFrame, documents: DataFrame, order: list, per_page: int = PER_PAGE) -> DataFrame:
    """(page, html): self-contained pages with the one-row summary and all documents in order, ``per_page`` on each.

    Pages are numbered by range partition and place, in the documents' order; every document stands on one page.
    """
    s = summary.first().asDict()
    done = max(1, s["succeeded"])
    shares = "".join(f"<li>{name}: {s[f'{name}_count']} ({100 * s[f'{name}_count'] / done:.0f}%)</li>" for name in ("low", "review", "high"))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in documents.columns)
    placed = documents.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select(F.spark_partition_id().alias("_part"), *[F.col(c).cast("string") for c in documents.columns])

    def run(batches):
        rows, part, number = [], 0, 0

        def page():
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06}-{number:06}"]), pa.array([_page(shares, head, rows)])], names=["page", "html"])

        for batch in batches:
            for part, *cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in cells) + "</tr>")
                if len(rows) == per_page:
                    yield page()
                    rows, number = [], number + 1
        if rows:
            yield page()

    return placed.mapInArrow(run, "page string, html string")


def write_batch_pages(summary: DataFrame, documents: DataFrame, order: list, path: str, per_page: int = PER_PAGE) -> None:
    """A folder for each page, named by its number."""
    pages = batch_pages(summary, documents, order, per_page).select("page", F.translate("html", "\n\r", "  ").alias("html"))
    pages.write.mode("overwrite").partitionBy("page").text(path)


def batch_page(summary: DataFrame, top: DataFrame) -> str:
    """One page with all rows of a table that the caller has bounded."""
    s = summary.first().asDict()
    done = max(1, s["succeeded"])
    shares = "".join(f"<li>{name}: {s[f'{name}_count']} ({100 * s[f'{name}_count'] / done:.0f}%)</li>" for name in ("low", "review", "high"))
    body = ["<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in top.collect()]
    return _page(shares, "".join(f"<th>{html.escape(c)}</th>" for c in top.columns), body)


def recognition_artifacts(paths: Column) -> Column:
    """Of a document's artifact paths those of recognised text, in order."""
    return F.filter(paths, lambda p: F.lower(p).endswith(".json") | F.lower(p).endswith(".md"))


def distinct_artifacts(*lists: Column) -> Column:
    """Artifact paths of several detectors, each once, in order of first mention."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
