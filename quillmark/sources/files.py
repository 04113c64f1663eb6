"""Sources: document files as binary rows with their checks, recognised text as JSON and Markdown, XML attachments, revisions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
MAX_MEGABYTES = 100


def is_pdf(content: Column) -> Column:
    """Whether the PDF mark occurs in the first 1024 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0


def read_documents(spark: SparkSession, path: str, max_megabytes: int = MAX_MEGABYTES, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, length, content, kind, error): files under a folder; ``error`` names why a file isn't taken, content is then null.

    The size is checked on the listing, before any content is read by a later filter.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    large = F.col("length") > max_megabytes * 2**20
    kind = F.when(is_pdf(F.col("content")), "pdf").when(ext == "pdf", "pdf").otherwise("image")
    error = F.when(large, "input_too_large").when((ext == "pdf") & ~is_pdf(F.col("content")), "invalid_pdf")
    return files.select("path", "length", F.when(error.isNull(), F.col("content")).alias("content"), kind.alias("kind"), error.alias("error"))


def read_recognised(spark: SparkSession, path: str) -> DataFrame:
    """(folder, ocr_json, markdown) of folders that hold document.json and document.md."""
    whole = lambda name: (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path, wholetext=True)
        .select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"), "value")
    )
    json = whole("document.json").withColumnRenamed("value", "ocr_json")
    return json.join(whole("document.md").withColumnRenamed("value", "markdown"), "folder", "left")


def invoice_header(xml: Column) -> Column:
    """Header fields of an embedded invoice by local names, whatever the namespaces."""
    # XPath addresses are literals of the invoice standard's element names
    at = lambda *names: F.nullif(F.expr("xpath_string(x, '" + "".join(f"//*[local-name()=\"{n}\"]" if i == 0 else f"/*[local-name()=\"{n}\"]" for i, n in enumerate(names)) + "')"), F.lit(""))
    return F.struct(
        at("ExchangedDocument", "ID").alias("invoice_id"), at("InvoiceCurrencyCode").alias("currency"),
        at("GrandTotalAmount").alias("grand_total"), at("SellerTradeParty", "Name").alias("seller"), at("BuyerTradeParty", "Name").alias("buyer"),
    )


# Names of attachments that hold an invoice.
INVOICE_NAMES = ("factur-x.xml", "factur_x.xml", "zugferd-invoice.xml", "xrechnung.xml")


def invoice_attachments(attachments: DataFrame, name_col: str = "name", xml_col: str = "xml") -> DataFrame:
    """XML attachments with content, and ``standard``: whether the name is that of an invoice standard."""
    name = F.lower(F.element_at(F.split(F.col(name_col), "[/\\\\]"), -1))
    rows = attachments.where(name.endswith(".xml") & (F.length(F.coalesce(F.col(xml_col), F.lit(""))) > 0))
    return rows.withColumn("standard", name.isin(*INVOICE_NAMES))


def read_invoice_headers(attachments: DataFrame, xml_col: str = "xml") -> DataFrame:
    return attachments.withColumn("x", F.col(xml_col)).withColumn("header", invoice_header(F.col("x"))).drop("x")


_MARK = re.compile(rb"%%EOF(?=[\x00\t\n\f\r ]|\Z)")
_TAIL = re.compile(rb"startxref\s+(\d{1,18})\s+\Z")
_OBJECT = re.compile(rb"\s*(?:xref|\d+\s+\d+\s+obj\b)")


def revision_ends(raw: bytes) -> list[int]:
    """Ends of the revisions in a PDF: end marks after a start pointer that leads to a cross-reference table or object.

    Looks back a bounded distance from each mark, so the scan is linear. Readability by a parser is the adapters' check.
    """
    out = []
    for m in _MARK.finditer(raw):
        tail = _TAIL.search(raw[max(0, m.start() - 256) : m.start()])
        if tail and int(tail[1]) < m.end() and _OBJECT.match(raw, int(tail[1]), min(m.end(), int(tail[1]) + 128)):
            out.append(m.end())
    return out


def revisions(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(id, revision, end_offset, next_offset): a row per revision with the one after it."""
    source = files.select(id_col, content_col)
    schema = T.StructType([source.schema[id_col], T.StructField("ends", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            ends = [revision_ends(x) if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.list_(pa.int64()))], names=schema.names)

    rows = source.mapInArrow(run, schema).select(id_col, "ends", F.posexplode("ends").alias("revision", "end_offset"))
    return rows.select(id_col, "revision", "end_offset", F.get("ends", F.col("revision") + 1).alias("next_offset"))


def unavailable(files: DataFrame, adapter: str, id_col: str = "path") -> DataFrame:
    """What an adapter gives whose library or service is absent: a status row per file and never a verdict."""
    return files.select(id_col, F.lit(adapter).alias("adapter"), F.lit("unavailable").alias("status"))
