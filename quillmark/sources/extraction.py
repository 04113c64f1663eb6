"""Extraction of facts and tables by a language-model service, as a dataflow around ``services.requested``.

Regions without page furniture and noise are cut into chunks that fit the service, each chunk is one request, and the answers' items are
numbered through a document in order of their chunks. Regions that no item and no disposition names are asked about once more, in chunks of their own.
What comes back is checked against the regions: unknown codes and regions, empty values and repeats go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import text as t
from quillmark.operators import chunks, matching, tables
from quillmark.operators.regions import region_markup
from quillmark.operators.scoring import first_by_key
from quillmark.sources import journal
from quillmark.sources.services import ServiceSettings
from quillmark.storage import shared_folder

#: Signs that a region's markup costs beside its text.
OVERHEAD = 200
ANSWER = (
    "facts array<struct<field_code:string,role:string,raw_label:string,raw_value:string,region_ids:array<string>>>, "
    "additional_fields array<struct<raw_label:string,raw_value:string,region_ids:array<string>>>, "
    "tables array<struct<title:string,semantic_type:string,region_ids:array<string>,column_roles:array<string>,default_row_role:string,row_role_overrides:array<struct<row_index:int,role:string>>>>, "
    "region_dispositions array<struct<region_id:string,disposition:string>>"
)
# What a region that gives no fact may be.
DISPOSITIONS = ("boilerplate", "decorative", "duplicate", "unreadable", "context")


def chunk_prompts(regions: DataFrame, head: str, max_chars: int) -> DataFrame:
    """(doc_id, chunk, prompt): the regions' markup in reading order, in chunks of at most ``max_chars``; a region that is too long is cut."""
    order = Window.partitionBy("doc_id").orderBy("page", "reading_order", "region_id")
    rows = regions.withColumn("pos", F.row_number().over(order).cast("bigint")).withColumn("markup", region_markup())
    placed = chunks.greedy_chunks(rows.select("doc_id", "pos", F.length("markup").alias("size"), F.lit(OVERHEAD).alias("over")), max_chars, "doc_id", "pos", "size", "over")
    part = max(100, max_chars - OVERHEAD)
    pieces = rows.select("doc_id", "pos", "markup").join(placed, ["doc_id", "pos"])
    cut = F.when(F.length("markup") + OVERHEAD > max_chars, F.substr("markup", (F.col("part") * part + 1).cast("int"), F.lit(part))).otherwise(F.col("markup"))
    per = pieces.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "part", cut.alias("text")))).alias("texts"))
    return per.select("doc_id", "chunk", F.concat(F.lit(head + "\n"), F.array_join(F.transform("texts", lambda x: x["text"]), "\n")).alias("prompt"))


def asked(regions: DataFrame, call: Callable[[str, dict], str], settings: ServiceSettings, head: str, max_chars: int, turn: int, kept: str) -> DataFrame:
    """(doc_id, turn, chunk, a, error): the parsed answers of one pass over some regions, by way of the journal ``kept``."""
    prompts = chunk_prompts(regions, head, max_chars).select(F.struct("doc_id", "chunk").alias("id"), "prompt")
    got = journal.answered(prompts, "id", "prompt", call, settings, kept)
    return got.select("id.doc_id", F.lit(turn).alias("turn"), "id.chunk", F.from_json("answer", ANSWER).alias("a"), "error")


def named_regions(answers: DataFrame) -> DataFrame:
    """(doc_id, region_id, used): regions that items name, and those with a known disposition."""
    none = F.array().cast("array<string>")
    ids = lambda field: F.coalesce(F.flatten(F.transform(F.col(f"a.{field}"), lambda x: F.coalesce(x["region_ids"], none))), none)
    used = answers.select("doc_id", F.explode(F.array_distinct(F.concat(ids("facts"), ids("additional_fields"), ids("tables")))).alias("region_id")).withColumn("used", F.lit(True))
    told = answers.select("doc_id", F.explode("a.region_dispositions").alias("d")).where(F.col("d.disposition").isin(*DISPOSITIONS))
    return used.unionByName(told.select("doc_id", F.col("d.region_id").alias("region_id"), F.lit(False).alias("used")))


def extract(regions: DataFrame, call: Callable[[str, dict], str], settings: ServiceSettings, head: str = "", max_chars: int = 12_000, retry: bool = True, kept: str | None = None) -> DataFrame:
    """The answers (doc_id, turn, chunk, a, error) of one or two passes.

    ``kept`` is the folder of the journal that holds the answers; a new one in the shared folder if none is named. What it holds isn't asked again, neither
    by the second pass, nor by uses of the result, nor by another run with the same journal. regions: doc_id, page, region_id, reading_order, content and what
    ``region_markup`` shows.
    """
    kept = kept or shared_folder(regions.sparkSession)
    first = asked(regions.where(~t.is_boilerplate(F.col("content")) & ~t.is_garbage(F.col("content"))), call, settings, head, max_chars, 1, kept)
    if not retry:
        return first
    left = matching.uncovered_regions(regions, named_regions(first))
    again = asked(regions.join(left, ["doc_id", "region_id"], "left_semi"), call, settings, head, max_chars, 2, kept)
    return first.unionByName(again)


def _items(answers: DataFrame, field: str) -> DataFrame:
    """(doc_id, ix, f): an answer field's items, numbered through the document."""
    rows = answers.select("doc_id", "turn", "chunk", F.posexplode(f"a.{field}").alias("at", "f"))
    order = Window.partitionBy("doc_id").orderBy("turn", "chunk", "at")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("ix"), "f")


def extracted_facts(answers: DataFrame, regions: DataFrame, field_codes: tuple[str, ...]) -> DataFrame:
    """(doc_id, fact_ix, field_code, role, raw_value, region_id, page): facts with a known code, a readable value and a known region, each once."""
    rows = _items(answers, "facts").select("doc_id", F.col("ix").alias("fact_ix"), "f.field_code", F.coalesce("f.role", F.lit("unknown")).alias("role"), t.cut(F.col("f.raw_value"), 500).alias("raw_value"), F.explode("f.region_ids").alias("region_id"))
    rows = rows.where(F.col("field_code").isin(*field_codes) & F.col("raw_value").isNotNull() & ~t.is_garbage(F.col("raw_value")))
    known = rows.join(regions.select("doc_id", "region_id", "page"), ["doc_id", "region_id"])
    per = known.groupBy("doc_id", "fact_ix", "field_code", "role", "raw_value").agg(F.min(F.struct("region_id", "page")).alias("r"))
    return first_by_key(per, ["doc_id", "field_code", "role", "raw_value"], "fact_ix").select("doc_id", "fact_ix", "field_code", "role", "raw_value", "r.region_id", "r.page")


def additional_fields(answers: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, field_ix, raw_label, raw_value, region_ids, page): fields that no code names, each label, value and place once.

    A label and a readable value that say different things are needed; what is page furniture by its text or by all its regions goes. Unknown regions are left out.
    """
    rows = _items(answers, "additional_fields").select("doc_id", F.col("ix").alias("field_ix"), t.cut(F.col("f.raw_label"), 200).alias("raw_label"), t.cut(F.col("f.raw_value"), 1000).alias("raw_value"), "f.region_ids")
    said = (F.col("raw_label") != "") & (F.col("raw_value") != "") & ~t.is_garbage(F.col("raw_value")) & (matching.comparison_key(F.col("raw_label")) != matching.comparison_key(F.col("raw_value")))
    rows = rows.where(said & ~t.is_boilerplate(F.concat_ws(" ", "raw_label", "raw_value")))
    places = rows.select("doc_id", "field_ix", F.explode(F.array_distinct("region_ids")).alias("region_id")).join(regions.select("doc_id", "region_id", "page", t.is_boilerplate(F.col("content")).alias("furniture")), ["doc_id", "region_id"])
    per = places.groupBy("doc_id", "field_ix").agg(F.array_sort(F.collect_set("region_id")).alias("region_ids"), F.min(F.struct("region_id", "page"))["page"].alias("page"), F.bool_and("furniture").alias("furniture"))
    found = rows.drop("region_ids").join(per, ["doc_id", "field_ix"], "left").where(~F.coalesce("furniture", F.lit(False)))
    found = found.withColumn("region_ids", F.coalesce("region_ids", F.array().cast("array<string>")))
    once = found.withColumn("_k", F.to_json(F.struct(F.lower("raw_label").alias("l"), F.lower("raw_value").alias("v"), "region_ids")))
    return first_by_key(once, ["doc_id", "_k"], "field_ix").select("doc_id", "field_ix", "raw_label", "raw_value", "region_ids", "page")


def extracted_tables(answers: DataFrame, regions: DataFrame, semantic_types: tuple[str, ...], column_roles: tuple[str, ...], row_roles: tuple[str, ...], most_rows: int = 2000, most_columns: int = 40) -> DataFrame:
    """(doc_id, table_ix, title, semantic_type, headers, column_roles, row_roles, rows, pages): tables as the richest table of their regions has them.

    Unknown roles count as ``other``; a column without a role takes the one its header tells. Row roles are the default, overridden by row. A table
    that says the same type, headers and regions as one before it goes.
    """
    kind = F.when(F.col("f.semantic_type").isin(*semantic_types), F.col("f.semantic_type")).otherwise("other")
    items = _items(answers, "tables").select("doc_id", F.col("ix").alias("table_ix"), t.cut(F.col("f.title"), 300).alias("title"), kind.alias("semantic_type"), "f")
    held = items.select("doc_id", "table_ix", F.explode("f.region_ids").alias("region_id")).join(regions.select("doc_id", "region_id", "page", "content"), ["doc_id", "region_id"])
    pages = held.groupBy("doc_id", "table_ix").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.array_sort(F.collect_set("region_id")).alias("regions"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("region_id", "content"))), lambda x: x["content"])).alias("html"))
    cells = tables.html_cells(pages.select(F.struct("doc_id", "table_ix").alias("id"), "html"), "id", "html").withColumnRenamed("table_ix", "nth")
    best = tables.table_rows(tables.best_tables(cells.withColumnRenamed("nth", "table_ix").withColumnRenamed("id", "doc_id"))).select("doc_id.doc_id", "doc_id.table_ix", "rows")
    rows = items.join(pages.drop("html"), ["doc_id", "table_ix"]).join(best, ["doc_id", "table_ix"])
    rows = rows.withColumn("headers", F.slice(F.get("rows", 0), 1, most_columns)).withColumn("body", F.transform(F.slice("rows", F.lit(2), F.least(F.lit(most_rows), F.greatest(F.size("rows") - 1, F.lit(0)))), lambda r: F.slice(r, 1, most_columns)))
    width = F.greatest(F.size("headers"), F.coalesce(F.array_max(F.transform("body", lambda r: F.size(r))), F.lit(0)))
    place = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))

    def role(i):
        said = F.get("f.column_roles", i)
        known = F.when(said.isin(*column_roles), said).otherwise("other")
        return F.when(known == "other", tables.column_role(F.coalesce(F.get("headers", i), F.lit("")), F.col("semantic_type"))).otherwise(known)

    plain = F.when(F.col("f.default_row_role").isin(*row_roles), F.col("f.default_row_role")).otherwise("other")
    overrides = F.map_from_entries(F.transform(F.filter(F.coalesce("f.row_role_overrides", F.array().cast("array<struct<row_index:int,role:string>>")), lambda o: o["role"].isin(*row_roles) & o["row_index"].isNotNull()), lambda o: F.struct(o["row_index"], o["role"])))
    per_row = F.transform("body", lambda r, i: F.coalesce(F.try_element_at(overrides, i), plain))
    out = rows.select("doc_id", "table_ix", "title", "semantic_type", "regions", F.transform(place, lambda i: F.coalesce(F.get("headers", i), F.lit(""))).alias("headers"), F.transform(place, role).alias("column_roles"), per_row.alias("row_roles"), F.col("body").alias("rows"), "pages")
    once = out.withColumn("_k", F.to_json(F.struct("semantic_type", "headers", "regions")))
    return first_by_key(once.where((F.size("headers") > 0) | (F.size("rows") > 0)), ["doc_id", "_k"], "table_ix").drop("_k", "regions")


def extraction_coverage(answers: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, regions, mapped, disposed, uncovered, ratio) of the regions that answers account for."""
    named = matching.known_regions(named_regions(answers), regions)
    return matching.coverage(regions, named.where("used"), named.where("not used"))
