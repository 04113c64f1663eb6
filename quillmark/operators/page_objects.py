"""Checks over a document's page objects: fonts, hidden and off-page text, overlays, annotations.

page_objects: doc_id, page, object_ix, type, text, font, embedded, render_mode, x0, y0, x1, y1 (top-left origin), coverage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators import limits

INVISIBLE = 3
# Annotations that a review looks at, and their points each.
ANNOTATIONS = ("FreeText", "Stamp", "Highlight", "Ink", "Square", "Circle", "Line", "Redact", "Text")
ANNOTATION_POINTS = 6.0


def font_inventory(objects: DataFrame) -> DataFrame:
    """(doc_id, font, uses, embedded, rank): fonts by use, then name."""
    per = objects.where("font is not null").groupBy("doc_id", "font").agg(F.count("*").alias("uses"), F.bool_and("embedded").alias("embedded"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("uses"), "font")))


def hidden_text(objects: DataFrame, scan_coverage: float = 0.72, least_chars: int = 20) -> DataFrame:
    """(doc_id, page, chars, state): invisible text by page; on a scanned page enough of it is a recognition layer, not a signal."""
    hidden = objects.where((F.col("type") == "text") & (F.col("render_mode") == INVISIBLE) & (F.trim("text") != ""))
    per = hidden.groupBy("doc_id", "page").agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    scans = objects.where(F.col("type") == "image").groupBy("doc_id", "page").agg(F.max("coverage").alias("coverage"))
    layer = (F.coalesce("coverage", F.lit(0.0)) >= scan_coverage) & (F.col("chars") >= least_chars)
    return per.join(scans, ["doc_id", "page"], "left").select("doc_id", "page", "chars", F.when(layer, "ocr_layer").otherwise("hidden").alias("state"))


def outside_text(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, n): text objects that lie wholly beyond the page. pages: doc_id, page, width, height."""
    rows = objects.where((F.col("type") == "text") & (F.trim("text") != "")).join(pages, ["doc_id", "page"])
    out = (F.col("x1") <= 0) | (F.col("y1") <= 0) | (F.col("x0") >= F.col("width")) | (F.col("y0") >= F.col("height"))
    return rows.where(out).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def overlays(objects: DataFrame, revisions: DataFrame, low: float = 0.001, high: float = 0.5) -> DataFrame:
    """(doc_id, page, object_ix, coverage, points): images over a page's largest image; scored only in revised documents.

    revisions: doc_id, revisions. The largest image of the page is the background; parts of a scan (``scanner``) aren't scored.
    """
    w = Window.partitionBy("doc_id", "page")
    rows = objects.where(F.col("type") == "image").withColumn("behind", F.max(F.struct("coverage", -F.col("object_ix"))).over(w))
    rows = rows.where((F.col("object_ix") != -F.col("behind")["col2"]) & F.col("coverage").between(low, high))
    rows = rows.join(revisions, "doc_id", "left")
    scored = (F.coalesce("revisions", F.lit(1)) > 1) & ~F.coalesce("scanner", F.lit(False))
    return rows.select("doc_id", "page", "object_ix", "coverage", F.when(scored, 35.0).otherwise(0.0).alias("points"))


def annotation_findings(annotations: DataFrame) -> DataFrame:
    """(doc_id, page, annotation_ix, subtype, points) of reviewable annotations with a rectangle of four numbers."""
    fine = F.col("subtype").isin(*ANNOTATIONS) & (F.size("rect") == 4) & F.forall("rect", lambda v: v.isNotNull())
    return annotations.where(fine).select("doc_id", "page", "annotation_ix", "subtype", F.lit(ANNOTATION_POINTS).alias("points"))


def revision_transitions(ends: DataFrame) -> DataFrame:
    """(doc_id, revision, end_offset, next_offset): neighbouring revisions."""
    w = Window.partitionBy("doc_id").orderBy("end_offset")
    pairs = ends.select("doc_id", (F.row_number().over(w) - 1).alias("revision"), "end_offset", F.lead("end_offset").over(w).alias("next_offset"))
    return pairs.where("next_offset is not null")


def revision_timeline(transitions: DataFrame, diffs: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(doc_id, transition, pages_before, pages_after, page_count_changed, changed_pages array<struct<page, fraction, regions>>, changed) of every transition.

    transitions: doc_id, transition, pages_before, pages_after. diffs: doc_id, transition, page, changed (share of the page), regions. Pages that both
    revisions have, up to the run's limit, are compared; a transition has changed where a page has a changed region, or the number of pages has.
    """
    most = limits.limit(transitions.sparkSession, "max_pages") if max_pages is None else max_pages
    comparable = F.least("pages_before", "pages_after", F.lit(most))
    seen = diffs.where("regions > 0").join(transitions.select("doc_id", "transition", comparable.alias("comparable")), ["doc_id", "transition"]).where("page <= comparable")
    item = F.struct("page", F.round("changed", 6).alias("fraction"), "regions")
    per = seen.groupBy("doc_id", "transition").agg(F.array_sort(F.collect_list(item)).alias("changed_pages"))
    rows = transitions.join(per, ["doc_id", "transition"], "left")
    pages = F.coalesce("changed_pages", F.array().cast(per.schema["changed_pages"].dataType))
    rows = rows.withColumn("changed_pages", pages).withColumn("page_count_changed", F.col("pages_before") != F.col("pages_after"))
    return rows.withColumn("changed", (F.size("changed_pages") > 0) | F.col("page_count_changed"))


def timeline_summary(timeline: DataFrame) -> DataFrame:
    """(doc_id, transitions, changed, pages, state) of a document's transitions."""
    per = timeline.groupBy("doc_id").agg(F.count("*").alias("transitions"), F.count_if("changed").alias("changed"), F.sum(F.size("changed_pages")).cast("bigint").alias("pages"))
    return per.withColumn("state", F.when(F.col("changed") > 0, "detected").otherwise("clear"))


def repeated_marks(marks: DataFrame, similarity: DataFrame, least: float = 0.9, shape: float = 0.78, near: float = 140.0, pages: int = 3, groups: int = 5) -> DataFrame:
    """(doc_id, anchor, members, pages): marks that recur on at least ``pages`` pages, at most ``groups`` a document.

    marks: doc_id, mark_id, page, width, height, cx, cy. similarity: left, right, similarity of mark pairs, computed from their
    masks for the pairs that ``mark_pairs`` gives. The best match per page counts; groups with the same members count once.
    """
    return recurring_marks(mark_pairs(marks, shape, near).join(similarity, ["left", "right"]), least, pages, groups)


def recurring_marks(pairs: DataFrame, least: float = 0.9, pages: int = 3, groups: int = 5) -> DataFrame:
    """``repeated_marks`` from the pairs with their similarity (doc_id, left, right, right_page, similarity); the best of a page is kept before the shuffle."""
    match = F.min(F.struct(-F.col("similarity"), F.col("right"))).alias("b")
    best = pairs.where(F.col("similarity") >= least).groupBy("doc_id", "left", "right_page").agg(match).select("doc_id", "left", F.col("b.right"), (-F.col("b.col1")).alias("similarity"))
    per = best.groupBy("doc_id", "left").agg(F.collect_set("right").alias("others"), F.round(F.avg("similarity"), 9).alias("mean"))
    per = per.withColumn("members", F.array_sort(F.array_union("others", F.array("left")))).where(F.size("members") >= pages)
    once = per.groupBy("doc_id", "members").agg(F.min("left").alias("anchor"), F.max("mean").alias("mean"))
    rank = Window.partitionBy("doc_id").orderBy(F.desc(F.size("members")), F.desc("mean"), "anchor")
    return once.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= groups).select("doc_id", "anchor", "members", F.size("members").alias("pages"))


def mark_pairs(marks: DataFrame, shape: float = 0.78, near: float = 140.0) -> DataFrame:
    """(doc_id, left, right, right_page): marks of one document on other pages, alike in shape and near in place. ``marks.scored_pairs`` gives them scored.

    Pairs meet by cells of the centre as wide as ``near``: each mark looks in its own and the eight cells around. They can be many more than the marks, so the
    shuffle's number of partitions is kept.
    """
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda c: F.floor(F.col(c) / near)
    here = marks.select("doc_id", F.col("mark_id").alias("left"), F.col("page").alias("left_page"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("cx").alias("x"), F.col("cy").alias("y"), cell("cx").alias("gx"), cell("cy").alias("gy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    here = here.withColumn("s", F.explode(steps)).withColumn("gx", F.col("gx") + F.col("s.i")).withColumn("gy", F.col("gy") + F.col("s.j")).drop("s").repartition(parts, "doc_id", "gx", "gy")
    there = marks.select("doc_id", F.col("mark_id").alias("right"), F.col("page").alias("right_page"), "width", "height", "cx", "cy", cell("cx").alias("gx"), cell("cy").alias("gy"))
    pairs = here.join(there, ["doc_id", "gx", "gy"]).where("left_page <> right_page")
    ratio = lambda a, b: F.least(a, b) / F.greatest(a, b)
    alike = (ratio(F.col("w"), F.col("width")) >= shape) & (ratio(F.col("h"), F.col("height")) >= shape)
    close = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= near
    return pairs.where(alike & close).select("doc_id", "left", "right", "right_page")
