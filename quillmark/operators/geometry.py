"""Boxes, image roles and window lattices as expressions; greedy box merging as an ordered fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators import selection

# Thresholds of the image roles.
FULL_PAGE, LEAST_COVERAGE, LEAST_SIDE, LEAST_PIXELS = 0.65, 0.02, 256, 262_144


def top_left_box(left: Column, bottom: Column, right: Column, top: Column, page_height: Column) -> Column:
    """Box with a top-left origin from bounds with a bottom-left one; null if empty or not finite."""
    fine = F.lit(True)
    for v in (left, bottom, right, top, page_height):
        fine = fine & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    x0, x1 = F.least(left, right), F.greatest(left, right)
    y0, y1 = page_height - F.greatest(bottom, top), page_height - F.least(bottom, top)
    return F.when(fine & (x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def region_on_page(pixels: Column, width: Column, height: Column, page_box: Column) -> Column:
    """A box in an image's pixels as a box on the page, where the image covers ``page_box``; null for an image without extent."""
    across = lambda x: page_box["x0"] + x / width * (page_box["x1"] - page_box["x0"])
    down = lambda y: page_box["y0"] + y / height * (page_box["y1"] - page_box["y0"])
    box = F.struct(across(pixels["x0"]).alias("x0"), down(pixels["y0"]).alias("y0"), across(pixels["x1"]).alias("x1"), down(pixels["y1"]).alias("y1"))
    return F.when((width > 0) & (height > 0), box)


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["x1"] - box["x0"]) * F.greatest(F.lit(0.0), box["y1"] - box["y0"])


def coverage(box: Column, page_width: Column, page_height: Column) -> Column:
    return F.least(F.lit(1.0), area(box) / F.greatest(F.lit(1.0), page_width * page_height))


def image_role(covered: Column, width: Column, height: Column) -> Column:
    """Structural role of an embedded image."""
    return (
        F.when(covered >= FULL_PAGE, "document")
        .when(width.isNull() | height.isNull(), "unknown")
        .when((covered < LEAST_COVERAGE) | (F.least(width, height) < LEAST_SIDE) | (width * height < LEAST_PIXELS), "decorative")
        .otherwise("photo")
    )


def scanner_segment(filters: Column, bits: Column, dpi_x: Column, dpi_y: Column) -> Column:
    """Whether an image looks like a part of a scan: a scanner codec, or few bits and an even resolution."""
    fax = F.arrays_overlap(filters, F.array(F.lit("JBIG2Decode"), F.lit("CCITTFaxDecode")))
    flat = F.arrays_overlap(filters, F.array(F.lit("FlateDecode"), F.lit("RunLengthDecode")))
    even = F.abs(dpi_x - dpi_y) <= 0.2 * F.greatest(dpi_x, dpi_y)
    return fax | (flat & (bits <= 8) & even)


def lattice(images: DataFrame, side: int = 224) -> DataFrame:
    """Centred windows without padding: (keys of images, window_ix, ring, left, top, is_center) from width and height."""
    keys = [c for c in images.columns if c not in ("width", "height")]
    # bround: the centre is rounded half to even
    fits = images.where((F.col("width") >= side) & (F.col("height") >= side))
    fits = fits.withColumn("cx", F.bround((F.col("width") - side) / 2.0, 0).cast("int")).withColumn("cy", F.bround((F.col("height") - side) / 2.0, 0).cast("int"))

    def steps(center, length):
        low = -F.floor(F.col(center) / side).cast("int")
        high = F.floor((F.col(length) - F.col(center) - side) / side).cast("int")
        return F.sequence(low, high)

    rows = fits.withColumn("i", F.explode(steps("cy", "height"))).withColumn("j", F.explode(steps("cx", "width")))
    ring = F.greatest(F.abs("i"), F.abs("j"))
    rows = rows.select(*keys, "i", "j", ring.alias("ring"), (F.col("cx") + F.col("j") * side).alias("left"), (F.col("cy") + F.col("i") * side).alias("top"))
    w = Window.partitionBy(*keys).orderBy("ring", F.abs("i") + F.abs("j"), "i", "j")
    return rows.select(*keys, (F.row_number().over(w) - 1).alias("window_ix"), "ring", "left", "top", ((F.col("i") == 0) & (F.col("j") == 0)).alias("is_center"))


def merged_boxes(boxes: Column, gap_x: float = 12.0, gap_y: float = 6.0) -> Column:
    """Greedy single pass over the boxes of one page in order of y0, x0: each joins the first merged box that is near.

    A fold, as each step depends on the boxes merged before; the boxes of a page are few.
    """
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b["y1"].alias("y1"), b["x1"].alias("x1"))))

    def near(a, b):
        return ~((a["x1"] + gap_x < b["x0"]) | (b["x1"] + gap_x < a["x0"]) | (a["y1"] + gap_y < b["y0"]) | (b["y1"] + gap_y < a["y0"]))

    def step(acc, b):
        at = F.array_position(F.transform(acc, lambda a: near(a, b)), True)
        joined = F.transform(
            acc,
            lambda a, i: F.when(
                i + 1 == at,
                F.struct(F.least(a["y0"], b["y0"]).alias("y0"), F.least(a["x0"], b["x0"]).alias("x0"), F.greatest(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x1"], b["x1"]).alias("x1")),
            ).otherwise(a),
        )
        return F.when(at > 0, joined).otherwise(F.concat(acc, F.array(b)))

    empty = F.array().cast("array<struct<y0:double,x0:double,y1:double,x1:double>>")
    return F.aggregate(ordered, empty, step)


def window_summary(scores: DataFrame, *keys: str, held: int = selection.HELD) -> DataFrame:
    """Median, 10/25/90 % points (linear interpolation), maximum, share from 0.5 on, and the global score of window scores.

    Points of groups with more than ``held`` windows are selected by counts, so no group has to fit into a task.
    """
    points = selection.percentiles(scores.select(*keys, F.col("score").alias("value")), (0.1, 0.25, 0.5, 0.9), *keys, held=held)
    per = scores.groupBy(*keys).agg(F.max("score").alias("highest"), F.avg((F.col("score") >= 0.5).cast("double")).alias("share"), F.count("*").alias("windows")).join(points, list(keys))
    whole = 0.5 * F.col("q")[2] + 0.3 * F.col("q")[1] + 0.2 * F.col("share")
    return per.select(
        *keys, "windows", F.col("q")[2].alias("median"), F.col("q")[0].alias("p10"), F.col("q")[1].alias("p25"), F.col("q")[3].alias("p90"), "highest", "share",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole)).alias("global_score"),
    )


def curve_points(score: Column) -> Column:
    """Points of a global window score: a square from 0 at 0.5 to 30 at 0.9."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - 0.5) / 0.4))
    return F.round(30 * x * x, 2)


def consensus(evaluations: DataFrame, least: float = 0.8, spread: float = 0.15) -> DataFrame:
    """One row per (image_id, family) of stable completed evaluations at or above ``least``, and whether two families agree.

    evaluations: image_id, family, adapter, scores array<double>, status. The strongest adapter stands for its family.
    """
    rows = evaluations.withColumn("score", F.element_at("scores", 1)).withColumn("range", F.array_max("scores") - F.array_min("scores"))
    rows = rows.where((F.col("status") == "completed") & (F.col("range") <= spread) & (F.col("score") >= least))
    w = Window.partitionBy("image_id", "family").orderBy(F.desc("score"), "adapter")
    best = rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("image_id", "family", "adapter", "score")
    families = best.groupBy("image_id").agg(F.count("*").alias("families"))
    return best.join(families, "image_id").withColumn("points", F.when(F.col("families") >= 2, 35.0).otherwise(0.0))
