"""Limits of an analysis run: read from the session (``config.session_conf``), else the defaults; applied as filters and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.config import Limits


def limit(spark: SparkSession, name: str) -> int:
    """A limit by its name in ``config.Limits``."""
    return int(spark.conf.get(f"quillmark.limits.{name}", str(getattr(Limits(), name))))


def analysed_pages(pages: DataFrame, most: int | None = None, page_col: str = "page") -> DataFrame:
    """The pages that a run analyses: the first ``most`` of a document, pages counted from 1."""
    most = limit(pages.sparkSession, "max_pages") if most is None else most
    return pages.where(F.col(page_col) <= most)


def page_counts(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, pages, analysed) of page rows (doc_id, page)."""
    most = limit(pages.sparkSession, "max_pages") if most is None else most
    return pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.countDistinct(F.when(F.col("page") <= most, F.col("page"))).alias("analysed"))


def routed_images(images: DataFrame, inventory: int | None = None, photos: int | None = None) -> DataFrame:
    """Images (doc_id, image_ix, role, ...) of the inventory, with ``kept``: the first ``photos`` photos. Quotas hold after routing."""
    inventory = limit(images.sparkSession, "max_images") if inventory is None else inventory
    photos = limit(images.sparkSession, "max_photos") if photos is None else photos
    place = Window.partitionBy("doc_id").orderBy("image_ix")
    rows = images.withColumn("place", F.row_number().over(place)).where(F.col("place") <= inventory)
    photo = F.col("role") == "photo"
    nth = F.sum(photo.cast("int")).over(place.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("kept", photo & (nth <= photos)).drop("place")


def image_counts(images: DataFrame, inventory: int | None = None, photos: int | None = None) -> DataFrame:
    """(doc_id, photo, document, decorative, unknown, kept, inventory_cut, photos_cut, state) of images (doc_id, image_ix, role)."""
    inventory = limit(images.sparkSession, "max_images") if inventory is None else inventory
    photos = limit(images.sparkSession, "max_photos") if photos is None else photos
    roles = [F.count_if(F.col("role") == r).alias(r) for r in ("photo", "document", "decorative", "unknown")]
    per = routed_images(images, inventory, photos).groupBy("doc_id").agg(*roles, F.count_if("kept").alias("kept"))
    whole = images.groupBy("doc_id").agg((F.count("*") > inventory).alias("inventory_cut"))
    state = F.when((F.col("kept") == 0) & ~F.col("inventory_cut"), "not_applicable").otherwise("partial")
    return per.join(whole, "doc_id").withColumn("photos_cut", F.col("photo") > photos).withColumn("state", F.when(F.col("kept") > 0, "completed").otherwise(state))
