"""Assessments that follow their findings: only documents whose findings changed are scored again.

Assessments lie in folders by a hash of the document. A document's findings have a digest that doesn't depend on their order; where it differs from
the stored one, or a document came or went, its folder is written anew (dynamic partition overwrite) from stored rows and the changed documents' new scores.
Other folders keep their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.scoring import assess_risk
from quillmark.storage import checkpointed

#: Folders of a store of assessments; fixed when the store is made.
BUCKETS = 64


def digests(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, digest) of every document: number and sum of its findings' hashes; repeated findings count."""
    fields = [c for c in sorted(findings.columns) if c != "doc_id"]
    per = findings.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*fields).cast("decimal(38,0)")).alias("s"))
    rows = documents.select("doc_id").distinct().join(per, "doc_id", "left")
    return rows.select("doc_id", F.concat_ws(":", F.coalesce("n", F.lit(0)).cast("string"), F.coalesce(F.col("s").cast("string"), F.lit("0"))).alias("digest"))


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(f"doc_id {kind}, n_families int, score int, level string, digest string, bucket int").parquet(path)


def refresh(findings: DataFrame, documents: DataFrame, path: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Bring the assessments at ``path`` up to date; how many documents were scored and how many folders were written.

    ``findings`` are all findings as they are now, e.g. after ``matching.replace_detector``.
    """
    spark = documents.sparkSession
    now = digests(findings, documents).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    old = _stored(spark, path, documents.schema["doc_id"].dataType.simpleString())
    if old is None:
        rows = assess_risk(findings, documents).join(now, "doc_id")
        rows.repartition("bucket").write.partitionBy("bucket").parquet(path)
        return {"scored": rows.count(), "folders": buckets}
    both = now.alias("a").join(old.select("doc_id", "digest", "bucket").alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "full")
    differing = both.where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
    changed = checkpointed(differing.select("a.doc_id", "a.digest", F.coalesce("a.bucket", "b.bucket").alias("bucket"), F.col("a.digest").isNull().alias("gone"), F.col("b.doc_id").alias("old_id")))
    touched = [r["bucket"] for r in changed.select("bucket").distinct().collect()]  # at most as many as there are folders
    if not touched:
        return {"scored": 0, "folders": 0}
    fresh = changed.where("not gone").select("doc_id", "digest", "bucket")
    scored = assess_risk(findings.join(fresh.select("doc_id"), "doc_id", "left_semi"), fresh).join(fresh, "doc_id")
    kept = old.where(F.col("bucket").isin(touched)).join(changed.select(F.coalesce("doc_id", "old_id").alias("doc_id")), "doc_id", "left_anti")
    rows = checkpointed(scored.select(*old.columns).unionByName(kept))  # before its own source is overwritten
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    left = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    for bucket in set(touched) - left:  # nobody is left there, so nothing was written over it
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return {"scored": fresh.count(), "folders": len(touched)}
