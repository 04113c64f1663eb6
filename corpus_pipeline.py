"""The corpus pipeline: quality filter, near-duplicate removal, redaction, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. All but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet to the shared folder and reads them again; a folder goes as soon as the next one is
written, and all go when a stage fails, so that texts from before the redaction don't stay. Rows are told apart by id and text: repeated rows, null ids and several texts under
one id are allowed. Columns beyond those of ``documents`` are left out, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe, mixing, near_copies, pii, quality
from quillmark.llm.common import bucket_of_id, one_each, removed, row_key, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = ("text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score at least the threshold."""
    learnable = bucket_of_id("doc_id", 5) != 0
    model = quality.fit(quality.sample(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), learnable))
    return quality.score(docs, model, also=REST).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``key``: the id (for a null id a negative number from the text) and a digest of the text."""
    digest = F.xxhash64(F.coalesce("text", F.lit("")), F.isnull("text"))
    return docs.select(*COLUMNS).withColumn("key", F.struct(row_key("doc_id", "text").alias("id"), digest.alias("digest")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near copies (five-word shingles, similarity 0.8 or more): the smallest id, of its texts the
    one with the smallest digest, once."""
    keyed = _keyed(docs)
    found = near_copies.near_copies(keyed.select("key", "text"), id_col="key")
    kept = found.where("key = component_id").groupBy("key").agg(F.count("*").alias("copies"))
    return one_each(keyed, kept, "key", "copies", docs.count()).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; lengths follow."""
    out = pii.redacted(docs, also=("lang", "source", "n_chars"))
    n_chars = F.coalesce(F.length("redacted").cast("bigint"), F.col("n_chars"))
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it. Rows that agree in id, source and text are taken together."""
    keyed = _keyed(docs).withColumn("key", F.struct("key.id", "key.digest", F.coalesce("source", F.lit("")).alias("source"), F.isnull("source").alias("none")))
    mixed = mixing.mix(keyed.select("key", "text", "source"), id_col="key")
    times = mixed.groupBy("key").agg(F.sum("times").cast("int").alias("times"), F.count("*").alias("copies"))
    taken = one_each(keyed, times.where("times > 0"), "key", "copies", docs.count())
    return taken.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether decoding them gives the text back."""
    coded = bpe.encode_documents(docs, bpe.default_vocabulary(), also=REST)
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("pii", redact_personal_data),
    ("mixing sources", mix_sources),
    ("bpe encoding", encode),
]

#: The stages learn, hash and sample: no SQL expresses them. tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents").select(*COLUMNS), shared_folder(spark)
    try:
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs.write.mode("overwrite").parquet(f"{folder}/stage{k}")
                docs = spark.read.parquet(f"{folder}/stage{k}")
                if k:
                    removed(spark, f"{folder}/stage{k - 1}")
    except BaseException:
        removed(spark, folder)
        raise
    return docs
