"""Answers of a paid service, kept by the digest of what was asked: a prompt is asked once, whatever asks for it and however often.

The journal is a folder of Parquet files in a store that all executors see. A run asks only what the journal holds no answer to; equal prompts are one request. Answers
become visible when their job commits. A task that fails after its calls makes them again, with the same ``key`` (the digest), by which a client can tell
a repeated request. Errors aren't kept, so the next run asks again. Two runs at a time may both ask a prompt that is new to both.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.services import ServiceSettings, requested

KEPT = "digest string, answer string"


def digest_of(prompt: Column, settings: ServiceSettings) -> Column:
    """What a prompt is known by: its text and the settings that shape an answer."""
    shape = f"{settings.url}|{settings.max_tokens}|{settings.most_tokens}|{','.join(settings.required)}\n"
    return F.sha2(F.concat(F.lit(shape), F.coalesce(prompt, F.lit(""))), 256)


def kept_answers(spark: SparkSession, path: str) -> DataFrame:
    """(digest, answer) of a journal, each digest once; none for a folder that isn't there yet."""
    runs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run-*")
    if not runs.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(runs):
        return spark.createDataFrame([], KEPT)
    return spark.read.schema(KEPT).parquet(f"{path}/run-*").where("answer is not null").dropDuplicates(["digest"])


def _with_key(call: Callable[[str, dict], str]) -> Callable[[str, dict], str]:
    return lambda payload, how: call(payload, how | {"key": hashlib.sha256(payload.encode("utf-8", "surrogatepass")).hexdigest()})


def answered(prompts: DataFrame, id_col: str, prompt_col: str, call: Callable[[str, dict], str], settings: ServiceSettings, path: str) -> DataFrame:
    """(id, answer, error): what the journal at ``path`` has, after what it lacked has been asked and added.

    Reading the result again asks nothing. ``error`` is set for prompts that failed in this run.
    """
    spark = prompts.sparkSession
    rows = prompts.select(id_col, prompt_col, digest_of(F.col(prompt_col), settings).alias("digest"))
    new = rows.select("digest", prompt_col).join(kept_answers(spark, path), "digest", "left_anti").groupBy("digest").agg(F.first(prompt_col).alias("prompt"))
    run = f"{path}/run-{uuid.uuid4().hex}"
    requested(new, "digest", "prompt", _with_key(call), settings).write.parquet(run)
    known = kept_answers(spark, path)
    failed = spark.read.schema(f"{KEPT}, error string").parquet(run).where("answer is null").select("digest", "error")
    return rows.join(known, "digest", "left").join(failed, "digest", "left").select(id_col, "answer", F.when(F.col("answer").isNull(), F.col("error")).alias("error"))
