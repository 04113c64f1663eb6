"""The folder that all executors share: checkpoints that cut lineage, and tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder, seen by all executors: below the cluster's ``spark.checkpoint.dir``, or a local one in local mode where none is named."""
    _name_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def _name_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmark-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    _name_folder(df.sparkSession)
    return df.checkpoint(eager=True)
