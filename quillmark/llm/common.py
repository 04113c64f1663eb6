"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one slice of a batch may hold as Python strings; a single longer text is a slice of its own.
SLICE_BYTES = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder, seen by all executors, for tables that cut lineage."""
    set_checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def row_key(id_col: str, text_col: str):
    """The id, or for a null id a negative number from the text."""
    return F.coalesce(F.col(id_col), -F.abs(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))) - 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_checkpoint_folder(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; a local one only where none is named (tests, local mode)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillmark-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    set_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bucket_of_id(id_col: str, modulus: int):
    """crc32 of the id as text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(modulus)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or one row."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield start, stop
        start = stop


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    fields: str,
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    also: tuple[str, ...] = (),
) -> DataFrame:
    """Apply a function of lists of texts to every row, without a shuffle.

    ``make`` runs once a task and returns that function; a null text reaches it as None. Columns: the id, ``also`` (which may
    name the text), then ``fields``.
    """
    source = df.select(id_col, *also, *(() if text_col in also else (text_col,)))
    place = source.columns.index(text_col)
    kept = [source.schema[c] for c in (id_col, *also)]
    schema = T.StructType(kept + list(T.StructType.fromDDL(fields)))
    names = [f.name for f in schema][len(kept) :]

    def run(batches):
        apply = make()
        arrow = None
        for batch in batches:
            for a, b in slices(batch.column(place)):
                out = apply(batch.column(place).slice(a, b - a).to_pylist())
                part = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                if arrow is None:
                    from pyspark.sql.pandas.types import to_arrow_type

                    arrow = [to_arrow_type(f.dataType) for f in schema][len(kept) :]
                part += [pa.array(out[n], type=t) for n, t in zip(names, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(part, names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than this share of all rows, and with more than HOT_ROWS rows, is hot; fewer than 1 / HOT_SHARE keys can be.
HOT_SHARE = 0.001
HOT_ROWS = 1000


def _split(rows: DataFrame, named: DataFrame, keys: list[str], copies: str, total: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Rows of other than hot keys, rows of hot keys joined by broadcast (None if there are none), and ``named`` without its counts.

    ``named`` is checkpointed, so that the plans that follow hold it as a scan; of its rows fewer than 1 / HOT_SHARE reach the driver.
    """
    named = checkpointed(named)
    hot = named.where(F.col(copies) > max(HOT_ROWS, total * HOT_SHARE)).collect()
    if not hot:
        return rows, None, named.drop(copies)
    few = rows.sparkSession.createDataFrame(hot, named.schema).drop(copies)
    return rows.join(F.broadcast(few.select(*keys)), keys, "left_anti"), rows.join(F.broadcast(few), keys), named.drop(copies)


def join_hot(rows: DataFrame, named: DataFrame, keys: list[str], copies: str, total: int, how: str = "inner") -> DataFrame:
    """Rows with the one row of ``named`` for their key; ``copies`` is a column of ``named``, how many of the ``total`` rows have the key.

    Hot keys are joined by broadcast, so that no task gets all rows of one; the others as Spark joins them.
    """
    rest, hot, named = _split(rows, named, keys, copies, total)
    joined = rest.join(named, keys, how)
    return joined if hot is None else hot.unionByName(joined)


def one_each(rows: DataFrame, named: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """One row for each key of ``named`` with its other columns; ``copies``: how many of the ``total`` rows have the key.

    Rows are moved once: what the join has placed by key is reduced in place. Hot keys are reduced with map-side combining.
    """
    rest, hot, named = _split(rows, named, [key], copies, total)
    once = rest.join(named, key).dropDuplicates([key])
    return once if hot is None else once.unionByName(hot.select(*once.columns).dropDuplicates([key]))


def block_pairs(blocks: DataFrame, bucket: list[str], payload: list[str]) -> DataFrame:
    """Each pair of blocks of a bucket once, a block with itself included: (same, payload + "1", payload + "2").

    Pairs are formed of block names alone; the blocks follow by name, so that the pairs of one bucket lie in as many tasks as it has blocks.
    """
    named = blocks.withColumn("_name", F.concat_ws(":", *[F.col(c).cast("string") for c in (*bucket, "block")]))
    ids = named.select(*bucket, "block", "_name")
    pairs = ids.select(*bucket, F.col("block").alias("_a"), F.col("_name").alias("_x")).join(ids.select(*bucket, F.col("block").alias("_b"), F.col("_name").alias("_y")), bucket)
    pairs = pairs.where("_a <= _b").select("_x", "_y", (F.col("_a") == F.col("_b")).alias("same"))
    left = named.select(F.col("_name").alias("_x"), *[F.col(c).alias(f"{c}1") for c in payload])
    right = named.select(F.col("_name").alias("_y"), *[F.col(c).alias(f"{c}2") for c in payload])
    return pairs.join(left, "_x").join(right, "_y").drop("_x", "_y")
