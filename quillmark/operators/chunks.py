"""Budgets over ordered rows: greedy chunks that start anew, and prefixes that fit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def greedy_chunks(rows: DataFrame, limit: int, key: str, order: str, size: str, overhead: str) -> DataFrame:
    """(key, order, part, chunk): rows are put in chunks of at most ``limit``; one that is too large alone is cut in parts.

    A part is max(100, limit - overhead) of the row's size and is a chunk of its own. The running size starts anew with each
    chunk, so the rows of a key are read in order; an Arrow batch function over sorted partitions holds only the open chunk's size.
    """
    source = rows.select(F.col(key).alias("key"), F.col(order).cast("bigint").alias("pos"), F.col(size).cast("bigint").alias("size"), F.col(overhead).cast("bigint").alias("over"))
    schema = T.StructType([source.schema["key"], *T.StructType.fromDDL("pos bigint, chunk bigint, parts bigint")])

    def run(batches):
        current, chunk, used = None, 0, 0
        for batch in batches:
            chunks, parts = [], []
            for k, n, more in zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                if current != (k,):
                    current, chunk, used = (k,), 0, 0
                if n + more > limit:
                    chunk += used > 0  # an open chunk is closed by a row that is cut
                    cut = -(-n // max(100, limit - more))
                    chunks.append(chunk)
                    parts.append(cut)
                    chunk, used = chunk + cut, 0
                    continue
                if used and used + n + more > limit:
                    chunk, used = chunk + 1, 0
                used += n + more
                chunks.append(chunk)
                parts.append(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chunks, pa.int64()), pa.array(parts, pa.int64())], names=schema.names)

    placed = source.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(run, schema)
    out = placed.where("parts > 0").select("key", "pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "chunk")
    return out.select(F.col("key").alias(key), F.col("pos").alias(order), "part", (F.col("chunk") + F.col("part")).alias("chunk"))


def fitting_prefix(rows: DataFrame, max_chars: int, key: str, order: str, size: str) -> DataFrame:
    """The ordered prefix of each key whose sizes (one more each, two to start) stay in the budget; the first row always stays."""
    budget = max(1_000, max_chars - 2_500)
    w = Window.partitionBy(key).orderBy(order)
    used = F.sum(F.col(size) + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 2
    # sizes aren't negative, so the running sum only grows and the prefix ends at the first row beyond the budget
    return rows.withColumn("used", used).withColumn("n", F.row_number().over(w)).where((F.col("used") <= budget) | (F.col("n") == 1)).drop("n")
