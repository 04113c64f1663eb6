"""Exact percentiles of groups of any size: large groups are narrowed by histograms instead of being held or sorted in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.storage import checkpointed

#: A group with more values than this is narrowed; smaller ones are held in one aggregation buffer.
HELD = 1_000_000
#: Parts of a range that a round tells apart, and how many values of a part are sorted at last.
PARTS, SORTED = 4096, 10_000


def _alike(keys: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"v.{k}").eqNullSafe(F.col(f"s.{k}"))
    return out


def selected(values: DataFrame, ranks: DataFrame, *keys: str, parts: int = PARTS, least: int = SORTED) -> DataFrame:
    """(keys, rank, value): the value of each rank (keys, rank from 0) among its group's values (keys, value).

    Each round splits the range that holds a rank in ``parts``, counts its values by part with map-side combining, and goes on with the part of the rank, whose
    bounds are values themselves. Places in the range are computed in floating point, but in one order for all values, so no value is lost between parts.
    Ranges of one value, or of at most ``least``, end. No group lies in one task before that.
    """
    values = values.select(*keys, F.col("value").cast("double").alias("value")).where("value is not null")
    span = values.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    state = checkpointed(ranks.select(*keys, "rank").distinct().alias("v").join(span.alias("s"), _alike(keys)).select(*[F.col(f"v.{k}") for k in keys], "rank", F.lit(0).cast("bigint").alias("base"), "lo", "hi", "n"))
    done = state.limit(0)
    names = [*keys, "rank"]
    while True:
        ended = (F.col("lo") == F.col("hi")) | (F.col("n") <= least)
        done, state = done.unionByName(state.where(ended)), state.where(~ended)
        if state.isEmpty():
            break
        inside = values.alias("v").join(state.alias("s"), _alike(keys) & F.expr("v.value between s.lo and s.hi")).select(*[F.col(f"s.{k}") for k in names], "base", "value", "lo", "hi")
        place = (F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, so that no range overflows
        counted = inside.groupBy(*names, "base", F.least(F.lit(parts - 1), F.floor(place * parts)).alias("part")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*names).orderBy("part")) + F.col("base")
        counted = counted.withColumn("upto", upto).where("rank < upto and rank >= upto - n")
        state = checkpointed(counted.select(*names, (F.col("upto") - F.col("n")).alias("base"), "lo", "hi", "n"))
    few = done.where("lo < hi")
    rows = values.alias("v").join(few.alias("s"), _alike(keys) & F.expr("v.value between s.lo and s.hi")).select(*[F.col(f"s.{k}") for k in names], "base", "value")
    nth = F.row_number().over(Window.partitionBy(*names).orderBy("value")) - 1 + F.col("base")
    return done.where("lo = hi").select(*names, F.col("lo").alias("value")).unionByName(rows.withColumn("nth", nth).where("nth = rank").select(*names, "value"))


def percentiles(values: DataFrame, points: tuple[float, ...], *keys: str, held: int = HELD) -> DataFrame:
    """(keys, q): the points of each group's values (keys, value), interpolated between the two nearest; nulls don't count.

    Groups of at most ``held`` values take Spark's aggregation, larger ones ``selected``.
    """
    sizes = values.where("value is not null").groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > held)
    large = checkpointed(sizes)
    plain = lambda df: df.groupBy(*keys).agg(F.percentile("value", F.array(*map(F.lit, points))).alias("q"))
    if large.isEmpty():
        return plain(values)
    small = values.alias("v").join(large.alias("s"), _alike(keys), "left_anti")
    wanted = large.select(*keys, F.posexplode(F.array(*map(F.lit, points))).alias("k", "point"), "n").withColumn("at", F.col("point") * (F.col("n") - 1))
    wanted = wanted.select(*keys, "k", "at", F.floor("at").alias("low"), F.ceil("at").alias("high"))
    found = checkpointed(selected(values, wanted.select(*keys, F.explode(F.array("low", "high")).alias("rank")), *keys))
    side = lambda name: found.select(*keys, F.col("rank").alias(name), F.col("value").alias(f"{name}_value"))
    both = wanted
    for name in ("low", "high"):
        both = both.alias("v").join(side(name).alias("s"), _alike(keys) & (F.col(f"v.{name}") == F.col(f"s.{name}"))).select("v.*", f"s.{name}_value")
    even = (F.col("low") == F.col("high")) | (F.col("low_value") == F.col("high_value"))
    value = F.when(even, F.col("low_value")).otherwise((F.col("high") - F.col("at")) * F.col("low_value") + (F.col("at") - F.col("low")) * F.col("high_value"))
    per = both.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("x")))), lambda p: p["x"]).alias("q"))
    return plain(small).unionByName(per)
