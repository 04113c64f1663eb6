"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is r times its size gives every document floor(r) times, and once more with the inclusion probability r -
floor(r). The cube method picks these: starting from the vector of probabilities, the flight phase moves along directions in
the null space of the constraints (the number of documents and the number of words), each move ending with a document at 0 or 1,
so that both totals stay exact. When no direction is left, at most two documents of a group are undecided. Groups are hash
buckets of a source, of about ``group_rows`` documents; what they leave undecided is gathered in fewer groups and flies again,
until a source has one group, whatever other sources have. There the moves settle the largest documents first, against all others, so
that the landing problem is left with a few of the smallest documents; trying all their outcomes gives the nearest total. Until
then each group holds its largest and smallest documents out of the flight, so that one group has both.

Sizes count ``[^\\x20\\x09-\\x0D]+`` in the text, null 0. Targets: sources by code point, null last, weigh 5, 2, 1, repeating;
they share the total size, none above ``ceiling`` times its own; the excess is shared anew by weight. Results depend on ids, sources and
texts only, so reruns agree. Rows that agree in all three are numbered (``copy``), and groups are dealt by id, text and number, so that
repeated or null ids don't gather in one group; which of such equal rows is taken once more is left open, as they can't be told apart. Ties in
the landing go to the outcome that comes first. Null and empty texts have size 0; sizes are counted in the whole text, by a built-in expression. An
empty table gives an empty result; a source of size 0 takes nothing. Columns beyond those named are left out, whatever their names.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed, join_hot

WEIGHTS = (5, 2, 1)
CEILING = 3.0
GROUP_ROWS = 4096
#: Sources up to which the table of targets is broadcast.
BROADCAST_SOURCES = 100_000
_EPS = 1e-9


def size_of(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size): water-filling of the total under the ceilings.

    The window has no partition: it runs over one row a source, already aggregated.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(ceiling)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    per = per.withColumn("before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("rest", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    per = per.withColumn("full", F.col("most") / F.col("weight") <= F.col("level"))
    # sources sorted by ceiling: the first that isn't full sets the level for itself and all after it
    shared = F.min(F.when(~F.col("full"), F.struct((F.col("most") / F.col("weight")).alias("o"), F.col("level").alias("level")))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * shared)
    return per.select("source", "source_size", "n_docs", F.least(target, F.col("most")).alias("target"))


def fly(p: list[float], sizes: list[float], random: np.random.Generator) -> list[float]:
    """The flight phase over one group, changing ``p``; at most two entries stay between 0 and 1. O(n): three at a time."""
    if not p:
        return p
    draws = iter(random.random(2 * len(p) + 4).tolist())
    todo = [i for i, x in enumerate(p) if _EPS < x < 1 - _EPS]
    for i in set(range(len(p))) - set(todo):
        p[i] = float(round(p[i]))
    active, rest = todo[:3], todo[3:]
    rest.reverse()
    while len(active) == 3:
        i, j, k = active
        # null space of the rows (1, 1, 1) and (size_i, size_j, size_k)
        u = (sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for x, d in zip(active, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
            elif d < 0:
                up, down = min(up, -p[x] / d), min(down, (p[x] - 1) / d)
        step = up if next(draws) * (up + down) < down else -down
        kept = []
        for x, d in zip(active, u, strict=True):
            p[x] += step * d
            if p[x] <= _EPS or p[x] >= 1 - _EPS:
                p[x] = float(round(p[x]))
            else:
                kept.append(x)
        if len(kept) == 3:  # rounding left no one at a bound: settle the nearest
            x = min(kept, key=lambda x: min(p[x], 1 - p[x]))
            p[x] = float(round(p[x]))
            kept.remove(x)
        while len(kept) < 3 and rest:
            kept.append(rest.pop())
        active = kept
    return p


def spread(p: list[float], sizes: list[float], random: np.random.Generator) -> list[float]:
    """A flight whose moves settle the largest undecided document against all others at once, along the direction a + b * size of
    the null space. It ends with a few of the smallest documents undecided, so the landing changes the totals little. O(n^2)."""
    q, s = np.array(p), np.array(sizes)
    q[q <= _EPS], q[q >= 1 - _EPS] = 0, 1
    order = np.argsort(-s, kind="stable")
    while len(order := order[(q[order] > 0) & (q[order] < 1)]) > 3:
        x = s[order[1:]]
        u = np.empty(len(order))
        u[0], n, one, two = 1.0, len(x), x.sum(), (x * x).sum()
        det = n * two - one * one
        if det > 1e-9 * max(1.0, n * two):
            u[1:] = -((two - one * s[order[0]]) + (n * s[order[0]] - one) * x) / det
        else:
            u[1:] = -1.0 / n
        at = q[order]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - at) / u, np.where(u < 0, -at / u, np.inf)).min()
            down = np.where(u > 0, at / u, np.where(u < 0, (at - 1) / u, np.inf)).min()
        q[order] = at = at + u * (up if random.random() * (up + down) < down else -down)
        near = np.minimum(at, 1 - at)
        settled = near <= _EPS
        settled[np.argmin(near)] = True
        q[order[settled]] = np.round(at[settled])
    return q.tolist()


def held_out(group_rows: int) -> int:
    """How many of the largest documents of a group, and how many of the smallest, wait until their source has one group."""
    return max(1, group_rows // 32) if group_rows >= 8 else 0


def fly_middle(p: list[float], sizes: list[float], random: np.random.Generator, held: int) -> list[float]:
    """The flight without the ``held`` largest and the ``held`` smallest of the undecided documents, which keep their probabilities."""
    order = sorted((i for i, x in enumerate(p) if _EPS < x < 1 - _EPS), key=lambda i: sizes[i])
    waiting = {i: p[i] for i in (*order[:held], *order[max(held, len(order) - held) :])}
    rest = [i for i in range(len(p)) if i not in waiting]
    for i, x in zip(rest, fly([p[i] for i in rest], [sizes[i] for i in rest], random), strict=True):
        p[i] = x
    return p


def land(p: list[float], sizes: list[float]) -> list[float]:
    """Settle the few undecided entries: the outcome whose total size, then number, is nearest."""
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    size, number = sum(p[i] * sizes[i] for i in left), sum(p[i] for i in left)
    best = min(product((0.0, 1.0), repeat=len(left)), key=lambda o: (abs(sum(x * sizes[i] for x, i in zip(o, left, strict=True)) - size), abs(sum(o) - number), o))
    for i, x in zip(left, best, strict=True):
        p[i] = x
    return p


def numbered(rows: DataFrame, total: int) -> DataFrame:
    """The rows with ``copy``, their number among the rows that agree in id, source and text (``digest``); ``part`` is each row's partition.

    Numbers are local to a partition, plus the counts of the partitions before it: no task gets all rows of a group.
    """
    rows = rows.withColumn("same", F.xxhash64("id", F.isnull("id"), "source", F.isnull("source"), "digest"))
    several = rows.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").withColumn("rows", F.col("n"))
    marked = join_hot(rows, several, ["same"], "rows", total, "left")
    place = ["same", "part"]
    many = marked.where("n is not null").withColumn("at", F.row_number().over(Window.partitionBy(*place).orderBy("size")) - 1)
    before = F.coalesce(F.sum("held").over(Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = marked.where("n is not null").groupBy(*place).agg(F.count("*").alias("held")).select(*place, before.alias("start"))
    many = many.join(starts, place).withColumn("copy", (F.col("start") + F.col("at")).cast("bigint")).drop("start", "at")
    return many.unionByName(marked.where("n is null").withColumn("copy", F.lit(0).cast("bigint"))).drop("same", "part", "n")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, ceiling: float = CEILING, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per row: id, size, source_size, target, and ``times``, how often the mix takes the document."""
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest")
    sized = checkpointed(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), digest, F.spark_partition_id().alias("part")))
    per = checkpointed(targets(sized.select("source", "size"), weights, ceiling))
    n_sources, most, total = per.agg(F.count("*"), F.coalesce(F.max("n_docs"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    small = F.broadcast(per) if n_sources <= BROADCAST_SOURCES else per
    small = small.withColumnRenamed("source", "source2")
    rows = numbered(sized, total).join(small, F.col("source").eqNullSafe(F.col("source2")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("ratio", F.least(ratio, F.lit(float(ceiling))))
    rows = rows.withColumn("whole", F.floor(F.col("ratio") + _EPS).cast("bigint"))
    rows = rows.withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
    rows = rows.select("id", "source", "size", "digest", "copy", "source_size", "n_docs", "target", "whole", "p")
    schema, level, parts = rows.schema, 0, []
    # each group leaves at most so many
    per_group = 2 * held_out(group_rows) + 2
    while True:
        groups = max(1, math.ceil(most / group_rows))
        bucket = F.pmod(F.xxhash64(F.col("id"), F.col("digest"), F.col("copy"), F.lit(level)), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / group_rows)).cast("bigint"))
        flown = rows.withColumn("bucket", bucket).groupBy("source", "bucket").applyInArrow(_flight(level, group_rows), _bucketed(schema))
        flown = checkpointed(flown.drop("bucket"))
        if groups == 1:
            parts.append(flown)
            break
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        parts.append(flown.where(~open_))
        rows, level = flown.where(open_), level + 1
        left = F.ceil(F.col("n_docs") / group_rows) * per_group
        rows = rows.withColumn("n_docs", left.cast("bigint"))
        most = per_group * groups
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") + F.col("p").cast("bigint")).alias("times"))


def _bucketed(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("bucket", T.LongType())])


def _flight(level: int, group_rows: int):
    def run(rows: pa.Table) -> pa.Table:
        last = rows["n_docs"][0].as_py() <= group_rows
        names = zip(*(rows[c].to_pylist() for c in ("id", "size", "digest", "copy")), strict=True)
        order = np.argsort(np.array([xxhash.xxh64_intdigest(f"{level}:{name}") for name in names], np.uint64), kind="stable")
        rows = rows.take(pa.array(order))
        seed = xxhash.xxh64_intdigest(f"{rows['source'][0].as_py()}:{rows['bucket'][0].as_py()}:{level}")
        sizes = [float(s) for s in rows["size"].to_pylist()]
        random, p = np.random.default_rng(seed), rows["p"].to_pylist()
        p = fly(spread(p, sizes, random), sizes, random) if last else fly_middle(p, sizes, random, held_out(group_rows))
        p = pa.chunked_array([pa.array(land(p, sizes) if last else p, pa.float64())])
        return rows.set_column(rows.schema.get_field_index("p"), "p", p)

    return run
