"""Cells, blocks and masks of images as plans: components over tiles, block statistics, thresholds and shifted masks.

Images are rows of cells or packed words, keyed by any columns; no image is gathered into one task. Empty tables give empty results; null coordinates
and values are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillmark.storage import checkpointed

#: Cells along a tile's side: runs are joined to parts within a tile by one task, and parts that meet at a border of tiles are linked there.
TILE = 64


def runs(cells: DataFrame, *keys: str, tile: int = TILE) -> DataFrame:
    """(keys, y, tile, x0, x1): the runs of neighbouring cells (keys, y, x) of a row, cut at the borders of tiles."""
    once = cells.select(*keys, "y", "x").dropna(subset=["y", "x"]).distinct().withColumn("tile", F.floor(F.col("x") / tile).cast("bigint"))
    place = Window.partitionBy(*keys, "y", "tile").orderBy("x")
    named = once.withColumn("run", F.col("x") - F.row_number().over(place))
    return named.groupBy(*keys, "y", "tile", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("run")


def _same(a: str, b: str, keys: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def run_links(found: DataFrame, *keys: str, tile: int = TILE) -> DataFrame:
    """(u, v): runs (keys, y, tile, x0, x1, node) that touch, by a side or a corner: one row on, or across a border of tiles."""
    tiles = F.array_distinct(F.array(F.col("tile"), F.floor((F.col("x0") - 1) / tile).cast("bigint"), F.floor((F.col("x1") + 1) / tile).cast("bigint")))
    looks = found.select(*keys, "y", "x0", "x1", "node", F.explode(tiles).alias("tile")).withColumn("row", F.explode(F.array(F.col("y"), F.col("y") + 1)))
    meet = _same("a", "b", keys) & F.expr("a.row = b.y and a.tile = b.tile and a.x0 <= b.x1 + 1 and b.x0 <= a.x1 + 1 and a.node <> b.node")
    return looks.alias("a").join(found.alias("b"), meet).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def least_reachable(links: DataFrame) -> DataFrame:
    """(node, root): for every node of links (u, v) the least node that it reaches.

    Rounds of two steps: every node's larger neighbours are linked to the least one around it, then every node and its smaller neighbours to the least of those.
    Rounds needed grow with the logarithm of the longest chain; each is cut by a checkpoint.
    """
    edges = checkpointed(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.where("v > u").join(around, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(below, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*")
        edges = checkpointed(small.where("u <> v").distinct())
        told = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if told == known:
            break
        known = told
    found = edges.groupBy("u").agg(F.min("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return found.select(F.col("u").alias("node"), "root").unionByName(roots.join(found, F.col("node") == F.col("u"), "left_anti"))


def _heads(group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, tile: int) -> np.ndarray:
    """For each run the first run of its part; runs of whole tiles, sorted by (group, y, x0), one group a tile."""
    n, width = len(group), tile + 2
    nth = np.cumsum(np.r_[True, group[1:] != group[:-1]][:n])
    row = (nth * (tile + 1) + y % tile) * width  # an empty row lies between two tiles, an empty place at each end of a row
    start, end = row + x0 % tile + 1, row + x1 % tile + 1
    low, high = np.searchsorted(end, start + width - 1), np.searchsorted(start, end + width + 1, "right")
    many = np.maximum(high - low, 0)
    u = np.repeat(np.arange(n), many)
    v = np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(u))
    head = np.arange(n)
    while (head[u] != head[v]).any():
        a, b = head[u], head[v]
        np.minimum.at(head, np.maximum(a, b), np.minimum(a, b))
        while (head != head[head]).any():
            head = head[head]
    return head


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of sorted batches again, as tables of whole groups: a group is rows with the same first column, which may begin in one batch and go on in the next."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy()
        cut = int(np.searchsorted(group, group[-1]))
        if cut or rest and rest[-1].column(0)[0].as_py() != group[0]:
            yield pa.Table.from_batches([x for x in (*rest, batch.slice(0, cut)) if x.num_rows])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def tile_parts(found: DataFrame, *keys: str, tile: int = TILE) -> DataFrame:
    """Runs (keys, y, tile, x0, x1) with ``node``, the number of their part inside a tile of ``tile`` by ``tile`` cells, and its first cell (head_y, head_x).

    A task holds the tiles of one Arrow batch at a time.
    """
    placed = found.select(F.xxhash64(*keys, F.floor(F.col("y") / tile), "tile").alias("group"), *keys, "y", "tile", "x0", "x1").repartition("group").sortWithinPartitions("group", "y", "x0")
    schema = T.StructType([*placed.schema, T.StructField("head_y", placed.schema["y"].dataType), T.StructField("head_x", placed.schema["x0"].dataType)])

    def done(rows: pa.Table) -> pa.RecordBatch:
        head = pa.array(_heads(*[rows.column(c).to_numpy().astype(np.int64) for c in ("group", "y", "x0", "x1")], tile))
        out = rows.append_column("head_y", rows.column("y").take(head)).append_column("head_x", rows.column("x0").take(head))
        return out.combine_chunks().to_batches()[0]

    def run(batches):
        for rows in whole_groups(batches):
            yield done(rows)

    parts = placed.mapInArrow(run, schema).drop("group")
    return parts.withColumn("node", F.xxhash64(*keys, "head_y", "head_x").bitwiseAND(F.lit(2**63 - 1)))


def _parted(cells: DataFrame, keys: tuple[str, ...], tile: int) -> tuple[DataFrame, DataFrame]:
    """The runs of ``tile_parts``, and (node, first) of the parts that go on beyond their tile: the first cell (y, x) of the whole.

    Only runs at a border of tiles can touch a part of another tile, so rounds over links see those alone.
    """
    named = checkpointed(tile_parts(runs(cells, *keys, tile=tile), *keys, tile=tile))
    at = lambda c: F.pmod(F.col(c), F.lit(tile))
    border = named.where(at("y").isin(0, tile - 1) | (at("x0") == 0) | (at("x1") == tile - 1))
    roots = checkpointed(least_reachable(run_links(border, *keys, tile=tile)))
    heads = border.select("node", F.struct(F.col("head_y").alias("y"), F.col("head_x").alias("x")).alias("head")).distinct()
    first = roots.join(heads, "node").groupBy("root").agg(F.min("head").alias("first"))
    return named, roots.join(first, "root").select("node", "first")


def _first() -> Column:
    return F.coalesce("first", F.struct(F.col("head_y").alias("y"), F.col("head_x").alias("x"))).alias("first")


def labelled_cells(cells: DataFrame, *keys: str, tile: int = TILE) -> DataFrame:
    """(keys, y, x, first): each cell with the first cell of its part."""
    named, beyond = _parted(cells, keys, tile)
    return named.join(beyond, "node", "left").select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), _first())


def components(cells: DataFrame, *keys: str, tile: int = TILE) -> DataFrame:
    """(keys, component, cells, x0, y0, x1, y1): the parts of cells (keys, y, x) that touch by sides or corners; numbered from 1 by their first cell.

    Rows become runs, runs that touch are joined within tiles, and what meets at their borders is linked and contracted; repeated cells count once.
    """
    named, beyond = _parted(cells, keys, tile)
    measures = lambda n, y0, y1: (F.sum(n).alias("cells"), F.min("x0").alias("x0"), F.min(y0).alias("y0"), F.max("x1").alias("x1"), F.max(y1).alias("y1"))
    inside = named.groupBy(*keys, "node", "head_y", "head_x").agg(*measures(F.col("x1") - F.col("x0") + 1, "y", "y"))
    per = inside.join(beyond, "node", "left").select(*keys, _first(), "cells", "x0", "y0", "x1", "y1").groupBy(*keys, "first").agg(*measures("cells", "y0", "y1"))
    return _numbered(per, keys).select(*keys, "component", "cells", "x0", "y0", "x1", "y1")


def _numbered(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return parts.withColumn("component", F.row_number().over(Window.partitionBy(*keys).orderBy("first")).cast("bigint"))


def closed(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells (keys, y, x) after closing by two by two cells that end at their own: a cell grows right and down, then stays if those left and above it are set.

    Coordinates start at 0; places before 0 don't count. Cells beyond the grid's far border have to be left out by the caller.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    spread = lambda df: df.select(*keys, "y", "x", F.explode(steps).alias("s")).select(*keys, (F.col("y") + F.col("s.i")).alias("y"), (F.col("x") + F.col("s.j")).alias("x"))
    counted = spread(spread(cells).distinct()).groupBy(*keys, "y", "x").agg(F.count("*").alias("n"))
    need = F.when(F.col("y") > 0, 2).otherwise(1) * F.when(F.col("x") > 0, 2).otherwise(1)
    return counted.where(F.col("n") == need).select(*keys, "y", "x")


def block_scores(pixels: DataFrame, *keys: str, side: int = 64, least_blocks: int = 9, least_spread: float = 1e-3) -> DataFrame:
    """(keys, y, x, energy, z): the 75 % point of each block of pixels (keys, y, x, value), and how far it lies from the image's median.

    z is (energy - median) / max(0.001, 1.4826 * median deviation); 0 for images of fewer than nine blocks, or with hardly any deviation. A block's
    values, side * side at most, are one group; blocks of an image are reduced to their median and, in a second step, to the median deviation.
    """
    block = pixels.dropna(subset=["y", "x", "value"]).groupBy(*keys, F.floor(F.col("y") / side).alias("y"), F.floor(F.col("x") / side).alias("x")).agg(F.percentile("value", 0.75).alias("energy"))
    image = Window.partitionBy(*keys)
    placed = block.withColumn("median", F.percentile("energy", 0.5).over(image)).withColumn("blocks", F.count("*").over(image))
    placed = placed.withColumn("spread", F.percentile(F.abs(F.col("energy") - F.col("median")), 0.5).over(image))
    z = (F.col("energy") - F.col("median")) / F.greatest(F.lit(least_spread), 1.4826 * F.col("spread"))
    flat = (F.col("blocks") < least_blocks) | (F.col("spread") < least_spread)
    return placed.select(*keys, "y", "x", "energy", F.when(flat, 0.0).otherwise(z).alias("z"))


def outlying_blocks(scores: DataFrame, *keys: str, least: float = 4.0) -> DataFrame:
    """(keys, component, cells, x0, y0, x1, y1, z): the parts of blocks (keys, y, x, z) at or above ``least`` after closing, with their highest z."""
    size = scores.groupBy(*keys).agg(F.max("y").alias("rows"), F.max("x").alias("columns"))
    grown = closed(scores.where(F.col("z") >= least), *keys).alias("a").join(size.alias("b"), _same("a", "b", keys)).where("y <= rows and x <= columns").select(*[F.col(f"a.{k}") for k in keys], "y", "x")
    cells = labelled_cells(grown, *keys).join(scores, [*keys, "y", "x"])
    per = cells.groupBy(*keys, "first").agg(F.count("*").alias("cells"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.max("z").alias("z"))
    return _numbered(per, keys).select(*keys, "component", "cells", "x0", "y0", "x1", "y1", "z")


def parting_levels(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, level, low, high): the grey level that parts an image's pixels (keys, level) best in two classes, and how many lie up to it and above.

    Levels are counted first (at most 256 an image); sums up to each level then give the variance between the classes. Of equal ones the least level wins; an image of
    one level has none.
    """
    counts = pixels.dropna(subset=["level"]).groupBy(*keys, "level").agg(F.count("*").alias("n"))
    image = Window.partitionBy(*keys)
    upto = image.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mass = F.col("n") * F.col("level")
    rows = counts.select(*keys, "level", F.sum("n").over(upto).alias("low"), F.sum(mass).over(upto).alias("low_sum"), F.sum("n").over(image).alias("all"), F.sum(mass).over(image).alias("all_sum"))
    rows = rows.withColumn("high", F.col("all") - F.col("low")).where("high > 0")
    apart = F.col("low_sum") / F.col("low") - (F.col("all_sum") - F.col("low_sum")) / F.col("high")
    rows = rows.withColumn("between", F.col("low").cast("double") * F.col("high") * apart * apart)
    best = rows.groupBy(*keys).agg(F.max_by(F.struct("level", "low", "high"), F.struct("between", -F.col("level"))).alias("b"))
    return best.select(*keys, "b.level", "b.low", "b.high")


def shifted_dice(left: Column, right: Column, columns: int, rows: int, reach: int = 2) -> Column:
    """Best Dice coefficient of two masks over shifts of the second by up to ``reach`` cells; 0 for two empty masks.

    A mask is an array of ``columns`` words, bit i of a word the cell in row i (at most 63 rows): a shift sideways moves the place in the array, one up or down the bits.
    """
    inside = F.lit((1 << rows) - 1).cast("bigint")
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    word = lambda mask, k: F.coalesce(F.get(mask, k), F.lit(0).cast("bigint"))

    def moved(k: Column, s: Column) -> Column:
        w = word(right, k - s["i"])
        up, down = F.call_function("shiftleft", w, F.greatest(s["j"], F.lit(0))), F.call_function("shiftright", w, F.greatest(-s["j"], F.lit(0)))
        return F.when(s["j"] >= 0, up).otherwise(down).bitwiseAND(inside)

    def dice(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("both"), F.lit(0).alias("sum"))
        add = lambda a, k: F.struct(
            (a["both"] + F.bit_count(word(left, k).bitwiseAND(moved(k, s)))).alias("both"), (a["sum"] + F.bit_count(word(left, k)) + F.bit_count(moved(k, s))).alias("sum")
        )
        done = F.aggregate(F.sequence(F.lit(0), F.lit(columns - 1)), start, add)
        return F.transform(F.array(done), lambda d: F.when(d["sum"] > 0, 2.0 * d["both"] / d["sum"]).otherwise(0.0))

    return F.array_max(F.flatten(F.transform(shifts, dice)))


def mask_word(mask: Column, columns: int, rows: int) -> Column:
    """A mask of at most 64 cells (see ``shifted_dice``) as one word: column after column, so one shift moves it sideways and up or down. Null: empty."""
    if columns * rows > 64:
        raise ValueError("a word holds 64 cells")
    out = F.lit(0).cast("bigint")
    for k in range(columns):
        out = out.bitwiseOR(F.call_function("shiftleft", F.coalesce(F.get(mask, k), F.lit(0).cast("bigint")), F.lit(k * rows)))
    return out


def shifted_dice_of_words(left: Column, right: Column, columns: int, rows: int, reach: int = 2) -> Column:
    """``shifted_dice`` of two words of ``mask_word``: a few machine operations a shift, for work on many pairs."""
    scores = []
    for by, inside in _word_shifts(columns, rows, reach):
        moved = F.call_function("shiftleft" if by >= 0 else "shiftrightunsigned", right, F.lit(abs(by))).bitwiseAND(F.lit(inside - (inside >> 63 << 64)).cast("bigint"))
        scores.append(2.0 * F.bit_count(left.bitwiseAND(moved)) / F.greatest(F.lit(1), F.bit_count(left) + F.bit_count(moved)))
    return F.greatest(*scores)


def _word_shifts(columns: int, rows: int, reach: int) -> Iterator[tuple[int, int]]:
    """(places, cells): how far each shift moves a word of ``mask_word`` to the left, and the cells that the moved mask may then fill."""
    for i in range(-reach, reach + 1):
        for j in range(-reach, reach + 1):
            inside = sum(1 << (x * rows + y) for x in range(columns) for y in range(rows) if 0 <= x - i < columns and 0 <= y - j < rows)
            if inside:
                yield i * rows + j, inside


def shifts_of_words(words: np.ndarray, columns: int, rows: int, reach: int = 2) -> Iterator[np.ndarray]:
    """The words (uint64) of masks moved by each shift, as ``shifted_dice_of_words`` moves them."""
    for by, inside in _word_shifts(columns, rows, reach):
        yield (words << np.uint64(by) if by >= 0 else words >> np.uint64(-by)) & np.uint64(inside)


def packed_masks(cells: DataFrame, *keys: str, columns: int) -> DataFrame:
    """(keys, mask): cells (keys, y, x) of each mask packed as ``shifted_dice`` reads them; y below 63."""
    per = cells.distinct().groupBy(*keys, "x").agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("y").cast("int"))).alias("word"))
    words = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("x").cast("int"), "word"))).alias("m"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit(0).cast("bigint")))
    return words.select(*keys, mask.alias("mask"))
