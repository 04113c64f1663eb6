"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints: words are runs of bytes other than ASCII white space in the lower-cased (A-Z) text; each shingle of ``width`` words,
repeats included, votes with its XXH64 (seed 42); a bit is set if more than half of the votes set it. A text of fewer words is one
shingle; a null or wordless text has fingerprint zero and links like any other.

Search: bit i of the fingerprint gets a non-zero vector m(i) of r + 1 bits, r the radius. For each non-zero v of r + 1 bits one
table keeps the bits i whose m(i) has an odd product with v. At most r differing bits have vectors that span no more than r
dimensions, so some v is orthogonal to all of them and its table drops every differing bit: each pair within the radius
collides in a table. There are 2**(r + 1) - 1 tables, over distinct fingerprints only, so copies cost nothing.

Members of one bucket are compared in the task that holds them, up to ``bucket_rows`` of them; larger buckets leave that task
as packed blocks. Pairs of blocks are formed by the blocks' names, in as many tasks as there are blocks, each pair comparing members across only.
Every comparison is exact, and a task gives at most one link a member. No pair is lost, no bucket is capped. Components come from the links; the
smallest id of a fingerprint names it. Fingerprints that many rows share are joined back by broadcast (fewer than a thousand can be that frequent).

Texts of any length are read whole, one at a time, in memory in proportion to one text. Ties and repeated rows keep their rows. A null id keeps its
row and never names a component unless no other id is there. Empty tables give empty results. Columns beyond the id and the text are left
out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, checkpointed, join_hot, map_texts
from .components import Forest, connected_components

RADIUS = 4
BUCKET_ROWS = 4096
#: Links that a task gathers before it gives them out.
FOREST_NODES = 500_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit fingerprint as an unsigned integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, h64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return h64(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -width].tolist()]
    votes = np.zeros(64, np.int64)
    stops = (ends[width - 1 :] - 1).tolist()
    for a in range(0, len(starts), 100_000):
        hashes = np.array([h64(joined[i:j], 42) for i, j in zip(starts[a : a + 100_000], stops[a : a + 100_000], strict=True)], np.uint64)
        votes += bit_counts(hashes)
    over = votes * 2 > len(starts)
    return int(np.packbits(over[::-1]).view(">u8")[0])


def bit_counts(x: np.ndarray) -> np.ndarray:
    """How many of the words have each bit set, lowest bit first."""
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(64, np.int64)
    for a in range(0, len(bits), 255):  # sums of 255 fit in a byte
        out += np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): the fingerprint's bits as a signed 64-bit integer."""

    def make():
        def apply(texts):
            return {"fp": np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)}

        return apply

    return map_texts(df, id_col, text_col, "fp bigint", make)


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering masks, as signed integers: every set of at most ``radius`` bits is disjoint from one of them."""
    n = 1 << radius + 1
    vectors = [i % (n - 1) + 1 for i in range(bits)]
    out = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, n)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def link_members(members: np.ndarray, radius: int, forest: Forest) -> None:
    """Link all members (distinct unsigned words) within the radius; each is compared with those not yet reached."""
    rest = members
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            for a in range(0, len(front), 64):
                near = np.bitwise_count(front[a : a + 64, None] ^ rest[None, :]) <= radius
                for i, j in zip(*np.nonzero(near & ~reached), strict=True):
                    if not reached[j]:
                        reached[j] = True
                        forest.link(int(rest[j]), int(front[a + i]))
            front, rest = rest[reached], rest[~reached]


def link_across(x: np.ndarray, y: np.ndarray, radius: int, forest: Forest) -> None:
    """Link members of x with members of y within the radius; a member is compared with those of the other side not yet reached."""
    rest = [x, y]
    while len(rest[0]) and len(rest[1]):
        front, rest[0], side = rest[0][:1], rest[0][1:], 0
        while len(front):
            other = rest[1 - side]
            reached = np.zeros(len(other), bool)
            for a in range(0, len(front), 64):
                near = np.bitwise_count(front[a : a + 64, None] ^ other[None, :]) <= radius
                for i, j in zip(*np.nonzero(near & ~reached), strict=True):
                    if not reached[j]:
                        reached[j] = True
                        forest.link(int(other[j]), int(front[a + i]))
            front, rest[1 - side], side = other[reached], other[~reached], 1 - side


_OUT = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("tab", pa.int32()), ("key", pa.int64()), ("block", pa.int32()), ("members", pa.binary())])


def _links(forest: Forest):
    pairs = list(forest.edges())
    if pairs:
        u, v = np.array(pairs, np.uint64).T.copy().view(np.int64)
        none = lambda t: pa.nulls(len(u), t)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none(pa.int32()), none(pa.int64()), none(pa.int32()), none(pa.binary())], schema=_OUT)


def _blocks(rows: list):
    if rows:
        none = pa.nulls(len(rows), pa.int64())
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([none, none, *(pa.array(c, type=t) for c, t in zip(cols, _OUT.types[2:], strict=True))], schema=_OUT)


def compare_buckets(radius: int, bucket_rows: int):
    """Over batches of (tab, key, fp) sorted by bucket: links, and the blocks of buckets too large for one task."""

    def run(batches):
        forest, held, count, bucket = Forest(), [], 0, None
        blocks, number = [], 0

        def close():
            nonlocal held, count, number
            if number:
                blocks.append((*bucket, number, np.concatenate(held).tobytes()))
            elif count > 1:
                link_members(np.concatenate(held), radius, forest)
            held, count, number = [], 0, 0

        for batch in batches:
            tab, key, fp = (np.asarray(batch.column(i)) for i in range(3))
            fp = fp.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (tab[1:] != tab[:-1]) | (key[1:] != key[:-1])])
            ends = np.r_[starts[1:], len(fp)]
            # buckets of one row that lie inside the batch hold no pair
            look = (ends - starts > 1) | (starts == 0) | (ends == len(fp))
            for a, b in zip(starts[look].tolist(), ends[look].tolist(), strict=True):
                if bucket != (at := (int(tab[a]), int(key[a]))):
                    close()
                    bucket = at
                while a < b:
                    take = min(b - a, bucket_rows - count)
                    held.append(fp[a : a + take].copy())
                    count, a = count + take, a + take
                    if count == bucket_rows and a < b or count == bucket_rows and b == len(fp):
                        blocks.append((*bucket, number, np.concatenate(held).tobytes()))
                        held, count, number = [], 0, number + 1
                if count == 0 and number:
                    held = [np.empty(0, np.uint64)]
            yield from _blocks(blocks)
            blocks.clear()
            if len(forest.parent) > FOREST_NODES:
                yield from _links(forest)
                forest = Forest()
        close()
        yield from _blocks(blocks)
        yield from _links(forest)

    return run


def compare_blocks(radius: int):
    """Over batches of (same, members, others): links inside a block, or across two."""

    def run(batches):
        for batch in batches:
            forest = Forest()
            for same, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if same:
                    link_members(np.frombuffer(x, np.uint64), radius, forest)
                else:
                    link_across(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), radius, forest)
            for b in _links(forest):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"])

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(u, v) links that connect all distinct fingerprints (column ``fp``) within the radius, some left out where others connect them."""
    tables = F.array(*[F.struct(F.lit(k).alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(radius))])
    keyed = fps.select("fp", F.explode(tables).alias("t")).select("t.tab", "t.key", "fp")
    # the partition count is left to the session (spark.sql.shuffle.partitions) and to AQE
    sorted_ = keyed.repartition("tab", "key").sortWithinPartitions("tab", "key")
    found = checkpointed(sorted_.mapInArrow(compare_buckets(radius, bucket_rows), "u bigint, v bigint, tab int, key bigint, block int, members binary"))
    links = found.where("u is not null").select("u", "v")
    blocks = found.where("members is not null").select("tab", "key", "block", "members")
    pairs = block_pairs(blocks, ["tab", "key"], ["members"]).select("same", "members1", "members2")
    return links.unionByName(pairs.mapInArrow(compare_blocks(radius), "u bigint, v bigint"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row: id, ``fp``, ``component_id`` (smallest id reachable)."""
    prints = checkpointed(fingerprints(df, id_col, text_col, width))
    named = checkpointed(prints.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("copies")))
    roots = connected_components(near_links(named.select("fp"), radius, bucket_rows))
    joined = checkpointed(named.join(roots.withColumnRenamed("node", "fp"), "fp", "left"))
    # only fingerprints with a link need their component's smallest id
    linked = joined.where("root is not null")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("prints"))
    total, n_linked = joined.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("root")).first()
    named_all = (
        join_hot(linked, lowest, ["root"], "prints", n_linked).select("fp", "copies", "component_id")
        .unionByName(joined.where("root is null").select("fp", "copies", F.col("low").alias("component_id")))
    )
    return join_hot(prints, named_all, ["fp"], "copies", total).select(id_col, "fp", "component_id")
