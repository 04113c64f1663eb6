"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors are scaled to unit length; a pair of cosine s then lies u = sqrt(2 - 2s) apart. Codes are made of what is left of a vector after the mean of some of
its label's vectors (the centre) is taken away: the residual is rotated by fixed random orthogonal matrices, and its signs are the code, of at least ``CODE_BITS``
bits. For residuals at an angle a bit differs with the chance angle/pi. Embeddings that share a direction (a median cosine of 0.8 or 0.9) have residuals in all directions,
so their codes still tell apart what is near and what isn't.

1. Meeting: projections on random directions, cut in steps of ``STEP`` u, make keys of k steps, k = max(0, ceil(log2(rows / ``direct_rows``))) by the label's
   number of distinct vectors, in as many tables as let a pair at the threshold s meet with a chance above 1 - 1e-9 (one table of one bucket where k is 0). Steps depend on
   distances alone, wherever the vectors lie. Only (key, id, code, length of the residual) is shuffled. In a bucket the two lengths and the distance u give the widest angle of
   a pair at s; pairs whose codes differ in more bits than that angle allows but for a chance below 1e-13 are passed over, the others
   are links between candidates, and a task gives at most one a member.
2. Deciding: the components of these links are small; their members' vectors are fetched once. There each code of the whole vector has a stored
   correction factor f, the inner product of code and rotated vector, and for another unit vector q the estimate <code, q>/f of the cosine is
   unbiased. With true cosine c it errs by sqrt(1-c^2) * sqrt(1-f^2)/f * t, t a coordinate of a random direction, so a pair at or above s
   has an estimate of at least s - sqrt(1-s^2) * sqrt(1-f^2)/f * min(1, Z/sqrt(d-1)) but for a chance below 1e-14. Pairs that pass are computed
   anew in double precision from the stored vectors, and only that decides. Every pair of a component is compared in exactly one place.

Buckets and components of any size are cut into blocks, and pairs of blocks are compared in different tasks; no bucket is capped. Copies are one
vector with a count, so groups of copies cost nothing.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or id, link with nothing. Rows with
one id are one node; repeated rows count as vectors of their own. Vectors of different length don't link. Ties: a component is named by its smallest
id. Empty tables give empty results. Columns beyond those named are left out, whatever their names.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import bound

from .common import block_pairs, checkpointed, join_hot
from .components import Forest, connected_components

THRESHOLD = 0.98
DIRECT_ROWS = 2048
BUCKET_ROWS = 4096
BLOCK_ROWS = 1024
CODE_BITS = 1024
#: Bits that are compared first.
FIRST_BITS = 256
#: Width of a projection's steps, in distances of the threshold.
STEP = 8.0
#: Vectors of a label whose mean is its centre.
CENTRE_OF = 16
Z = 8.0
MISS = 1e-9
SEED = 20_240_521
_CHUNK = 512
_CODE_CHUNK = 64


@functools.lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


@functools.lru_cache(maxsize=8)
def rotations(dim: int) -> np.ndarray:
    """As many rotations side by side as give CODE_BITS signs."""
    out = [rotation(dim)]
    for k in range(1, -(-CODE_BITS // dim)):
        q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).standard_normal((dim, dim)))
        out.append((q * np.sign(np.diag(r))).astype(np.float32))
    return np.concatenate(out, axis=1)


@functools.lru_cache(maxsize=8)
def hyperplanes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, tables, bits]).standard_normal((dim, tables * bits))


def table_count(bits: int, threshold: float) -> int:
    """Tables that let a pair at the threshold meet with a chance above 1 - MISS; a step is shared with a chance that STEP alone gives."""
    if bits == 0:
        return 1
    tail = math.erfc(STEP / math.sqrt(2))
    share = 1 - tail - 2 / (math.sqrt(2 * math.pi) * STEP) * (1 - math.exp(-STEP * STEP / 2))
    return math.ceil(math.log(MISS) / math.log1p(-(share**bits)))


def code_bits(dim: int) -> int:
    return dim * -(-CODE_BITS // dim)


def words(dim: int) -> int:
    """64-bit words of a code."""
    return -(-code_bits(dim) // 64)


def most_bits(n: int, share: float) -> int:
    """Of n bits that each differ with this chance, the number exceeded with a chance below 1e-13 (Chernoff's bound)."""
    p = min(max(share, 1e-6), 1 - 1e-6)
    q = np.arange(math.ceil(n * p), n) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        far = n * (np.where(q > 0, q * np.log(q / p), 0) + (1 - q) * np.log((1 - q) / (1 - p))) > 30
    return math.ceil(n * p) + int(far.argmax()) if far.any() else n


_GRID = 1024


@functools.lru_cache(maxsize=64)
def bit_limits(dim: int, threshold: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The squared distance at the threshold, and by the cosine of two residuals (from 1 down to -1) how many of the first and of all bits may differ."""
    shares = [math.acos(1 - 2 * i / _GRID) / math.pi for i in range(_GRID + 1)]
    first = min(FIRST_BITS, code_bits(dim))
    return 2 - 2 * threshold + 1e-9, *(np.array([most_bits(n, x) for x in shares], np.int16 if n < 32_768 else np.int64) for n in (first, code_bits(dim)))


def units(vectors: np.ndarray) -> np.ndarray:
    out = vectors.astype(np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)  # first, so that no square over- or underflows
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def codes(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """(vectors, words + 1): the packed signs of the residuals under all rotations, then the residual's length."""
    left = unit - centre
    signs = np.packbits(left.astype(np.float32) @ rotations(unit.shape[1]) > 0, axis=1)
    out = np.zeros((len(unit), 8 * words(unit.shape[1]) + 8), np.uint8)
    out[:, : signs.shape[1]] = signs
    out[:, -8:] = np.linalg.norm(left, axis=1)[:, None].view(np.uint8)
    return out.view(np.uint64)


def keys(unit: np.ndarray, bits: int, threshold: float) -> np.ndarray:
    """(vectors, tables)."""
    tables = table_count(bits, threshold)
    if not bits:
        return np.zeros((len(unit), 1), np.int64)
    steps = np.random.default_rng([SEED, tables, bits]).random(tables * bits)
    place = np.floor(unit @ hyperplanes(unit.shape[1], tables, bits) / (STEP * math.sqrt(2 - 2 * threshold)) + steps).astype(np.int64)
    odd = np.random.default_rng([SEED, bits]).integers(1, 1 << 62, bits, np.int64) * 2 + 1
    return (place.reshape(len(unit), tables, bits) * odd).sum(axis=2)  # wraps around; equal steps give equal keys


def near_codes(x: np.ndarray, y: np.ndarray, limits: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
    """Which codes may belong to a pair at the threshold. Pairs that differ too much within the first words aren't looked at further."""
    apart, few, most = limits
    a, b = (np.maximum(np.ascontiguousarray(c[:, -1]).view(np.float64), 1e-12) for c in (x, y))
    cosine = ((a * a - apart)[:, None] + b * b) / (2 * a[:, None] * b)
    place = np.ceil((1 - np.clip(cosine, -1, 1)) * (_GRID / 2)).astype(np.int64)
    n = x.shape[1] - 1
    first = min(n, FIRST_BITS // 64)
    far = np.zeros(place.shape, np.int16)
    for k in range(first):
        far += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
    near = far <= (few if first < n else most)[place]
    if first < n:
        i, j = np.nonzero(near)
        for s in range(0, len(i), 65536):
            p, q = i[s : s + 65536], j[s : s + 65536]
            near[p, q] = np.bitwise_count(x[p, :n] ^ y[q, :n]).sum(axis=1, dtype=np.int64) <= most[place[p, q]]
    return near


def link_codes(ids: np.ndarray, code: np.ndarray, limits: tuple, forest: Forest, across: int = 0) -> None:
    """Link candidates by their codes: all pairs, or only those between the first ``across`` and the others.

    Components are found by spreading the smallest place through each chunk's matrix, so that a dense bucket costs no step a pair.
    """
    n = len(ids)
    root = np.arange(n)
    for a in range(0, across or n, _CODE_CHUNK):
        b = min(a + _CODE_CHUNK, across or n)
        low = across or a
        near = near_codes(code[a:b], code[low:], limits)
        if not across:
            near &= np.arange(low, n)[None, :] > np.arange(a, b)[:, None]
        rows = np.flatnonzero(near.any(axis=1))
        if not len(rows):
            continue
        cols = np.flatnonzero(near.any(axis=0))
        met = near[np.ix_(rows, cols)]
        rows, cols = rows + a, cols + low
        while True:
            r, c = root[rows], root[cols]
            least = np.minimum(r, np.where(met, c[None, :], n).min(axis=1))
            through = np.minimum(c, np.where(met, least[:, None], n).min(axis=0))
            if (least == r).all() and (through == c).all():
                break
            np.minimum.at(root, r, least)
            np.minimum.at(root, c, through)
            while (root[root] != root).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(n))
    for x, y in zip(ids[moved].tolist(), ids[root[moved]].tolist(), strict=True):
        forest.link(x, y)


class Compared:
    """Links of some vectors, by estimates with bounds and exact recomputation: partial counts, and a spanning set of links."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, threshold: float):
        self.ids, self.copies, self.s, dim = ids, copies, threshold, vectors.shape[1]
        self.unit = units(vectors)
        self.rotated = self.unit.astype(np.float32) @ rotation(dim)
        self.signs = np.where(self.rotated > 0, np.float32(1), np.float32(-1))
        f = np.abs(self.rotated).sum(axis=1).astype(np.float64) / math.sqrt(dim)
        spread = np.sqrt(np.maximum(0, 1 - f * f)) / f * min(1.0, Z / math.sqrt(max(1, dim - 1)))
        self.least = ((threshold - math.sqrt(max(0.0, 1 - threshold * threshold)) * spread) * f * math.sqrt(dim) - 1e-3).astype(np.float32)
        self.counts = np.zeros(len(ids), np.int64)
        self.root = np.arange(len(ids))
        self.recomputed = 0

    def run(self, across: int = 0) -> Compared:
        """Compare all pairs, or only those between the first ``across`` rows and the others."""
        n = len(self.ids)
        for a in range(0, across or n, _CHUNK):
            b = min(a + _CHUNK, across or n)
            low = across or a
            # estimate of each code against each query, without its scale
            near = self.rotated[a:b] @ self.signs[low:].T >= self.least[low:]
            if not across:
                near &= np.arange(low, n)[None, :] > np.arange(a, b)[:, None]
            self.recomputed += int(near.sum())
            if near.mean() > 0.02:
                near &= self.unit[a:b] @ self.unit[low:].T >= self.s
            else:
                i, j = np.nonzero(near)
                for c in range(0, len(i), 65536):
                    p, q = i[c : c + 65536], j[c : c + 65536]
                    near[p, q] = np.einsum("ij,ij->i", self.unit[a + p], self.unit[low + q]) >= self.s
            for r in np.flatnonzero(near.any(axis=1)):
                here = np.unique(self.root[np.r_[a + r, low + np.flatnonzero(near[r])]])
                if len(here) > 1:
                    self.root[np.isin(self.root, here)] = here[0]
            self.counts[a:b] += near @ self.copies[low:]
            self.counts[low:] += self.copies[a:b] @ near
        return self

    def found(self):
        """(node, other, linked): partial counts, and a link of each node to its root."""
        some = (self.root != np.arange(len(self.ids))) | (self.counts > 0)
        return self.ids[some], self.ids[self.root[some]], self.counts[some]


def _code_rows(kind: str, threshold: float):
    """Over batches of (grp, dim, bits, low, v, centre): a row (grp, dim, bits, tab, key, low, code) for each table."""

    def run(batches):
        for batch in batches:
            grp, dims, bits, ids, vectors = batch.column(0), np.asarray(batch.column(1)), np.asarray(batch.column(2)), np.asarray(batch.column(3)), batch.column(4)
            for dim, k in sorted(set(zip(dims.tolist(), bits.tolist(), strict=True))):
                at = np.flatnonzero((dims == dim) & (bits == k))
                flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), dim)
                unit = units(flat)
                code = codes(unit, batch.column(5).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim))
                size, raw, found = code.shape[1] * 8, code.tobytes(), keys(unit, k, threshold)
                packed = pa.array([raw[i * size : (i + 1) * size] for i in range(len(at))], pa.binary())
                same = lambda x: pa.array(np.full(len(at), x, np.int32))  # noqa: B023, E731
                for t in range(found.shape[1]):
                    yield pa.RecordBatch.from_arrays([grp.take(pa.array(at)), same(dim), same(k), same(t), pa.array(found[:, t]), pa.array(ids[at]), packed], names=["grp", "dim", "bits", "tab", "key", "low", "code"])

    return run


_OUT = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("grp", pa.string()), ("dim", pa.int32()), ("bits", pa.int32()), ("tab", pa.int32()), ("key", pa.int64()), ("block", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary())])
_DDL = "u bigint, v bigint, grp string, dim int, bits int, tab int, key bigint, block int, ids binary, codes binary"
_BUCKET = ["grp", "dim", "bits", "tab", "key"]
#: Nodes of links that a task gathers before it gives them out.
_FOREST_NODES = 500_000


def _links(forest: Forest, schema: pa.Schema):
    pairs = list(forest.edges())
    if pairs:
        u, v = (pa.array(x, pa.int64()) for x in zip(*pairs, strict=True))
        yield pa.RecordBatch.from_arrays([u, v, *(pa.nulls(len(pairs), t) for t in schema.types[2:])], schema=schema)


def _compare_buckets(threshold: float, bucket_rows: int):
    """Over batches sorted by bucket: candidate links, and the blocks of buckets too large for one task."""

    def run(batches):
        forest, bucket, ids, code, count, number = Forest(), None, [], [], 0, 0

        def block():
            values = (*bucket, number, np.concatenate(ids).tobytes(), np.concatenate(code).tobytes())
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([x], t) for x, t in zip(values, _OUT.types[2:], strict=True))], schema=_OUT)

        def close():
            if number and count:
                yield block()
            elif count > 1:
                link_codes(np.concatenate(ids), np.concatenate(code), bit_limits(bucket[1], threshold), forest)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            grp, low, packed = batch.column(0), np.asarray(batch.column(5)), batch.column(6).cast(pa.binary())
            numbers = [np.asarray(batch.column(i)) for i in range(1, 5)]
            change = np.ones(n, bool)
            change[1:] = pc.not_equal(grp.slice(1), grp.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            for x in numbers:
                change[1:] |= x[1:] != x[:-1]
            place = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + n + 1]
            starts = np.flatnonzero(change)
            ends = np.r_[starts[1:], n]
            # buckets of one row that lie inside the batch hold no pair
            look = (ends - starts > 1) | (starts == 0) | (ends == n)
            for a, b in zip(starts[look].tolist(), ends[look].tolist(), strict=True):
                at = [grp[a].as_py(), *(int(x[a]) for x in numbers)]
                if at != bucket:
                    yield from close()
                    bucket, ids, code, count, number = at, [], [], 0, 0
                    if len(forest.parent) > _FOREST_NODES:
                        yield from _links(forest, _OUT)
                        forest = Forest()
                while a < b:
                    if count == bucket_rows:
                        yield block()
                        ids, code, count, number = [], [], 0, number + 1
                    take = min(b - a, bucket_rows - count)
                    ids.append(low[a : a + take].copy())
                    code.append(np.frombuffer(packed.buffers()[2], np.uint8)[place[a] : place[a + take]].copy().view(np.uint64).reshape(take, -1))
                    count, a = count + take, a + take
        yield from close()
        yield from _links(forest, _OUT)

    return run


_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _compare_code_blocks(threshold: float):
    """Over batches of (dim, same, ids1, codes1, ids2, codes2)."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                dim, same, x, a, y, b = (batch.column(i)[k].as_py() for i in range(6))
                forest, ids, code = Forest(), np.frombuffer(x, np.int64), np.frombuffer(a, np.uint64)
                if not same:
                    ids, code = np.r_[ids, np.frombuffer(y, np.int64)], np.r_[code, np.frombuffer(b, np.uint64)]
                link_codes(ids, code.reshape(len(ids), -1), bit_limits(dim, threshold), forest, 0 if same else len(x) // 8)
                yield from _links(forest, _PAIR)

    return run


def _compare_vector_blocks(kind: str, threshold: float):
    """Over batches of (dim, same, members1, members2), members as arrays of (low, copies, v)."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                dim, same = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                parts = [batch.column(i)[k].values for i in ((2,) if same else (2, 3))]
                ids, copies = (np.concatenate([np.asarray(p.field(f)) for p in parts]) for f in (0, 1))
                vectors = np.concatenate([p.field(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim) for p in parts])
                found = Compared(ids, copies, vectors, threshold).run(0 if same else len(parts[0])).found()
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=["node", "other", "linked"])

    return run


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(grp, v, low, copies, dim) of the vectors that can link."""
    v = F.col(vector_col)
    fine = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & v.isNotNull()
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.where(fine).select(F.col(label_col).cast("string").alias("grp"), v.alias("v"), F.col(id_col).cast("bigint").alias("id"))
    return rows.groupBy("grp", "v").agg(F.min("id").alias("low"), F.count("*").alias("copies")).withColumn("dim", F.size("v"))


def candidate_links(groups: DataFrame, total: int, kind: str, threshold: float, direct_rows: int, bucket_rows: int) -> DataFrame:
    """(u, v): links that connect the ``total`` distinct vectors (grp, v, low, dim) whose codes let them be near."""
    some = F.array(*[F.min_by("v", F.xxhash64(F.lit(i), "low")) for i in range(CENTRE_OF)])
    sizes = groups.groupBy("grp", "dim").agg(F.count("*").alias("rows"), some.alias("some"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / direct_rows))).cast("int")
    # a centre serves the speed only: any point would do, so values out of range count as 0
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scaled = F.transform("some", lambda v: bound(length(v), lambda n: F.transform(v, lambda x: F.nanvl(F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)), F.lit(0.0)))))
    mean = bound(scaled, lambda vs: F.transform(F.sequence(F.lit(0), F.col("dim") - 1), lambda i: F.aggregate(vs, F.lit(0.0), lambda a, v: a + F.get(v, i)) / CENTRE_OF))
    sizes = sizes.select("grp", "dim", "rows", bits.alias("bits"), mean.alias("centre"))
    sized = join_hot(groups, sizes, ["grp", "dim"], "rows", total).select("grp", "dim", "bits", "low", "v", "centre")
    keyed = sized.mapInArrow(_code_rows(kind, threshold), "grp string, dim int, bits int, tab int, key bigint, low bigint, code binary")
    found = checkpointed(keyed.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET).mapInArrow(_compare_buckets(threshold, bucket_rows), _DDL))
    blocks = found.where("ids is not null").select(*_BUCKET, "block", "ids", "codes")
    pairs = block_pairs(blocks, _BUCKET, ["dim", "ids", "codes"]).select(F.col("dim1"), "same", "ids1", "codes1", "ids2", "codes2")
    return found.where("u is not null").select("u", "v").unionByName(pairs.mapInArrow(_compare_code_blocks(threshold), "u bigint, v bigint"))


def near_duplicate_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
    direct_rows: int = DIRECT_ROWS, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per row: id, ``n_links``, ``component_id`` (smallest id reachable, itself included), ``kept``."""
    kind = "<f4" if isinstance(df.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    groups = checkpointed(distinct_vectors(df.select(id_col, vector_col, label_col), id_col, vector_col, label_col))
    distinct, total = groups.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    clusters = checkpointed(connected_components(candidate_links(groups, distinct, kind, threshold, direct_rows, bucket_rows)))
    place = ["root", "grp", "dim"]
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n")).withColumn("rows", F.col("n"))
    sized = join_hot(clusters.withColumnRenamed("node", "low"), sizes, ["root"], "rows", clusters.count())
    block = F.pmod(F.xxhash64("low"), F.ceil(F.col("n") / block_rows)).cast("int")
    blocks = groups.join(sized, "low").withColumn("block", block).groupBy(*place, "block").agg(F.collect_list(F.struct("low", "copies", "v")).alias("members"))
    pairs = block_pairs(checkpointed(blocks), place, ["dim", "members"]).select("dim1", "same", "members1", "members2")
    links = checkpointed(pairs.mapInArrow(_compare_vector_blocks(kind, threshold), "node bigint, other bigint, linked bigint"))
    roots = connected_components(links.select(F.col("node").alias("u"), F.col("other").alias("v")))
    counted = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    digest = lambda c: (F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(SEED), c).alias("h2"))
    named = (
        groups.select("grp", *digest(F.col("v")), "low", "copies")
        .join(counted.withColumnRenamed("node", "low"), "low", "left")
        .join(roots.withColumnRenamed("node", "low"), "low", "left")
        .select("grp", "h1", "h2", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "low").alias("root"))
    )
    # vectors are told apart by 128 bits of hashes, so that they needn't travel again
    rows = df.select(F.col(id_col), F.col(label_col).cast("string").alias("grp"), *digest(F.col(vector_col)))
    joined = join_hot(rows, named, ["grp", "h1", "h2"], "copies", total, "left")
    component = F.when(F.col(id_col).isNotNull(), F.coalesce("root", id_col))
    links_of = F.when(F.col(id_col).isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0)
    return joined.select(id_col, links_of.cast("bigint").alias("n_links"), component.alias("component_id"), (component == F.col(id_col)).alias("kept"))
