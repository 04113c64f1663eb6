"""Near copies by an exact check of shingle sets, with candidates from covering SimHash tables and min-wise fingerprints.

Shingles: runs of five words (as in ``simhash``), hashed to XXH64 (seed 42); a text of fewer words is one shingle. Two texts are
near copies if their shingle sets have a Jaccard similarity of at least ``SIMILARITY``. Wordless and null texts have the empty
set and link with each other.

Candidates come from two searches. The covering tables of ``simhash`` find every pair of sets whose SimHash differs in at most
``simhash.RADIUS`` bits, without exception. Pairs at 0.8 mostly differ in more, so each set also gets ``TABLES`` fingerprints of ``MINIMA`` minima each: a pair of
similarity s shares one of them with a chance of 1 - (1 - s**6)**32, so that one at 0.8 is missed with a chance of 6e-5, one at 0.9 with less than
1e-10. Copies of a set cost nothing. All sets of one fingerprint are linked to the least of them; the components of these links are
clusters. Texts that share a passage can form a large cluster without a pair at 0.8, so the pairs of a cluster not yet connected are first estimated from sketches, a byte
of each of the 192 minima: one at the similarity is passed over with a chance of 1e-9, one at half hardly ever isn't. What is left is compared exactly, in blocks of ``block_rows`` sets and ``block_bytes`` bytes on average at most, whose pairs are spread over tasks. Texts are
hashed anew only for members of clusters. Keys, clusters and sets that hold many rows are joined by broadcast.

Texts of any length are read whole. Repeated rows stay; rows of one id with several texts each get the component of their text. A null id keeps its row and
names no component unless no other id is there. The id may be a struct: the least comes first by its fields. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import block_pairs, checkpointed, join_hot, map_texts
from .components import Forest, connected_components
from .simhash import bit_counts

WIDTH = 5
SIMILARITY = 0.8
TABLES = 32
MINIMA = 6
#: Chance that the sketches rule out a pair at the similarity.
SKETCH_MISS = 1e-9
BLOCK_ROWS = 1024
#: Bytes of hashes that a block holds on average at most; a single longer set is held whole.
BLOCK_BYTES = 8_000_000
#: Members of clusters up to which their ids are broadcast.
BROADCAST_MEMBERS = 1_000_000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, h64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h64(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist()
    return np.unique(np.fromiter((h64(joined[i:j], 42) for i, j in zip(starts, stops, strict=True)), np.uint64, len(starts)))


def set_name(hashes: np.ndarray) -> int:
    """The set's digest; zero for the empty set."""
    return xxhash.xxh64_intdigest(hashes.tobytes()) if len(hashes) else 0


_RANDOM = np.random.default_rng(5)
_XOR, _ODD = _RANDOM.integers(0, 1 << 64, (2, TABLES * MINIMA, 1), np.uint64)
_ODD |= np.uint64(1)


def minima_of(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of the permutations."""
    low = np.full(TABLES * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 1024):
        np.minimum(low, ((hashes[None, a : a + 1024] ^ _XOR) * _ODD).min(axis=1), out=low)
    return low


def keys_of(low: np.ndarray) -> np.ndarray:
    """One fingerprint a table, from a set's minima."""
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(TABLES, MINIMA))], np.uint64).view(np.int64)


def sketch_of(low: np.ndarray) -> bytes:
    """A byte of each minimum."""
    return ((low >> np.uint64(24)) & np.uint64(255)).astype(np.uint8).tobytes()


@functools.lru_cache(maxsize=8)
def least_matches(similarity: float, chance: float = SKETCH_MISS) -> int:
    """Equal bytes that the sketches of two sets of this similarity have but for this chance: a byte is equal by the similarity, or by accident."""
    n, p = TABLES * MINIMA, similarity + (1 - similarity) / 256
    total = 0.0
    for k in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) if p < 1 else float(k == n)
        if total > chance:
            return k
    return n


def simhash_of(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles."""
    votes = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 100_000):
        votes += bit_counts(hashes[a : a + 100_000])
    return int(np.packbits((votes * 2 > len(hashes))[::-1]).view(">u8")[0])


def _named():
    def apply(texts):
        sets = [shingles(t) for t in texts]
        lows = [minima_of(s) for s in sets]
        signed = lambda values: np.array(values, np.uint64).view(np.int64)
        return {"fp": signed([set_name(s) for s in sets]), "print": signed([simhash_of(s) for s in sets]), "shingles": [len(s) for s in sets], "keys": [keys_of(m) if len(s) else np.empty(0, np.int64) for s, m in zip(sets, lows, strict=True)], "sketch": [sketch_of(m) for m in lows]}

    return apply


def _packed():
    def apply(texts):
        sets = [shingles(t) for t in texts]
        return {"name": np.array([set_name(s) for s in sets], np.uint64).view(np.int64), "hashes": [s.tobytes() for s in sets]}

    return apply


#: One in so many sets is looked at for keys that hold many rows, and what counts as many; it decides how rows travel, not what is found.
LOOK = 64
MANY = 20_000


def bucket_stars(batches):
    """Over batches of (key, fp) sorted by both: a link from every other fp of a key to the least."""
    key = low = None
    for batch in batches:
        keys, fps = (np.asarray(batch.column(i)) for i in range(2))
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        least = np.repeat(fps[starts], np.diff(np.r_[starts, len(keys)]))
        if key == keys[0]:
            least[: starts[1] if len(starts) > 1 else len(keys)] = low
        key, low = keys[-1], least[-1]
        link = fps != least
        yield pa.RecordBatch.from_arrays([pa.array(fps[link]), pa.array(least[link])], names=["u", "v"])


def stars(named: DataFrame, n_sets: int, many: int = MANY) -> DataFrame:
    """(u, v): every set (fp, keys) linked to the least of each fingerprint that it shares.

    Rows are moved once, sorted by fingerprint. Fingerprints that a look at some sets shows to be very frequent are reduced to their least with map-side
    combining and joined by broadcast instead; about 1,000 * TABLES of them can be at most, as each holds a thousandth of the sets.
    """
    keyed = named.select(F.explode("keys").alias("key"), "fp")
    some = named.where(F.pmod(F.xxhash64("fp"), F.lit(LOOK)) == 0).select(F.explode("keys").alias("key"))
    hot = [r["key"] for r in some.groupBy("key").count().where(F.col("count") * LOOK > max(many, n_sets // 1000)).collect()] if n_sets > many else []
    found = keyed
    if hot:
        frequent = F.broadcast(named.sparkSession.createDataFrame([(k,) for k in hot], "key bigint"))
        found = keyed.join(frequent, "key", "left_anti")
        theirs = keyed.join(frequent, "key")
        least = theirs.groupBy("key").agg(F.min("fp").alias("v"))
        linked = theirs.join(F.broadcast(least), "key").where("fp <> v").select(F.col("fp").alias("u"), "v")
    out = found.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(bucket_stars, "u bigint, v bigint")
    return out.unionByName(linked) if hot else out


def link_sets(names: list[int], sets: list[np.ndarray], sketches: np.ndarray, similarity: float, forest: Forest, across: int = 0) -> int:
    """Link all sets within the similarity, or those of the first ``across`` with the others; each is compared with those that aren't yet
    connected with it and whose sketches (a row each) don't rule them out. How many pairs were compared exactly."""
    compared, least = 0, least_matches(similarity)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    side = (order < across).astype(int)
    sets, sizes, names, sketches = [sets[i] for i in order], sizes[order], [names[i] for i in order], sketches[order]
    rest = np.arange(len(sets))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            i = front.pop()
            # sizes too far apart can't be similar
            a, b = np.searchsorted(sizes[rest], (sizes[i] * similarity - 1e-6, sizes[i] / similarity + 1e-6), "left")
            some = rest[a:b]
            if across:
                some = some[side[some] != side[i]]
            some = some[(sketches[some] == sketches[i]).sum(axis=1) >= least]
            if not len(some):
                continue
            compared += len(some)
            ends = np.cumsum(sizes[some])
            both = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], both), max(len(sets[i]) - 1, 0))
            hit = np.r_[0, np.cumsum(sets[i][at] == both)] if len(both) else np.zeros(1, np.int64)
            shared = hit[ends] - hit[np.r_[0, ends[:-1]]]
            near = shared >= similarity * (sizes[i] + sizes[some] - shared) - 1e-9
            for j in some[near].tolist():
                forest.link(names[j], names[i])
                front.append(j)
            rest = np.setdiff1d(rest, some[near], assume_unique=True)
    return compared


def compare_blocks(similarity: float):
    """Over batches of (same, members, others), arrays of (fp, hashes, sketch): links that connect what is similar inside a block, or across two."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                forest, same = Forest(), batch.column(0)[k].as_py()
                parts = [batch.column(i)[k].as_py() for i in ((1,) if same else (1, 2))]
                names, sets = [m["fp"] for p in parts for m in p], [np.frombuffer(m["hashes"], np.uint64) for p in parts for m in p]
                sketches = np.frombuffer(b"".join(m["sketch"] for p in parts for m in p), np.uint8).reshape(len(names), -1)
                link_sets(names, sets, sketches, similarity, forest, 0 if same else len(parts[0]))
                u, v = zip(*forest.edges(), strict=True) if forest.parent and any(True for _ in forest.edges()) else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def candidate_links(named: DataFrame, n_sets: int) -> DataFrame:
    """(u, v): links between the sets (fp, print, keys) that share a fingerprint or whose SimHashes are near. SimHashes are nodes, too."""
    prints = checkpointed(named.groupBy("print").agg(F.count("*").alias("n")))
    near = checkpointed(simhash.near_links(prints.select(F.col("print").alias("fp"))))
    ends = near.select(F.col("u").alias("print")).unionByName(near.select(F.col("v").alias("print"))).distinct()
    met = prints.where("n > 1").unionByName(prints.join(ends, "print")).distinct()
    of_print = join_hot(named.select("fp", "print"), met, ["print"], "n", n_sets)
    return stars(named, n_sets).unionByName(near).unionByName(of_print.select(F.col("fp").alias("u"), F.col("print").alias("v"))).distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, ``fp`` (the shingle set's digest), ``component_id`` (smallest id reachable)."""
    prints = checkpointed(map_texts(df, id_col, text_col, "fp bigint, print bigint, shingles int, keys array<bigint>, sketch binary", _named))
    named = checkpointed(prints.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("copies"), F.first("print").alias("print"), F.first("shingles").alias("shingles"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    n_sets, n_rows = named.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    clusters = connected_components(candidate_links(named, n_sets))
    found = checkpointed(clusters.withColumnRenamed("node", "fp").join(named.select("fp", "low", "shingles", "sketch"), "fp"))
    parts = F.ceil(F.greatest(F.count("*") / block_rows, F.sum(F.col("shingles").cast("bigint") * 8) / block_bytes))
    sizes = found.groupBy("root").agg(parts.alias("n"), F.count("*").alias("rows")).where("rows > 1")
    n_found = found.count()
    block = F.pmod(F.xxhash64("fp"), F.greatest(F.lit(1).cast("bigint"), F.col("n"))).cast("int")
    members = checkpointed(join_hot(found, sizes, ["root"], "rows", n_found).select("fp", "low", "root", "sketch", block.alias("block")))
    few = n_found <= BROADCAST_MEMBERS
    wanted = members.select(F.col("low").alias(id_col)).distinct()
    texts = df.select(id_col, text_col).join(F.broadcast(wanted) if few else wanted, id_col, "left_semi")
    sets = map_texts(texts, id_col, text_col, "name bigint, hashes binary", _packed).withColumnRenamed(id_col, "low2")
    held = sets.join(F.broadcast(members) if few else members, F.col("low2").eqNullSafe(F.col("low")) & (F.col("name") == F.col("fp")))
    blocks = held.dropDuplicates(["fp"]).groupBy("root", "block").agg(F.collect_list(F.struct("fp", "hashes", "sketch")).alias("members"))
    pairs = block_pairs(checkpointed(blocks), ["root"], ["members"]).select("same", "members1", "members2")
    links = pairs.mapInArrow(compare_blocks(similarity), "u bigint, v bigint")
    roots = connected_components(links).withColumnRenamed("node", "fp").withColumnRenamed("root", "root_fp")
    joined = checkpointed(named.select("fp", "low", "copies").join(roots, "fp", "left").withColumn("root_fp", F.coalesce("root_fp", "fp")))
    lowest = joined.groupBy("root_fp").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    component = join_hot(joined, lowest, ["root_fp"], "n", n_sets).select("fp", "copies", "component_id")
    return join_hot(prints.select(id_col, "fp"), component, ["fp"], "copies", n_rows).select(id_col, "fp", "component_id")
