"""Repair of conversations against alignments with every possible target, over batches of any length, and with odd rows."""

import hashlib
import random
from functools import lru_cache

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import turn_repair as tr

TURNS = "conv_id bigint, turn bigint, role string, text string, cost bigint, conv string"
ROLES = ["user", "assistant", "system", "tool", "", " "]


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Least (cost, audit) over all targets, by recursion from the end."""
    faults = plain_faults(rows)
    best = None
    for target in ["", *(s + "ua" * k for k in range(1, len(rows) + 2) for s in ("", "s"))]:

        @lru_cache(None)
        def rest(i, j, target=target):
            ways = []
            if i < len(rows):
                ways.append((4, "D", i + 1, j))
            if j < len(target):
                if target[j] != "s":
                    ways.append((3, "I", i, j + 1))
                if i < len(rows) and faults[i] not in ("blank", "duplicate"):
                    cut = 3 * (faults[i] == "truncated")
                    if rows[i][0][:1] == target[j]:
                        ways.append((cut, "K", i + 1, j + 1))
                    elif target[j] != "s":
                        ways.append((3 + cut, "R", i + 1, j + 1))
            if not ways:
                return (0, "") if (i, j) == (len(rows), len(target)) else (10**9, "")
            return min((c + x[0], letter + x[1]) for c, letter, a, b in ways for x in [rest(a, b)])

        found = (*rest(0, 0), target)
        best = found if best is None or found[:2] < best[:2] else best
    cost, audit, target = best
    lines, follow, roles = [], iter(rows), iter(target)
    for letter in audit:
        row = ("", "") if letter == "I" else next(follow)
        if letter != "D":
            role = {"u": "user", "a": "assistant", "s": "system"}[next(roles)]
            lines.append(f"{row[0] if letter == 'K' else role}:{row[1]}")
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversation(r, n):
    texts = ["One.", "Two!", "three", " \n", "", "Four? ", "five.x", "six"]
    return [(r.choice(ROLES if r.random() < 0.4 else ROLES[:2]), r.choice(texts) if r.random() < 0.5 else f"{r.random()}.") for _ in range(n)]


def in_batches(convs, size):
    """Results of the task's kernel over batches of so many rows."""
    rows = [(c, k, role, text, False, ("", *tr.FAULTS).index(f)) for c, turns in convs for (k, (role, text)), f in zip(enumerate(turns), plain_faults(turns), strict=True)]
    schema = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("absent", pa.bool_()), ("fault", pa.int32())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows[i : i + size]], schema) for i in range(0, len(rows), size)]
    return {x["conv"]: x for b in tr._repair_task(iter(batches)) for x in b.to_pylist()}


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_kernel_gives_the_cheapest_edits(size):
    r = random.Random(size)
    convs = [(k, conversation(r, r.randint(1, 7))) for k in range(40)]
    got = in_batches(convs, size)
    for k, turns in convs:
        assert (got[k]["cost"], got[k]["audit"], got[k]["repaired_sha256"]) == plain_repair(turns), turns
        assert len(got[k]["roles"]) == len(got[k]["audit"])


def test_long_conversation_in_pieces():
    r = random.Random(9)
    turns = conversation(r, 3000)
    whole, pieces = in_batches([(1, turns)], 5000)[1], in_batches([(1, turns)], 700)[1]
    assert whole == pieces and whole["gaps"] == 0


def test_operator(spark):
    rows = [
        (1, 5, "assistant", "B."), (1, 2, "user", "A."), (1, 2, "user", "A."), (2, None, None, "x."), (3, 1, "user", None), (3, 9, "user", "cut"), (None, 1, "user", "Q?"), (None, 2, "assistant", "R." * 200_000),
        (4, None, "user", "late."), (4, None, "assistant", "first."), (5, 0, "user", "gone."),
    ]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], TURNS).withColumn("gone", F.col("conv_id") == 5).repartition(3)
    repaired = tr.repair(df, absent_col="gone")
    got = {r["conv_id"]: r for r in repaired.collect()}
    told = lambda k: tuple(got[k][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
    assert told(1) == (2, 0, 1, 0, 1, 4, "KDK")
    assert told(2) == (0, 0, 0, 0, 0, 4, "D")  # a role of one space: rerole and insert cost 6, deletion 4
    assert told(3) == (7, 1, 0, 1, 1, 8, "DD")
    assert told(4) == (0, 0, 0, 0, 0, 6, "IKKI") and told(None) == (0, 0, 0, 0, 0, 0, "KK")
    assert told(5) == (0, 0, 0, 0, 0, 0, "") and got[5]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    turns = tr.repaired_turns(df, repaired, absent_col="gone").collect()
    for k, r in got.items():
        lines = [f"{t['role']}:{t['text']}" for t in sorted(turns, key=lambda t: t["position"]) if t["conv_id"] == k]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == r["repaired_sha256"]
    assert tr.repair(df.limit(0), absent_col="gone").count() == 0 and tr.repaired_turns(df.limit(0), repaired.limit(0)).count() == 0


def test_damage(spark):
    import zlib

    df = spark.createDataFrame([(k, t, "assistant", "No. Yes! Why?") for k in range(40) for t in range(3)] + [(None, None, None, None)], "conv_id bigint, turn bigint, role string, text string")
    got = {}
    for r in tr.damaged(df).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["dropped"]))
    for (k, t), rows in got.items():
        name = f"{' ' if k is None else k}:{' ' if t is None else t}"
        harm, role, text = zlib.crc32(name.encode()) % 20, " " if k is None else "assistant", " " if k is None else "No. Yes! Why?"
        want = ("user" if harm == 4 else role, "" if harm == 1 else "".join(c for c in text if c not in ".!?") if harm == 2 else text, harm == 0)
        assert rows == [want] * (2 if harm == 3 else 1)
