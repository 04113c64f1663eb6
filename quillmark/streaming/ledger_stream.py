"""Ledgers checked as their rows arrive: the state of an account is its last balance, its last date and the direction of its dates.

Gives the rows of ``operators.ledger.replay_ledger``. Rows of an account have to arrive in order from micro-batch to micro-batch; inside one they may lie in any
order. A row numbered at or below the last one seen is a repeated delivery and is left out, so a batch that is sent twice changes nothing.

A group of accounts is one key of the state, and the rows of a group reach it packed: a call of the state store and a row that is read by itself cost more than following
the row. A group's state is read and written whole in each micro-batch that has rows of it. Checkpoints from before the groups can't be gone on with.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quillmark.operators.ledger import TOLERANCE

#: State stores that ``transformWithState`` needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Accounts are dealt into so many groups by their keys, and a group is one key of the state: calls of the store grow with the groups, not with the accounts. A checkpoint
#: goes on only with the number that it began with.
GROUPS = 4096
#: A task hands on the rows of a group together, from so many of its rows at a time.
PACKED_ROWS = 262144
ROW = ("row_no", "date", "debit", "credit", "balance", "comparable")
STATE = "seen array<bigint>, row_no array<bigint>, balance array<decimal(38,18)>, date array<date>, direction array<int>"
CHECKED = "row_no bigint, checked boolean, mismatch boolean, inversion boolean, skipped boolean"


class AccountState:
    """What is known of an account after some of its rows."""

    def __init__(self, row_no=None, balance=None, date=None, direction=None):
        self.row_no, self.balance, self.date, self.direction = row_no, balance, date, direction

    def follow(self, row) -> dict | None:
        """The checks of the next row, which becomes part of the state; None for one that was seen."""
        if self.row_no is not None and row["row_no"] <= self.row_no:
            return None
        self.row_no = row["row_no"]
        turn = None
        if row["date"] is not None:
            if self.date is not None and row["date"] != self.date:
                turn = 1 if row["date"] > self.date else -1
            self.date = row["date"]
        self.direction = turn if self.direction is None else self.direction
        out = {"row_no": self.row_no, "checked": False, "mismatch": False, "inversion": turn is not None and turn != self.direction, "skipped": False}
        if row["balance"] is not None:
            moved = (row["credit"] or Decimal(0)) - (row["debit"] or Decimal(0))
            out["skipped"] = not row["comparable"]
            out["checked"] = bool(row["comparable"] and self.balance is not None and (row["debit"] is not None or row["credit"] is not None))
            out["mismatch"] = out["checked"] and abs(self.balance + moved - row["balance"]) > TOLERANCE
            self.balance = row["balance"]
        return out


class LedgerProcessor(StatefulProcessor):
    """Keyed state: reads the accounts of a group once a micro-batch, follows their rows, and stores them."""

    def __init__(self, keys: tuple[str, ...], names: list[str], layout: str, idle_ms: int | None):
        self.keys, self.names, self.layout, self.idle_ms = keys, names, layout, idle_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("accounts", self.layout, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  the names are Spark's
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else None
        known, out = {}, []
        for *account, seen, row_no, balance, date, direction in zip(*(self.state.get() or ()), strict=True):
            if now is None or seen + self.idle_ms > now:
                known[_comparable(account)] = [account, seen, AccountState(row_no, balance, date, direction)]
        for row in sorted((r for pack in rows for r in pack["rows"]), key=lambda r: r["row_no"]):
            account = [row[k] for k in self.keys]
            held = known.setdefault(_comparable(account), [account, now, AccountState()])
            held[1] = now
            if (found := held[2].follow(row)) is not None:
                out.append((*account, *found.values()))
        self.state.update(_columns((*a, seen, s.row_no, s.balance, s.date, s.direction) for a, seen, s in known.values()))
        if out:
            yield Row(**dict(zip(self.names, _columns(out), strict=True)))

    def close(self) -> None:
        pass


def _columns(rows) -> tuple[list, ...]:
    return tuple(map(list, zip(*rows, strict=True)))


def _comparable(value):
    """A key that equals another where Spark groups them together: NaN equals NaN."""
    if isinstance(value, list | tuple | dict):
        return tuple(map(_comparable, value.values() if isinstance(value, dict) else value))
    return value if value == value else "NaN"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a group, with a list of its rows, for every ``PACKED_ROWS`` rows."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= PACKED_ROWS:
            yield _pack(held)
            held, n = [], 0
    if n:
        yield _pack(held)


def _pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).sort_by("_group").combine_chunks().to_batches()[0]
    groups = rows.column(0).to_numpy()
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    each = pa.StructArray.from_arrays(rows.columns[1:], fields=list(rows.schema)[1:])
    return pa.RecordBatch.from_arrays([pa.array(groups[starts]), pa.ListArray.from_arrays(pa.array(np.append(starts, len(groups)), pa.int32()), each)], ["_group", "rows"])


def replayed_stream(rows: DataFrame, *keys: str, idle_ms: int | None = None) -> DataFrame:
    """keys, row_no, checked, mismatch, inversion, skipped of a stream of ledger rows (keys, row_no, date, debit, credit, balance, comparable).

    ``idle_ms``: an account without rows for so long loses its state and begins anew; by default it is kept.
    """
    group = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("bigint").alias("_group")
    found = rows.select(group, *keys, *ROW)
    each = T.StructType(found.schema.fields[1:])
    packed = found.mapInArrow(_packed, T.StructType([found.schema["_group"], T.StructField("rows", T.ArrayType(each))]))
    layout = ", ".join(f"k{i} array<{f.dataType.simpleString()}>" for i, f in enumerate(each.fields[: len(keys)]))
    checks = T.StructType([*each.fields[: len(keys)], *T._parse_datatype_string(CHECKED).fields])
    lists = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in checks.fields])
    processor = LedgerProcessor(keys, lists.names, f"{layout}, {STATE}", idle_ms)
    out = packed.groupBy("_group").transformWithState(processor, lists, "Append", "ProcessingTime" if idle_ms else "None")
    return out.select(F.inline(F.arrays_zip(*lists.names)))


def start_replay(spark: SparkSession, rows: DataFrame, path: str, checkpoint: str, *keys: str, idle_ms: int | None = None) -> StreamingQuery:
    """Write the checks of what has arrived to ``path``, exactly once over restarts on one ``checkpoint``."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    out = replayed_stream(rows, *keys, idle_ms=idle_ms).writeStream.format("parquet").outputMode("append")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
