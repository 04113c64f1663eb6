"""The stream of ledger rows gives what the batch gives, over restarts, repeated deliveries and idle accounts."""

import random
from datetime import date, timedelta
from decimal import Decimal

from quillmark.operators import ledger
from quillmark.streaming import inbox, ledger_stream

ROWS = "acct string, row_no bigint, date date, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), comparable boolean"


def made(accounts, n):
    r, out = random.Random(6), []
    for a in accounts:
        balance, day = Decimal(0), date(2024, 1, 1)
        for k in range(n):
            day += timedelta(days=r.choice([0, 1, 2, -1]))
            debit, credit = (Decimal(r.randint(0, 999)) / 100 if r.random() < 0.7 else None for _ in range(2))
            balance += (credit or 0) - (debit or 0) + (1 if r.random() < 0.1 else 0)
            out.append((a, k, day if r.random() < 0.8 else None, debit, credit, balance if r.random() < 0.8 else None, r.random() < 0.9))
    return out


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rows = made(["a", "b", None, "d"], 40)
    df = spark.createDataFrame(rows, ROWS)
    for part in range(5):
        some = df.where(f"row_no >= {part * 8} and row_no < {part * 8 + 8}")
        if part == 3:  # the part before is delivered again
            some = some.unionByName(df.where("row_no >= 16 and row_no < 24"))
        some.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = inbox.read_inbox(spark, str(tmp_path / "in"), df.schema)
        ledger_stream.start_replay(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"), "acct").awaitTermination(120)
    key = lambda r: (str(r[0]), *r[1:])
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=key)
    assert got == sorted(map(tuple, ledger.replay_ledger(df, "acct").collect()), key=key)


def test_state_follows_rows_one_by_one():
    state, row = ledger_stream.AccountState(), lambda **x: {"date": None, "debit": None, "credit": None, "balance": None, "comparable": True} | x
    assert state.follow(row(row_no=1, balance=Decimal(5)))["checked"] is False
    assert state.follow(row(row_no=2, credit=Decimal(1), balance=Decimal("6.02"))) == {"row_no": 2, "checked": True, "mismatch": False, "inversion": False, "skipped": False}
    assert state.follow(row(row_no=3, debit=Decimal(1), balance=Decimal("5.05")))["mismatch"] is True
    assert state.follow(row(row_no=3, balance=Decimal(9))) is None and state.balance == Decimal("5.05")
    assert state.follow(row(row_no=4, balance=Decimal(9), comparable=False))["skipped"] is True and state.balance == 9
    assert state.follow(row(row_no=5, balance=Decimal(9)))["checked"] is False  # nothing moved


def test_idle_accounts_begin_anew(spark, tmp_path):
    import time

    df = spark.createDataFrame([("a", 1, None, None, Decimal(1), Decimal(1), True), ("a", 2, None, None, Decimal(1), Decimal(9), True)], ROWS)
    for k in (1, 2):
        df.where(f"row_no = {k}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = inbox.read_inbox(spark, str(tmp_path / "in"), df.schema)
        ledger_stream.start_replay(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"), "acct", idle_ms=200).awaitTermination(120)
        time.sleep(0.5)
    assert all(not r["checked"] for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_state_keeps_groups_of_accounts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger_stream, "GROUPS", 4)
    monkeypatch.setattr(ledger_stream, "PACKED_ROWS", 100)
    df = spark.createDataFrame(made([None, *(f"a{k}" for k in range(60))], 10), ROWS)
    for part in range(2):
        df.where(f"floor(row_no / 5) = {part}").repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = inbox.read_inbox(spark, str(tmp_path / "in"), df.schema)
        query = ledger_stream.start_replay(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"), "acct")
        query.awaitTermination(120)
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert kept and max(kept) <= 4  # not one of the store's keys an account
    key = lambda r: (str(r[0]), *r[1:])
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=key)
    assert got == sorted(map(tuple, ledger.replay_ledger(df, "acct").collect()), key=key)


def test_keys_of_several_kinds_meet_in_groups_as_in_spark(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger_stream, "GROUPS", 1)
    names = [(float("nan"), b"x"), (0.0, b"x"), (0.0, b"y"), (None, None), (2.5, b"")]
    rows = [(*names[a[0]], a[0] + 2**60, *a[1:]) for a in made(range(5), 6)]
    df = spark.createDataFrame(rows, "a double, b binary, c bigint, " + ROWS.split(", ", 1)[1])
    for part in range(2):
        df.where(f"floor(row_no / 3) = {part}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = inbox.read_inbox(spark, str(tmp_path / "in"), df.schema)
        ledger_stream.start_replay(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"), "a", "b", "c").awaitTermination(120)
    shown = lambda out: sorted(str((str(r[0]), r[1] and bytes(r[1]), *r[2:])) for r in out.collect())
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == shown(ledger.replay_ledger(df, "a", "b", "c"))


def test_an_idle_account_begins_anew_in_a_group_that_is_not_idle():
    class Value:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Clock:
        now = 0

        def getCurrentProcessingTimeInMs(self):  # noqa: N802
            return self.now

    processor, clock = ledger_stream.LedgerProcessor(("acct",), ["acct", "row_no", "checked", "mismatch", "inversion", "skipped"], "", 200), Clock()
    processor.state = Value()
    row = lambda acct, n: {"acct": acct, "row_no": n, "date": None, "debit": None, "credit": Decimal(1), "balance": Decimal(n), "comparable": True}
    seen = []
    for clock.now, accounts in ((0, "ab"), (150, "a"), (250, "ab")):
        rows = [{"rows": [row(a, clock.now)]} for a in accounts]
        seen += [(a, c) for r in processor.handleInputRows((0,), iter(rows), clock) for a, c in zip(r["acct"], r["checked"], strict=True)]
    assert sorted(seen) == [("a", False), ("a", True), ("a", True), ("b", False), ("b", False)]
