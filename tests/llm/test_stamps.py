"""Times of many layouts: odd stamps one by one, votes, transitions, and both ways of giving verdicts."""

from datetime import UTC, datetime

import pytest

from quillmark.llm import stamps

ROW = "stamp_id bigint, source string, zone string, raw string, utc_us string"


def us(*parts):
    return int(datetime(*parts, tzinfo=UTC).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("raw", "zone", "want"),
    [
        ("1700000000", None, (1_700_000_000_000_000, "epoch", False)), ("1700000000123", "x", (1_700_000_000_123_000, "epoch", False)), ("٠١٢٣٤٥٦٧٨٩", "UTC", None),
        ("2024-02-29", "UTC", (us(2024, 2, 29), "plain", False)), ("2023-02-29", "UTC", None), ("20240131T23:59:59Z", None, (us(2024, 1, 31, 23, 59, 59), "plain", False)),
        (" \t05.06.2024 07:08\r\n", "UTC", (us(2024, 6, 5, 7, 8), "plain", False)), ("31 Dec 2024 11:59 PM +05:30", None, (us(2024, 12, 31, 18, 29), "plain", False)),
        ("31 dec 2024", "UTC", None), ("31 Dec 2024 12:00AM", "UTC", (us(2024, 12, 31), "plain", False)), ("31 Dec 2024 13:00 PM", "UTC", None), ("31 Dec 2024 00:10AM", "UTC", None),
        ("2024-01-01 24:00", "UTC", None), ("2024-01-01 10:60", "UTC", None), ("2024-01-01 10:10:60", "UTC", None), ("2024-01-01 10:10:59 -0130", None, (us(2024, 1, 1, 11, 40, 59), "plain", False)),
        ("2024-01-01 10:10+14:59", None, (us(2023, 12, 31, 19, 11), "plain", False)), ("2024-01-01 10:10+15:00", "UTC", None), ("2024-01-01 10:10+01:60", "UTC", None),
        ("2024-01-01  10:10", "UTC", None), ("2024-01-01T10:10  Z", "UTC", None), ("2024-01-01Z", "UTC", None), ("2024-01-01 10", "UTC", None), ("1999-01-01", "UTC", None), ("", "UTC", None), (None, "UTC", None),
        ("2024-01-01 ", "UTC", (us(2024, 1, 1), "plain", False)), ("2024-01-01T", "UTC", None), ("2024-0101", "UTC", None), ("01.02-2024", "UTC", None), ("2" * 200_000, "UTC", None),
        ("07/07/2024", "UTC", (us(2024, 7, 7), "plain", False)), ("13/13/2024", "UTC", None), ("25/12/2024", "UTC", (us(2024, 12, 25), "plain", False)), ("12/25/2024", "UTC", (us(2024, 12, 25), "plain", False)),
        ("2024-03-31 02:30", "Europe/Berlin", (us(2024, 3, 31, 1, 30), "plain", True)), ("2024-03-31 03:00", "Europe/Berlin", (us(2024, 3, 31, 1), "plain", False)),
        ("2024-03-31 01:59:59", "Europe/Berlin", (us(2024, 3, 31, 0, 59, 59), "plain", False)), ("2024-10-27 02:00", "Europe/Berlin", (us(2024, 10, 27), "plain", True)),
        ("2024-10-27 03:00", "Europe/Berlin", (us(2024, 10, 27, 2), "plain", False)), ("2024-10-27 02:30+01:00", "Europe/Berlin", (us(2024, 10, 27, 1, 30), "plain", False)),
        ("2099-07-01", "America/New_York", (us(2099, 7, 1, 4), "plain", False)), ("2000-01-01", "Asia/Kolkata", (us(1999, 12, 31, 18, 30), "plain", False)),
        ("2024-01-01", None, None), ("2024-01-01", "No/Where", None), ("2024-01-01", "../etc", None), ("2024-01-01", "", None), ("2024-01-01Z", None, None),
    ],
)
def test_one_stamp(raw, zone, want):
    (row,) = stamps.scanned([(1, "s", zone, raw)])
    got = stamps.finished(row[0], row[2], row[3], None)
    assert got == (1, *(want or (None, "bad", False)))


@pytest.fixture(scope="module")
def shop(spark):
    rows = [(k, "day", "UTC", f"{13 + k}/02/2024", "c") for k in range(4)] + [(4, "day", "UTC", "02/13/2024", None), (5, "day", "UTC", "01/02/2024", None)]
    rows += [(10 + k, "tie", "UTC", f"{13 + k}/02/2024", None) for k in range(3)] + [(13, "tie", "UTC", "02/13/2024", None), (14, "tie", "UTC", "01/02/2024 05:00", None)]
    rows += [(20, None, "UTC", "02/13/2024", None), (21, None, "UTC", "01/02/2024", None), (22, "none", "UTC", "01/02/2024", None), (22, "none", "UTC", "01/02/2024", None)]
    rows += [(30, "x" * 5000, "UTC", "13/02/2024", None), (31, "x" * 5000, "UTC", "01/02/2024", None), (32, "bad", "No/Where", "13/02/2024", None), (33, "bad", "UTC", "01/02/2024", None)]
    rows += [(40, "gap", "Europe/Berlin", "13/02/2024", None), (41, "gap", "Europe/Berlin", "03/11/2024 02:30", None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, ROW).repartition(3)


@pytest.mark.parametrize("sources", [4096, 2])
def test_votes(shop, sources):
    got = {}
    for r in stamps.normalised(shop, sources=sources).collect():
        got.setdefault(r["stamp_id"], []).append((r["utc_us"], r["rule"], r["ambiguous"]))
    assert got[5] == [(us(2024, 2, 1), "votes", True)]  # four against one
    assert got[14] == [(us(2024, 1, 2, 5), "default", True)]  # three against one isn't over three times
    assert got[21] == [(us(2024, 1, 2), "votes", True)] and got[22] == [(us(2024, 1, 2), "default", True)] * 2
    assert got[31] == [(us(2024, 2, 1), "votes", True)] and got[33] == [(us(2024, 1, 2), "default", True)] and got[32] == [(None, "bad", False)]
    assert got[41] == [(us(2024, 11, 3, 1, 30), "votes", True)] and got[None] == [(None, "bad", False)]
    assert sum(map(len, got.values())) == shop.count()


def test_no_rows(shop):
    assert stamps.normalised(shop.limit(0)).collect() == []
