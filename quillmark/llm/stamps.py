"""Times of many layouts as UTC: a recursive-descent scanner in mapPartitions, votes by source, transitions by bisection.

``normalised`` scans every stamp once for votes and once for its result. Stamps with slashes that are possible in one order only vote for
it in their source; ``reduceByKey`` sums the votes with map-side combining, so that a hot source costs no more than another. Verdicts are
broadcast only for a bounded number of sources: all of them where there are at most ``SOURCES``, else those with more than 1 / SOURCES of
the undecided rows (fewer than SOURCES can have), and the others, none of them hot, are joined by source.

Defined results: a null raw, a text that isn't wholly one stamp and impossible times are ``bad``, with a null time. A wall time whose zone is
null or unknown is ``bad`` too and casts no vote; with an offset of its own the zone isn't read. A null source is a source of its own. Long
texts fail at the first character that fits nothing. Repeated rows vote once each and all stay. Empty tables give empty results. Columns other
than the four named are not read, so they may have any name.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from calendar import monthrange
from collections.abc import Iterator
from datetime import UTC, date, datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame

SPACE = " \t\n\v\f\r"
MONTHS = {name: k for k, name in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
#: Verdicts in a broadcast.
SOURCES = 4096
#: A source's name in a broadcast or shuffle has so many characters at most; longer ones go by their digest.
NAME = 64
#: An order of the numbers wins with over this many times the other's votes.
MAJORITY = 3
EPOCH_DAY = date(1970, 1, 1).toordinal()
DAY_S, MICRO = 86_400, 1_000_000
FIELDS = "stamp_id bigint, utc_us bigint, rule string, ambiguous boolean"


class NoStamp(Exception):
    """The text isn't a stamp."""


class Scanner:
    """One stamp's text with a position; each method reads one part of the grammar and moves on.

    stamp = digits(10) | digits(13) | day_part [time_part]
    day_part = year "-" two "-" two | year two two | two "." two "." year | two " " month " " year | two "/" two "/" year
    time_part = ("T" | " ") two ":" two [":" two] [[" "] half] [[" "] offset]
    """

    __slots__ = ("at", "text")

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def sees(self, *words: str) -> str | None:
        """The word that comes next, passed over."""
        for w in words:
            if self.text.startswith(w, self.at):
                self.at += len(w)
                return w
        return None

    def must(self, word: str) -> None:
        if not self.sees(word):
            raise NoStamp

    def digits(self, n: int) -> int:
        part = self.text[self.at : self.at + n]
        if len(part) < n or not part.isdigit():
            raise NoStamp
        self.at += n
        return int(part)

    def two(self, least: int, most: int) -> int:
        if not least <= (x := self.digits(2)) <= most:
            raise NoStamp
        return x

    def year(self) -> int:
        if not 2000 <= (y := self.digits(4)) <= 2099:
            raise NoStamp
        return y

    def month(self) -> int:
        if not (found := self.sees(*MONTHS)):
            raise NoStamp
        return MONTHS[found]

    def days(self) -> tuple[int | None, int | None]:
        """Days since 1970 of the date, for slashes as (month first, day first); None where impossible."""
        if self.text[2:3] in (".", " ", "/"):
            a, sign = self.digits(2), self.sees(".", " ", "/")
            b = self.month() if sign == " " else self.digits(2)
            self.must(sign)
            y = self.year()
            return (day_of(y, a, b), day_of(y, b, a)) if sign == "/" else (d := day_of(y, b, a), d)
        y = self.year()
        dash = self.sees("-")
        m = self.digits(2)
        if dash:
            self.must("-")
        return (d := day_of(y, m, self.digits(2)), d)

    def seconds(self) -> tuple[int, int | None]:
        """Seconds of the day, and of the offset if there is one."""
        if self.at == len(self.text):
            return 0, None
        if not self.sees("T", " "):
            raise NoStamp
        h, _, m = self.two(0, 23), self.must(":"), self.two(0, 59)
        s = self.two(0, 59) if self.sees(":") else 0
        if half := self.sees(" AM", " PM", "AM", "PM"):
            if not 1 <= h <= 12:
                raise NoStamp
            h = h % 12 + 12 * half.endswith("PM")
        return h * 3600 + m * 60 + s, self.offset()

    def offset(self) -> int | None:
        if self.at == len(self.text):
            return None
        self.sees(" ")
        if self.sees("Z"):
            return 0
        if not (sign := self.sees("+", "-")):
            raise NoStamp
        h = self.two(0, 14)
        self.sees(":")
        return (h * 3600 + self.two(0, 59) * 60) * (1 if sign == "+" else -1)

    def end(self) -> None:
        if self.at != len(self.text):
            raise NoStamp


def day_of(y: int, m: int, d: int) -> int | None:
    """Days since 1970; None for an impossible date."""
    return date(y, m, d).toordinal() - EPOCH_DAY if 1 <= m <= 12 and 1 <= d <= monthrange(y, m)[1] else None


#: A parsed stamp: rule so far ("bad", "epoch", "plain", or "both" for two different dates), seconds or microseconds with the month first, with the
#: day first, whether they are UTC already, and the vote: "m" or "d".
BAD = ("bad", None, None, True, None)


def parsed(raw: str | None) -> tuple:
    text = (raw or "").strip(SPACE)
    if not text.isascii():
        return BAD
    if len(text) in (10, 13) and text.isdigit():
        return "epoch", int(text) * (MICRO if len(text) == 10 else 1000), None, True, None
    scan = Scanner(text)
    try:
        month_first, day_first = scan.days()
        clock, offset = scan.seconds()
        scan.end()
    except NoStamp:
        return BAD
    if month_first is None and day_first is None:
        return BAD
    month_s, day_s = (None if d is None else d * DAY_S + clock - (offset or 0) for d in (month_first, day_first))
    vote = "m" if day_s is None else "d" if month_s is None else None
    if vote or month_s == day_s:
        return "plain", month_s if day_s is None else day_s, None, offset is not None, vote
    return "both", month_s, day_s, offset is not None, None


def _offset(zone: ZoneInfo, at: int) -> int:
    return int(datetime.fromtimestamp(at, UTC).astimezone(zone).utcoffset().total_seconds())


@lru_cache(maxsize=256)
def transitions(name: str | None) -> tuple | None:
    """Changes of a zone's offset from 2000 to 2099, by wall time: where each begins to matter and ceases to, the offsets before and after.

    None for an unknown zone. A day's steps find each change, halving finds its second.
    """
    try:
        zone = ZoneInfo(name)
    except (OSError, KeyError, TypeError, ValueError):
        return None
    begin, end = ((date(y, 1, 1).toordinal() - EPOCH_DAY) * DAY_S for y in (2000, 2100))
    starts, ends, offsets = [], [], [_offset(zone, begin - 2 * DAY_S)]
    for day in range(begin - 2 * DAY_S, end + 2 * DAY_S, DAY_S):
        if _offset(zone, day + DAY_S) == offsets[-1]:
            continue
        low, high = day, day + DAY_S
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if _offset(zone, middle) == offsets[-1] else (low, middle)
        before, after = offsets[-1], _offset(zone, day + DAY_S)
        starts.append(high + min(before, after))
        ends.append(high + max(before, after))
        offsets.append(after)
    return starts, ends, offsets


def utc_of(wall: int, changes: tuple) -> tuple[int, bool]:
    """UTC seconds of a wall time, and whether a change skips or repeats it; then the offset before the change holds."""
    starts, ends, offsets = changes
    k = bisect_right(starts, wall)
    if k and wall < ends[k - 1]:
        return wall - offsets[k - 1], True
    return wall - offsets[k], False


def named(source: str | None) -> str | None:
    """A source's name as a key of bounded length."""
    return source if source is None or len(source) <= NAME else "#" + hashlib.sha256(source.encode()).hexdigest()


def scanned(rows: Iterator) -> Iterator[tuple]:
    """(id, key of the source, zone, parsed stamp); a wall time in no known zone is bad."""
    for stamp_id, source, zone, raw in rows:
        p = parsed(raw)
        yield stamp_id, named(source), zone, p if p[3] or transitions(zone) else BAD


def ballots(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(source, (votes for the month first, for the day first, undecided rows))."""
    for _, source, _, (rule, _, _, _, vote) in rows:
        if vote or rule == "both":
            yield source, (int(vote == "m"), int(vote == "d"), int(rule == "both"))


def verdict(votes: tuple[int, int, int] | None) -> str | None:
    """The order that wins by votes: "m" or "d"."""
    month, day, _ = votes or (0, 0, 0)
    return "m" if month > MAJORITY * day else "d" if day > MAJORITY * month else None


def finished(stamp_id: int | None, zone: str | None, p: tuple, won: str | None) -> tuple:
    """A result row."""
    rule, first, second, known, _ = p
    if rule in ("bad", "epoch"):
        return stamp_id, first, rule, False
    if rule == "both":
        rule, first = "votes" if won else "default", second if won == "d" else first
    odd = False
    if not known:
        first, odd = utc_of(first, transitions(zone))
    return stamp_id, first * MICRO, rule, odd or rule != "plain"


def normalised(df: DataFrame, id_col: str = "stamp_id", source_col: str = "source", zone_col: str = "zone", raw_col: str = "raw", sources: int = SOURCES) -> DataFrame:
    """stamp_id, utc_us, rule, ambiguous of every row; ``sources`` bounds the verdicts of a broadcast."""
    spark, plain = df.sparkSession, df.select(id_col, source_col, zone_col, raw_col)
    if plain.isEmpty():
        return spark.createDataFrame([], FIELDS)
    stamps = plain.rdd.mapPartitions(scanned)
    votes = stamps.mapPartitions(ballots).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
    many = votes.count() > sources
    least = votes.map(lambda x: x[1][2]).sum() / sources if many else -1
    told = spark.sparkContext.broadcast(votes.filter(lambda x: x[1][2] > least).mapValues(verdict).collectAsMap())

    def here(rows):
        for stamp_id, source, zone, p in rows:
            if not many or p[0] != "both" or source in told.value:
                yield finished(stamp_id, zone, p, told.value.get(source))

    out = stamps.mapPartitions(here)
    if many:
        rest = stamps.filter(lambda x: x[3][0] == "both" and x[1] not in told.value).map(lambda x: (x[1], (x[0], x[2], x[3])))
        out = out.union(rest.leftOuterJoin(votes.filter(lambda x: x[1][2] <= least)).map(lambda x: finished(*x[1][0], verdict(x[1][1]))))
    return spark.createDataFrame(out, FIELDS, verifySchema=False)
