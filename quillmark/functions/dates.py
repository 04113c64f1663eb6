"""Date finders and normalisers as Column expressions. Calendar-invalid dates give null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Countries and languages that write the day first.
DAY_FIRST_COUNTRIES = ("AT", "BE", "CH", "DE", "ES", "FR", "GB", "IE", "IT", "LU", "NL", "PT")
DAY_FIRST_LANGUAGES = ("de", "es", "fr", "it", "lb", "nl", "pt")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ISO = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
NAMED = r"(?i)\b(\d{1,2})-(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-(\d{4})\b"
NUMERIC = r"\b(\d{1,2})([/.-])(\d{1,2})\2(\d{4})\b"


def calendar(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers, or null."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _supported(year: Column) -> Column:
    return year.between(1000, 2999)


def found_dates(text: Column) -> Column:
    """array<struct<raw, value date, ambiguous>>: all dates of supported years, ISO first, then named, then numeric ones."""

    def iso(raw):
        y = _int(raw, ISO, 1)
        return F.when(_supported(y), F.struct(raw.alias("raw"), calendar(y, _int(raw, ISO, 2), _int(raw, ISO, 3)).alias("value"), F.lit(False).alias("ambiguous")))

    def named(raw):
        y = _int(raw, NAMED, 3)
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(raw, NAMED, 2))).cast("int")
        return F.when(_supported(y), F.struct(raw.alias("raw"), calendar(y, month, _int(raw, NAMED, 1)).alias("value"), F.lit(False).alias("ambiguous")))

    def numeric(raw):
        a, b, y = _int(raw, NUMERIC, 1), _int(raw, NUMERIC, 3), _int(raw, NUMERIC, 4)
        day_first, month_first = calendar(y, b, a), calendar(y, a, b)
        both = day_first.isNotNull() & month_first.isNotNull() & (day_first != month_first)
        return F.when(_supported(y), F.struct(raw.alias("raw"), F.coalesce(day_first, month_first).alias("value"), F.coalesce(both, F.lit(False)).alias("ambiguous")))

    parts = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), f) for p, f in ((ISO, iso), (NAMED, named), (NUMERIC, numeric))]
    return F.array_compact(F.concat(*parts))


def first_date(text: Column) -> Column:
    """The first found date, null if there is none or it isn't in the calendar."""
    return F.try_element_at(found_dates(text), F.lit(1))["value"]


def date_order(language: Column, country: Column) -> Column:
    place = F.upper(F.trim(F.coalesce(country, F.lit(""))))
    tongue = F.lower(F.translate(F.trim(F.coalesce(language, F.lit(""))), "_", "-"))
    return (
        F.when((place == "US") | (tongue == "en-us"), "mdy")
        .when(place.isin(*DAY_FIRST_COUNTRIES) | F.split_part(tongue, F.lit("-"), F.lit(1)).isin(*DAY_FIRST_LANGUAGES), "dmy")
    )


def normalized_date(value: Column, language: Column, country: Column) -> Column:
    """struct<value string, status string> of an extracted fact; two dates or an undecided order are ambiguous."""
    # How dates are written in facts.
    start, end = r"(?<![\d/.,-])", r"(?!\d|[/,-]|\.\d)"
    iso_p = start + r"(\d{4})([-/.,])(\d{1,2})\2(\d{1,2})" + end
    local_p = start + r"(\d{1,2})([-/.,])(\d{1,2})\2(\d{4}|\d{2})" + end
    n_iso = F.size(F.regexp_extract_all(value, F.lit(iso_p), F.lit(0)))
    n_local = F.size(F.regexp_extract_all(value, F.lit(local_p), F.lit(0)))
    a, b, raw_year = _int(value, local_p, 1), _int(value, local_p, 3), F.regexp_extract(value, local_p, 4)
    short = raw_year.try_cast("int")
    year = F.when(F.length(raw_year) == 2, F.when(short <= 49, short + 2000).otherwise(short + 1900)).otherwise(short)
    dated = lambda y, m, d: F.when(_supported(y), calendar(y, m, d))
    iso = dated(_int(value, iso_p, 1), _int(value, iso_p, 3), _int(value, iso_p, 4))
    order = F.when((a > 12) & b.between(1, 12), "dmy").when((b > 12) & a.between(1, 12), "mdy").otherwise(date_order(language, country))
    local = F.when(order == "dmy", dated(year, b, a)).when(order == "mdy", dated(year, a, b))
    n = n_iso + n_local
    result = F.when(n == 1, F.when(n_iso == 1, iso).otherwise(local))
    status = (
        F.when(n == 0, "raw_only").when(n > 1, "ambiguous").when((n_iso == 0) & order.isNull(), "ambiguous")
        .when(result.isNull(), "raw_only").otherwise("normalized")
    )
    return F.struct(F.date_format(result, "yyyy-MM-dd").alias("value"), status.alias("status"))


def pdf_date(value: Column) -> Column:
    """Timestamp of a PDF date (D:YYYYMMDDhhmmss, later parts optional); the zone is left out."""
    p = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"
    part = lambda g, default: F.coalesce(F.nullif(F.regexp_extract(value, p, g), F.lit("")), F.lit(default))
    text = F.concat_ws("-", part(1, "x"), part(2, "01"), part(3, "01"), part(4, "00"), part(5, "00"), part(6, "00"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd-HH-mm-ss"))
