"""Amount parsers and currencies as Column expressions. The two parsers differ on purpose and are never unified.

``table_amount`` reads statement and invoice cells to decimal(38,6); ``fact_amount`` reads extracted facts with their locale and
says whether the value was normalized, ambiguous or left raw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import bound
from quillmark.functions.dates import date_order

CURRENCY_CODES = ("EUR", "USD", "GBP", "CHF", "THB")


def _last(s: Column, sign: str) -> Column:
    return F.length(s) - F.instr(F.reverse(s), sign)


def _has(s: Column, sign: str) -> Column:
    return F.instr(s, sign) > 0


def table_amount(value: Column) -> Column:
    trimmed = F.regexp_replace(value, r"^\s+|\s+$", "")
    number = bound(F.regexp_replace(trimmed, r"[^0-9,.\-]", ""), _table_number)
    negative = trimmed.startswith("(") & trimmed.endswith(")")
    return bound(number, lambda x: F.when(negative & (x > 0), -x).otherwise(x))


def _table_number(s: Column) -> Column:
    comma, dot = _has(s, ","), _has(s, ".")
    decimal_comma = _last(s, ",") > _last(s, ".")
    both = F.when(decimal_comma, F.translate(F.translate(s, ".", ""), ",", ".")).otherwise(F.translate(s, ",", ""))

    def repeated(sign):
        parts = F.split(s, r"\." if sign == "." else sign)
        tail = F.element_at(parts, -1)
        head = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "")
        groups = F.forall(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda g: F.length(g) == 3)
        return F.when(F.length(tail) == 2, F.concat(head, F.lit("."), tail)).when(groups, F.array_join(parts, ""))

    def single(sign):
        head, tail = F.split_part(s, F.lit(sign), F.lit(1)), F.split_part(s, F.lit(sign), F.lit(2))
        return F.concat(head, F.when(F.length(tail) <= 2, ".").otherwise(""), tail)

    count = lambda sign: F.length(s) - F.length(F.translate(s, sign, ""))
    text = (
        F.when(comma & dot, both)
        .when(count(",") > 1, repeated(","))
        .when(count(".") > 1, repeated("."))
        .when(comma, single(","))
        .when(dot, single("."))
        .otherwise(s)
    )
    return bound(text, lambda x: F.when(x.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), x.try_cast("decimal(38,6)")))


def explicit_currency(value: Column) -> Column:
    code = F.upper(F.regexp_extract(value, rf"(?i)\b({'|'.join(CURRENCY_CODES)})\b", 1))
    return (
        F.when(value.contains("€"), "EUR").when(value.contains("£"), "GBP").when(value.contains("$"), "USD").when(code != "", code)
    )


def account_currency(value: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(value, r"(?i)\bCURRENCY\b\s*[:.]?\s*([A-Z]{3})", 1)), F.lit(""))


# Currency signs in order of precedence, and codes that count in a context.
CURRENCY_SIGNS = {"US$": "USD", "C$": "CAD", "A$": "AUD", "€": "EUR", "£": "GBP"}
CONTEXT_CODES = "AED AUD BGN BRL CAD CHF CNY CZK DKK EUR GBP HKD HUF INR JPY KRW MXN NOK PLN RON SAR SEK SGD TRY USD ZAR"


def context_currency(values: Column) -> Column:
    """Currency of the first of several texts that names one: by a sign, else by its first known code."""

    def named(value):
        text = F.upper(value)
        sign = F.coalesce(*[F.when(text.contains(m), code) for m, code in CURRENCY_SIGNS.items()])
        codes = F.regexp_extract_all(text, F.lit(r"(?<![A-Z])[A-Z]{3}(?![A-Z])"), F.lit(0))
        known = F.filter(codes, lambda c: F.array_contains(F.split(F.lit(CONTEXT_CODES), " "), c))
        return F.coalesce(sign, F.get(known, 0))

    return F.get(F.array_compact(F.transform(values, named)), 0)


def decimal_separator(language: Column, country: Column) -> Column:
    order, place = date_order(language, country), F.upper(F.trim(F.coalesce(country, F.lit(""))))
    return F.when((order == "dmy") & (place != "GB"), ",").when((order == "mdy") | place.isin("GB", "IE"), ".")


def fact_amount(value: Column, language: Column, country: Column) -> Column:
    """struct<value double, status string>. Width variants of digits and spaces are folded; other compatibility forms aren't."""
    wide = "".join(chr(0xFF10 + i) for i in range(10))
    s = F.translate(value, wide + "−–—’\u00a0\u202f", "0123456789---'  ")
    s = F.regexp_replace(s, r"^\s*(?:±|\+\s*(?:[/\\|Il1]\s*)?-\s*)", "")
    s = F.regexp_replace(s, r"(?<=\d)([,.])\s*-(?!\d)", "$100")  # group 1, then two zeros

    def parsed(s):
        return bound(F.regexp_extract(s, r"[-+]?\d[\d\s.,']*", 0), lambda found: _fact_parts(s, found, language, country))

    return bound(s, parsed)


def _fact_parts(s: Column, found: Column, language: Column, country: Column) -> Column:
    others = F.regexp_replace(F.substr(s, F.instr(s, found) + F.length(found)), r"[^0-9]", "")
    status = F.when(found == "", "raw_only").when(others != "", "ambiguous")
    number = F.regexp_replace(F.regexp_replace(found, r"[\s']", ""), r"[.,]+$", "")
    text = bound(number, lambda x: _fact_decimal(x, language, country))

    def result(amount):
        # no text: the separators don't say which number it is; no amount: it isn't a number
        said = F.coalesce(status, F.when(amount["text"].isNull(), "ambiguous"), F.when(amount["value"].isNull(), "raw_only"), F.lit("normalized"))
        signed = F.when(s.rlike(r"\(\s*\d") & (amount["value"] > 0), -amount["value"]).otherwise(amount["value"])
        return F.struct(F.when(said == "normalized", signed.cast("double")).alias("value"), said.alias("status"))

    return bound(bound(text, lambda x: F.struct(x.alias("text"), x.try_cast("decimal(38,6)").alias("value"))), result)


def _fact_decimal(number: Column, language: Column, country: Column) -> Column:
    """The number with a decimal point, null if its separators are ambiguous."""
    comma, dot = _has(number, ","), _has(number, ".")
    both = F.when(_last(number, ",") > _last(number, "."), F.translate(F.translate(number, ".", ""), ",", ".")).otherwise(F.translate(number, ",", ""))
    sign = F.when(comma, ",").otherwise(".")
    threes = lambda xs: F.forall(xs, lambda g: F.length(g) == 3)

    def one(parts):
        n, tail = F.size(parts), F.element_at(parts, -1)
        head = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), "")
        pair = F.concat(F.element_at(parts, 1), F.lit("."), tail)
        inner = F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0)))
        return (
            F.when((n == 2) & F.length(tail).isin(1, 2), pair)
            .when((n > 2) & F.length(tail).isin(1, 2) & threes(inner), F.concat(head, F.lit("."), tail))
            .when(threes(F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0)))), F.array_join(parts, ""))
            .when((n == 2) & (decimal_separator(language, country) == sign), pair)
        )

    return F.when(comma & dot, both).when(comma | dot, bound(F.split(F.translate(number, ",", "."), r"\."), one)).otherwise(number)
