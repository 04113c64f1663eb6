"""Normalised values of extracted facts, by the code of their field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import amounts, bound, dates
from quillmark.functions import identifiers as ids
from quillmark.functions import text as t

# Codes of fields by how their value is normalised.
IDENTIFIERS = ("bic", "payment_card_number", "tax_identifier", "professional_identifier", "registration_identifier", "other_identifier", "account_number")
DATES = ("date", "date_period")
TEXTS = (
    "person_name", "organization_name", "address", "document_number", "invoice_number", "contract_number", "claim_number", "service_description", "service_code",
    "product_description", "product_code", "transaction_description",
)


def _said(value: Column) -> Column:
    """struct<value, status>: normalised if there is a value."""
    kept = F.nullif(value, F.lit(""))
    return F.struct(kept.alias("value"), F.when(kept.isNotNull(), "normalized").otherwise("raw_only").alias("status"))


def embedded_iban(raw: Column) -> Column:
    """The first IBAN inside a value, by its country's length; null if there is none."""
    lengths = F.create_map(*[F.lit(x) for c in ids.IBAN_STRUCTURES for x in (c, ids.iban_length(c))])

    def search(compact):
        def candidate(i):
            tail = F.substr(compact, i)
            size = F.try_element_at(lengths, F.left(tail, F.lit(2)))
            return F.when(tail.rlike("^[A-Z]{2}[0-9]{2}") & (F.length(tail) >= size), F.left(tail, size))

        places = F.sequence(F.lit(1), F.greatest(F.length(compact), F.lit(1)))
        return F.get(F.array_compact(F.transform(places, candidate)), 0)

    return bound(F.upper(F.regexp_replace(raw, r"[^A-Za-z0-9]", "")), search)


def normalized_value(field_code: Column, raw: Column, language: Column, country: Column) -> Column:
    """struct<value string, status string> of a fact; codes without a rule keep their raw value only."""
    compact = F.upper(F.regexp_replace(raw, r"[^\p{L}\p{N}]", ""))
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    phone = F.when(digits != "", F.concat(F.when(F.ltrim(raw).startswith("+"), "+").otherwise(""), digits))
    mail = F.when(raw.contains("@"), F.lower(t.trimmed(raw)))
    amount = amounts.fact_amount(raw, language, country)
    day = dates.normalized_date(raw, language, country)
    return (
        F.when(raw.isNull(), _said(F.lit(None).cast("string")))
        .when(field_code == "iban", _said(embedded_iban(raw))).when(field_code.isin(*IDENTIFIERS), _said(compact))
        .when(field_code == "phone_number", _said(phone)).when(field_code == "email_address", _said(mail))
        .when(field_code == "monetary_amount", F.struct(amount["value"].cast("string").alias("value"), amount["status"].alias("status")))
        .when(field_code.isin(*DATES), F.struct(day["value"].alias("value"), day["status"].alias("status")))
        .when(field_code.isin(*TEXTS), _said(t.folded(raw))).otherwise(_said(F.lit(None).cast("string")))
    )
