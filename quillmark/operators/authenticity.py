"""Findings from cryptographic and structured-data checks, by a rule table that is a literal in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Checks whose observations count, and the category and points of the codes.
CHECKS = ("pades", "post_signature", "facturx", "two_d_doc")
RULES = {
    "PDF_SIGNATURE_INVALID": ("provenance_integrity", 20.0),
    "PDF_SUSPICIOUS_POST_SIGNATURE_CHANGE": ("document_integrity", 20.0),
    "TWO_D_DOC_SIGNATURE_INVALID": ("provenance_integrity", 20.0),
    "TWO_D_DOC_VISIBLE_MISMATCH": ("document_integrity", 20.0),
    "FACTURX_VISIBLE_MISMATCH": ("document_integrity", 20.0),
    "TWO_D_DOC_MALFORMED": ("document_integrity", 4.0),
    "FACTURX_XML_MALFORMED": ("document_integrity", 4.0),
    "FACTURX_XSD_INVALID": ("document_integrity", 4.0),
}


def authenticity_findings(observations: DataFrame) -> DataFrame:
    """(doc_id, detector, code, category, risk_points, confidence, page) of observations that ask for attention.

    observations: doc_id, check_code, code, state, strength, page. Codes without a rule give nothing.
    """
    category = F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (k, v[0])])
    points = F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (k, v[1])])
    keep = F.col("check_code").isin(*CHECKS) & (F.col("state") == "attention") & F.col("code").isin(*RULES)
    confidence = F.when(F.col("strength") == "strong", 0.95).otherwise(0.80)
    return observations.where(keep).select(
        "doc_id", F.lit("document_authenticity").alias("detector"), "code", F.try_element_at(category, F.col("code")).alias("category"),
        F.try_element_at(points, F.col("code")).alias("risk_points"), confidence.alias("confidence"), "page",
    )


def detector_status(observations: DataFrame) -> DataFrame:
    """(doc_id, status): partial if one of the checks failed to run."""
    failed = F.bool_or(F.col("check_code").isin(*CHECKS) & (F.col("state") == "error"))
    return observations.groupBy("doc_id").agg(F.when(failed, "partial").otherwise("completed").alias("status"))


# ---- what the adapters' results mean: (code, state, strength) by ordered conditions


def _verdict(*rules: tuple[Column | None, str, str, str]) -> Column:
    """The first rule whose condition holds; the last has none."""
    out = None
    for condition, code, state, strength in rules:
        value = F.struct(F.lit(code).alias("code"), F.lit(state).alias("state"), F.lit(strength).alias("strength"))
        if condition is None:
            return value if out is None else out.otherwise(value)
        out = (F if out is None else out).when(F.coalesce(condition, F.lit(False)), value)
    return out


def signature_verdict(intact: Column, valid: Column, trusted: Column) -> Column:
    return _verdict(
        (~intact | ~valid, "PDF_SIGNATURE_INVALID", "attention", "strong"),
        (trusted, "PDF_SIGNATURE_TRUSTED", "clear", "strong"),
        (None, "PDF_SIGNATURE_INTACT_UNTRUSTED", "indeterminate", "moderate"),
    )


def post_signature_verdict(covered: Column, modification: Column, policy_kept: Column, difference: Column) -> Column:
    """From the signature's coverage, the class of later changes, whether the document's policy is kept, and the kind of difference."""
    change = F.coalesce(F.upper(modification), F.lit(""))
    return _verdict(
        (~policy_kept | (change == "OTHER") | F.coalesce(difference.contains("Suspicious"), F.lit(False)), "PDF_SUSPICIOUS_POST_SIGNATURE_CHANGE", "attention", "strong"),
        (change.isin("NONE", "") & covered.contains("ENTIRE_FILE"), "PDF_NO_POST_SIGNATURE_CHANGE", "clear", "strong"),
        (None, "PDF_ALLOWED_POST_SIGNATURE_CHANGE", "detected", "moderate"),
    )


def barcode_verdict(result: Column) -> Column:
    """From a signed barcode's verification: ``certificate_unknown``, ``signature_invalid``, ``malformed`` or ``valid``."""
    return _verdict(
        (result == "certificate_unknown", "TWO_D_DOC_CERTIFICATE_UNKNOWN", "indeterminate", "moderate"),
        (result == "signature_invalid", "TWO_D_DOC_SIGNATURE_INVALID", "attention", "strong"),
        (result == "malformed", "TWO_D_DOC_MALFORMED", "attention", "moderate"),
        (result == "valid", "TWO_D_DOC_SIGNATURE_VALID", "clear", "strong"),
    )


def invoice_verdict(well_formed: Column, profile_known: Column, schema_valid: Column) -> Column:
    return _verdict(
        (~well_formed, "FACTURX_XML_MALFORMED", "attention", "moderate"),
        (~profile_known, "FACTURX_PROFILE_UNRECOGNISED", "attention", "weak"),
        (~schema_valid, "FACTURX_XSD_INVALID", "attention", "moderate"),
        (None, "FACTURX_XSD_VALID", "clear", "moderate"),
    )


# Source types that declare an algorithmic origin.
ALGORITHMIC = ("compositewithtrainedalgorithmicmedia", "trainedalgorithmicmedia")


def manifest_validation(raw_state: Column, failures: Column) -> Column:
    """State of a provenance manifest from its own word and the codes of its failures; lack of trust alone doesn't invalidate it."""
    state = F.lower(F.trim(F.coalesce(raw_state, F.lit(""))))
    codes = F.transform(F.coalesce(failures, F.array().cast("array<string>")), lambda c: F.lower(c))
    trust_only = (F.size(codes) > 0) & F.forall(codes, lambda c: c.contains("untrusted"))
    return (
        F.when(state.isin("invalid", "invalidated") | ((F.size(codes) > 0) & ~trust_only), "invalidated").when(state == "trusted", "trusted")
        .when((state == "untrusted") | trust_only, "untrusted").when(state == "valid", "valid").otherwise("unknown")
    )


def algorithmic_declaration(source_types: Column, validation: Column) -> Column:
    """struct<state, trust>: whether a manifest declares an algorithmic origin; null source types mean that there is no manifest."""
    suffix = lambda s: F.lower(F.element_at(F.split(F.regexp_replace(s, "/+$", ""), "/"), -1))
    declared = F.exists(source_types, lambda s: suffix(s).isin(*ALGORITHMIC))
    pair = lambda state, trust: F.struct(F.lit(state).alias("state"), trust.alias("trust"))
    return (
        F.when(source_types.isNull(), pair("indeterminate", F.lit("unknown")))
        .when(~declared, pair("not_detected", F.lit("not_applicable"))).otherwise(pair("detected", validation))
    )
