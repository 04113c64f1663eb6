"""Identifiers that stand after their label in recognised text, with the checks of a document's identifiers.

Positions decide here, so the extraction runs in an Arrow batch function. What follows a label is read as a stream of pieces (runs of letters
and digits, each with the gap before it); a table says for each kind which label opens it, how far the stream reaches and which reader
takes its values from the pieces. Validation, counting, conflicts and observations are expressions over the extracted rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillmark.functions import identifiers as ids
from quillmark.functions import text as t

# Labels of the kinds, shapes of card numbers, label and value of CKYC and MICR.
_I = re.IGNORECASE
CARD_LABEL = re.compile(r"\b(?:(?:credit|debit|payment)\s+card(?:\s+(?:account|no|number))?|card\s+(?:account|no|number)|(?:num[eé]ro|n[°o])\s+(?:de\s+)?carte|carte\s+(?:bancaire|de\s+credit)|kartennummer)\b", _I)
#: Words of card numbers with hidden places and of plain ones, what may stand between two words of either; size of a group, most full groups, digits of a number.
CARD_WORDS = ((re.compile(r"[0-9X*•]+", _I), re.compile(r"[ \t-]+")), (re.compile("[0-9]+"), re.compile(r"[\s-]")))
CARD_GROUP, CARD_FULL, CARD_DIGITS = 4, 4, range(13, 20)
BIC_LABEL = re.compile(r"\b(?:(?:BIC|SWIFT)(?:\s*[/|-]\s*(?:BIC|SWIFT))?(?:\s+(?:CODE|NO|NUMBER))?|CODE\s+(?:BIC|SWIFT))\b", _I)
IBAN_LABEL = re.compile(r"\bIBAN(?:\s+(?:NO|NUMBER|NUM[EÉ]RO))?\b", _I)
CKYC = re.compile(r"\bCKYC(?:\s+(?:ID|NO|NUMBER))?\b\s*[:.]?\s*([SLO]?\d{10,16})", _I)
MICR = re.compile(r"\bMICR(?:\s+(?:CODE|NO|NUMBER))?\b\s*[:.]?\s*(\d{6,18})", _I)
DIGIT_LABELS = {
    "siret": (re.compile(r"\b(?:N(?:°|O)\s*)?SIRET\b", _I), 14),
    "siren": (re.compile(r"\b(?:N(?:°|O)\s*)?SIREN(?!T)\b", _I), 9),
    "rpps": (re.compile(r"\b(?:N(?:°|O)\s*)?RPPS\b", _I), 11),
    "finess": (re.compile(r"\b(?:N(?:°|O)\s*)?FINESS(?:\s+(?:EJ|ET|JURIDIQUE|G[EÉ]OGRAPHIQUE))?\b", _I), 9),
}
VAT_LABEL = re.compile(r"\b(?:N(?:°|O)\s*)?(?:TVA(?:\s+INTRACOMMUNAUTAIRE)?|VAT(?:\s+(?:ID|NO|NUMBER))?)\b", _I)
#: Lengths of VAT numbers with their prefix; Romania's vary.
VAT_LENGTHS = {
    "AT": (11,), "BE": (12,), "BG": (11, 12), "CY": (11,), "CZ": (10, 11, 12), "DE": (11,), "DK": (10,), "EE": (11,), "EL": (11,), "ES": (11,),
    "FI": (10,), "FR": (13,), "HR": (13,), "HU": (10,), "IE": (10, 11), "IT": (13,), "LT": (11, 14), "LU": (10,), "LV": (13,), "MT": (10,),
    "NL": (14,), "PL": (12,), "PT": (11,), "RO": tuple(range(4, 13)), "SE": (14,), "SI": (10,), "SK": (12,), "XI": (11, 14),
}

#: Signs between a label and its value.
LEAD = " \t:.-"
_PIECE = re.compile(r"([^A-Za-z0-9]*)([A-Za-z0-9]+)")


class Piece(NamedTuple):
    gap: str
    word: str
    end: int  # place after the piece in the stream's text


class Stream:
    """The pieces after a label, up to a reach of so many characters."""

    def __init__(self, text: str, start: int, reach: int):
        self.text = text[start : start + reach].lstrip(LEAD)
        self.pieces = [Piece(m[1], m[2].upper(), m.end()) for m in _PIECE.finditer(self.text)]

    def joined(self, gaps: str) -> list[Piece]:
        """The pieces from the start on, as long as only these signs stand between them."""
        out: list[Piece] = []
        for p in self.pieces:
            if p.gap.strip(gaps) or not out and p.gap:
                break
            out.append(p)
        return out


class Found(NamedTuple):
    value: str
    masked: bool = False
    suffix: str | None = None
    border: int = 0  # how clearly the value ends: 2 at a border sign, 1 before a word, 0 otherwise


def _chain(text: str, words: list[re.Match], gap: re.Pattern) -> list[re.Match]:
    """The words from the first on, as long as what stands between two fits."""
    out = words[:1]
    for w in words[1:]:
        if not gap.fullmatch(text, out[-1].end(), w.start()):
            break
        out.append(w)
    return out


def _as_groups(text: str, chain: list[re.Match]) -> list[re.Match]:
    """Two to four groups of four and one of up to four, not inside a longer word."""
    sizes = [len(w.group()) for w in chain]
    full = next((k for k, n in enumerate(sizes[:CARD_FULL]) if n != CARD_GROUP), min(len(sizes), CARD_FULL))
    taken = chain[: full + (sizes[full : full + 1] != [] and sizes[full] <= CARD_GROUP)]
    while taken and text[taken[-1].end() : taken[-1].end() + 1].isalnum():
        taken = taken[:-1]
    return taken if len(taken) > 2 and not text[taken[0].start() - 1 : taken[0].start()].isalnum() else []


def _as_number(text: str, chain: list[re.Match]) -> list[re.Match]:
    """As many words as make a number that isn't too long."""
    total = 0
    for k, w in enumerate([*chain, None]):
        if w is None or total + len(w.group()) >= CARD_DIGITS.stop:
            return chain[:k] if total in CARD_DIGITS else []
        total += len(w.group())
    return []


def read_card(stream: Stream) -> Iterator[Found]:
    """The nearest number, in groups with hidden places or plain; of two that begin together the longer. A short fifth group may be a suffix."""
    found = []
    for (shape, gap), taken in zip(CARD_WORDS, (_as_groups, _as_number), strict=True):
        words = list(shape.finditer(stream.text))
        chains = (taken(stream.text, _chain(stream.text, words[k:], gap)) for k in range(len(words)))
        found += [next((c for c in chains if c), [])]
    if any(found):
        words = min(filter(None, found), key=lambda c: (c[0].start(), c[0].start() - c[-1].end()))
        groups = [re.sub("[*•]", "X", w.group().upper()) for w in words]
        yield Found("".join(groups), any("X" in g for g in groups), groups[-1] if len(groups) > CARD_FULL and len(groups[-1]) < 3 else None)


def read_iban(stream: Stream) -> Iterator[Found]:
    """As many characters as the country has; whole groups of digits that follow stay, as they make the value wrong."""
    pieces = stream.joined(" \t-\xa0")
    whole = "".join(p.word for p in pieces)
    wanted = ids.iban_length(whole[:2]) if re.match("[A-Z]{2}[0-9]{2}", whole) else None
    if wanted and len(whole) >= wanted and re.match(r"[A-Z]{2}\s*[0-9]{2}", stream.text, re.IGNORECASE):
        taken, extra = 0, ""
        for p in pieces:
            if taken > wanted or taken == wanted and not (p.word.isdigit() and len(extra) + len(p.word) <= 14):
                break
            if taken == wanted:
                extra += p.word
            else:
                taken += len(p.word)
        yield Found(whole[:wanted] + extra)


def read_bic(stream: Stream) -> Iterator[Found]:
    """One run of at least eight characters, or groups of 4, 2, 2 and perhaps 3."""
    pieces = stream.joined(" \t")
    words = [p.word for p in pieces]
    if words and len(words[0]) >= 8:
        yield Found(words[0])
    elif len(words) > 2 and (len(words[0]), len(words[1])) == (4, 2) and len(words[2]) >= 2:
        more = words[3][:3] if len(words) > 3 and len(words[2]) == 2 and len(words[3]) >= 3 else ""
        yield Found(words[0] + words[1] + words[2][:2] + more)


def read_digits(length: int) -> Callable[[Stream], Iterator[Found]]:
    """Exactly so many digits, whatever stands between them."""

    def read(stream: Stream) -> Iterator[Found]:
        run = re.match(r"[0-9](?:[ \t.-]*[0-9])*", stream.text)
        value = "".join(filter(str.isdigit, run.group())) if run else ""
        if len(value) == length:
            yield Found(value)

    return read


def read_vat(stream: Stream) -> Iterator[Found]:
    """One candidate for each length that the country allows."""
    pieces = stream.joined(" \t.-\xa0")
    ends, whole = {}, ""  # how many characters there are up to a place of the stream
    for p in pieces:
        for k in range(len(p.word)):
            ends[len(whole) + k + 1] = p.end - len(p.word) + k + 1
        whole += p.word
    for length in VAT_LENGTHS.get(whole[:2], ()):
        if length in ends:
            rest = stream.text[ends[length] :]
            border = 2 if not rest or rest[0] in "\n\r,;|)/]}" else 1 if re.match(r"[ \t]+[A-Z]{3,}\b", rest, re.IGNORECASE) else 0
            yield Found(whole[:length], border=border)


class Rule(NamedTuple):
    kind: str
    label: re.Pattern
    reach: int
    read: Callable[[Stream], Iterator[Found]]


#: Kinds in the order in which they are listed.
RULES = (
    Rule("card", CARD_LABEL, 80, read_card),
    Rule("iban", IBAN_LABEL, 128, read_iban),
    Rule("bic", BIC_LABEL, 40, read_bic),
    *(Rule(kind, label, 80, read_digits(length)) for kind, (label, length) in DIGIT_LABELS.items()),
    Rule("eu_vat", VAT_LABEL, 80, read_vat),
)
#: Kinds whose value stands in the pattern itself; each occurrence counts.
INLINE = (("ckyc", CKYC), ("micr", MICR))


def identifiers_of(text: str) -> list[tuple]:
    """(kind, value, slot, masked, suffix, border) in order of the kinds; ``slot`` names the label's place in this text."""
    name = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    out = [(rule.kind, f.value, f"{name}:{m.end()}", f.masked, f.suffix, f.border) for rule in RULES for m in rule.label.finditer(text) for f in rule.read(Stream(text, m.end(), rule.reach))]
    return out + [(kind, m[1].upper(), f"{name}:{m.end()}", False, None, 2) for kind, pattern in INLINE for m in pattern.finditer(text)]


def labelled_identifiers(regions: DataFrame, text_col: str = "content") -> DataFrame:
    """(doc_id, page, kind, value, slot, masked, suffix, border) of regions (doc_id, page, text)."""
    source = regions.select("doc_id", "page", text_col)
    schema = T.StructType([source.schema["doc_id"], source.schema["page"], *T.StructType.fromDDL("kind string, value string, slot string, masked boolean, suffix string, border int")])

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = identifiers_of(text or "")
                at += [i] * len(found)
                rows += found
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)


CHECKED = ("card", "iban", "bic", "siret", "siren", "rpps", "finess", "eu_vat")


def chosen(found: DataFrame) -> DataFrame:
    """The extracted rows with ``reasons`` and ``valid``; of a VAT label's candidates one: the longest valid one, else the one that ends most
    clearly, then the longest."""
    check = ids.validated(F.col("kind"), F.col("value"), CHECKED)
    # generated as a row of its own, so that the validators stand in the plan once
    rows = found.select("*", F.inline(F.array(check))).withColumn("valid", F.coalesce("valid", F.lit(False))).withColumnRenamed("country_code", "country").drop("normalized")
    rank = Window.partitionBy("doc_id", "page", "kind", "slot").orderBy(F.desc("valid"), F.desc(F.when(F.col("valid"), F.length("value"))), F.desc("border"), F.desc(F.length("value")), "value")
    # dealt out by document, as all that follows is by document: the rows are made once and move once
    return rows.repartition("doc_id").withColumn("n", F.row_number().over(rank)).where("n = 1 or kind <> 'eu_vat'").drop("n")


def checked_identifiers(found: DataFrame) -> DataFrame:
    """(doc_id, kind, value, page, pages, valid, base_valid, reasons, country, state): distinct values per document, at their first page.

    ``base_valid``: whether a card with a possible suffix is valid without it. Masked cards are indeterminate. CKYC has 14 digits; MICR has nine
    and is checked only beside a CKYC.
    """
    # a valid card number is 13 to 19 digits that pass Luhn's test
    shorter = F.left("value", F.length("value") - F.length("suffix"))
    base = F.when(F.col("suffix").isNotNull(), shorter.rlike("^[0-9]{13,19}$") & ids.luhn_ok(shorter))
    rows = chosen(found).withColumn("base_valid", base)
    per = rows.groupBy("doc_id", "kind", "value").agg(
        F.min("page").alias("page"), F.countDistinct("page").alias("pages"), F.count("*").alias("occurrences"), F.bool_or("masked").alias("masked"), F.max("suffix").alias("suffix"),
        F.bool_or("valid").alias("valid"), F.bool_or("base_valid").alias("base_valid"), F.first("reasons").alias("reasons"), F.first("country").alias("country"),
    )
    indian = F.bool_or(F.col("kind") == "ckyc").over(Window.partitionBy("doc_id"))
    state = (
        F.when(F.col("masked"), "indeterminate")
        .when(F.col("kind") == "ckyc", F.when(F.col("value").rlike("^[SLO]?[0-9]{14}$"), "clear").otherwise("attention"))
        .when(F.col("kind") == "micr", F.when(~F.col("indian"), "detected").when(F.length("value") == 9, "clear").otherwise("attention"))
        .when(F.col("valid") | F.coalesce("base_valid", F.lit(False)), "clear").otherwise("attention")
    )
    return per.withColumn("indian", indian).withColumn("state", state).drop("indian")


# Words for the reasons of an invalid identifier.
REASONS = {
    "invalid_length": "longueur non conforme", "invalid_format": "caracteres ou positions non conformes", "invalid_checksum": "checksum invalide",
    "invalid_institution_code": "code institution invalide", "invalid_country_code": "code pays invalide", "unknown_country_code": "code pays inconnu",
    "invalid_location_code": "code localisation invalide", "invalid_branch_code": "code agence invalide", "invalid_component": "composant invalide",
    "unknown_country_or_structure": "pays inconnu ou structure nationale absente", "invalid_country_structure": "longueur ou structure nationale non conforme",
}


def reason_text(reasons) -> F.Column:
    """The reasons in words, joined by commas."""
    words = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    said = F.array_join(F.transform(reasons, lambda r: F.coalesce(F.try_element_at(words, r), r)), ", ")
    return F.when(F.coalesce(F.size(reasons), F.lit(0)) > 0, said).otherwise("format invalide")


def identifier_observations(checked: DataFrame, geography: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """(doc_id, code, kind, value, page, state, strength, detail, anomaly, occurrences): one observation for each distinct identifier (CKYC and MICR: with
    how often it occurs), one for several cards in a document, and one for Indian fields beside another banking country.

    ``geography``: (doc_id, country) of ``bank_geography``; or ``regions``, from which and from ``checked`` the country is found on the way. What concerns a whole
    document is found by windows, so ``checked`` is read once.
    """
    kind, valid = F.col("kind"), F.col("valid")
    verdict = lambda name, fine: F.concat(F.lit(f"OCR_{name}_"), F.when(fine, "VALID").otherwise("INVALID"))
    card = F.when(F.col("masked"), "OCR_CARD_MASKED").when(valid, "OCR_CARD_LUHN_VALID").when(F.col("base_valid"), "OCR_CARD_SUFFIX_SEPARATED").otherwise("OCR_CARD_LUHN_INVALID")
    code = F.when(kind == "card", card).when(kind == "micr", F.when(F.col("state") == "detected", "OCR_MICR_OBSERVED").otherwise(verdict("MICR", F.col("state") == "clear")))
    code = code.when(kind == "ckyc", verdict("CKYC", F.col("state") == "clear")).otherwise(F.concat(F.lit("OCR_"), F.upper(kind), F.when(valid, "_VALID").otherwise("_INVALID")))
    detail = F.when(F.col("masked"), "masked").when(kind.isin("ckyc", "micr"), F.format_string("%d digits", F.length(F.regexp_replace("value", "[^0-9]", "")))).when(F.col("state") == "attention", reason_text(F.col("reasons")))
    shown = F.when(F.col("state") == "detected", "clear").otherwise(F.col("state"))
    named = F.when((kind == "bic") & (F.col("state") == "clear"), F.col("country")) if geography is None and regions is not None else F.lit(None).cast("string")
    rows = checked.select("doc_id", code.alias("code"), "kind", "value", "page", shown.alias("state"), detail.alias("detail"), "occurrences", (F.col("state") == "attention").alias("anomaly"), "masked", "suffix", named.alias("named"))
    if geography is not None or regions is not None:
        places = geography if geography is not None else branch_countries(regions)
        rows = rows.unionByName(places.select("doc_id", F.col("country").alias("named")), allowMissingColumns=True)
    whole = Window.partitionBy("doc_id")
    plain = (kind == "card") & ~F.col("masked") & F.col("suffix").isNull()
    rows = rows.select(
        "*", F.row_number().over(whole.orderBy("kind", "value")).alias("nth"), F.collect_set(F.when(plain, F.col("value"))).over(whole).alias("cards"), F.min(F.when(plain, F.col("page"))).over(whole).alias("card_page"),
        F.bool_or(kind == "ckyc").over(whole).alias("ckyc"), F.bool_or(kind == "micr").over(whole).alias("micr"), F.min("named").over(whole).alias("least"), F.max("named").over(whole).alias("most"),
    )
    # several plain cards: two of one length that differ in one place are in conflict
    values = F.array_sort("cards")
    one, two = F.get(values, 0), F.get(values, 1)
    differing = F.aggregate(F.arrays_zip(F.split(one, "").alias("a"), F.split(two, "").alias("b")), F.lit(0), lambda n, p: n + (p["a"] != p["b"]).cast("int"))
    conflict = (F.size("cards") == 2) & (F.length(one) == F.length(two)) & (differing == 1)
    observed = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, ("code", "kind", "value", "page", "state", "detail", "occurrences", "anomaly"), strict=True)])
    once = F.lit(1).cast("bigint")
    several = observed(
        F.when(conflict, "OCR_CARD_VALUES_CONFLICT").otherwise("OCR_CARD_MULTIPLE_VALUES"), F.lit("card"), F.array_join(values, ","), F.col("card_page"), F.when(conflict, "attention").otherwise("clear"),
        F.format_string("%d values", F.size("cards")), once, conflict,
    )
    foreign = observed(
        F.when(F.col("micr"), "OCR_BANKING_GEOGRAPHY_MISMATCH").otherwise("OCR_BANKING_FOREIGN_FIELD"), F.lit("ckyc"), F.col("least"), F.lit(None).cast(checked.schema["page"].dataType), F.lit("attention"),
        F.when(F.col("micr"), "CKYC, MICR").otherwise("CKYC"), once, F.lit(True),
    )
    single = observed(*[F.col(n) for n in ("code", "kind", "value", "page", "state", "detail", "occurrences", "anomaly")])
    head = F.col("nth") == 1
    abroad = F.col("ckyc") & (F.col("least") == F.col("most")) & (F.col("least") != "IN")
    found = F.array_compact(F.array(F.when(kind.isNotNull(), single), F.when(head & (F.size("cards") > 1), several), F.when(head & abroad, foreign)))
    out = rows.select("doc_id", F.inline(found))
    strength = F.when(F.col("state") != "attention", "informational").when(F.col("code") == "OCR_BANKING_FOREIGN_FIELD", "weak").otherwise("moderate")
    return out.withColumn("strength", strength)


def identifier_check(observations: DataFrame) -> DataFrame:
    """(doc_id, state, checked, unverifiable, anomalies) of the observations: CKYC and MICR count each occurrence."""
    kinds = F.when(F.col("code").isin("OCR_CARD_VALUES_CONFLICT", "OCR_CARD_MULTIPLE_VALUES", "OCR_BANKING_GEOGRAPHY_MISMATCH", "OCR_BANKING_FOREIGN_FIELD"), 0).when(F.col("kind").isin("ckyc", "micr"), F.col("occurrences")).otherwise(1)
    masked = F.col("code") == "OCR_CARD_MASKED"
    weight = F.when(F.col("kind").isin("ckyc", "micr"), F.col("occurrences")).otherwise(1)
    per = observations.groupBy("doc_id").agg(
        F.sum(F.when(masked, 0).otherwise(kinds)).alias("checked"), F.count_if(masked).alias("unverifiable"), F.sum(F.when(F.col("anomaly"), weight).otherwise(0)).alias("anomalies")
    )
    return per.withColumn("state", F.when(F.col("anomalies") > 0, "attention").otherwise("clear"))


def bank_geography(checked: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, country) where valid BICs and branch addresses name exactly one country."""
    from quillmark.operators.matching import sole_country

    bics = checked.where("kind = 'bic' and state = 'clear'").select("doc_id", F.col("country"))
    return sole_country(bics.unionByName(branch_countries(regions)))


def branch_countries(regions: DataFrame) -> DataFrame:
    """(doc_id, country) of regions with a branch address."""
    key = t.folded(F.col("content"))
    branch = regions.where((key.contains("branch address") | key.contains("account branch")) & key.contains("luxembourg"))
    return branch.select("doc_id", F.lit("LU").alias("country"))
