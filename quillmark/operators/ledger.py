"""Recomputation of statements, ledgers and invoices from parsed cells.

Amounts are decimals; a difference of up to 0.02 is accepted. Windows are partitioned by table, the unit whose rows depend on each
other.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import amounts, bound, dates
from quillmark.functions import text as t

TOLERANCE = Decimal("0.02")
# Header words of the roles, by substring of the folded header.
STATEMENT_HEADERS = {
    "opening": ("opening balance", "beginning balance", "previous balance", "balance brought forward", "solde initial", "solde d ouverture", "ancien solde"),
    "debit": ("total debit", "debit total", "total withdrawals", "total des debits"),
    "credit": ("total credit", "credit total", "total deposits", "total des credits"),
    "closing": ("pending balance", "closing balance", "ending balance", "current balance", "new balance", "solde final", "solde de cloture", "nouveau solde"),
}
LEDGER_HEADERS = {
    "date": ("transaction date", "posting date", "booking date", "date transaction", "date operation", "date comptable", "buchungsdatum"),
    "debit": ("debit", "withdrawal", "retrait", "belastung"),
    "credit": ("credit", "deposit", "versement", "gutschrift"),
    "balance": ("balance", "solde", "kontostand"),
}
INVOICE_LABELS = {
    "subtotal": ("subtotal", "sub total", "total ht", "total hors taxe", "net total", "net amount", "nettobetrag"),
    "tax": ("tva", "vat", "tax", "tax amount", "montant taxe", "mwst", "mehrwertsteuer"),
    "total": ("total ttc", "total toutes taxes comprises", "grand total", "total due", "amount due", "montant a payer", "net a payer", "gesamtbetrag"),
}


def header_column(headers: Column, aliases: tuple[str, ...]) -> Column:
    """Position (from 0) of the first folded header that holds an alias, else null."""
    def hit(h):
        out = F.lit(False)
        for a in aliases:
            out = out | h.contains(a)
        return out

    place = F.array_position(F.transform(headers, hit), True)
    return F.when(place > 0, (place - 1).cast("int"))


def replay_ledger(rows: DataFrame, *keys: str) -> DataFrame:
    """Check each balance against the one before. rows: keys, row_no, date, debit, credit, balance, comparable (boolean).

    Adds checked, mismatch and inversion. Rows without a balance are passed over; a row that isn't comparable (foreign currency) is
    not checked but gives the next one its previous balance. A date that turns against the first direction is an inversion.
    """
    w = Window.partitionBy(*keys).orderBy("row_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prev_balance", F.last("balance", ignorenulls=True).over(before)).withColumn("prev_date", F.last("date", ignorenulls=True).over(before))
    moved = F.col("date").isNotNull() & F.col("prev_date").isNotNull() & (F.col("date") != F.col("prev_date"))
    rows = rows.withColumn("direction", F.when(moved, F.when(F.col("date") > F.col("prev_date"), 1).otherwise(-1)))
    rows = rows.withColumn("first_direction", F.first("direction", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    some = F.col("debit").isNotNull() | F.col("credit").isNotNull()
    checked = F.col("balance").isNotNull() & F.col("prev_balance").isNotNull() & some & F.col("comparable")
    zero = F.lit(Decimal(0))
    expected = F.col("prev_balance") - F.coalesce("debit", zero) + F.coalesce("credit", zero)
    skipped = F.col("balance").isNotNull() & ~F.col("comparable")
    return rows.select(
        *keys, "row_no", checked.alias("checked"),
        F.coalesce(checked & (F.abs(expected - F.col("balance")) > F.lit(TOLERANCE)), F.lit(False)).alias("mismatch"),
        F.coalesce(F.col("direction") != F.col("first_direction"), F.lit(False)).alias("inversion"),
        skipped.alias("skipped"),
    )


def ledger_summary(replayed: DataFrame, *keys: str) -> DataFrame:
    """State per ledger with its counts and, in order, its faulty rows."""
    numbers = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col("row_no"))))
    per = replayed.groupBy(*keys).agg(
        F.count_if("checked").alias("rows_checked"), F.count_if("mismatch").alias("n_mismatch"), F.count_if("inversion").alias("n_inversion"),
        F.count_if("skipped").alias("rows_skipped"), numbers("mismatch").alias("mismatch_rows"), numbers("inversion").alias("inversion_rows"),
    )
    state = (
        F.when((F.col("rows_checked") == 0) & (F.col("n_inversion") == 0), "indeterminate")
        .when((F.col("n_mismatch") == 0) & (F.col("n_inversion") == 0), "clear").otherwise("attention")
    )
    return per.withColumn("state", state)


def balance_check(rows: DataFrame, parts: Column, whole: Column, tolerance=TOLERANCE) -> DataFrame:
    """Adds expected, delta and state of an equation; null if a term is missing."""
    delta = F.abs(parts - whole)
    state = F.when(delta.isNull(), None).when(delta <= F.lit(tolerance), "clear").otherwise("attention")
    return rows.withColumn("expected", parts).withColumn("delta", delta).withColumn("state", state)


def invoice_totals(cells: DataFrame, *keys: str) -> DataFrame:
    """subtotal, tax and total per table from label rows (keys, row_ix, label folded, amount): the last matching row of a class."""
    out = []
    for name, aliases in INVOICE_LABELS.items():
        hit = F.lit(False)
        for a in aliases:
            hit = hit | F.col("label").contains(a)
        keep = hit & F.col("amount").isNotNull()
        out.append(F.max_by(F.when(keep, F.col("amount")), F.when(keep, F.col("row_ix"))).alias(name))
    per = cells.groupBy(*keys).agg(*out).where("subtotal is not null and tax is not null and total is not null")
    return balance_check(per, F.col("subtotal") + F.col("tax"), F.col("total"))


def _placed(tables: DataFrame, roles: dict[str, tuple[str, ...]]) -> DataFrame:
    """Tables with a column for the place of each role; those without all of them are left out. Headers are folded once a table."""
    places = lambda h: F.struct(*[header_column(h, aliases).alias(f"{name}_at") for name, aliases in roles.items()])
    rows = tables.where(F.size("rows") >= 2).select("doc_id", "table_ix", "rows", F.inline(F.array(bound(F.transform(F.get("rows", 0), t.folded), places))))
    return rows.where(" and ".join(f"{name}_at is not null" for name in roles))


def _amounts(cells: list[Column], names: tuple[str, ...]) -> Column:
    """A struct of the cells' amounts, the parser standing once in the plan."""
    return bound(F.transform(F.array(*cells), amounts.table_amount), lambda a: F.struct(*[F.get(a, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def statement_observations(tables: DataFrame) -> DataFrame:
    """(doc_id, table_ix, expected, observed, delta, state) of tables (doc_id, table_ix, rows) whose headers name all four totals of a statement.

    The first row after the headers is read; a table with a missing or unreadable total gives no row.
    """
    names = tuple(STATEMENT_HEADERS)
    cells = [F.get(F.get("rows", 1), F.col(f"{n}_at")) for n in names]
    rows = _placed(tables, STATEMENT_HEADERS).select("doc_id", "table_ix", F.inline(F.array(_amounts(cells, names))))
    checked = balance_check(rows.dropna(subset=list(names)), F.col("opening") - F.col("debit") + F.col("credit"), F.col("closing"))
    return checked.select("doc_id", "table_ix", "expected", F.col("closing").alias("observed"), "delta", "state")


def ledger_rows(tables: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows of ledger tables for ``replay_ledger``: doc_id, table_ix, row_no, date, debit, credit, balance, comparable.

    accounts: doc_id, currency (null if unknown). Rows too short for the named columns are left out; a row in another currency than the account's
    isn't comparable.
    """
    places = [F.col(f"{n}_at") for n in LEDGER_HEADERS]
    wide = _placed(tables, LEDGER_HEADERS).withColumn("last_at", F.greatest(*places))
    rows = wide.select("doc_id", "table_ix", "last_at", *places, F.posexplode("rows").alias("row_no", "cells")).where((F.col("row_no") > 0) & (F.size("cells") > F.col("last_at")))
    cell = lambda n: F.get("cells", F.col(f"{n}_at"))
    money = ("debit", "credit", "balance")
    said = F.get(F.array_compact(F.transform(F.array(cell("debit"), cell("credit")), amounts.explicit_currency)), 0)
    rows = rows.select("doc_id", "table_ix", "row_no", dates.first_date(F.trim(cell("date"))).alias("date"), said.alias("said"), F.inline(F.array(_amounts([cell(n) for n in money], money))))
    rows = rows.join(accounts.select("doc_id", "currency"), "doc_id", "left")
    return rows.select("doc_id", "table_ix", "row_no", "date", *money, (F.col("said").isNull() | F.coalesce(F.col("said") == F.col("currency"), F.lit(False))).alias("comparable"))


def invoice_cells(tables: DataFrame) -> DataFrame:
    """Label rows for ``invoice_totals``: the first cell folded, and the last readable amount after it."""
    rows = tables.select("doc_id", "table_ix", F.posexplode("rows").alias("row_ix", "cells")).where(F.size("cells") > 0)
    values = F.array_compact(F.transform(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))), amounts.table_amount))
    return rows.select("doc_id", "table_ix", "row_ix", t.folded(F.get("cells", 0)).alias("label"), F.try_element_at(values, F.lit(-1)).alias("amount"))


def financial_observations(tables: DataFrame, accounts: DataFrame) -> DataFrame:
    """(doc_id, table_ix, code, state, strength) of all formulas that a document's tables allow."""
    statement = statement_observations(tables).select("doc_id", "table_ix", F.lit("STATEMENT_SUMMARY").alias("name"), "state")
    replayed = ledger_summary(replay_ledger(ledger_rows(tables, accounts), "doc_id", "table_ix"), "doc_id", "table_ix")
    invoice = invoice_totals(invoice_cells(tables), "doc_id", "table_ix").select("doc_id", "table_ix", F.lit("INVOICE_TOTAL").alias("name"), "state")
    every = statement.unionByName(replayed.select("doc_id", "table_ix", F.lit("LEDGER").alias("name"), "state")).unionByName(invoice)
    ending = F.when(F.col("state") == "clear", "_VALID").when(F.col("state") == "indeterminate", "_INDETERMINATE").otherwise("_MISMATCH")
    return every.select("doc_id", "table_ix", F.concat(F.lit("OCR_"), "name", ending).alias("code"), "state", F.when(F.col("state") == "attention", "strong").otherwise("informational").alias("strength"))


def financial_check(documents: DataFrame, tables: DataFrame, accounts: DataFrame) -> DataFrame:
    """(doc_id, checks, anomalies, state): not applicable without a table, indeterminate without a formula that applies."""
    found = financial_observations(tables, accounts).groupBy("doc_id").agg(F.count("*").alias("checks"), F.count_if(F.col("state") == "attention").alias("anomalies"))
    with_tables = tables.select("doc_id").distinct().withColumn("tables", F.lit(True))
    rows = documents.select("doc_id").join(with_tables, "doc_id", "left").join(found, "doc_id", "left")
    state = F.when(F.col("tables").isNull(), "not_applicable").when(F.col("checks").isNull(), "indeterminate").when(F.col("anomalies") > 0, "attention").otherwise("clear")
    return rows.select("doc_id", F.coalesce("checks", F.lit(0)).alias("checks"), F.coalesce("anomalies", F.lit(0)).alias("anomalies"), state.alias("state"))
