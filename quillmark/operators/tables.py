"""Tables in recognised text: HTML and Markdown parsing to cells, and column roles.

HTML tables have spans and nested markup, so they are parsed in an Arrow batch function; Markdown tables and roles are expressions.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillmark.functions import text as t

SPAN_MOST, CELL_MOST = 40, 500
# Roles in order of precedence, with the patterns of their folded headers.
ROLES = (
    ("value_date", r"\bvalue date\b|\bdate (?:de )?valeur\b|\bvalutadatum\b"),
    ("transaction_date", r"\btransaction date\b|\bbooking date\b|\bdate (?:operation|transaction|comptable)\b|\bbuchungsdatum\b|\bdatum\b|^date$"),
    ("description", r"\bdescription\b|\blibelle\b|\bdesignation\b|\bparticulars?\b|\bdetails?\b|\bmerchant\b|\bbeneficiaire\b|\bverwendungszweck\b|\bbeschreibung\b"),
    ("debit_amount", r"\bdebits?\b|\bdebit amount\b|\bwithdrawals?\b|\bsoll\b"),
    ("credit_amount", r"\bcredits?\b|\bcredit amount\b|\bdeposits?\b|\bhaben\b"),
    ("balance", r"\bbalance\b|\bsolde\b|\bsaldo\b"),
    ("currency", r"\bcurrency\b|\bdevise\b|\bwaehrung\b"),
    ("quantity", r"\bquantity\b|\bquantite\b|\bqty\b|\bqte\b|\bmenge\b"),
    ("unit_price", r"\bunit price\b|\bprix unitaire\b|\bprice per unit\b|\beinzelpreis\b"),
    ("tax_rate", r"\btax rate\b|\bvat rate\b|\btaux (?:de )?(?:tva|taxe)\b|\bmwst ?%"),
    ("tax_amount", r"\btax amount\b|\bvat amount\b|\bmontant (?:de )?(?:tva|taxe)\b"),
    ("service_code", r"\bservice code\b|\bcode (?:service|prestation|acte)\b"),
    ("product_code", r"\bproduct code\b|\bcode produit\b|\bproduct reference\b|\bsku\b"),
    ("line_total", r"\b(?:line total|total ligne|gesamtpreis)\b"),
)
LINE_TABLES = ("invoice_lines", "services", "products")


def column_role(header: Column, table_type: Column) -> Column:
    """Role of a column from its header, ``other`` if the header doesn't say."""
    s = t.folded(header)
    out = F.when(s == "", "other")
    for role, pattern in ROLES:
        out = out.when(s.rlike(pattern), role)
    amount = F.when(table_type.isin(*LINE_TABLES), "line_total").otherwise("amount")
    return out.when(s.rlike(r"\b(?:amount|montant|betrag|value)\b") | s.isin("total", "gesamt"), amount).otherwise("other")


def markdown_rows(text: Column) -> Column:
    """array<array<string>> of the first run of piped lines whose second line is a separator; the separator is left out."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: F.instr(s, "|") > 0)
    cells = F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(F.regexp_replace(s, r"^\|", ""), r"\|$", ""), r"\|"), lambda c: F.trim(c)))
    separator = F.forall(F.get(cells, 1), lambda c: c.rlike(r"^:?-{3,}:?$"))
    fine = (F.size(cells) >= 2) & F.coalesce(separator, F.lit(False))
    return F.when(fine, F.concat(F.slice(cells, 1, 1), F.slice(cells, F.lit(3), F.greatest(F.size(cells) - 2, F.lit(0)))))


class _Cells(HTMLParser):
    """Rows of cells (text, is_header, colspan, rowspan) of every table, nested ones apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append([self.tables[-1], None])
        elif self.open and tag == "tr":
            self.open[-1][0].append([])
            self.open[-1][1] = None
        elif self.open and tag in ("td", "th"):
            rows = self.open[-1][0]
            if not rows:
                rows.append([])
            spans = dict(attrs)
            number = lambda k: min(SPAN_MOST, max(1, int(spans[k]))) if (spans.get(k) or "").isdigit() else 1
            self.open[-1][1] = cell = [[], tag == "th", number("colspan"), number("rowspan")]
            rows[-1].append(cell)
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr"):
            self.open[-1][1] = None
        elif self.open and tag == "table":
            self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1][1] is not None:
            self.open[-1][1][0].append(data)


def html_tables(markup: str) -> list[tuple[list[str], list[list[str]]]]:
    """(headers, rows) of every table: spans filled in, header levels joined by `` / `` without repeats, empty rows dropped."""
    parser = _Cells()
    parser.feed(markup)
    parser.close()
    out = []
    for table in parser.tables:
        grid: list[dict[int, tuple[str, bool]]] = [{} for _ in table]
        for r, row in enumerate(table):
            c = 0
            for parts, head, wide, tall in row:
                while c in grid[r]:
                    c += 1
                text = " ".join("".join(parts).split())[:CELL_MOST]
                for y in range(r, min(len(table), r + tall)):
                    for x in range(c, c + wide):
                        grid[y].setdefault(x, (text, head))
                c += wide
        width = max((max(g, default=-1) + 1 for g in grid), default=0)
        full = [[g.get(x, ("", False)) for x in range(width)] for g in grid]
        full = [row for row in full if any(c[0] for c in row)]
        n_heads = next((i for i, row in enumerate(full) if not all(c[1] or not c[0] for c in row)), len(full))
        headers = [" / ".join(dict.fromkeys(full[i][x][0] for i in range(n_heads) if full[i][x][0])) for x in range(width)] if n_heads else []
        out.append((headers, [[c[0] for c in row] for row in full[n_heads:]]))
    return out


def html_cells(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table_ix, row_ix, col_ix, is_header, text) of every table in the column; row 0 holds the headers."""
    source = df.select(id_col, html_col).where(F.lower(html_col).contains("<table"))
    schema = T.StructType([source.schema[id_col], *T.StructType.fromDDL("table_ix int, row_ix int, col_ix int, is_header boolean, text string")])

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, markup in enumerate(batch.column(1).to_pylist()):
                for k, (headers, body) in enumerate(html_tables(markup or "")):
                    for r, cells in enumerate([headers, *body]):
                        for c, text in enumerate(cells):
                            at.append(i)
                            rows.append((k, r, c, r == 0, text))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, x) for c, x in zip(cols, types, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)


def best_tables(cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The cells of each document's richest table: most cells and headers together, the first on ties. cells as of ``html_cells``."""
    # dealt out once by document: the cells are made once, and what follows by table stays where it is
    placed = cells.repartition(id_col).withColumn("size", F.count("*").over(Window.partitionBy(id_col, "table_ix")))
    best = F.max(F.struct("size", -F.col("table_ix"))).over(Window.partitionBy(id_col))
    return placed.withColumn("best", best).where(-F.col("table_ix") == F.col("best")["col2"]).drop("size", "best")


def table_rows(cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, table_ix, rows array<array<string>>) of cells; row 0 holds the headers. A table is bounded by the caps on rows and columns."""
    per_row = cells.groupBy(id_col, "table_ix", "row_ix").agg(F.array_sort(F.collect_list(F.struct("col_ix", "text"))).alias("cells"))
    per = per_row.groupBy(id_col, "table_ix").agg(F.array_sort(F.collect_list(F.struct("row_ix", F.transform("cells", lambda c: c["text"]).alias("texts")))).alias("rows"))
    return per.select(id_col, "table_ix", F.transform("rows", lambda r: r["texts"]).alias("rows"))
