"""Checks of whole documents: labelled identifiers, statements, file structure, page limits, image routing, field values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import values
from quillmark.operators import geometry, labelled, ledger, limits, manifests, page_objects, regions, software, tables
from quillmark.plans import query, spread, table
from quillmark.plans.content import _LUHN, _LUHN_SIREN, _MOD97

# Texts of one region a customer; both sides build them, then each reads the identifiers out of the text by its own means.
_DOSSIER = """select c_custkey doc_id, 'Dossier ' || c_name || chr(10) || 'SIREN: ' || lpad((c_custkey * 791993 % 1000000000)::bigint::varchar, 9, '0') || ' ; carte bancaire ' || num
  || case when c_custkey % 5 = 0 then ' ; carte bancaire ' || left(num, 15) || ((right(num, 1)::int + 1) % 10)::varchar when c_custkey % 5 = 1 then ' ; carte bancaire ' || reverse(num) else '' end
  || case when c_custkey % 3 = 0 then ' ; CKYC NO : S' || left(num || num, 13 + (c_custkey % 2)::int) else '' end || case when c_custkey % 4 < 2 then ' ; MICR CODE: ' || left(num, 8 + (c_custkey % 2)::int) else '' end
  || case when c_custkey % 4 = 2 then ' ; IBAN NO LU28 0019 4006 4475 0000' || case when c_custkey % 8 = 2 then ' 12' else '' end else '' end
  || case when c_custkey % 2 = 0 then ' ; BIC: CCPL LU LL' else '' end as content
  from (select *, '4' || lpad((c_custkey * 99991 % 1000000)::bigint::varchar, 6, '0') || lpad((c_custkey * 7919 % 1000000000)::bigint::varchar, 9, '0') num from customer)"""
_FINDINGS = f"""with c as ({_DOSSIER})
  , cards as (select distinct doc_id, unnest(regexp_extract_all(content, 'carte bancaire ([0-9]+)', 1)) s from c)
  , one as (select doc_id, regexp_extract(content, 'SIREN: ([0-9]+)', 1) siren, regexp_extract(content, 'CKYC NO : ([SLO]?[0-9]+)', 1) ckyc, regexp_extract(content, 'MICR CODE: ([0-9]+)', 1) micr,
      replace(regexp_extract(content, 'IBAN NO ([A-Z0-9 ]+)', 1), ' ', '') iban, replace(regexp_extract(content, 'BIC: ([A-Z]{{4}} [A-Z]{{2}} [A-Z]{{2}})', 1), ' ', '') bic from c)
  , f as (
    select doc_id, 'OCR_CARD_LUHN_' || case when {_LUHN} then 'VALID' else 'INVALID' end code, s as value from cards
    union all select doc_id, case when count(*) = 2 and list_sum(list_transform(range(1, 17), lambda i: (substr(min(s), i, 1) <> substr(max(s), i, 1))::int)) = 1 then 'OCR_CARD_VALUES_CONFLICT' else 'OCR_CARD_MULTIPLE_VALUES' end,
      string_agg(s, ',' order by s) from cards group by doc_id having count(*) > 1
    union all select doc_id, 'OCR_SIREN_' || case when {_LUHN} then 'VALID' else 'INVALID' end, s from (select doc_id, siren s from one)
    union all select doc_id, 'OCR_CKYC_' || case when length(regexp_replace(ckyc, '[SLO]', '')) = 14 then 'VALID' else 'INVALID' end, ckyc from one where ckyc <> ''
    union all select doc_id, case when ckyc = '' then 'OCR_MICR_OBSERVED' when length(micr) = 9 then 'OCR_MICR_VALID' else 'OCR_MICR_INVALID' end, micr from one where micr <> ''
    union all select doc_id, 'OCR_IBAN_' || case when length(s) = 20 and {_MOD97} then 'VALID' else 'INVALID' end, s from (select doc_id, iban s from one where iban <> '')
    union all select doc_id, 'OCR_BIC_VALID', bic from one where bic <> ''
    union all select doc_id, case when micr <> '' then 'OCR_BANKING_GEOGRAPHY_MISMATCH' else 'OCR_BANKING_FOREIGN_FIELD' end, substr(bic, 5, 2) from one where bic <> '' and ckyc <> '')
  , o as (select *, case when code in ('OCR_CARD_VALUES_CONFLICT', 'OCR_BANKING_GEOGRAPHY_MISMATCH', 'OCR_BANKING_FOREIGN_FIELD') or code like '%\\_INVALID' escape '\\' then 'attention' else 'clear' end state from f)"""


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    digits = lambda factor, size: F.lpad((key * factor % 10**size).cast("bigint").cast("string"), size, "0")
    num = F.concat(F.lit("4"), digits(99991, 6), digits(7919, 9))
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", "c_name", num.alias("num"))
    other = F.when(key % 5 == 0, F.concat(F.lit(" ; carte bancaire "), F.left("num", F.lit(15)), ((F.right("num", F.lit(1)).cast("int") + 1) % 10).cast("string")))
    other = other.when(key % 5 == 1, F.concat(F.lit(" ; carte bancaire "), F.reverse("num"))).otherwise("")
    ckyc = F.when(key % 3 == 0, F.concat(F.lit(" ; CKYC NO : S"), F.left(F.concat("num", "num"), (F.lit(13) + key % 2).cast("int")))).otherwise("")
    micr = F.when(key % 4 < 2, F.concat(F.lit(" ; MICR CODE: "), F.left("num", (F.lit(8) + key % 2).cast("int")))).otherwise("")
    iban = F.when(key % 4 == 2, F.concat(F.lit(" ; IBAN NO LU28 0019 4006 4475 0000"), F.when(key % 8 == 2, " 12").otherwise(""))).otherwise("")
    bic = F.when(key % 2 == 0, " ; BIC: CCPL LU LL").otherwise("")
    content = F.concat(F.lit("Dossier "), "c_name", F.lit("\nSIREN: "), digits(791993, 9), F.lit(" ; carte bancaire "), "num", other, ckyc, micr, iban, bic)
    texts = rows.select(key.alias("doc_id"), F.lit(1).alias("page"), content.alias("content"))
    checked = labelled.checked_identifiers(labelled.labelled_identifiers(texts))
    return labelled.identifier_observations(checked, regions=texts)


@query(_FINDINGS + " select doc_id, code, value, state, case when state <> 'attention' then 'informational' when code = 'OCR_BANKING_FOREIGN_FIELD' then 'weak' else 'moderate' end strength from o")
def identifier_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir).select("doc_id", "code", "value", "state", "strength")


@query(
    _FINDINGS + """ select doc_id, count(*) filter (code not in ('OCR_CARD_VALUES_CONFLICT', 'OCR_CARD_MULTIPLE_VALUES', 'OCR_BANKING_GEOGRAPHY_MISMATCH', 'OCR_BANKING_FOREIGN_FIELD')) checked,
  count(*) filter (state = 'attention') anomalies, case when count(*) filter (state = 'attention') > 0 then 'attention' else 'clear' end state from o group by doc_id"""
)
def identifier_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled.identifier_check(_observations(spark, sf_dir)).select("doc_id", "checked", "anomalies", "state")


# Registrations of a company and of health professionals, grouped by spaces in half of the texts.
_REGISTERED = r"""select c_custkey doc_id, 'N° SIRET : ' || case when c_custkey % 2 = 0 then left(siren, 3) || ' ' || substr(siren, 4, 3) || ' ' || right(siren, 3) || ' ' || nic else siren || nic end || chr(10) || 'RPPS ' || rpps || ', FINESS ET ' || finess
    || chr(10) || 'N° TVA intracommunautaire ' || vat as content
  from (select *, case c_custkey % 3 when 0 then 'FR ' || lpad(((siren::bigint * 100 + 12 + c_custkey % 2) % 97)::varchar, 2, '0') || ' ' || siren when 1 then 'LU' || six || lpad(((six::bigint % 89 + c_custkey % 2) % 100)::varchar, 2, '0')
      else 'BE 0' || seven || lpad((97 - seven::bigint % 97 - c_custkey % 2)::varchar, 2, '0') end vat
    from (select c_custkey, lpad((c_custkey * 791993 % 1000000000)::bigint::varchar, 9, '0') siren, lpad((c_custkey * 7919 % 100000)::bigint::varchar, 5, '0') nic, '1' || lpad((c_custkey * 99991 % 10000000000)::bigint::varchar, 10, '0') rpps,
      lpad((c_custkey * 31337 % 1000000000)::bigint::varchar, 9, '0') finess, lpad((c_custkey * 777 % 1000000)::bigint::varchar, 6, '0') six, lpad((c_custkey * 104729 % 10000000)::bigint::varchar, 7, '0') seven from customer))"""


@query(
    rf"""with c as ({_REGISTERED}), o as (select doc_id, regexp_replace(regexp_extract(content, 'SIRET : ([0-9 ]+)', 1), ' ', '', 'g') siret, regexp_extract(content, 'RPPS ([0-9]+)', 1) rpps, regexp_extract(content, 'FINESS ET ([0-9]+)', 1) finess,
      regexp_replace(regexp_extract(content, 'TVA intracommunautaire ([A-Z0-9 ]+)', 1), ' ', '', 'g') vat from c)
  , v as (select doc_id, 'SIRET' kind, s as value, {_LUHN} and {_LUHN_SIREN} valid from (select doc_id, siret s from o)
    union all select doc_id, 'RPPS', s, {_LUHN} from (select doc_id, rpps s from o) union all select doc_id, 'FINESS', s, {_LUHN} from (select doc_id, finess s from o)
    union all select doc_id, 'EU_VAT', vat, case left(vat, 2) when 'FR' then (substr(vat, 5)::bigint * 100 + 12) % 97 = substr(vat, 3, 2)::int when 'LU' then substr(vat, 3, 6)::int % 89 = right(vat, 2)::int
      else 97 - substr(vat, 3, 8)::int % 97 = right(vat, 2)::int end from o)
  select doc_id, 'OCR_' || kind || case when valid then '_VALID' else '_INVALID' end code, value, case when valid then 'clear' else 'attention' end state from v"""
)
def registration_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    digits = lambda factor, size: F.lpad((key * factor % 10**size).cast("bigint").cast("string"), size, "0")
    number = lambda c: F.col(c).cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", digits(791993, 9).alias("siren"), digits(7919, 5).alias("nic"), F.concat(F.lit("1"), digits(99991, 10)).alias("rpps"), digits(31337, 9).alias("finess"), digits(777, 6).alias("six"), digits(104729, 7).alias("seven"))
    vat = F.when(key % 3 == 0, F.concat(F.lit("FR "), two((number("siren") * 100 + 12 + key % 2) % 97), F.lit(" "), "siren")).when(key % 3 == 1, F.concat(F.lit("LU"), "six", two((number("six") % 89 + key % 2) % 100)))
    vat = vat.otherwise(F.concat(F.lit("BE 0"), "seven", two(97 - number("seven") % 97 - key % 2)))
    siret = F.when(key % 2 == 0, F.concat_ws(" ", F.left("siren", F.lit(3)), F.substr("siren", F.lit(4), F.lit(3)), F.right("siren", F.lit(3)), "nic")).otherwise(F.concat("siren", "nic"))
    content = F.concat(F.lit("N° SIRET : "), siret, F.lit("\nRPPS "), "rpps", F.lit(", FINESS ET "), "finess", F.lit("\nN° TVA intracommunautaire "), vat)
    texts = rows.select(key.alias("doc_id"), F.lit(1).alias("page"), content.alias("content"))
    return labelled.identifier_observations(labelled.checked_identifiers(labelled.labelled_identifiers(texts))).select("doc_id", "code", "value", "state")


# Statement tables as cells of text; the SQL reads the numbers back out of the cells.
_STATEMENT = """select c_custkey doc_id, round(c_acctbal, 2)::decimal(18, 2)::varchar opening, coalesce(sum(round(o_totalprice, 2)::decimal(18, 2)), 0)::decimal(18, 2) paid, (c_custkey % 1000)::varchar || ',50' credit,
    round(c_acctbal, 2)::decimal(18, 2) - coalesce(sum(round(o_totalprice, 2)::decimal(18, 2)), 0) + (c_custkey % 1000)::decimal(18, 2) + 0.5 + (ascii(right(c_name, 1)) % 5 - 2) * 0.01 closing
  from customer left join orders on c_custkey = o_custkey group by c_custkey, c_acctbal, c_name"""
_CELLS = f"with s as (select doc_id, opening, paid::decimal(18, 2)::varchar debit, credit, closing::decimal(18, 2)::varchar closing from ({_STATEMENT}))"
_READ = _CELLS + ", r as (select doc_id, opening::decimal(18, 2) - debit::decimal(18, 2) + replace(credit, ',', '.')::decimal(18, 2) expected, closing::decimal(18, 2) observed from s)"


def _statement_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = "decimal(18,2)"
    paid = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round("o_totalprice", 2).cast(money)).cast(money).alias("paid"))
    rows = table(spark, sf_dir, "customer").join(paid, "c_custkey", "left")
    opening, debit = F.round("c_acctbal", 2).cast(money), F.coalesce("paid", F.lit(0).cast(money)).cast(money)
    fault = ((F.ascii(F.right("c_name", F.lit(1))) % 5 - 2) * F.lit(0.01)).cast(money)
    closing = (opening - debit + (F.col("c_custkey") % 1000).cast(money) + F.lit(0.5).cast(money) + fault).cast(money)
    cells = F.array(opening.cast("string"), debit.cast("string"), F.concat((F.col("c_custkey") % 1000).cast("string"), F.lit(",50")), closing.cast("string"))
    head = F.array(*map(F.lit, ("Ancien solde", "Total des débits", "Total des crédits", "Nouveau solde")))
    return rows.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("table_ix"), F.array(head, cells).alias("rows"))


@query(_READ + " select doc_id, expected::double expected, observed::double observed, case when abs(expected - observed) <= 0.02 then 'clear' else 'attention' end state from r")
def statement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.statement_observations(_statement_cells(spark, sf_dir))
    return out.select("doc_id", F.col("expected").cast("double").alias("expected"), F.col("observed").cast("double").alias("observed"), "state")


# A document has by turns a statement, an invoice, a ledger, an unknown table, and no table.
_CHECKS = (
    _READ + """, i as (select o_custkey doc_id, (sum(round(l_extendedprice * 100)::bigint) / 100.0)::decimal(18, 2)::varchar net, (count(*) * 1.25)::decimal(18, 2)::varchar tax,
      ((sum(round(l_extendedprice * 100)::bigint) + count(*) * 125 + case when count(*) % 3 = 0 then 5 else 0 end) / 100.0)::decimal(18, 2)::varchar total from orders join lineitem on o_orderkey = l_orderkey group by o_custkey)
  , l as (select o_custkey doc_id, row_number() over w n, strftime(o_orderdate, '%Y-%m-%d') d, (o_orderkey % 100)::varchar || '.00' credit, sum(o_orderkey % 100) over w + case when o_orderkey % 17 = 3 then 1 else 0 end || '.00' balance
      from orders window w as (partition by o_custkey order by o_orderkey))
  , p as (select doc_id, d::date d, credit::decimal(18, 2) credit, balance::decimal(18, 2) balance, n, lag(balance::decimal(18, 2)) over w before, lag(d::date) over w prior from l window w as (partition by doc_id order by n))
  , q as (select *, case when d > prior then 1 when d < prior then -1 end turn from p), t as (select *, first_value(turn ignore nulls) over (partition by doc_id order by n rows between unbounded preceding and current row) first_turn from q)
  , g as (select doc_id, count(before) checked, count(*) filter (abs(before + credit - balance) > 0.02) + count(*) filter (turn <> first_turn) faults, count(*) filter (turn <> first_turn) inversions from t group by doc_id)
  select c_custkey doc_id, case c_custkey % 5 when 0 then 1 when 1 then (net is not null)::int when 2 then (g.doc_id is not null)::int else 0 end checks,
    case c_custkey % 5 when 0 then (abs(expected - observed) > 0.02)::int when 1 then coalesce((abs(net::decimal(18, 2) + tax::decimal(18, 2) - total::decimal(18, 2)) > 0.02)::int, 0) when 2 then coalesce((faults > 0)::int, 0) else 0 end anomalies,
    case c_custkey % 5 when 0 then case when abs(expected - observed) > 0.02 then 'attention' else 'clear' end
      when 1 then case when net is null then 'not_applicable' when abs(net::decimal(18, 2) + tax::decimal(18, 2) - total::decimal(18, 2)) > 0.02 then 'attention' else 'clear' end
      when 2 then case when g.doc_id is null then 'not_applicable' when faults > 0 then 'attention' else 'clear' end when 3 then 'indeterminate' else 'not_applicable' end state
  from customer join r on r.doc_id = c_custkey left join i on i.doc_id = c_custkey left join g on g.doc_id = c_custkey"""
)


@query(_CHECKS)
def financial_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders, items = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    money = lambda cents: (cents / 100).cast("decimal(18,2)").cast("string")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100, 0).cast("bigint")).alias("net")
    invoices = orders.join(items, orders.o_orderkey == items.l_orderkey).groupBy(F.col("o_custkey").alias("doc_id")).agg(cents, F.count("*").alias("n"))
    line = lambda label, value: F.array(F.lit(label), F.lit(""), value)
    total = F.col("net") + F.col("n") * 125 + F.when(F.col("n") % 3 == 0, 5).otherwise(0)
    invoices = invoices.select("doc_id", F.lit(0).alias("table_ix"), F.array(line("Libellé", F.lit("Montant")), line("Total HT", money(F.col("net"))), line("TVA", money(F.col("n") * 125)), line("Net à payer", money(total))).alias("rows"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    running = F.sum(F.col("o_orderkey") % 100).over(w) + F.when(F.col("o_orderkey") % 17 == 3, 1).otherwise(0)
    whole = lambda n: F.concat(n.cast("bigint").cast("string"), F.lit(".00"))
    booked = orders.select(
        F.col("o_custkey").alias("doc_id"),
        F.struct(F.row_number().over(w).alias("n"), F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(""), whole(F.col("o_orderkey") % 100), whole(running)).alias("cells")).alias("row"),
    )
    head = F.array(*map(F.lit, ("Date opération", "Débit", "Crédit", "Solde")))
    ledgers = booked.groupBy("doc_id").agg(F.array_sort(F.collect_list("row")).alias("r")).select("doc_id", F.lit(0).alias("table_ix"), F.concat(F.array(head), F.transform("r", lambda x: x["cells"])).alias("rows"))
    unknown = customer.where("c_custkey % 5 = 3").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("table_ix"), F.array(F.array(F.lit("Name")), F.array(F.col("c_name"))).alias("rows"))
    every = _statement_cells(spark, sf_dir).where("doc_id % 5 = 0").unionByName(invoices.where("doc_id % 5 = 1")).unionByName(ledgers.where("doc_id % 5 = 2")).unionByName(unknown)
    docs = customer.select(F.col("c_custkey").alias("doc_id"))
    return ledger.financial_check(docs, every, docs.withColumn("currency", F.lit("EUR")))


_MARK = "/Type /Sig"


@query(
    f"""with f as (select p_partkey doc_id, '%PDF-1.7 ' || p_name || repeat('{_MARK} ', (p_size % 3)::int) || repeat('%%EOF', (p_size % 4)::int) || case when p_size % 4 > 0 and p_size % 5 = 0 then chr(10) || p_brand || ' ' else ' ' end as content, p_size % 4 revisions, p_size % 5 = 0 as tail,
      make_date(2020 + (p_size % 3)::int, 5, 1) created, make_date(2020 + (p_partkey % 3)::int, 5, 2) modified, p_brand from part), s as (select *, (length(content) - length(replace(content, '{_MARK}', ''))) / {len(_MARK)} signed from f)
  , every as (select doc_id, 'PDF_INCREMENTAL_UPDATES' code, case when signed > 0 then least(4.0, least(15.0, 8 + 3.0 * (revisions - 1))) else least(15.0, 8 + 3.0 * (revisions - 1)) end points, revisions - 1 amount from s where revisions > 1
    union all select doc_id, 'PDF_DATE_CONTRADICTION', 15.0, 0 from s where modified < created
    union all select doc_id, 'PDF_TRAILING_DATA', 12.0, length(split_part(content, '%%EOF' || chr(10), 2)) - 1 from s where revisions > 0 and tail)
  select doc_id, code, points::double risk_points, amount::bigint amount from every"""
)
def structure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, parts = F.col("p_size"), table(spark, sf_dir, "part")
    body = F.concat(F.lit("%PDF-1.7 "), "p_name", F.call_function("repeat", F.lit(_MARK + " "), (size % 3).cast("int")))
    marked = F.concat(body, F.call_function("repeat", F.lit("%%EOF"), (size % 4).cast("int")))
    tail = F.when((size % 4 > 0) & (size % 5 == 0), F.concat(F.lit("\n"), "p_brand", F.lit(" "))).otherwise(" ")
    ends = F.transform(F.slice(F.sequence(F.lit(0), F.lit(4)), F.lit(2), (size % 4).cast("int")), lambda k: (F.length(body) + 5 * k).cast("bigint"))
    stamp = lambda year, day: F.format_string("D:%d05%02d120000Z", year, F.lit(day))
    files = parts.select(
        F.col("p_partkey").alias("doc_id"), F.encode(F.concat(marked, tail), "ISO-8859-1").alias("content"), ends.alias("ends"),
        stamp((F.lit(2020) + size % 3).cast("int"), 1).alias("created"), stamp((F.lit(2020) + F.col("p_partkey") % 3).cast("int"), 2).alias("modified"),
    )
    return software.structure_findings(files).select("doc_id", "code", "risk_points", "amount")


@query(
    """with p as (select l_suppkey doc_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) page from lineitem)
  select doc_id, count(*) pages, count(*) filter (page <= 25) analysed from p group by doc_id"""
)
def page_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    return limits.page_counts(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), place.alias("page")))


_TIMELINE = """with t as (select o_custkey doc_id, row_number() over (partition by o_custkey order by o_orderkey) transition, o_orderkey, 3 + o_orderkey % 4 pages_before, 3 + o_orderkey % 5 pages_after from orders)
  , d as (select doc_id, transition, l_linenumber page, l_tax changed, l_suppkey % 3 regions from t join lineitem on l_orderkey = o_orderkey)
  , c as (select doc_id, transition, count(*) n from d join t using (doc_id, transition) where regions > 0 and page <= least(pages_before, pages_after, 4) group by all)
  , r as (select t.doc_id, t.transition, pages_before <> pages_after page_count_changed, coalesce(n, 0) n from t left join c using (doc_id, transition))"""


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    nth, key = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")), F.col("o_orderkey")
    steps = orders.select(F.col("o_custkey").alias("doc_id"), nth.alias("transition"), key, (key % 4 + 3).alias("pages_before"), (key % 5 + 3).alias("pages_after"))
    diffs = steps.join(items, key == F.col("l_orderkey")).select("doc_id", "transition", F.col("l_linenumber").alias("page"), F.col("l_tax").alias("changed"), (F.col("l_suppkey") % 3).alias("regions"))
    return page_objects.revision_timeline(steps.drop("o_orderkey"), diffs, 4)


@query(_TIMELINE + " select doc_id, transition, page_count_changed, n pages, n > 0 or page_count_changed changed from r")
def revision_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir).select("doc_id", "transition", "page_count_changed", F.size("changed_pages").alias("pages"), "changed")


@query(_TIMELINE + """ select doc_id, count(*) transitions, count(*) filter (n > 0 or page_count_changed) changed, sum(n)::bigint pages,
  case when count(*) filter (n > 0 or page_count_changed) > 0 then 'detected' else 'clear' end state from r group by doc_id""")
def timeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_objects.timeline_summary(_timeline(spark, sf_dir))


_ROLES = ("photo", "document", "photo", "decorative", "unknown")


@query(
    f"""with i as (select l_orderkey doc_id, l_linenumber * 1000000 + l_partkey ix, [{", ".join(f"'{r}'" for r in _ROLES)}][l_partkey % 5 + 1] as role from lineitem), k as (select *, row_number() over (partition by doc_id order by ix) n, count(*) over (partition by doc_id) whole from i)
  , q as (select *, role = 'photo' and sum((role = 'photo')::int) over (partition by doc_id order by n) <= 2 kept from k where n <= 5)
  select doc_id, count(*) filter (role = 'photo') photo, count(*) filter (role = 'document') document, count(*) filter (role = 'decorative') decorative, count(*) filter (role = 'unknown') as "unknown", count(*) filter (kept) kept,
    max(whole) > 5 inventory_cut, count(*) filter (role = 'photo') > 2 photos_cut, case when count(*) filter (kept) > 0 then 'completed' when max(whole) > 5 then 'partial' else 'not_applicable' end state from q group by doc_id"""
)
def image_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, _ROLES)), (F.col("l_partkey") % 5 + 1).cast("int"))
    images = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("image_ix"), role.alias("role"))
    return limits.image_counts(images, 5, 2)


@query(
    """select l_orderkey, l_linenumber, round(10 + l_quantity / 100 * 300, 4) x0, round(20 + l_tax * 400, 4) y0, round(10 + (l_quantity + 5) / 100 * 300, 4) x1, round(20 + (l_tax + 0.1) * 400, 4) y1 from lineitem"""
)
def image_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    q, t = F.col("l_quantity"), F.col("l_tax") * 100
    on_page = geometry.region_on_page(box(q, t, q + 5, t + 10), F.lit(100), F.lit(100), box(F.lit(10.0), F.lit(20.0), F.lit(310.0), F.lit(420.0)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(on_page[n], 4).alias(n) for n in ("x0", "y0", "x1", "y1")])


@query(
    """with t as (select c_custkey doc_id, [c_custkey % 4, c_custkey % 3, c_custkey % 5] n, c_name from customer), s as (select doc_id, c_name, n, list_transform(n, lambda k: 2 + 2 * k) sizes from t)
  , b as (select doc_id, c_name, list_position(sizes, list_max(sizes)) - 1 table_ix, n[list_position(sizes, list_max(sizes))] n from s)
  select doc_id, table_ix::int table_ix, r row_ix, case when r = 0 then 'Key' else r::varchar end as "first", case when r = 0 then 'Name' else c_name end as "second" from b, unnest(range(0, n + 1)) u(r)"""
)
def best_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    row = F.concat(F.lit("<tr><td>%d</td><td>"), "c_name", F.lit("</td></tr>"))
    body = lambda n: F.array_join(F.transform(F.slice(F.sequence(F.lit(1), F.lit(5)), F.lit(1), n.cast("int")), lambda i: F.replace(row, F.lit("%d"), i.cast("string"))), "")
    markup = F.concat(*[F.concat(F.lit("<table><tr><th>Key</th><th>Name</th></tr>"), body(key % n), F.lit("</table><p>x</p>")) for n in (4, 3, 5)])
    texts = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select(key.alias("doc_id"), markup.alias("html"))
    cells = tables.html_cells(texts, "doc_id", "html")
    rows = tables.table_rows(tables.best_tables(cells)).select("doc_id", "table_ix", F.posexplode("rows").alias("row_ix", "r"))
    return rows.select("doc_id", "table_ix", F.col("row_ix").cast("bigint").alias("row_ix"), F.get("r", 0).alias("first"), F.get("r", 1).alias("second"))


@query("select conv_id, turn, unnest([0, 1, 2, 3]) place, md5(unnest([coalesce(text, ''), role, 'a ' || role, 'z'])) content from conversations")
def content_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.struct(F.lit(1).alias("n"), F.array(F.struct(F.col("role").alias("content"))).alias("items"), F.struct(F.array(F.struct(F.concat(F.lit("a "), "role").alias("content"))).alias("deeper")).alias("deep"))
    whole = F.struct(inner.alias("page"), F.coalesce("text", F.lit("")).alias("content"), F.struct(F.lit("z").alias("content"), F.lit(2.5).alias("score")).alias("last"))
    docs = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.to_json(whole).alias("ocr_json"))
    return regions.content_values(docs).select("doc_id.conv_id", "doc_id.turn", "place", F.md5("content").alias("content"))


@query(
    """with v as (select c_custkey, c_custkey % 7 k, '25-989-' || c_custkey c_phone, c_name, round(c_acctbal, 2)::decimal(18, 2) bal from customer)
  select c_custkey, case k when 0 then 'LU280019400644750000' when 1 then '+' || regexp_replace(c_phone, '[^0-9]', '', 'g') when 2 then lower(replace(c_name, '#', '.')) || '@mail.example' when 3 then '40' || c_custkey || 'AB'
      when 4 then lower(trim(regexp_replace(strip_accents(c_name), '[^a-zA-Z0-9]+', ' ', 'g'))) when 5 then '2024-03-' || lpad((c_custkey % 28 + 1)::varchar, 2, '0') else null end as value,
    case when k = 6 then 'raw_only' else 'normalized' end status from v"""
)
def normalized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, k = F.col("c_custkey"), F.col("c_custkey") % 7
    code = F.element_at(F.array(*map(F.lit, ("iban", "phone_number", "email_address", "account_number", "person_name", "date", "free_text"))), (k + 1).cast("int"))
    raw = (
        F.when(k == 0, "Compte IBAN LU28 0019-4006 4475 0000 bis").when(k == 1, F.concat(F.lit(" +25-989-"), key.cast("string"))).when(k == 2, F.concat(F.lit(" "), F.upper(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@Mail.Example ")))
        .when(k == 3, F.concat(F.lit("40-"), key.cast("string"), F.lit(" ab"))).when(k == 5, F.format_string("2024-03-%02d", key % 28 + 1)).otherwise(F.col("c_name"))
    )
    out = values.normalized_value(code, raw, F.lit("fr"), F.lit("LU"))
    return table(spark, sf_dir, "customer").select("c_custkey", out["value"].alias("value"), out["status"].alias("status"))




# A manifest an event: statuses in lists, in objects and below other keys, codes that are numbers, and the event's own properties.
_MANIFEST = """'{"active":{"success":[{"code":"' || event_type || '","explanation":"' || case when event_id % 3 = 0 then '' else 'seen' end || '"},{"code":' || event_id || '}],"deep":[{"failure":{"props":' || props
  || case when event_id % 2 = 0 then ',"code":"untrusted"' else ',"inner":[[{"code":"k.' || event_id % 7 || '","informational":{"x":{"code":"note"}}}]]' end || '}}]},"assertions":[{"digital_source_type":"http://e/' || event_type || '"},{"code":"outside"}]}'"""


@query(
    f"""with m as (select event_id, ({_MANIFEST})::json j from events), t as (select event_id, t.value v, t.fullkey k from m, json_tree(j) t where t.type = 'OBJECT')
  select event_id, list_last(regexp_extract_all(k, '[.](success|informational|failure)(?:[.\\[]|$)', 1)) outcome, v->>'code' code, nullif(v->>'explanation', '') explanation from t
  where json_type(v->'code') = 'VARCHAR' and regexp_matches(k, '[.](success|informational|failure)([.\\[]|$)')""".replace("\\\\", "\\")
)
def manifest_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_MANIFEST).alias("manifest"))
    return manifests.validation_statuses(manifests.walked(rows, "event_id", "manifest")).withColumnRenamed("id", "event_id")


@query(f"""with m as (select event_id, ({_MANIFEST})::json j from events) select event_id, list_sort(list(distinct t.value->>'$')) source_types from m, json_tree(j) t where t.key = 'digital_source_type' group by event_id""")
def manifest_source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_MANIFEST).alias("manifest"))
    return manifests.source_types(manifests.walked(rows, "event_id", "manifest")).withColumnRenamed("id", "event_id")
