"""Content checks: identifiers, amounts, dates, ledgers, invoices, software."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import amounts, dates, text as t
from quillmark.functions import identifiers as ids
from quillmark.operators import dating, ledger, matching, software
from quillmark.plans import query, table
from quillmark.plans.scoring import _CARDS, cards
from quillmark.storage import checkpointed, shared_folder
from quillmark.streaming import inbox
from quillmark.streaming import ledger_stream as replays

KINDS = ("card", "siren", "siret", "rpps", "finess", "bic", "iban")
#: Made-up and published sample identifiers.
SAMPLES = (
    ("card", "4111 1111 1111 1111"), ("card", "4111-1111-1111-1121"), ("card", "411111"), ("card", "4111x11111111111"),
    ("siren", "404833048"), ("siren", "404833049"), ("siren", "40483304"), ("siret", "73282932000074"), ("siret", "73282932000075"),
    ("rpps", "10000668540"), ("rpps", "10000668541"), ("rpps", "20000668540"), ("finess", "921234563"), ("finess", "921234564"),
    ("bic", "CCPLLULL"), ("bic", "PBNKDEFFXXX"), ("bic", "PBNKDEFFX"), ("bic", "PBN1DEFF"), ("bic", "PBNKQQFF"),
    ("iban", "LU28 0019 4006 4475 0000"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "GB83 WEST 1234 5698 7654 32"),
    ("iban", "DE89370400440532013000"), ("iban", "DE8937040044053201300"), ("iban", "ZZ89370400440532013000"),
)
_LUHN = "list_sum(list_transform(range(1, length(s) + 1), lambda i: case when i % 2 = 1 then try_cast(substr(reverse(s), i, 1) as int) else try_cast(substr(reverse(s), i, 1) as int) * 2 - case when try_cast(substr(reverse(s), i, 1) as int) > 4 then 9 else 0 end end)) % 10 = 0"
#: A SIRET begins with a valid SIREN.
_LUHN_SIREN = _LUHN.replace("length(s)", "9").replace("reverse(s)", "reverse(left(s, 9))")
_MOD97 = "list_reduce(list_prepend(0::bigint, list_transform(string_split(substr(s, 5) || left(s, 4), ''), lambda c: case when c between '0' and '9' then c::bigint else ascii(c)::bigint - 55 end)), lambda a, x: (a * case when x < 10 then 10 else 100 end + x) % 97) = 1"


@query(
    "with w(kind, value) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in SAMPLES) + """), v as (select -1 key, kind, value from w union all
    select c_custkey, unnest(['card', 'siren', 'siret', 'rpps', 'finess', 'bic', 'iban']), unnest(['4' || d15, left(d15, 9), left(d15, 14), '1' || left(d15, 10), right(d15, 9), upper(left(c_mktsegment, 4)) || country || 'LL', country || left(d15, 2) || ' ' || substr(d15, 3) || '000'])
      from (select *, lpad((c_custkey * 99991 % 10000000)::bigint::varchar, 7, '0') || lpad((c_custkey * 7919 % 100000000)::bigint::varchar, 8, '0') d15, ['LU', 'DE', 'QQ'][c_custkey % 3 + 1] country from customer))
  , n as (select *, upper(regexp_replace(value, '[\\s.-]', '', 'g')) s from v)
  , st(country, len, pattern) as (values """ + ", ".join(f"('{c}', {ids.iban_length(c)}, '^{ids.bban_regex(p)}$')" for c, p in ids.IBAN_STRUCTURES.items()) + f""")
  select key, kind, value, coalesce(case
    when kind = 'card' then length(s) between 13 and 19 and regexp_full_match(s, '[0-9]+') and {_LUHN}
    when kind in ('siren', 'finess') then length(s) = 9 and {_LUHN}
    when kind = 'siret' then length(s) = 14 and {_LUHN} and {_LUHN_SIREN}
    when kind = 'rpps' then length(s) = 11 and s like '1%' and {_LUHN}
    when kind = 'bic' then regexp_full_match(s, '[A-Z]{{4}}[A-Z]{{2}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?') and list_contains(string_split('{' '.join(ids.COUNTRIES)}', ' '), substr(s, 5, 2))
    when kind = 'iban' then length(s) = len and regexp_matches(substr(s, 5), pattern) and {_MOD97} end, false) valid
  from n left join st on kind = 'iban' and country = left(s, 2)"""
)
def identifier_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = spark.createDataFrame([(-1, *s) for s in SAMPLES], "key bigint, kind string, value string")
    key = F.col("c_custkey")
    digits = lambda factor, size: F.lpad((key * factor % 10**size).cast("bigint").cast("string"), size, "0")
    customers = table(spark, sf_dir, "customer").select(key.alias("key"), F.concat(digits(99991, 7), digits(7919, 8)).alias("d"), F.element_at(F.array(*map(F.lit, ("LU", "DE", "QQ"))), (key % 3 + 1).cast("int")).alias("country"), "c_mktsegment")
    left = lambda n: F.left("d", F.lit(n))
    of = {
        "card": F.concat(F.lit("4"), "d"), "siren": left(9), "siret": left(14), "rpps": F.concat(F.lit("1"), left(10)), "finess": F.right("d", F.lit(9)),
        "bic": F.concat(F.upper(F.left("c_mktsegment", F.lit(4))), "country", F.lit("LL")), "iban": F.concat("country", left(2), F.lit(" "), F.substr("d", F.lit(3)), F.lit("000")),
    }
    rows = samples.unionByName(customers.select("key", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in of.items()]))))
    return rows.select("key", "kind", "value", ids.validated(F.col("kind"), F.col("value"), KINDS)["valid"].alias("valid"))


@query("with " + _CARDS + " select number, min(doc_id) first_doc, count(distinct doc_id) docs from checked group by number")
def identifier_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = cards(table(spark, sf_dir, "documents")).groupBy("number")
    return per.agg(F.min("doc_id").alias("first_doc"), F.countDistinct("doc_id").alias("docs"))


def _amount_texts(items: DataFrame) -> DataFrame:
    """Line amounts written in several ways, with what they say."""
    cents = F.round(F.col("l_extendedprice") * 100, 0).cast("bigint")
    whole, part = F.floor(cents / 100).cast("bigint"), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = F.format_number(whole, 0)
    style = F.col("l_linenumber") % 5
    raw = (
        F.when(style == 0, F.concat(grouped, F.lit("."), part)).when(style == 1, F.concat(F.translate(grouped, ",", "."), F.lit(","), part, F.lit(" EUR")))
        .when(style == 2, F.concat(F.lit("("), whole.cast("string"), F.lit("."), part, F.lit(")"))).when(style == 3, F.concat(F.lit("$ "), grouped))
        .otherwise(F.concat(whole.cast("string"), F.lit(","), part))
    )
    return items.select("l_orderkey", "l_linenumber", raw.alias("raw"))


_CENTS = "cast(round(l_extendedprice * 100, 0) as bigint)"
_AMOUNT = f"case l_linenumber % 5 when 2 then -{_CENTS} / 100.0 when 3 then floor({_CENTS} / 100.0) else {_CENTS} / 100.0 end"


@query(f"select l_orderkey, l_linenumber, round({_AMOUNT}, 2) amount, case l_linenumber % 5 when 1 then 'EUR' when 3 then 'USD' end currency from lineitem")
def table_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _amount_texts(table(spark, sf_dir, "lineitem"))
    amount = amounts.table_amount(F.col("raw")).cast("double")
    return rows.select("l_orderkey", "l_linenumber", F.round(amount, 2).alias("amount"), amounts.explicit_currency(F.col("raw")).alias("currency"))


@query(f"select l_orderkey, l_linenumber, round({_AMOUNT}, 2) amount, 'normalized' status from lineitem")
def fact_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _amount_texts(table(spark, sf_dir, "lineitem"))
    parsed = amounts.fact_amount(F.col("raw"), F.lit("fr"), F.lit("LU"))
    return rows.select("l_orderkey", "l_linenumber", F.round(parsed["value"], 2).alias("amount"), parsed["status"].alias("status"))


@query(
    """select o_orderkey, case when o_orderkey % 4 = 3 and day(o_orderdate) <= 12 then make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) else cast(o_orderdate as date) end date,
    o_orderkey % 4 in (1, 3) and day(o_orderdate) <= 12 and day(o_orderdate) <> month(o_orderdate) ambiguous from orders"""
)
def found_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-first dates whose day could be a month are read day first, and called ambiguous unless both are equal."""
    d, style = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    formats = {0: "yyyy-MM-dd", 1: "dd/MM/yyyy", 2: "dd-MMM-yyyy", 3: "MM.dd.yyyy"}
    raw = F.when(style == 0, F.date_format(d, formats[0])).when(style == 1, F.date_format(d, formats[1])).when(style == 2, F.date_format(d, formats[2])).otherwise(F.date_format(d, formats[3]))
    found = F.try_element_at(dates.found_dates(F.concat(F.lit("le "), raw, F.lit(" fin"))), F.lit(1))
    return table(spark, sf_dir, "orders").select("o_orderkey", found["value"].alias("date"), found["ambiguous"].alias("ambiguous"))


@query(
    """select o_orderkey, case when o_orderkey % 5 = 4 and day(o_orderdate) <= 12 then null else strftime(o_orderdate, '%Y-%m-%d') end as value,
  case when o_orderkey % 5 = 4 and day(o_orderdate) <= 12 then 'ambiguous' else 'normalized' end status from orders"""
)
def normalized_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, style = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(style == 0, F.date_format(d, "yyyy-MM-dd")).when(style == 1, F.date_format(d, "dd/MM/yy")).when(style == 2, F.date_format(d, "dd.MM.yyyy")).when(style == 3, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "dd,MM,yyyy"))
    language = F.when(style.isin(1, 2), "fr").when(style == 3, "en")
    country = F.when(style.isin(1, 2), "LU").when(style == 3, "US")
    found = dates.normalized_date(raw, language, country)
    return table(spark, sf_dir, "orders").select("o_orderkey", found["value"].alias("value"), found["status"].alias("status"))


@query("select o_orderkey, date_trunc('day', o_orderdate) + interval 13 hour + interval (o_orderkey % 60) minute as stamp from orders")
def pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("13"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"), F.lit("00+02'00'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.pdf_date(raw).alias("stamp"))


_REFERENCE = "1998-01-01"
_DATED = f"""with d as (select o_custkey doc_id, o_orderkey, cast(o_orderdate as date) d, o_orderkey % 3 k from orders)
  , e as (select doc_id, o_orderkey, case when k = 2 and o_orderkey % 5 = 0 then null else d end d, k = 1 and day(d) <= 12 and day(d) <> month(d) ambiguous from d)"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of a customer's orders in three ways of writing, some of them not in the calendar; pages are orders."""
    d, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    wrong = F.concat(F.lit("31/02/"), F.date_format(d, "yyyy"))
    raw = F.when(key % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(key % 3 == 1, F.date_format(d, "dd/MM/yyyy")).when(key % 5 == 0, wrong).otherwise(F.date_format(d, "dd-MMM-yyyy"))
    regions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), key.alias("page"), F.concat(F.lit("Fait le "), raw, F.lit(" ici")).alias("content"))
    return dating.document_dates(regions)


@query(
    _DATED + f""" select doc_id, count(d) n, count(*) filter (d is null) invalid, count(*) filter (not ambiguous and d > date '{_REFERENCE}' + 1) future, min(d) first_date, max(d) last_date,
  case when count(*) filter (d is null) > 0 then 'attention' else 'clear' end state from e group by doc_id"""
)
def date_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dating.date_inventory(_dated(spark, sf_dir), F.lit(_REFERENCE).cast("date"))


@query(
    _DATED + f""" select doc_id, o_orderkey page, case when d is null then 'OCR_DATE_INVALID' else 'OCR_DATE_IN_FUTURE' end code, case when d is null then 'attention' else 'detected' end state
  from e where d is null or not ambiguous and d > date '{_REFERENCE}' + 1"""
)
def date_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dating.date_observations(_dated(spark, sf_dir), F.lit(_REFERENCE).cast("date")).select("doc_id", "page", "code", "state")


_LEDGER = """select o_custkey as acct, row_number() over (partition by o_custkey order by o_orderkey) row_no, cast(o_orderdate as date) d,
    case when o_orderkey % 7 = 0 then null else cast(round(o_totalprice, 2) as decimal(18, 2)) end debit, cast(o_orderkey % 100 as decimal(18, 2)) credit, o_orderkey from orders"""
_BALANCED = f"""with l as ({_LEDGER}), b as (select *, case when o_orderkey % 11 = 0 then null else
    sum(credit - coalesce(debit, 0)) over (partition by acct order by row_no) + case when o_orderkey % 13 = 0 then 1 else 0 end end balance, o_orderkey % 5 <> 0 comparable from l)
  , p as (select *, last_value(balance ignore nulls) over w prev_balance, last_value(d ignore nulls) over w prev_date from b window w as (partition by acct order by row_no rows between unbounded preceding and 1 preceding))
  , q as (select *, case when d <> prev_date then case when d > prev_date then 1 else -1 end end direction from p)
  , r as (select *, first_value(direction ignore nulls) over (partition by acct order by row_no rows between unbounded preceding and current row) first_direction from q)
  , s as (select acct, row_no, balance is not null and prev_balance is not null and (debit is not null or credit is not null) and comparable checked,
      coalesce(balance is not null and prev_balance is not null and comparable and abs(prev_balance - coalesce(debit, 0) + coalesce(credit, 0) - balance) > 0.02, false) mismatch,
      coalesce(direction <> first_direction, false) inversion, balance is not null and not comparable skipped from r)"""


def _ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("acct").orderBy("o_orderkey")
    money = "decimal(18,2)"
    rows = table(spark, sf_dir, "orders").withColumn("acct", F.col("o_custkey"))
    rows = rows.withColumn("row_no", F.row_number().over(w)).withColumn("date", F.to_date("o_orderdate"))
    rows = rows.withColumn("debit", F.when(F.col("o_orderkey") % 7 != 0, F.round("o_totalprice", 2).cast(money))).withColumn("credit", (F.col("o_orderkey") % 100).cast(money))
    running = F.sum(F.col("credit") - F.coalesce("debit", F.lit(Decimal(0)))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fault = F.when(F.col("o_orderkey") % 13 == 0, 1).otherwise(0)
    rows = rows.withColumn("balance", F.when(F.col("o_orderkey") % 11 != 0, running + fault)).withColumn("comparable", F.col("o_orderkey") % 5 != 0)
    return rows.select("acct", "row_no", "date", "debit", "credit", "balance", "comparable", "o_orderkey")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.replay_ledger(_ledger_rows(spark, sf_dir), "acct")


@query(_BALANCED + " select * from s")
def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir)


@query(_BALANCED + " select * from s")
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledgers as a stream that is started five times on one checkpoint, each time with a fifth of the orders."""
    rows, folder = checkpointed(_ledger_rows(spark, sf_dir)), shared_folder(spark)
    last = rows.agg(F.coalesce(F.max("o_orderkey"), F.lit(0))).first()[0]
    for part in range(5):
        rows.where(F.floor(F.col("o_orderkey") * 5 / (last + 1)) == part).drop("o_orderkey").write.mode("append").parquet(f"{folder}/in")
        arriving = inbox.read_inbox(spark, f"{folder}/in", rows.drop("o_orderkey").schema)
        replays.start_replay(spark, arriving, f"{folder}/out", f"{folder}/state", "acct").awaitTermination()
    return spark.read.schema("acct bigint, " + replays.CHECKED).parquet(f"{folder}/out")


@query(
    _BALANCED + """ select acct, count(*) filter (checked) rows_checked, count(*) filter (mismatch) n_mismatch, count(*) filter (inversion) n_inversion, count(*) filter (skipped) rows_skipped,
  coalesce(list(row_no order by row_no) filter (mismatch), []) mismatch_rows, coalesce(list(row_no order by row_no) filter (inversion), []) inversion_rows,
  case when count(*) filter (checked) = 0 and count(*) filter (inversion) = 0 then 'indeterminate' when count(*) filter (mismatch or inversion) = 0 then 'clear' else 'attention' end state from s group by acct"""
)
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_summary(_ledger(spark, sf_dir), "acct")


_NET = "cast(round(l_extendedprice * 100) as bigint) * cast(round(100 - l_discount * 100) as bigint)"


@query(
    f"""with c as (select o_orderkey, max(o_totalprice) total, (sum({_NET}) + 50) // 100 net, (sum({_NET} * cast(round(l_tax * 100) as bigint)) + 5000) // 10000 tax from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey)
  , d as (select o_orderkey, net + tax expected, case when o_orderkey % 4 = 0 then cast(round(total * 100) as bigint) else net + tax end total from c)
  select o_orderkey, round(abs(expected - total) / 100.0, 2) delta, case when abs(expected - total) <= 2 then 'clear' else 'attention' end state from d"""
)
def invoice_total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    hundredths = lambda c: F.round(c * 100, 0).cast("bigint")
    net = hundredths(F.col("l_extendedprice")) * F.round(100 - F.col("l_discount") * 100, 0).cast("bigint")
    cents = lambda c, unit: (F.floor((F.sum(c) + unit / 2) / unit).cast("decimal(18,0)") / 100).cast("decimal(18,2)")
    per = items.groupBy("l_orderkey").agg(cents(net, 100).alias("subtotal"), cents(net * hundredths(F.col("l_tax")), 10000).alias("tax"))
    rows = per.join(orders, per.l_orderkey == orders.o_orderkey)
    total = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice").cast("decimal(18,2)")).otherwise(F.col("subtotal") + F.col("tax"))
    line = lambda ix, label, amount: F.struct(F.lit(ix).alias("row_ix"), F.lit(label).alias("label"), amount.cast("decimal(18,2)").alias("amount"))
    cells = rows.select("o_orderkey", F.inline(F.array(line(1, "sous total ht subtotal", F.col("subtotal")), line(2, "montant tva", F.col("tax")), line(3, "grand total", total))))
    return ledger.invoice_totals(cells, "o_orderkey").select("o_orderkey", F.round(F.col("delta").cast("double"), 2).alias("delta"), "state")


_SOFTWARE = ("Adobe Photoshop 24.1", "GIMP 2.10", "DALL·E 3", "Microsoft® Word 2019", "iLovePDF", "Skia/PDF m114", "Canva", "Adobe Acrobat Pro", "PDFsam Basic", "CamScanner", "DocuSign", "Éditeur Zoé", "MyGimpy")
_RULES = " ".join(f"when regexp_matches(s, ' ({'|'.join(names)}) ') then '{c}'" for c, names in software.SOFTWARE.items())
_POINTS = " ".join(f"when '{k}' then {v}" for k, v in software.POINTS.items())


@query(
    f"""with v as (select p_partkey, [{", ".join(f"'{v}'" for v in _SOFTWARE)}][p_partkey % {len(_SOFTWARE)} + 1] || case when p_partkey % 2 = 0 then ' ' || p_size else '' end as value from part)
  , n as (select p_partkey, value, ' ' || trim(lower(regexp_replace(strip_accents(value), '[^a-zA-Z0-9]+', ' ', 'g'))) || ' ' s from v)
  , c as (select p_partkey, value, case {_RULES} else 'unknown' end category from n) select p_partkey, value, category, case category {_POINTS} else 0.0 end points from c"""
)
def software_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _SOFTWARE)), (F.col("p_partkey") % len(_SOFTWARE) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(name, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_size"))).otherwise("")).alias("value"))
    category = software.software_category(F.col("value"))
    return rows.select("p_partkey", "value", category.alias("category"), software.software_points(category).alias("points"))


_META = ((1, "Creator", "Canva"), (1, "Producer", "GIMP 2"), (2, "Creator", "Microsoft Word"), (2, "Producer", "Smallpdf"), (3, "Creator", "Figma"), (3, "Producer", "Sejda"), (4, "Software", "Stable Diffusion web"), (4, "parameters", "Steps: 20, Sampler: Euler"), (5, "Comment", "Midjourney v6 / midjourney"))
_META_SQL = f"""w(ix, key, value) as (values {", ".join(f"({d}, '{k}', '{v}')" for d, k, v in _META)}), m as (select p_partkey doc_id, key, value from part join w on ix = p_partkey % 6)"""


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata entries of parts: one of five sets, or none."""
    sets = spark.createDataFrame(list(_META), "ix int, key string, value string")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 6).alias("ix")).join(F.broadcast(sets), "ix").select("doc_id", "key", "value")




@query(
    f"""with {_META_SQL}, n as (select *, ' ' || trim(lower(regexp_replace(strip_accents(value), '[^a-zA-Z0-9]+', ' ', 'g'))) || ' ' s from m where key in ('Creator', 'Producer'))
  , c as (select *, case {_RULES} else 'unknown' end category from n), p as (select *, case category {_POINTS} else 0.0 end points from c)
  select doc_id, key, category, points from (select *, row_number() over (partition by doc_id order by points desc, key) r from p where points > 0) where r = 1"""
)
def software_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return software.software_finding(_metadata(spark, sf_dir))


@query(
    f"""with {_META_SQL}, k(needle, marker) as (values {", ".join(f"('{a}', '{b}')" for a, b in software.AI_MARKERS.items())})
  select distinct doc_id, marker, key from m join k on contains(lower(key || ' ' || value), needle)
  union select doc_id, 'diffusion_generation_parameters', key from m where contains(lower(key), 'parameters') and contains(lower(value), 'sampler') and contains(lower(value), 'steps')"""
)
def ai_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return software.ai_markers(_metadata(spark, sf_dir))


@query(
    """with o as (select l_orderkey doc_id, l_suppkey % 3 page, l_linenumber object_ix, case when l_partkey % 40 = 0 then 'F' || l_partkey else 'Arial' end font, l_quantity font_size, cast(floor(l_extendedprice) as bigint) || '' txt from (select *, l_orderkey % 200 as k from lineitem))
  , g as (select doc_id % 150 d, page, doc_id * 10 + object_ix object_ix, font, font_size, txt from o), u as (select *, count(*) over (partition by d, page, font) uses, count(*) over (partition by d, page) total from g), m as (select *, max(uses) over (partition by d, page) most from u)
  select d doc_id, page, object_ix, font, txt as text from m where total >= 10 and most >= 5 and uses <= 2 and font_size >= 4"""
)
def rare_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    font = F.when(F.col("l_partkey") % 40 == 0, F.concat(F.lit("F"), F.col("l_partkey"))).otherwise("Arial")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 150).alias("doc_id"), (F.col("l_suppkey") % 3).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("object_ix"),
        font.alias("font"), F.col("l_quantity").alias("font_size"), F.floor("l_extendedprice").cast("bigint").cast("string").alias("text"),
    )
    return software.rare_fonts(rows)


@query(
    """select p_partkey, case when p_size % 4 = 0 then 18.0 when p_size % 4 = 1 then case p_size % 5 when 0 then 45.0 when 1 then 45.0 when 2 then 40.0 when 3 then 30.0 else 0.0 end when p_size % 4 = 2 then 15.0 else 0.0 end points,
  case when p_size % 7 = 0 then 0.0 when p_size % 2 = 0 then least(4.0, least(15.0, 8.0 + 3.0 * (p_size % 7))) else least(15.0, 8.0 + 3.0 * (p_size % 7)) end structure from part"""
)
def provenance_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    state = F.when(n % 4 == 0, "invalid").when(n % 4 == 1, "declared").when(n % 4 == 2, "metadata").otherwise("none")
    trust = F.element_at(F.array(*map(F.lit, ("trusted", "valid", "untrusted", "unknown", "invalidated"))), (n % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", software.provenance_points(state, trust).alias("points"), software.structure_points(n % 7, n % 2 == 0).alias("structure"))


@query("with " + _CARDS + """, every as (select doc_id, number from checked union all select doc_id, left(number, length(number) - 1) || (right(number, 1)::int + 1) % 10 from checked where doc_id % 2 = 0
    union all select doc_id, '9' || number from checked where doc_id % 3 = 0)
  , p as (select doc_id, min(number) as "first", max(number) as "second", count(distinct number) n from every group by doc_id)
  select doc_id, "first", "second" from p where n = 2 and length("first") = length("second") and list_sum(list_transform(range(1, length("first") + 1), lambda i: (substr("first", i, 1) <> substr("second", i, 1))::int)) = 1""")
def card_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents; every second document also has each number with its last digit moved by one, every third one with a digit before it."""
    found = cards(table(spark, sf_dir, "documents")).select("doc_id", "number")
    moved = F.concat(F.expr("left(number, length(number) - 1)"), ((F.right("number", F.lit(1)).cast("int") + 1) % 10).cast("string"))
    near = found.where("doc_id % 2 = 0").select("doc_id", moved.alias("number"))
    longer = found.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("9"), "number").alias("number"))
    return matching.one_digit_conflict(found.unionByName(near).unionByName(longer))


@query("select doc_id, md5(trim(lower(regexp_replace(strip_accents(replace(text, 'ß', '?')), '[^a-zA-Z0-9]+', ' ', 'g')))) k from documents")
def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.folded(F.replace("text", F.lit("ß"), F.lit("?")))).alias("k"))


@query(
    r"""with c as (select doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) s from documents), w as (select *, string_split(s, ' ') parts, array_to_string(string_split(s, ' ')[1:180], ' ') f from c)
  , n as (select *, case when length(f) > 1600 then regexp_replace(left(f, 1600), ' [^ ]*$', '') else f end short from w)
  select doc_id, md5(case when len(parts) > 180 or length(s) > 1600 then regexp_replace(short, '[ ,;:]+$', '') || '.' else short end) note,
  md5(case when length(text) <= 300 then text else left(text, 195) || chr(10) || '[...]' || chr(10) || right(text, 98) end) elided from n"""
)
def shortened_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.limited_note(F.col("text"))).alias("note"), F.md5(t.middle_elided(F.col("text"), 300)).alias("elided"))


@query(
    r"""with a as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b[A-Z]{2}\d{2}(?:[\s-]?[A-Z0-9]){10,32}\b', '[identifiant]', 'g'), '(?i)\b[\w.+-]+@[\w.-]+\.[A-Z]{2,}\b', '[adresse]', 'g'),
    '\b(?:\d[\s-]?){8,}\d\b', '[identifiant]', 'g'), '\b\d{1,4}(?:[./,-]\d{1,4}){1,2}\b', '[date ou valeur]', 'g') s from documents)
  select doc_id, trim(regexp_replace(regexp_replace(s, '(^|[^\w])[+-]?\d[\d\s.,'']*(?:\s?(?:EUR|USD|CHF|GBP|€|\$|£))?', '\1[valeur]', 'g'), '\s+', ' ', 'g')) as text from a"""
)
def abstracted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.abstracted(F.col("text")).alias("text"))


@query(
    """select page_id, regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', ''), '[^A-Za-z0-9._-]+', '-', 'g') || '-' || left(sha256(url), 10) stem,
  case page_id % 4 when 0 then 'image/jpeg' when 1 then 'image/png' when 2 then 'image/tiff' else 'image/x-own' end media from pages"""
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, (".JPG", "png", "tif", "image/x-own"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", t.output_stem(F.col("url")).alias("stem"), t.media_type(kind).alias("media"))
