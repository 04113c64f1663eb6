"""Joins, coverage, reviews and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import authenticity
from quillmark.operators import matching as m
from quillmark.plans import query, table


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("region_id"))


def _side(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(condition).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("region_id"))


@query(
    """select l_orderkey doc_id, l_linenumber region_id from lineitem a
  where not exists (select 1 from lineitem b where b.l_orderkey = a.l_orderkey and b.l_linenumber = a.l_linenumber and (b.l_quantity > 30 or b.l_discount > 0.05))"""
)
def uncovered_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.uncovered_regions(_regions(spark, sf_dir), _side(spark, sf_dir, "l_quantity > 30"), _side(spark, sf_dir, "l_discount > 0.05"))


@query(
    """select l_orderkey doc_id, count(*) regions, count(*) filter (l_quantity > 30) mapped, count(*) filter (l_quantity <= 30 and l_discount > 0.05) disposed,
  count(*) filter (l_quantity <= 30 and l_discount <= 0.05) uncovered, round(count(*) filter (l_quantity > 30 or l_discount > 0.05) / count(*), 6) ratio
  from (select l_orderkey, l_linenumber, max(l_quantity) l_quantity, max(l_discount) l_discount from lineitem group by all) group by l_orderkey"""
)
def extraction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.coverage(_regions(spark, sf_dir), _side(spark, sf_dir, "l_quantity > 30"), _side(spark, sf_dir, "l_discount > 0.05"))
    return out.withColumn("ratio", F.round("ratio", 6))


@query("select l.doc_id, l.quality from labels l semi join documents d on d.doc_id = l.doc_id and d.lang = 'en'")
def known_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lit("r").alias("region_id"))
    return m.known_regions(table(spark, sf_dir, "labels").withColumn("region_id", F.lit("r")), docs).select("doc_id", "quality")


_VALUES = """select o_orderkey doc_id, unnest(['amount', 'date', 'customer']) field, unnest([cast(cast(floor(o_totalprice) as bigint) as varchar) || '00', strftime(o_orderdate, '%Y%m%d'), 'Customer ' || (100000 + o_custkey)]) as value from orders"""
_FACTS = """select o_orderkey doc_id, unnest(['total', 'issued', 'holder']) field_code, unnest([cast(cast(floor(o_totalprice) as bigint) + case when o_orderkey % 3 = 0 then 1 else 0 end as varchar) || '00',
  strftime(o_orderdate, '%d/%m/%Y'), case when o_orderkey % 2 = 0 then 'M. customer ' || (100000 + o_custkey) else 'other name' end]) fact from orders"""
# Texts are compared as keys; a value of eight digits that is a date may also be written the other way round.
_KEY = "lower(regexp_replace(strip_accents({c}), '[^a-zA-Z0-9]+', '', 'g'))"
_COMPARED = f"""with v as ({_VALUES}), f as ({_FACTS}), s(field, field_code) as (values ('amount', 'total'), ('date', 'issued'), ('customer', 'holder'))
  , k as (select v.doc_id, v.field, {_KEY.format(c="value")} a, {_KEY.format(c="fact")} b, regexp_replace(value, '[^0-9]', '', 'g') da, regexp_replace(fact, '[^0-9]', '', 'g') db from v join s using (field) join f on f.doc_id = v.doc_id and f.field_code = s.field_code)
  , w as (select *, list_filter([a, case when try_strptime(da, '%Y%m%d') is not null and length(da) = 8 then right(da, 2) || substr(da, 5, 2) || left(da, 4) end, case when try_strptime(da, '%d%m%Y') is not null and length(da) = 8 then right(da, 4) || substr(da, 3, 2) || left(da, 2) end], lambda x: x is not null) va,
      list_filter([b, case when try_strptime(db, '%Y%m%d') is not null and length(db) = 8 then right(db, 2) || substr(db, 5, 2) || left(db, 4) end, case when try_strptime(db, '%d%m%Y') is not null and length(db) = 8 then right(db, 4) || substr(db, 3, 2) || left(db, 2) end], lambda x: x is not null) vb from k)
  , c as (select doc_id, field, length(a) >= 4 and length(b) >= 4 and not (regexp_full_match(a, '[0-9]{{4}}') or regexp_full_match(b, '[0-9]{{4}}'))
      and list_bool_or(list_transform(va, lambda x: list_bool_or(list_transform(vb, lambda y: contains(y, x) or contains(x, y))))) hit from w)"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    price, key = F.floor("o_totalprice").cast("bigint"), F.col("o_orderkey")
    pair = lambda a, b: F.struct(F.lit(a).alias("name"), b.alias("value"))
    customer = (F.col("o_custkey") + 100000).cast("string")
    fields = orders.select(F.col("o_orderkey").alias("doc_id"), F.inline(F.array(
        pair("amount", F.concat(price.cast("string"), F.lit("00"))), pair("date", F.date_format("o_orderdate", "yyyyMMdd")), pair("customer", F.concat(F.lit("Customer "), customer)),
    ))).withColumnRenamed("name", "field")
    facts = orders.select(F.col("o_orderkey").alias("doc_id"), F.inline(F.array(
        pair("total", F.concat((price + F.when(key % 3 == 0, 1).otherwise(0)).cast("string"), F.lit("00"))), pair("issued", F.date_format("o_orderdate", "dd/MM/yyyy")),
        pair("holder", F.when(key % 2 == 0, F.concat(F.lit("M. customer "), customer)).otherwise("other name")),
    ))).withColumnRenamed("name", "field_code").withColumn("role", F.lit(None).cast("string"))
    selectors = spark.createDataFrame([("amount", "total", None), ("date", "issued", None), ("customer", "holder", None)], "field string, field_code string, role string")
    return m.field_consistency(fields, F.broadcast(selectors), facts)


@query(_COMPARED + " select doc_id, field, 1 candidates, case when hit then 'matched' else 'unmatched' end state from c")
def field_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)


@query(_COMPARED + " select doc_id, count(*) filter (hit) matched, count(*) filter (not hit) unmatched, count(*) filter (hit) >= 2 and count(*) filter (not hit) > 0 mismatch from c group by doc_id")
def consistency_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.consistency_mismatch(_compared(spark, sf_dir))


@query("select doc_id, field, contains(lower(regexp_replace(strip_accents(text), '[^a-zA-Z0-9]+', '', 'g')), value) visible from documents, (values ('a', 'ofthe'), ('b', 'schund'), ('c', 'zzzzzzz')) t(field, value)")
def visible_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = F.array(*[F.struct(F.lit(a).alias("field"), F.lit(b).alias("value")) for a, b in (("a", "of the"), ("b", "sch und"), ("c", "zzzzzzz"))])
    return m.visible_fields(docs.select("doc_id", F.inline(pairs)), docs)


@query(
    """with n as (select s_suppkey id, s_nationkey g, case when s_suppkey % 3 = 0 then 'Rivière ' else 'Riviere' end || (s_suppkey % 40) as name from supplier), r as (select *, lower(regexp_replace(strip_accents(name), '[^a-zA-Z0-9]+', '', 'g')) k from n)
  , k as (select g, k, min(id) id, min_by(name, id) as name, count(*) copies from r group by g, k)
  select a.g, a.id short_id, b.id long_id, a.name short_name, b.name long_name, a.copies short_copies, b.copies long_copies from k a join k b on a.g = b.g and length(b.k) - length(a.k) = 1 and contains(b.k, a.k) and length(a.k) >= 5"""
)
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "Rivière ").otherwise("Riviere"), F.col("s_suppkey") % 40)
    return m.name_pairs(table(spark, sf_dir, "supplier").withColumn("name", name), "s_nationkey", "name", "s_suppkey")


@query("select doc_id, country from (select c_custkey // 3 doc_id, count(distinct n_name) n, min(n_name) country from customer join nation on c_nationkey = n_nationkey group by c_custkey // 3) where n = 1")
def sole_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return m.sole_country(rows.select(F.floor(F.col("c_custkey") / 3).cast("bigint").alias("doc_id"), F.col("n_name").alias("country")))


@query(
    """with r as (select l_orderkey, min(l_linenumber) k from lineitem where l_returnflag = 'R' group by l_orderkey)
  select o_orderkey doc_id, 1 fact_ix, case when r.l_orderkey is null then o_orderstatus else 'line ' || k end as value, case when r.l_orderkey is null then 'unchanged' else 'corrected' end status from orders left join r on o_orderkey = l_orderkey"""
)
def reviewed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("fact_ix"), F.col("o_orderstatus").alias("value"))
    verdict = F.when(F.col("l_returnflag") == "R", "contradicted").otherwise("confirmed")
    reviews = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("fact_ix"), F.col("l_linenumber").alias("review_ix"), verdict.alias("verdict"), F.concat(F.lit("line "), F.col("l_linenumber")).alias("correction")
    )
    return m.reviewed(facts, reviews)


@query(
    """select 'union' op, count(*) n from (select c_nationkey k from customer union select s_nationkey from supplier) union all
  select 'except', count(*) from (select o_custkey k from orders where o_orderkey % 2 = 0 except select o_custkey from orders where o_orderkey % 2 = 1) union all
  select 'intersect_all', count(*) from (select l_quantity k from lineitem where l_returnflag = 'R' intersect all select l_quantity from lineitem where l_returnflag = 'A')"""
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier, orders, items = (table(spark, sf_dir, n) for n in ("customer", "supplier", "orders", "lineitem"))
    both = customer.select(F.col("c_nationkey").alias("k")).unionByName(supplier.select(F.col("s_nationkey").alias("k"))).distinct()
    even, odd = (orders.where(f"o_orderkey % 2 = {r}").select(F.col("o_custkey").alias("k")) for r in (0, 1))
    returned, accepted = (items.where(f"l_returnflag = '{f}'").select(F.col("l_quantity").alias("k")) for f in "RA")
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(both, "union").unionByName(count(even.distinct().join(odd, "k", "left_anti"), "except")).unionByName(count(returned.intersectAll(accepted), "intersect_all"))


@query("select l_orderkey doc_id, count(*) n, round(sum(case when l_suppkey % 5 = 0 then 1.0 else l_quantity end), 2) points from lineitem group by l_orderkey")
def replaced_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("d"), F.col("l_suppkey") % 5).alias("detector"), F.col("l_quantity").alias("points"))
    new = rows.where("detector = 'd0'").withColumn("points", F.lit(1.0))
    return m.replace_detector(rows, "d0", new).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("points"), 2).alias("points"))


_CODES = (*authenticity.RULES, "OTHER_CODE")


@query(
    "with rules(code, category, points) as (values " + ", ".join(f"('{k}', '{c}', {p}::double)" for k, (c, p) in authenticity.RULES.items()) + f""")
  , o as (select l_orderkey doc_id, l_linenumber page, [{", ".join(f"'{c}'" for c in _CODES)}][l_partkey % {len(_CODES)} + 1] code, l_suppkey % 5 chk, l_discount >= 0.05 hit, l_tax > 0.04 strong from lineitem)
  select doc_id, code, category, points as risk_points, case when strong then 0.95 else 0.80 end::double confidence, page from o join rules using (code) where hit and chk < 4"""
)
def authenticity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("l_partkey") % len(_CODES) + 1).cast("int"))
    check = F.element_at(F.array(*map(F.lit, (*authenticity.CHECKS, "fonts"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), check.alias("check_code"), code.alias("code"), F.when(F.col("l_discount") >= 0.05, "attention").otherwise("clear").alias("state"),
        F.when(F.col("l_tax") > 0.04, "strong").otherwise("weak").alias("strength"), F.col("l_linenumber").alias("page"),
    )
    return authenticity.authenticity_findings(rows).drop("detector")


@query(
    r"""with recursive n as (select master_id g, client_id id, name, lower(regexp_replace(strip_accents(name), '[^a-zA-Z0-9]+', '', 'g')) k, row_number() over (partition by master_id order by client_id) i from clients where master_id is not null and name is not null),
  v as (select g, count(*) n, list({'k': k, 'name': name} order by id) names from n group by g),
  s as (select g, i, j, row_number() over (partition by g order by i, j) step from v, range(1, n + 1) a(i), range(i + 1, n + 1) b(j)),
  f(g, step, names) as (select g, 0::bigint, names from v
    union all select g, step, case when short >= 5 and long - short = 1 and (contains(x.k, y.k) or contains(y.k, x.k)) then list_transform(names, lambda z, k: case when k in (i, j) then (case when length(y.k) > length(x.k) then y else x end) else z end) else names end
      from (select f.g, s.step, names, i, j, names[i] x, names[j] y, least(length(names[i].k), length(names[j].k)) short, greatest(length(names[i].k), length(names[j].k)) long from f join s on s.g is not distinct from f.g and s.step = f.step + 1)),
  l as (select g, max_by(names, step) names from f group by g)
  select g doc_id, id fact_ix, names[i].name as value, coalesce(names[i].name <> name, false) corrected from n join l using (g)"""
)
def reconciled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names under which one client is known, as repeats of one field."""
    facts = table(spark, sf_dir, "clients").where("master_id is not null and name is not null")
    return m.reconciled_names(facts.select(F.col("master_id").alias("doc_id"), F.col("client_id").alias("fact_ix"), F.lit("client").alias("role"), F.lit("Name").alias("label"), F.col("name").alias("value")))
