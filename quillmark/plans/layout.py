"""Regions, tables, boxes, windows, budgets and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import chunks, geometry, regions, tables
from quillmark.plans import query, table
from quillmark.streaming import inbox


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as recognised pages: a turn is a region, two turns make a page."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    region = F.struct(
        F.col("turn").alias("index"), F.array(*map(F.lit, (0.0, 0.0, 500.0, 500.0))).alias("bbox_2d"), F.col("text").alias("content"), F.upper("role").alias("label"),
        F.when(F.col("turn") % 3 == 0, F.col("turn") % 100 + 1.5).alias("confidence"),
    )
    pages = turns.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("page")).agg(F.sort_array(F.collect_list(region)).alias("regions"))
    docs = pages.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "regions"))), lambda p: p["regions"]).alias("pages"))
    return docs.select(F.col("conv_id").alias("doc_id"), F.to_json("pages").alias("ocr_json"))


_REGIONS = r"""with r as (select conv_id doc_id, dense_rank() over (partition by conv_id order by turn // 2) page,
    row_number() over (partition by conv_id, turn // 2 order by turn) - 1 region_ix, turn, role, trim(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')) content from conversations where text is not null)"""


@query(_REGIONS + """ select doc_id, page, region_ix, printf('p%03d-r%03d', page, region_ix) region_id, turn reading_order, upper(role) as label, length(content) chars,
  case when turn % 3 = 0 then (turn % 100 + 1.5) / 100 end confidence from r""")
def flattened_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions.flatten_regions(_payloads(spark, sf_dir))
    return rows.select("doc_id", "page", "region_ix", "region_id", "reading_order", "label", F.length("content").alias("chars"), "confidence")


@query(_REGIONS + """ select doc_id, count(distinct page) pages, count(*) regions, sum(length(content)) chars, count(*) filter (role = 'assistant') tables,
  case when count(*) >= 2 and sum(length(content)) >= 40 then 'clear' else 'indeterminate' end state from r group by doc_id""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions.flatten_regions(_payloads(spark, sf_dir)).withColumn("label", F.when(F.col("label") == "ASSISTANT", "table").otherwise("text"))
    return regions.quality_gate(rows)


_TOKENS = "regexp_extract_all(lower(regexp_replace(replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', ' ', 'g')), '[a-z0-9]+')"
_AGREEMENT = f"""with l as (select doc_id, token, count(*) n from (select doc_id, unnest({_TOKENS.format(c="text")}) token from documents) group by all)
  , r as (select page_id doc_id, token, count(*) n from (select page_id, unnest({_TOKENS.format(c="html")}) token from pages) group by all)
  , b as (select doc_id, sum(least(coalesce(l.n, 0), coalesce(r.n, 0))) common, sum(coalesce(l.n, 0)) nl, sum(coalesce(r.n, 0)) nr from l full join r using (doc_id, token) group by doc_id)
  , a as (select doc_id, coalesce(case when nl > 0 and nr > 0 then 2.0 * common / (nl + nr) else 0.0 end, 0.0) agreement from (select doc_id from documents union select page_id from pages) left join b using (doc_id))"""


def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return regions.token_agreement(table(spark, sf_dir, "documents"), pages, "text", "html")


@query(_AGREEMENT + " select doc_id, round(agreement, 6) agreement from a")
def token_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agreement(spark, sf_dir).select("doc_id", F.round("agreement", 6).alias("agreement"))


@query(
    _AGREEMENT + """, c as (select o_custkey doc_id, list_sort(list(round(o_totalprice % 1, 2))) c from orders group by o_custkey)
  , s as (select doc_id, c[(cast(floor((len(c) - 1) * 0.25) as int)) + 1] native, case when doc_id % 4 = 3 then null else agreement end agreement from a left join c using (doc_id))
  , t as (select doc_id, case when native is not null and agreement is not null then 0.8 * native + 0.2 * agreement when native is not null then native when agreement is not null then least(0.8, 0.55 + 0.25 * agreement) else 0.5 end score,
      case when native is not null then 'native_confidence' when agreement is not null then 'json_markdown_agreement' else 'no_confidence_available' end source from s)
  select doc_id, round(score, 6) score, source, case when score >= 0.78 then 1.0 when score >= 0.65 then 0.75 else 0.0 end point_factor from t"""
)
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    native = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.collect_list(F.round(F.col("o_totalprice") % 1, 2)).alias("confidences"))
    rows = _agreement(spark, sf_dir).join(native, "doc_id", "left").withColumn("agreement", F.when(F.col("doc_id") % 4 != 3, F.col("agreement")))
    return regions.reliability(rows).withColumn("score", F.round("score", 6))


@query(
    """select n_nationkey doc_id, 0 table_ix, r row_ix, c col_ix, r = 0 is_header, case when r = 0 then ['Code', 'Name / Latin'][c + 1] when c = 0 then n_nationkey::varchar else n_name end as text
  from nation cross join (select unnest([0, 1]) r) cross join (select unnest([0, 1]) c)"""
)
def html_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = F.format_string("<p>x</p><table><tr><th rowspan=2>Code</th><th>Name</th></tr><tr><th>Latin</th></tr><tr><td>%d</td><td><b>%s</b></td></tr></table>", "n_nationkey", "n_name")
    return tables.html_cells(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), markup.alias("html")), "doc_id", "html")


@query("select r_regionkey doc_id, case when r_regionkey = 4 then null else 2 end n_rows, case when r_regionkey = 4 then null else r_name end first_name from region")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("r_regionkey") == 4, "| a | b |").otherwise("|---|:---:|")
    text = F.format_string("Intro\n| key | name |\n%s\n| %d | %s |\nend", line, "r_regionkey", "r_name")
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), tables.markdown_rows(text).alias("t"))
    return rows.select("doc_id", F.when(F.col("t").isNotNull(), F.size("t")).alias("n_rows"), F.get(F.get("t", F.lit(1)), F.lit(1)).alias("first_name"))


_HEADERS = {
    "Date de valeur": "value_date", "Date": "transaction_date", "Libellé": "description", "Débit": "debit_amount", "Credits": "credit_amount", "Solde": "balance",
    "Devise": "currency", "Qté": "quantity", "Prix unitaire": "unit_price", "Taux de TVA": "tax_rate", "Montant TVA": "tax_amount", "Code acte": "service_code",
    "SKU": "product_code", "Total ligne": "line_total", "Montant": "amount", "Total": "amount", "Autre": "other", "": "other",
}


_LIST = ", ".join(f"'{h}'" for h in _HEADERS)


@query(
    "with h(header, role) as (values " + ", ".join(f"('{h}', '{r}')" for h, r in _HEADERS.items()) + f"""), c as (select p_partkey, [{_LIST}][p_partkey % {len(_HEADERS)} + 1] header from part)
  select p_partkey, upper(header) as header, case when role = 'amount' and p_partkey % 2 = 0 then 'line_total' else role end as role from c join h using (header)"""
)
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.upper(F.element_at(F.array(*map(F.lit, _HEADERS)), (F.col("p_partkey") % len(_HEADERS) + 1).cast("int")))
    kind = F.when(F.col("p_partkey") % 2 == 0, "invoice_lines").otherwise("bank_transactions")
    return table(spark, sf_dir, "part").select("p_partkey", header.alias("header"), tables.column_role(header, kind).alias("role"))


@query(
    """with i as (select p_partkey, p_size * 41 + 200 w, p_size * 25 + 230 h from part), f as (select *, cast(round_even((w - 224) / 2.0, 0) as int) cx, cast(round_even((h - 224) / 2.0, 0) as int) cy from i where w >= 224 and h >= 224)
  , g as (select p_partkey, i, j, greatest(abs(i), abs(j)) ring, cx + j * 224 "left", cy + i * 224 top from f, unnest(range(-(cy // 224), (h - cy - 224) // 224 + 1)) a(i), unnest(range(-(cx // 224), (w - cx - 224) // 224 + 1)) b(j))
  select p_partkey, row_number() over (partition by p_partkey order by ring, abs(i) + abs(j), i, j) - 1 window_ix, ring, "left", top, i = 0 and j = 0 is_center from g"""
)
def lattice_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 41 + 200).alias("width"), (F.col("p_size") * 25 + 230).alias("height"))
    return geometry.lattice(images)


@query(
    """select p_partkey, case when c >= 0.65 then 'document' when w is null then 'unknown' when c < 0.02 or least(w, h) < 256 or w * h < 262144 then 'decorative' else 'photo' end as role, round(c, 6) covered
  from (select p_partkey, case when p_partkey % 9 = 0 then null else p_size * 30 end w, p_size * 40 h, least(1.0, (p_size * 12.0) * (p_size * 11.0) / (612.0 * 792.0)) c from part)"""
)
def image_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("p_size") * 12.0).alias("x1"), (F.col("p_size") * 11.0).alias("y1"))
    covered = geometry.coverage(box, F.lit(612.0), F.lit(792.0))
    width = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") * 30)
    return table(spark, sf_dir, "part").select("p_partkey", geometry.image_role(covered, width, F.col("p_size") * 40).alias("role"), F.round(covered, 6).alias("covered"))


@query("select l_orderkey, l_linenumber, case when l_tax = 0 then null else l_quantity + l_tax end x1, case when l_tax = 0 then null else 800 - l_quantity end y0, case when l_tax = 0 then null else 800.0 end y1 from lineitem")
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    right = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(q + F.col("l_tax"))
    box = geometry.top_left_box(F.lit(0.0), F.lit(0.0), right, q, F.lit(800.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box["x1"].alias("x1"), box["y0"].alias("y0"), box["y1"].alias("y1"))


_NEAR = "not (a.x1 + 12 < b.x0 or b.x1 + 12 < a.x0 or a.y1 + 6 < b.y0 or b.y1 + 6 < a.y0)"


@query(
    f"""with recursive b as (select l_orderkey, row_number() over (partition by l_orderkey order by y0, x0, y1, x1) n, {{'y0': y0, 'x0': x0, 'y1': y1, 'x1': x1}} b
    from (select l_orderkey, (l_quantity * 10)::double x0, l_partkey % 80 * 10.0::double y0, (l_quantity * 10 + 40)::double x1, l_partkey % 80 * 10.0::double + 12 y1 from lineitem))
  , f(l_orderkey, n, acc) as (select l_orderkey, 1, [b] from b where n = 1
    union all select f.l_orderkey, f.n + 1, case when list_bool_or(list_transform(acc, lambda a: {_NEAR})) then list_transform(acc, lambda a, i: case when i = list_position(list_transform(acc, lambda a: {_NEAR}), true)
        then {{'y0': least(a.y0, b.y0), 'x0': least(a.x0, b.x0), 'y1': greatest(a.y1, b.y1), 'x1': greatest(a.x1, b.x1)}} else a end) else list_append(acc, b) end
      from f join b on b.l_orderkey = f.l_orderkey and b.n = f.n + 1)
  , last as (select l_orderkey, acc from (select *, row_number() over (partition by l_orderkey order by n desc) k from f) where k = 1)
  select l_orderkey, m.y0 y0, m.x0 x0, m.y1 y1, m.x1 x1 from (select l_orderkey, unnest(acc) m from last)"""
)
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct((F.col("l_quantity") * 10).cast("double").alias("x0"), (F.col("l_partkey") % 80 * 10.0).alias("y0"), (F.col("l_quantity") * 10 + 40).cast("double").alias("x1"), (F.col("l_partkey") % 80 * 10.0 + 12).alias("y1"))
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("b"))
    return pages.select("l_orderkey", F.inline(geometry.merged_boxes(F.col("b"))))


_WINDOWS = "with w as (select vec_id, (c + 1) / 2.0 score from (select vec_id, cast(unnest(embedding) as double) c from embeddings))"


@query(
    _WINDOWS + """, s as (select vec_id, count(*) windows, quantile_cont(score, 0.5) median, quantile_cont(score, 0.1) p10, quantile_cont(score, 0.25) p25, quantile_cont(score, 0.9) p90, max(score) highest, avg(case when score >= 0.5 then 1.0 else 0.0 end) share from w group by vec_id)
  , g as (select *, greatest(0.0, least(1.0, 0.5 * median + 0.3 * p25 + 0.2 * share)) global_score from s)
  select vec_id, windows, round(median, 5) median, round(p10, 5) p10, round(p25, 5) p25, round(p90, 5) p90, round(highest, 5) highest, round(share, 5) share, round(global_score, 5) global_score,
    round(30 * greatest(0.0, least(1.0, (round(global_score, 5) - 0.5) / 0.4)) * greatest(0.0, least(1.0, (round(global_score, 5) - 0.5) / 0.4)), 2) points from g"""
)
def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("c")).select("vec_id", ((F.col("c").cast("double") + 1) / 2).alias("score"))
    out = geometry.window_summary(scores, "vec_id")
    out = out.select("vec_id", "windows", *[F.round(c, 5).alias(c) for c in ("median", "p10", "p25", "p90", "highest", "share", "global_score")])
    return out.withColumn("points", geometry.curve_points(F.col("global_score")))


@query(
    """with e as (select l_orderkey image_id, 'f' || l_suppkey % 3 family, 'a' || l_linenumber adapter, l_tax * 5 + 0.6 s1, l_tax * 5 + 0.6 - l_discount * 2 s2, l_returnflag <> 'R' ok from lineitem)
  , k as (select *, row_number() over (partition by image_id, family order by s1 desc, adapter) n from e where ok and round(greatest(s1, s2) - least(s1, s2), 9) <= 0.15 and round(s1, 9) >= 0.8)
  , b as (select * from k where n = 1) select image_id, family, adapter, round(s1, 6) score, count(*) over (partition by image_id) families, case when count(*) over (partition by image_id) >= 2 then 35.0 else 0.0 end points from b"""
)
def model_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.round(F.col("l_tax") * 5 + 0.6, 9)
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.concat(F.lit("f"), F.col("l_suppkey") % 3).alias("family"), F.concat(F.lit("a"), F.col("l_linenumber")).alias("adapter"),
        F.array(first, F.round(first - F.col("l_discount") * 2, 9)).alias("scores"), F.when(F.col("l_returnflag") == "R", "error").otherwise("completed").alias("status"),
    )
    return geometry.consensus(rows, spread=0.15 + 1e-9).withColumn("score", F.round("score", 6))


@query(
    """select o_custkey, o_orderkey, used from (select o_custkey, o_orderkey, 2 + sum(length(o_orderpriority) * 40 + 1) over (partition by o_custkey order by o_orderkey) used, row_number() over (partition by o_custkey order by o_orderkey) n from orders) where used <= 9500 or n = 1"""
)
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of one customer's file: its orders in turn, as far as they fit."""
    rows = table(spark, sf_dir, "orders").withColumn("size", F.length("o_orderpriority") * 40)
    return chunks.fitting_prefix(rows, 12_000, "o_custkey", "o_orderkey", "size").select("o_custkey", "o_orderkey", "used")


@query(
    """with recursive t as (select conv_id, turn, length(text) size, 40 as over_, row_number() over (partition by conv_id order by turn) n from conversations where text is not null)
  , f(conv_id, n, chunk, used, turn, first_chunk, parts) as (
    select conv_id, 0::bigint, 0::bigint, 0::bigint, null::bigint, null::bigint, null::bigint from (select distinct conv_id from t)
    union all select f.conv_id, t.n,
      case when size + over_ > 900 then f.chunk + (case when used > 0 then 1 else 0 end) + cast(ceil(size / 860.0) as bigint) when used = 0 or used + size + over_ <= 900 then f.chunk else f.chunk + 1 end,
      case when size + over_ > 900 then 0 when used = 0 or used + size + over_ <= 900 then used + size + over_ else size + over_ end, t.turn,
      case when size + over_ > 900 then f.chunk + (case when used > 0 then 1 else 0 end) when used = 0 or used + size + over_ <= 900 then f.chunk else f.chunk + 1 end,
      case when size + over_ > 900 then cast(ceil(size / 860.0) as bigint) else 1 end
    from f join t on t.conv_id = f.conv_id and t.n = f.n + 1)
  select conv_id, turn, part, first_chunk + part as chunk from f, unnest(range(parts)) p(part) where turn is not null"""
)
def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.length("text").alias("size"), F.lit(40).alias("over"))
    return chunks.greedy_chunks(turns, 900, "conv_id", "turn", "size", "over")


@query("select date_trunc('hour', ts) as start, event_type, count(*) n, round(sum(value), 2) total from events group by all")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.windowed_counts(table(spark, sf_dir, "events"))
