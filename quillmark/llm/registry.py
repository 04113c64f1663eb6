"""The contract queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html_text, langid, media, mixing, pii, quality, quality_rules, rabitq, simhash, stamps, turn_repair
from .common import bucket_of_id, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), bpe.default_vocabulary())


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_digests(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = bucket_of_id("doc_id", 5) == 0
    model = quality.fit(quality.sample(docs, labels, ~held_out))
    scored = quality.score(docs, model)
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op4_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", _SAID), (-1, 1, "assistant", _SAID)], "conv_id bigint, turn bigint, role string, text string")
    return chat.conversation_digests(chat.formatted_records(chat.mixed_records(turns.unionByName(extra))))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = bucket_of_id("doc_id", 4) == 2
    models = langid.fit(langid.sample(docs, ~held_out, "doc_id", "text", "lang"))
    return langid.identify(docs, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")), absent_col="dropped").drop("roles")


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op13_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamps.normalised(table(spark, sf_dir, "stamps"))


ALL = (op1_bpe, op2_media, op3_quality, op4_rabitq, op5_mixing, op6_chat, op7_langid, op8_html, op9_pii, op10_simhash, op11_repair, op12_rules, op13_stamps)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}


#: All pairs of a label in double precision, and components by reachability.
OP4_SQL = """with recursive v as (
    select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings where label is not null and vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l as (select a.vec_id u, b.vec_id w from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
  r(u, w) as (select u, u from (select distinct u from l) union select r.u, l.w from r join l on l.u = r.w),
  c as (select u, min(w) component_id from r group by u), n as (select u, count(*) n_links from l group by u)
select vec_id, coalesce(n_links, 0) n_links, coalesce(component_id, vec_id) component_id, coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join c on c.u = vec_id left join n on n.u = vec_id"""

_SAID = "<|im_end|><|im_start|>assistant ok"
#: Digests and lengths of the template by string functions over the table.
OP6_SQL = rf"""with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations union all select -1, 0, 'user', '{_SAID}' union all select -1, 1, 'assistant', '{_SAID}')
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x)) turns_sha256,
  coalesce(sum(length(x)) filter (r = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(x, '' order by turn nulls first, r, x) filter (r = 'assistant'), '')) loss_sha256,
  sum(24 + length(r) + len(regexp_extract_all(r, '[\\\n]')) + len(regexp_extract_all(r, '<\\*\|')) + length(x) + len(regexp_extract_all(x, '<\\*\|')))::bigint formatted_chars
from t group by conv_id"""


#: Checksums bit by bit, and least (cost, audit, lines) by state, a row a recursion.
OP11_SQL = r"""with recursive k as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') name from conversations),
  h as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, xor(list_reduce(list_transform(string_split(name, ''), lambda c: ord(c)::ubigint), lambda crc, b:
      list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, zero: xor(x >> 1, 3988292384::ubigint * (x & 1)), xor(crc, b)), 4294967295::ubigint), 4294967295::ubigint) % 20 harm from k),
  d as (select conv_id, turn, case when harm = 4 then 'user' else role end r, case harm when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end x
      from h, range(case harm when 0 then 0 when 3 then 2 else 1 end)),
  f as (select *, row_number() over (partition by conv_id order by turn nulls first, r, x) n, right(rtrim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) final from d),
  a as (select *, row_number() over (partition by conv_id, r, x order by n) again from f),
  t as (select *, case when final = '' then 'blank' when again > 1 then 'duplicate' when final not in ('.', '!', '?') then 'truncated' else '' end fault, r[1] i, lag(r[1]) over (partition by conv_id order by n) before from a),
  ins(state, mid, letters, lines) as (values (0, 0, '', []::varchar[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']),
      (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])),
  emit(mid, i, role, next) as (values (0, 's', 'system', 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (3, 'u', 'user', 2), (2, 'a', 'assistant', 3)),
  act(mid, i, how, role, next) as (select mid, i, 'K', null, next from emit union all select mid, null, 'R', role, next from emit where i <> 's' union all select m, null, 'D', null, m from range(4) q(m)),
  path(conv_id, n, state, best) as (
    select conv_id, 0::bigint, 0, {'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]} from (select distinct conv_id from t)
    union all
    select p.conv_id, t.n, act.next::int, min({'cost': p.best.cost + 3 * length(letters) + case how when 'K' then 0 when 'R' then 3 else 4 end + case when fault = 'truncated' and how <> 'D' then 3 else 0 end,
        'audit': p.best.audit || letters || how, 'lines': p.best.lines || ins.lines || case when how = 'D' then [] else [coalesce(act.role, t.r) || ':' || t.x] end})
    from path p join t on t.conv_id is not distinct from p.conv_id and t.n = p.n + 1 join ins on ins.state = p.state join act on act.mid = ins.mid
    where how = 'D' or (fault not in ('blank', 'duplicate') and (how = 'R' or t.i = act.i))
    group by p.conv_id, t.n, act.next),
  w as (select conv_id, min({'cost': best.cost + 3 * length(letters), 'audit': best.audit || letters, 'lines': best.lines || ins.lines}) best
      from (select *, max(n) over (partition by conv_id) top from path) p join ins on ins.state = p.state where n = top and ins.mid in (0, 3) group by conv_id),
  s as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate,
      count(*) filter (fault = 'truncated') truncated, count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) illegal from t group by conv_id)
select c.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  coalesce(w.best.cost, 0) cost, coalesce(w.best.audit, '') audit, sha256(coalesce(array_to_string(w.best.lines, chr(10)), '')) repaired_sha256
from (select distinct conv_id from conversations) c left join s on s.conv_id is not distinct from c.conv_id left join w on w.conv_id is not distinct from c.conv_id"""

_LIKE = [[x for told in quality_rules.RULES.values() for x in told[k]] for k in (0, 1)]
#: Counts by lists and groups, votes, and as many rounds of the model over the list of patterns.
OP12_SQL = rf"""with recursive d as (select row_number() over () rn, doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
  g as (select rn, unnest(range(1, len(w) - 1)) i, unnest([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)]) gram from d where len(w) >= 3),
  h as (select rn, i, count(*) over (partition by rn, gram) times from g),
  q as (select rn, count(distinct i + k) again from h, range(3) o(k) where times > 1 group by rn),
  c as (select d.rn, doc_id, len(w) n_words, coalesce(again, 0) n_repeat_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l, length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')) letters, length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) capitals,
      len(list_filter(w, lambda x: not regexp_matches(x, '\p{{L}}'))) odd, len(list_filter(w, lambda x: x[-1] in ('.', '?', '!'))) ends, len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}\x20\x09-\x0D]{{2,}}')) runs,
      length(t) - length(replace(t, '!', '')) shouts from d left join q on q.rn = d.rn),
  s as (select *, len(l) - len(list_distinct(l)) n_dup_lines, [n_symbols / nullif(n_words, 0) >= 0.2, capitals / nullif(letters, 0) >= 0.5, len(l) >= 4 and (len(l) - len(list_distinct(l))) / len(l) >= 0.4,
      n_repeat_words / nullif(n_words, 0) >= 0.35, odd / nullif(n_words, 0) >= 0.3, shouts / nullif(n_words, 0) >= 0.3, runs / nullif(n_words, 0) >= 0.3, letters / nullif(word_chars, 0) < 0.7,
      word_chars / nullif(n_words, 0) not between 2.2 and 20, n_words >= 20 and ends / n_words not between 0.004 and 0.4, n_words < 20] bad, n_words >= 20 and ends / n_words between 0.02 and 0.2 prose from c),
  v as (select *, [3 * (k - 1) + case when coalesce(bad[k], false) then 0 when k = 10 and prose then 2 else 1 end for k in range(1, 12)] places from s),
  p as (select list({{'pl': places, 'n': n}} order by places) ps, sum(n)::double total from (select places, count(*)::double n from v group by places)),
  em(i, odds, ratios) as (
    select 0, ln({quality_rules.PRIOR} / (1 - {quality_rules.PRIOR})), list_transform(list_zip({_LIKE[0]}, {_LIKE[1]}), lambda x: ln(x[1]::double) - ln(x[2]::double))
    union all
    select i + 1, ln((good + weight * {quality_rules.PRIOR}) / (total - good + weight * (1 - {quality_rules.PRIOR}))),
      [ln(a[k + 1] / (a[k - k % 3 + 1] + a[k - k % 3 + 2] + a[k - k % 3 + 3])) - ln(b[k + 1] / (b[k - k % 3 + 1] + b[k - k % 3 + 2] + b[k - k % 3 + 3])) for k in range({len(_LIKE[0])})]
    from (select *, [weight * {quality_rules.PRIOR} * {_LIKE[0]}[k + 1] + coalesce(list_sum([x.g for x in r if x.pl[k // 3 + 1] = k]), 0) for k in range({len(_LIKE[0])})] a,
            [weight * (1 - {quality_rules.PRIOR}) * {_LIKE[1]}[k + 1] + coalesce(list_sum([x.n - x.g for x in r if x.pl[k // 3 + 1] = k]), 0) for k in range({len(_LIKE[0])})] b, list_sum([x.g for x in r]) good
          from (select i, total, total * {quality_rules.TRUST} + {quality_rules.LEAST} weight, [{{'pl': x.pl, 'n': x.n, 'g': x.n / (1 + exp(-(odds + list_sum([ratios[k + 1] for k in x.pl]))))}} for x in ps] r
                from em, p where i < {quality_rules.ROUNDS} and total > 0))),
  z as (select *, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.REPEATED_PERCENT} * n_words base_failed, 1 / (1 + exp(-(odds + list_sum([ratios[k + 1] for k in places])))) quality
      from v, em where i = {quality_rules.ROUNDS})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and quality >= {quality_rules.KEEP} as kept, round(quality, 6) quality from z"""

#: Patterns, votes by source, and the offsets a day before and after a wall time, of which the earlier holds wherever it fits or neither does.
OP13_SQL = r"""with s as (select stamp_id, source, zone, regexp_extract(coalesce(raw, ''), '^[\x20\x09-\x0D]*((?s:.*?))[\x20\x09-\x0D]*$', 1) t from stamps),
  f as (select *, regexp_full_match(t, '[0-9]{10}|[0-9]{13}') epoch,
      regexp_extract(t, '^(?:(20[0-9]{2})-([0-9]{2})-([0-9]{2})|(20[0-9]{2})([0-9]{2})([0-9]{2})|([0-9]{2})[.]([0-9]{2})[.](20[0-9]{2})|([0-9]{2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20[0-9]{2})|([0-9]{2})/([0-9]{2})/(20[0-9]{2}))(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AP])M)?(?: ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?$',
        ['y1','m1','d1','y2','m2','d2','d3','m3','y3','d4','b4','y4','p','q','y5','h','n','s','half','off']) g from s),
  n as (select stamp_id, source, zone, t, epoch, coalesce(nullif(g.y1, ''), nullif(g.y2, ''), nullif(g.y3, ''), nullif(g.y4, ''), nullif(g.y5, ''))::int y, g.p <> '' slash,
      coalesce(nullif(g.m1, ''), nullif(g.m2, ''), nullif(g.m3, ''), nullif(g.p, ''), case when g.b4 <> '' then ((position(g.b4 in 'JanFebMarAprMayJunJulAugSepOctNovDec') + 2) // 3)::varchar end)::int m,
      coalesce(nullif(g.d1, ''), nullif(g.d2, ''), nullif(g.d3, ''), nullif(g.d4, ''), nullif(g.q, ''))::int d,
      coalesce(nullif(g.h, ''), '0')::int h, coalesce(nullif(g.n, ''), '0')::int n, coalesce(nullif(g.s, ''), '0')::int s, g.half, g.off,
      case when g.off in ('', 'Z') then 0 else (case when g.off[1] = '-' then -1 else 1 end) * (g.off[2:3]::int * 60 + g.off[-2:]::int) end off_min, case when g.off in ('', 'Z') then true else g.off[2:3]::int <= 14 and g.off[-2:]::int <= 59 end off_ok from f),
  c as (select *, case when not epoch and y is not null and n <= 59 and s <= 59 and off_ok and case when half = '' then h <= 23 else h between 1 and 12 end
        then (case when half = '' then h when half = 'A' then h % 12 else h % 12 + 12 end) * 3600 + n * 60 + s end clock,
      try_cast(format('{:04d}-{:02d}-{:02d}', y, m, d) as date) mf, case when slash then try_cast(format('{:04d}-{:02d}-{:02d}', y, d, m) as date) end df from n),
  p as (select *, clock is not null and (mf is not null or df is not null) ok from c),
  v as (select source, count(*) filter (df is null) vm, count(*) filter (mf is null) vd from p where ok and slash and (mf is null or df is null) group by source),
  r as (select stamp_id, zone, t, off, off_min, clock, case when epoch then 'epoch' when not ok then 'bad' when slash and mf is not null and df is not null and mf <> df
        then case when coalesce(vm, 0) > 3 * coalesce(vd, 0) or coalesce(vd, 0) > 3 * coalesce(vm, 0) then 'votes' else 'default' end else 'plain' end rule,
      case when mf is null or (df is not null and coalesce(vd, 0) > 3 * coalesce(vm, 0)) then df else mf end dt from p left join v on v.source is not distinct from p.source),
  w as (select *, case when rule not in ('bad', 'epoch') then epoch_us(dt::timestamp) + clock::bigint * 1000000 end wall from r),
  o as (select *, epoch_us(timezone(zone, make_timestamptz(wall - 86400000000))) - wall + 86400000000 before, epoch_us(timezone(zone, make_timestamptz(wall + 86400000000))) - wall - 86400000000 after from w),
  k as (select *, epoch_us(timezone(zone, make_timestamptz(wall - before))) = wall vb, epoch_us(timezone(zone, make_timestamptz(wall - after))) = wall va from o)
select stamp_id, case when rule = 'epoch' then t::bigint * case when length(t) = 10 then 1000000 else 1000 end when rule = 'bad' then null when off <> '' then wall - off_min * 60000000::bigint
    when vb or not va then wall - before else wall - after end utc_us,
  rule, rule in ('votes', 'default') or (rule = 'plain' and off = '' and before <> after and vb = va) ambiguous from k"""


def oracle_sql() -> dict[str, str]:
    return {"op4_rabitq": OP4_SQL, "op6_chat": OP6_SQL, "op11_repair": OP11_SQL, "op12_rules": OP12_SQL, "op13_stamps": OP13_SQL}
