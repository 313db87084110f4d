"""One query for each operator over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, html_text, langid, media, mixing, ngram_join, packing, phrases, piece_codec, pii, token_counts, warc, winnowing
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.build_derivatives(warc.pages_as_warc(table(spark, sf_dir, "pages")), "page_id")
    return made.withColumn("record_sha256", F.sha2("record", 256)).withColumn("record", F.decode("record", "UTF-8"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store_texts(table(spark, sf_dir, "documents"), previews=True))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.sample_key(spark))
    return made.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.concat_ws(",", F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"], e["length"]))).alias("spans"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = piece_codec.encode(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.find_repairs(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_mix_sources, op3_winnowing, op4_warc, op5_ngram_join, op6_best_fit_packing, op7_language_id, op8_media_columns, op9_pii_surrogates, op10_html_extraction, op11_piece_codec, op12_conversation_repair, op13_phrase_mining)}

OP5_SQL = r"""
with recursive words as (
  select rowid as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from (select row_number() over () as rowid, * from documents)
), sets as (
  select r, doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as s
  from words
), items as (select r, unnest(s) as g from sets),
shared as (select a.r as a, b.r as b, count(*) as n from items a join items b on a.g = b.g and a.r < b.r group by all),
links as (
  select a, b from shared join sets x on x.r = a join sets y on y.r = b where 100 * n >= 80 * (len(x.s) + len(y.s) - n)
), both_ways as (select a, b from links union all select b, a from links),
reach(r, to_r) as (
  select r, r from sets union select reach.r, both_ways.b from reach join both_ways on reach.to_r = both_ways.a
)
select x.doc_id, len(x.s)::bigint as n_shingles, min(y.doc_id) as component_id
from sets x join reach on reach.r = x.r join sets y on y.r = reach.to_r group by x.r, x.doc_id, x.s
"""

OP12_SQL = r"""
with recursive source as (
  select conv_id, turn, coalesce(conv_id::varchar, ' ') as conv, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
  from conversations
), coded as (
  select *, xor(4294967295, list_reduce(list_prepend(4294967295::ubigint, list_transform(range(8 * strlen(key)), lambda j: ((ascii(key[(j // 8 + 1)::bigint]) >> (j % 8)::int) & 1)::ubigint)),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384::ubigint * (xor(c, b) & 1::ubigint)))) % 20 as k
  from source
), damaged as (
  select conv, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from coded, range(case when k = 3 then 2 else 1 end) where k <> 0
), numbered as (
  select *, row_number() over (partition by conv order by turn nulls first, role, text) as i from damaged
), placed as (
  select *, row_number() over (partition by conv, role, text order by i) - 1 as earlier, lag(role) over (partition by conv order by i) as role_before, rtrim(text, e' \t\n\u000b\f\r') as shown
  from numbered
), lines as (
  select *, shown = '' as blank, shown <> '' and earlier > 0 as again, shown <> '' and earlier = 0 and right(shown, 1) not in ('.', '!', '?') as cut,
    case when shown <> '' and earlier = 0 and right(shown, 1) not in ('.', '!', '?') then 3 else 0 end as x, left(role, 1) as ini
  from placed
), walk as (
  select conv, 0::bigint as i, {'c': 0::bigint, 'a': '', 't': null::varchar} as e, null::struct(c bigint, a varchar, t varchar) as s, null::struct(c bigint, a varchar, t varchar) as u, null::struct(c bigint, a varchar, t varchar) as a
  from (select distinct conv from source)
  union all
  select conv, i + 1, {'c': e.c + 4, 'a': e.a || 'D', 't': e.t},
    list_min(list_filter([{'c': s.c + 4, 'a': s.a || 'D', 't': s.t}, {'c': case when ini = 's' and not go then e.c + x end, 'a': e.a || 'K', 't': role || ':' || text}], lambda z: z.c is not null)),
    list_min(list_filter(list_append(list_transform([e, s, ma], lambda m: {'c': case when not go then m.c + x + (case when ini = 'u' then 0 else 3 end) end, 'a': m.a || (case when ini = 'u' then 'K' else 'R' end),
      't': coalesce(m.t || chr(10), '') || (case when ini = 'u' then role else 'user' end) || ':' || text}), {'c': mu.c + 4, 'a': mu.a || 'D', 't': mu.t}), lambda z: z.c is not null)),
    list_min(list_filter([{'c': ma.c + 4, 'a': ma.a || 'D', 't': ma.t}, {'c': case when not go then mu.c + x + (case when ini = 'a' then 0 else 3 end) end, 'a': mu.a || (case when ini = 'a' then 'K' else 'R' end),
      't': coalesce(mu.t || chr(10), '') || (case when ini = 'a' then role else 'assistant' end) || ':' || text}], lambda z: z.c is not null))
  from (
    select w.conv, w.i, w.e, w.s, l.ini, l.x, l.role, l.text, l.blank or l.again as go,
      list_min(list_filter(list_append(list_transform([w.e, w.s, w.a], lambda m: {'c': m.c + 3, 'a': m.a || 'I', 't': coalesce(m.t || chr(10), '') || 'user:'}), w.u), lambda z: z.c is not null)) as mu,
      list_min(list_filter(list_append(list_transform([w.e, w.s], lambda m: {'c': m.c + 6, 'a': m.a || 'II', 't': coalesce(m.t || chr(10), '') || 'user:' || chr(10) || 'assistant:'})
        || [{'c': w.u.c + 3, 'a': w.u.a || 'I', 't': w.u.t || chr(10) || 'assistant:'}], w.a), lambda z: z.c is not null)) as ma
    from walk w join lines l on l.conv = w.conv and l.i = w.i + 1
  )
), ended as (
  select conv, list_min(list_filter([e, a, {'c': s.c + 6, 'a': s.a || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': u.c + 3, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}], lambda z: z.c is not null)) as best
  from walk qualify row_number() over (partition by conv order by i desc) = 1
), counted as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again) as duplicate, count(*) filter (cut) as truncated,
    count(*) filter (role_before is not null and left(role_before, 1) || ini not in ('su', 'ua', 'au')) as illegal
  from lines group by conv
)
select d.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  best.c as cost, best.a as audit, sha256(coalesce(best.t, '')) as repaired_sha256
from (select distinct conv, conv_id from source) d join ended on ended.conv = d.conv left join counted on counted.conv = d.conv
"""

OP13_SQL = r"""
with pieces as (
  select lang, row_number() over () as p, u from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as u from documents)
), words as (
  select lang, p, unnest(w) as w1, generate_subscripts(w, 1) as i from (select lang, p, regexp_extract_all(u, '[^\x20\x09]+') as w from pieces)
), runs as (
  select lang, w1, lead(w1) over q as w2, lead(w1, 2) over q as w3 from words window q as (partition by p order by i)
), f as (
  select lang, 1 as k, w1 as phrase, count(*) as f from runs group by all
  union all select lang, 2, w1 || ' ' || w2, count(*) from runs where w2 is not null group by all
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from runs where w3 is not null group by all
), sizes as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
candidates as (select lang, k as len, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 10),
cuts as (
  select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, (1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as score
  from (select *, unnest(range(1, len)) as k from candidates) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : c.k], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1 : c.len], ' ')
), best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
  select lang, phrase, max(a) as a from (
    select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from candidates where len = 3
  ) group by all
), kept as (
  select b.* from best b left join longer o on o.lang = b.lang and o.phrase = b.phrase where o.a is null or 100 * o.a < 50 * b.a
)
select k.lang, row_number() over (partition by k.lang order by k.score desc, k.a desc, k.phrase) as rank, k.phrase, k.a::bigint as a, k.l::bigint as l, k.r::bigint as r, s.n, k.score::bigint as score
from kept k join sizes s on s.lang = k.lang
qualify rank <= 2000
"""

ORACLES: dict[str, str] = {"op5_ngram_join": OP5_SQL, "op12_conversation_repair": OP12_SQL, "op13_phrase_mining": OP13_SQL}
