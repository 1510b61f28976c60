"""The registered queries of the document operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (bpe, conversations, decontaminate, exact_dedup, filter_audit, language, line_dedup, mixture, near_dup,
               pii, quality, token_count, toxicity)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn_from(docs, table(spark, sf, "labels")))


@query
def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf, "documents"))


@query
def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.score_quality(docs, quality.learn_from(docs, table(spark, sf, "labels")))


@query
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf, "documents"))


@query
def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return language.predict_language(docs, language.learn_from(docs))


@query
def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


ORACLES["op7_exact_dedup"] = """
    with t as (select doc_id, coalesce(text, '') as text,
                      regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') as body from documents)
    select doc_id, first_value(doc_id) over (partition by body order by length(text) desc, doc_id) as keep_id,
           count(*) over (partition by body) as group_size,
           doc_id = first_value(doc_id) over (partition by body order by length(text) desc, doc_id) as kept,
           sha256(body) as text_sha256
    from t"""


@query
def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf, "documents"))


@query
def op10_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                       public_tokenizers.PATTERN)


@query
def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return conversations.repair_report(conversations.damage(rows), rows)


def _plus(top: str, cost: int, letters: str) -> str:
    """SQL: a top, written as twelve digits of cost and its audit, after one more edit."""
    return f"(printf('%012d', substr({top}, 1, 12)::bigint + {cost}) || substr({top}, 13) || '{letters}')"


def _repair_sql() -> str:
    crc = ("xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ord(c)::bigint)), "
           "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), "
           "lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)")
    into_u = f"least(u, {_plus('s0', 3, 'I')}, {_plus('h', 3, 'I')}, {_plus('b', 3, 'I')})"
    into_b = f"least(b, {_plus('u', 3, 'I')}, {_plus('s0', 6, 'II')}, {_plus('h', 6, 'II')})"
    free = "case when not gone then"
    extra = "case when cut then 3 else 0 end"
    kept = [f"printf('%012d', substr(x, 1, 12)::bigint + {extra}) || substr(x, 13) || 'K'".replace("x,", f"{x},")
            for x in ("s0", "o", "ui")]
    rero = [f"printf('%012d', substr(x, 1, 12)::bigint + 3 + {extra}) || substr(x, 13) || 'R'".replace("x,", f"{x},")
            for x in ("o", "ui")]
    return f"""
    with recursive damaged as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
               coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
    faulty as (select *, {crc} % 20 as fault from damaged),
    rows as (
        select coalesce(conv_id::varchar, ' ') as conv, turn, case when fault = 4 then 'user' else role end as role,
               case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
        from faulty, unnest(case when fault = 3 then [0, 1] else [0] end) where fault <> 0),
    marked as (
        select *, sha256(length(role)::varchar || ':' || role || text) as digest,
               rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body, left(role, 1) as ini from rows),
    ordered as (select *, row_number() over (partition by conv order by turn nulls first, digest) as i from marked),
    placed as (select *, row_number() over (partition by conv, digest order by i) as seen from ordered),
    t as (
        select *, body = '' as blank, body <> '' and seen > 1 as duplicate, body = '' or seen > 1 as gone,
               body <> '' and seen = 1 and right(body, 1) not in ('.', '!', '?') as cut,
               lag(ini) over (partition by conv order by i) as before from placed),
    dp as (
        select distinct coalesce(conv_id::varchar, ' ') as conv, 0::bigint as i, '000000000000' as s0, null::varchar as h,
               null::varchar as u, null::varchar as b from conversations
        union all
        select conv, i, {_plus('s0', 4, 'D')}, least({_plus('h', 4, 'D')}, {free} case when ini = 's' then {kept[0]} end end),
               least({_plus('ui', 4, 'D')}, {free} case when ini = 'u' then {kept[1]} end end, {free} {rero[0]} end),
               least({_plus('bi', 4, 'D')}, {free} case when ini = 'a' then {kept[2]} end end, {free} {rero[1]} end)
        from (select *, least(s0, h, bi) as o from (
              select dp.conv, t.i, s0, h, ini, gone, cut, {into_u} as ui, {into_b} as bi
              from dp join t on t.conv = dp.conv and t.i = dp.i + 1))),
    best as (
        select conv, least(s0, b, {_plus('u', 3, 'I')}, {_plus('h', 6, 'II')}) as x
        from (select *, row_number() over (partition by conv order by i desc) as last from dp) where last = 1),
    letters as (
        select conv, p, edit, count(*) filter (edit <> 'I') over (partition by conv order by p) as i
        from (select conv, unnest(string_split(substr(x, 13), '')) as edit, generate_subscripts(string_split(substr(x, 13), ''), 1) as p
              from best where length(x) > 12)),
    outputs as (
        select l.conv, l.edit, t.role, t.ini, t.text, row_number() over (partition by l.conv order by l.p) as j
        from letters l left join t on t.conv = l.conv and t.i = l.i and l.edit <> 'I' where l.edit <> 'D'),
    shaped as (select *, coalesce(first_value(ini) over (partition by conv order by j), '') = 's'
                         and first_value(edit) over (partition by conv order by j) = 'K' as led from outputs),
    joined as (
        select conv, string_agg(case when edit = 'K' then role when (j % 2 = 1) <> led then 'user' else 'assistant' end
                                || ':' || coalesce(text, ''), chr(10) order by j) as whole from shaped group by conv),
    counts as (
        select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
               count(*) filter (duplicate) as duplicate, count(*) filter (cut) as truncated,
               count(*) filter (i > 1 and before || ini not in ('su', 'ua', 'au')) as illegal from t group by conv)
    select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
           coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, substr(x, 1, 12)::bigint as cost,
           substr(x, 13) as audit, sha256(coalesce(whole, '')) as repaired_sha256
    from (select distinct conv_id, coalesce(conv_id::varchar, ' ') as conv from conversations) o
    join best using (conv) left join counts using (conv) left join joined using (conv)"""


ORACLES["op11_conversation_repair"] = _repair_sql()


@query
def op12_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mix_sources(table(spark, sf, "documents"))


ORACLES["op12_source_mix"] = """
    with rows as (
        select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
               md5('1:' || coalesce(doc_id::varchar, '')) as line from documents),
    sources as (
        select source, sum(size)::bigint as source_size, count(*) as n,
               row_number() over (order by source nulls last) as no,
               (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from rows group by source),
    ratios as (select *, source_size * 3 as most, source_size * 3 / weight as ratio, sum(source_size) over ()::bigint as whole
               from sources),
    levels as (
        select *, whole - sum(most) over o + most as left_over, sum(weight) over () - sum(weight) over o + weight as weights
        from ratios window o as (order by ratio, no rows unbounded preceding)),
    level as (select ratio as r, no as m, left_over::bigint as l, weights::bigint as w from levels
              where most::hugeint * weights >= left_over::hugeint * weight order by ratio, no limit 1),
    targets as (select source, source_size, n, no, whole, case when (ratio, no) < (r, m) then most::double
                       else (l * weight)::double / w end as target from levels, level),
    block as (select greatest(1, least(1024, coalesce(floor(min(target) filter (target > 0) / 256), 0)))::bigint as b from targets),
    seats as (
        select no, count(*) as quota from (
            select no from (select no, target / (2 * k + 1) as q, k, (2 * whole + b) // (2 * b) as n_seats
                            from targets, block, unnest(range((2 * whole + b) // (2 * b))) as s(k) where target > 0)
            qualify row_number() over (order by q desc, no, k) <= n_seats) group by no),
    dealt as (
        select r.*, t.source_size, t.target, t.no, coalesce(s.quota, 0) as quota,
               floor(('0x' || substr(line, 1, 8))::bigint * greatest(1, ceil(t.n / 65536)) / 4294967296)::bigint as shard
        from rows r join targets t on r.source is not distinct from t.source left join seats s on s.no = t.no),
    shards as (select no, shard, sum(size)::bigint as shard_size, max(quota) as quota from dealt group by all),
    given as (
        select no, shard, count(*) as won from (
            select no, shard from (select no, shard, shard_size / (2 * k + 1) as q, k, quota
                                   from shards, unnest(range(quota)) as s(k) where shard_size > 0)
            qualify row_number() over (partition by no order by q desc, shard, k) <= quota) group by all),
    takes as (select no, shard, shard_size, least(coalesce(won, 0) * b, shard_size * 3) as takes
              from shards left join given using (no, shard), block),
    lined as (select d.*, shard_size, takes, sum(size) over (partition by no, shard order by line, doc_id, size
                                                             rows unbounded preceding) - size as start
              from dealt d join takes using (no, shard))
    select doc_id, size, source_size, target,
           case when shard_size = 0 then 0 else takes // shard_size * size
                + greatest(0, least(size, takes % shard_size - start)) end::bigint as taken
    from lined"""


@query
def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))


ORACLES["op13_filter_audit"] = """
    with base as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
    words as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from base),
    firsts as (select text, min(doc_id) as least_id from base group by text),
    known as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
    masks as (
        select part, coalesce(good, 0) as good, coalesce(known.toxic, 0) as toxic,
               (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
               + 4 * (100 * len(regexp_extract_all(words.text, '[A-Z]')) > 10 * length(words.text))::int
               + 8 * regexp_matches(words.text, '[#$%&*|]')::int + 16 * coalesce(words.doc_id > least_id, false)::int as mask
        from words join firsts using (text) left join known on known.doc_id = words.doc_id),
    cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from masks group by all),
    letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as v(f, bit)),
    orders as (
        select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
        from letters a, letters b, letters c, letters d, letters e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
    steps as (select filter_order, s.step::int as step, bits[s.step] as own,
                     list_sum(list_append(bits[:s.step - 1], 0))::int as before from orders, unnest(range(1, 6)) as s(step)),
    counts as (
        select part, filter_order, step, own,
               sum(case when mask & (before | own) = 0 then n else 0 end)::bigint as kept,
               sum(case when mask & before = 0 and mask & own <> 0 then n else 0 end)::bigint as removed,
               sum(case when mask & before <> 0 and mask & own <> 0 then n else 0 end)::bigint as redundant,
               sum(case when mask = own then n else 0 end)::bigint as unique_fails,
               sum(case when mask & before = 0 and mask & own <> 0 then good else 0 end)::bigint as good_lost,
               sum(case when mask & before = 0 and mask & own <> 0 then toxic else 0 end)::bigint as toxic_lost
        from cells, steps group by part, filter_order, step, own)
    select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) over (partition by part, own))::bigint as shapley from counts"""
