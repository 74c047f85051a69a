"""Registered queries of the training-data operators, with DuckDB SQL where SQL expresses them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Entry
from ..session import table
from . import (alignment, chat, embeddings, fingerprints, gru_lm, mixing, periodic, piece_codec, repeats, simhash_grid,
               token_counts, toxicity, warc)

ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        ENTRIES[name] = Entry(name, fn, sql, "llm")
        return fn
    return deco


@register("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = token_counts.count_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.json")))
    return got.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@register("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_grid.simhash_components(table(spark, sf_dir, "documents"))


@register("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = piece_codec.encode_texts(docs, str(public_tokenizers.path("piece_bpe_32k.model")))
    return got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


#: flattest mix in which no source is read more than twice while every document is read
MAX_REPETITION, BLOCK_TOKENS, SEED = 2.0, 4_096, 0

MIX_SQL = rf"""
with recursive d as (
  select doc_id, source, case when source is null then 'n' else 'v' || source end as src,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 15))::bigint as doc,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as n_tokens
  from documents),
s as (select src, sum(n_tokens)::bigint as tokens from d group by src),
q as (select src, tokens, tokens / (select sum(tokens) from s)::double as p from s where tokens > 0),
-- bisect the exponent to the smallest at which no source is used more than the limit
b(i, low, high) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1,
    case when r > {MAX_REPETITION} then (low + high) / 2 else low end,
    case when r > {MAX_REPETITION} then high else (low + high) / 2 end
  from (select i, low, high, (select max(pow(p, (low + high) / 2 - 1)) / min(pow(p, (low + high) / 2 - 1)) from q) as r from b)
  where i < {mixing.STEPS}),
e as (select round(high, {mixing.DIGITS}) as t from b where i = {mixing.STEPS}),
v as (select src, tokens, pow(p, t) as v, pow(p, t) / p as u, t from q, e),
plan as (
  select src, tokens, t, round(v / (select sum(v) from v), {mixing.DIGITS}) as weight,
    round(u / (select min(u) from v), {mixing.DIGITS}) as uses from v
  union all select src, tokens, (select t from e), 0.0, 1.0 from s where tokens = 0),
p2 as (
  select src, t, weight, floor(uses)::bigint as epochs,
    round((uses - floor(uses)) * tokens)::bigint as rest,
    pow(2, ceil(log2(greatest(ceil(tokens / {BLOCK_TOKENS}.0), 1))))::bigint as blocks from plan),
k as (  -- keys of the epochs' permutations
  select src, epoch, ('0x' || substr(md5('{SEED}|' || src || '|' || epoch::varchar), 1, 15))::bigint as key, blocks,
    (1 + floor(log2(blocks))::bigint) >> 1 as sh
  from (select src, blocks, unnest(generate_series(1, epochs + 1)) as epoch from p2)),
x as (
  select d.doc_id, d.source, d.src, d.n_tokens, d.doc % p2.blocks as block, p2.blocks, p2.epochs, p2.rest, p2.weight, p2.t,
    k.epoch, k.key, k.sh, (k.key % {1 << 28}) * 2 + 1 as f
  from d join p2 using (src) join k using (src)),
x1 as (select *, (block * f + (key >> 28)) % blocks as y from x),
r as (select *, (xor(y, y >> sh) * f) % blocks as rank from x1),
last as (
  select src, max(rank) + 1 as last_ranks from (
    select src, rank, rest, coalesce(sum(n) over (partition by src order by rank rows between unbounded preceding and 1 preceding), 0) as before
    from (select src, rank, any_value(rest) as rest, sum(n_tokens) as n from r where epoch = epochs + 1 group by src, rank))
  where before < rest group by src)
select doc_id, source, n_tokens, epoch::bigint as epoch, block, ((epoch - 1) * blocks + rank)::bigint as slot,
  (epochs * blocks + coalesce(last_ranks, 0))::bigint as n_slots, weight, t as exponent
from r left join last using (src)
where epoch <= epochs or rank < coalesce(last_ranks, 0)
"""


@register("op2_mix_sources", MIX_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix_sources(table(spark, sf_dir, "documents"), max_repetition=MAX_REPETITION, block_tokens=BLOCK_TOKENS, seed=SEED)
    return got.select("doc_id", "source", "n_tokens", "epoch", "block", "slot", "n_slots", "weight", "exponent")


CHAT_SQL = """
with r as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
t as (select conv_id, turn, list(struct_pack(role := role, text := text) order by role, text) as said from r group by conv_id, turn),
c as (select conv_id, list(struct_pack(turn := turn, said := said) order by turn nulls last) as l from t group by conv_id),
p as (select distinct list_slice(l, 1, i) as l from (select l, unnest(generate_series(1, len(l) - 1)) as i from c)),
m as (select min(conv_id) as conv_id, l, count(*) as n_equal from c group by l),
kept as (select conv_id, len(l)::bigint as n_turns, n_equal from m where not exists (select 1 from p where p.l = m.l))
select r.conv_id, turn, role, n_turns, n_equal,
  '<|im_start|>' || replace(replace(role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
  || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) as rendered
from r join kept on r.conv_id is not distinct from kept.conv_id
"""


@register("op3_chat_format", CHAT_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_conversations(table(spark, sf_dir, "conversations"))


WARC_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as digest from pages),
b as (select digest, max(page_id) as best from p where n >= 1000 group by digest having count(*) > 1)
select page_id, n::bigint as payload_bytes, p.digest as payload_digest,
  case when best is not null and page_id is distinct from best then 'revisit' else 'response' end as record_type,
  case when best is not null and page_id is distinct from best then best end as refers_to
from p left join b on p.digest = b.digest
"""


@register("op6_warc_chunks", WARC_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


EMBEDDINGS_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (select vec_id, vec_id from embeddings union select reach.a, l.b from reach join l on reach.b = l.a),
c as (select a, min(b) as component_id from reach group by a)
select vec_id, (select count(*) from l where l.a = vec_id)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join c on c.a = vec_id
"""


@register("op7_embedding_near_dedup", EMBEDDINGS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(table(spark, sf_dir, "embeddings"))


@register("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_table(table(spark, sf_dir, "documents"))


@register("op5_gru_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))


RUNS_SQL = r"""
with h as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
  xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda a, b:
    list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) as h
  from documents),
g as (select doc_id, words, len(words) as n, h % 10 = 0 and len(words) > 0 as planted, h // 10 as g from h),
a as (select *, case when planted then g % n end as a, case when planted then 1 + (n - g % n) // (3 + g % 8) end as p from g),
t as (select doc_id, n, i, words[1 + case when planted and i >= a then a + (i - a) % p else i end] as w from a, unnest(range(0, n)) u(i)),
e as (select x.doc_id, y.i - x.i as q, x.i from t x join t y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and (y.i - x.i) * 4 <= x.n),
s as (select doc_id, q, min(i) as start, count(*) + q as length from (
  select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as k from e) group by doc_id, q, k having count(*) + q >= greatest(6, 4 * q)),
r as (select doc_id, start, length, min(q) as period from s group by doc_id, start, length),
b as (select doc_id, count(*) as n_runs, arg_max(struct_pack(start := start, length := length, period := period), (length / period, -start, -period)) as best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from r group by doc_id),
c as (select doc_id, string_agg(w, ' ' order by i) as kept from t
  where not exists (select 1 from r where r.doc_id = t.doc_id and t.i >= r.start + r.period and t.i < r.start + r.length) group by doc_id)
select h.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length, best.period::bigint as period,
  (1000 * best.length // best.period)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from h left join b on h.doc_id = b.doc_id left join c on h.doc_id = c.doc_id
"""


@register("op11_periodic_runs", RUNS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    at = lambda n: g % n
    period = lambda n: 1 + F.floor((n - g % n) / (3 + g % 8))
    got = periodic.find_runs(periodic.with_repeats(docs, h % 10 == 0, at, period)).withColumn("best", periodic.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    return got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                      F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                      F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


REPEATS_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as hx from documents),
n as (select doc_id, hx, length(hx) // 2 as nb from d),
-- pieces of 2,048 bytes with the 99 that follow, so that a window is cut from a short text
p as (select doc_id, nb, c * 2048 as off, substr(hx, c * 4096 + 1, 4096 + 198) as ph from n, unnest(range(0, (nb + 2047) // 2048)) t(c) where nb >= 100),
w as (select doc_id, off + i as x, md5_number(substr(ph, 2 * i + 1, 200)) as s from p, unnest(range(0, least(2048, nb - 99 - off))) t(i)),
r as (select doc_id, x from (select doc_id, x, row_number() over (partition by s order by doc_id, x) as k from w) where k > 1),
g as (select doc_id, x, sum(fresh) over (partition by doc_id order by x) as g from (
  select doc_id, x, case when x <= lag(x) over (partition by doc_id order by x) + 100 then 0 else 1 end as fresh from r)),
s as (select doc_id, list(a order by a) as starts, list(b order by a) as ends, sum(b - a) as n_removed, count(*) as n_spans from (
  select doc_id, g, min(x) as a, max(x) + 100 as b from g group by doc_id, g) group by doc_id),
k as (select n.doc_id, nb, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  case when starts is null then hx else array_to_string(list_transform(range(0, len(starts) + 1), lambda i:
    substr(hx, 2 * (case when i = 0 then 0 else ends[i] end) + 1,
      2 * ((case when i = len(starts) then nb else starts[i + 1] end) - (case when i = 0 then 0 else ends[i] end)))), '') end as kept
  from n left join s on n.doc_id = s.doc_id)
select doc_id, nb::bigint as n_bytes, n_removed::bigint as n_removed, n_spans::bigint as n_spans, sha256(unhex(kept)) as kept_sha256 from k
"""


@register("op12_suffix_array_dedup", REPEATS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@register("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")),
                           str(public_tokenizers.path("piece_bpe_32k.model")))
