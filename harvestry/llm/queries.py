"""The queries opN_<name> and pipeline, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, dedup, exact, html_extract, lang_id, mixing, resample, spelling, tokens, topk, toxicity, urls
from .shared import held_out, small_batches

VOCABULARY, END_ID = "word_bpe_49k.json", 1
FIRST_DAY, DAYS = "2024-01-01", 365
#: The dated lists that op10 applies: (list, domain, day, action).
LISTS = [
    ("gambling", "casino-win.example.com", "2024-01-01", "add"),
    ("gambling", "casino-win.example.com", "2024-07-01", "remove"),
    ("gambling", "casino-win.example.com", "2024-10-01", "add"),
    ("gambling", "free-bets.example.com", "2024-03-15", "add"),
    ("pharma", "cheap-pills.example.com", "2024-02-01", "add"),
    ("pharma", "cheap-pills.example.com", "2024-11-15", "remove"),
    ("adverts", "ads-track.example.com", "2024-01-01", "add"),
    ("quality", "example.org", "2024-06-01", "add"),
    ("quality", "example.org", "2024-06-08", "remove"),
]
#: Schemas of the tools that op8 knows: (name, param, type, required).
TOOLS = [
    ("search", "query", "string", True), ("search", "limit", "integer", False),
    ("calculate", "expression", "string", True), ("weather", "city", "string", True), ("weather", "metric", "boolean", False),
    ("convert", "amount", "number", True), ("convert", "unit", "string", True),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def lists(spark: SparkSession) -> DataFrame:
    day = datetime.date.fromisoformat
    return spark.createDataFrame([(a, b, day(c), d) for a, b, c, d in LISTS], "list string, domain string, day date, action string")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = lang_id.fit(docs.filter(~out))
    return lang_id.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("whole") + F.col("part")).alias("taken"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, shared = tokens.encode_corpus(table(spark, sf_dir, "documents"), vocabulary_path(), END_ID)
    return tokens.digests(files, shared)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tool_traffic(conversations: DataFrame) -> DataFrame:
    """The conversations, and tool traffic that follows from them, since they hold none: (conv_id, turn, role, text).

    Turns count by fours. Each assistant's message is followed by one that calls a tool, and most of these by its
    result. What is called, and what is wrong with it, depends on conv_id + turn, by eights: arguments as an object
    beside content (0) or as a string (1), a missing one (2), one of a wrong type (3), an unknown tool whose result has
    another id (4), two calls of one id (5), no result (6), a nested argument that the tool doesn't know (7).
    """
    m = conversations.select("conv_id", (F.col("turn").cast("long") * 4).alias("turn"), "role", "text")
    m = m.withColumn("v", F.when(F.lower(F.trim("role")) == "assistant", F.pmod(F.col("conv_id") + F.floor(F.col("turn") / 4), F.lit(8))))
    json, v = chat.json_text, F.col("v")
    right = F.concat(F.lit('{"query":'), json(F.substring(F.coalesce("text", F.lit("")), 1, 40)), F.lit(',"limit":'), F.col("turn").cast("string"), F.lit("}"))
    args = (
        F.when(v == 1, json(right)).when(v == 2, F.lit('{"limit":1}')).when(v == 3, F.lit('{"query":5}')).when(v == 4, F.lit("{}"))
        .when(v == 7, F.lit('{"query":"x","extra":{"z":1,"a":[1,{"b":null}]}}')).otherwise(right)
    )
    call_id = F.concat(F.lit("c"), F.col("turn").cast("string"))
    one = F.concat(F.lit('{"id":'), json(call_id), F.lit(',"name":"'), F.when(v == 4, "nope").otherwise("search"), F.lit('","arguments":'), args, F.lit("}"))
    text = F.concat(F.when(v == 0, '{"content":"Let me see","tool_calls":[').otherwise('{"tool_calls":['), one, F.when(v == 5, F.concat(F.lit(","), one)).otherwise(""), F.lit("]}"))
    answer = F.concat(F.lit('{"tool_call_id":'), json(F.when(v == 4, "zz").otherwise(call_id)), F.lit(',"content":"r"}'))
    said = lambda after, role, what: F.struct((F.col("turn") + after).alias("turn"), role.alias("role"), what.alias("text"))
    own = said(0, F.col("role"), F.col("text"))
    called, answered = said(1, F.col("role"), text), said(2, F.lit("tool"), answer)
    rows = F.when(v.isNull(), F.array(own)).when(v == 6, F.array(own, called)).otherwise(F.array(own, called, answered))
    return m.select("conv_id", F.explode(rows).alias("r")).select("conv_id", "r.*")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame(TOOLS, "name string, param string, type string, required boolean")
    return chat.link_chat(tool_traffic(table(spark, sf_dir, "conversations")), tools)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~out))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id"), F.lit(DAYS)).cast("int"))
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), lists(spark), day)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (
        op1_language_id, op2_html_extraction, op3_exact_top_k, op4_mixing, op5_minhash_dedup, op6_token_ids, op7_decontamination, op8_chat_formatting, op9_toxicity, op10_url_filters,
        op11_importance_resampling, op12_spelling_variants, op13_exact_dedup, pipeline,
    )
    return {f.__name__: f for f in found}


def _rows(rows: list[tuple]) -> str:
    quote = lambda x: str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


OP3 = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
s as (select a.vec_id as query_id, b.vec_id, cast(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) as bigint) as score
  from v a, v b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""

OP4 = """
with recursive d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
    cast('0x' || substr(md5('mix-1:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) % 4096 as bucket from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, 1.0 + (row_number() over (order by source nulls last) - 1) % 3 as weight, 3.0 * source_size as cap, (select sum(source_size) from s) as total from s),
fill(round, source, source_size, weight, cap, total, stopped) as (
  select 0, source, source_size, cast(weight as double), cast(cap as double), cast(total as double), false from w
  union all
  select round + 1, source, source_size, weight, cap, total, stopped or cap <=
    (total - coalesce(sum(case when stopped then cap end) over (), 0)) / sum(case when not stopped then weight end) over () * weight
  from fill where round < (select count(*) from s)),
f as (select * from fill where round = (select count(*) from s)),
t as (select source, source_size, case when stopped then cap else (total - coalesce(sum(case when stopped then cap end) over (), 0)) / sum(case when not stopped then weight end) over () * weight end as target from f),
p as (select *, case when source_size > 0 then target / source_size else 0.0 end as ratio from t),
g as (select *, floor(ratio) as whole, (ratio - floor(ratio)) * source_size as rest from p),
b as (select source, bucket, sum(size) as words, coalesce(sum(sum(size)) over (partition by source order by bucket rows between unbounded preceding and 1 preceding), 0) as below from d group by source, bucket),
e as (select g.source, min(bucket) as edge from g join b on g.source is not distinct from b.source where below + words > rest group by g.source)
select d.doc_id, d.size, g.source_size, g.target, cast(d.size * g.whole + case when e.edge is null or d.bucket > e.edge then 0 when d.bucket < e.edge then d.size
  else round_even(d.size * ((g.rest - b.below) / b.words), 0) end as bigint) as taken
from d join g on d.source is not distinct from g.source left join e on d.source is not distinct from e.source
left join b on d.source is not distinct from b.source and b.bucket = e.edge
"""

OP10 = f"""
with l(list, domain, day, action) as (values {_rows(LISTS)}),
e as (select list, domain, cast(day as date) as valid_from, action, lead(cast(day as date)) over (partition by list, domain order by day) as valid_to from l),
p as (select page_id, url, cast(date '{FIRST_DAY}' + cast(((page_id % {DAYS}) + {DAYS}) % {DAYS} as integer) as date) as fetch_day,
  nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '') as host from pages),
m as (select distinct p.url, p.fetch_day, e.list, e.domain, e.valid_from from p join e on e.action = 'add' and (p.host = e.domain or ends_with(p.host, '.' || e.domain))
  and p.fetch_day >= e.valid_from and (e.valid_to is null or p.fetch_day < e.valid_to)),
v as (select url, fetch_day, count(*) over (partition by url, fetch_day) as n_active, domain, list, valid_from,
  row_number() over (partition by url, fetch_day order by length(domain) desc, valid_from desc, list desc) as n from m)
select p.page_id, p.url, p.fetch_day, p.host, cast(coalesce(v.n_active, 0) as bigint) as n_active, v.domain, v.list, v.valid_from as since, v.url is not null as blocked
from p left join v on p.url = v.url and p.fetch_day = v.fetch_day and v.n = 1
"""

OP8 = r"""
with m as (select conv_id, cast(turn as bigint) * 4 as turn, coalesce(lower(trim(role)), 'unknown') as role, coalesce(text, '') as text from conversations),
a as (select conv_id, turn, (((conv_id + turn // 4) % 8) + 8) % 8 as v, 'c' || cast(turn as varchar) as id,
    '{"limit":' || cast(turn as varchar) || ',"query":' || cast(to_json(substr(text, 1, 40)) as varchar) || '}' as good from m where role = 'assistant'),
c as (select *, case v when 2 then '{"limit":1}' when 3 then '{"query":5}' when 4 then '{}' when 7 then '{"extra":{"a":[1,{"b":null}],"z":1},"query":"x"}' else good end as args,
    case v when 4 then 'nope' else 'search' end as name from a),
n as (select *, unnest(case v when 5 then [0, 1] else [0] end) as pos from c),
o as (
  select conv_id, turn, role, cast(null as varchar) as call_id, turn as anchor_turn, 0 as step, 0 as pos, 'plain' as status,
    '{"content":' || cast(to_json(text) as varchar) || ',"role":' || cast(to_json(role) as varchar) || '}' as message from m
  union all
  select conv_id, turn + 1, 'assistant', null, turn + 1, 0, 0, 'plain', '{"content":"Let me see","role":"assistant"}' from a where v = 0
  union all
  select conv_id, turn + 1, 'assistant', id, turn + 1, 1, pos,
    case when pos = 1 then 'duplicate' else case v when 2 then 'missing_argument' when 3 then 'bad_type' when 4 then 'unknown_tool' when 6 then 'no_result' when 7 then 'unknown_argument' else 'ok' end end,
    '{"arguments":' || args || ',"id":"' || id || '","name":"' || name || '","role":"assistant"}' from n
  union all
  select conv_id, turn + 2, 'tool', case v when 4 then 'zz' else id end, turn + 2, 2, 0, case v when 4 then 'orphan' else 'linked' end,
    '{"content":"r","role":"tool","tool_call_id":"' || case v when 4 then 'zz' else id end || '"}' from a where v <> 6)
select * from o
"""




def _crc32(text: str) -> str:
    """crc32 of a text's UTF-8 bytes in SQL: a step for each bit, the byte comes in at its first."""
    bits = f"flatten(list_transform(range(len(hex({text})) // 2), lambda i: [cast('0x' || substr(hex({text}), 2 * i + 1, 2) as bigint), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_concat([cast(4294967295 as bigint)], {bits}), lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
with w as (select 0 as part, doc_id as id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents
  union all select 1, item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
f as (select part, id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as feature from w),
b as (select feature, {_crc32('feature')} % 10000 as bucket from (select distinct feature from f)),
n as (select part, bucket, count(*) as n from f join b using (feature) group by part, bucket),
t as (select bucket, coalesce(max(n) filter (where part = 0), 0) as s, coalesce(max(n) filter (where part = 1), 0) as t from n group by bucket),
a as (select coalesce(sum(n) filter (where part = 0), 0) as s_all, coalesce(sum(n) filter (where part = 1), 0) as t_all from n),
g as (select bucket, cast(floor(1000 * ln((t + 1.0::double) * (s_all + 10000) / ((s + 1.0::double) * (t_all + 10000)))) as bigint) as gain from t, a),
m as (select id, count(*) as n_features, cast(floor(sum(gain)::double / count(*)) as bigint) as weight from f join b using (feature) join g using (bucket) where part = 0 group by id),
x as (select doc_id, len(words) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, cast('0x' || substr(sha256('7:' || cast(doc_id as varchar)), 1, 8) as bigint) as h
  from (select id as doc_id, words from w where part = 0) left join m on id = doc_id),
y as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from x),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from y where n_words >= 20)
select y.doc_id, n_features, weight, score, case when rank <= 25 * (select count(*) from r) // 100 then rank end as rank from y left join r on r.doc_id = y.doc_id
"""

OP12 = f"""
with recursive d as (select doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
h as (select doc_id, run, count(*) as n, cast(doc_id as varchar) || ':' || run as salted from d group by doc_id, run),
c as (select run, n, {_crc32('salted')} as h from h),
k as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from c),
w as (select word, cast(sum(n) as bigint) as n from k where length(word) >= 5 group by word having sum(n) >= 3),
p as (select word, n, unnest(range(length(word))) as place from w),
e as (select word, n, place, substr(word, 1, place) || substr(word, place + 2) as rest from p),
l as (select a.word, b.word as near, b.n as near_n from e a join e b on a.rest = b.rest and a.place = b.place and a.word <> b.word
  union select a.word, b.word, b.n from e a join w b on a.rest = b.word
  union select b.word, a.word, a.n from e a join w b on a.rest = b.word),
q as (select word, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from l group by word),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * w.n then near end as form, case when near_n >= 2 * w.n then near_n end as form_n from w left join q on q.word = w.word),
r as (select word, word as root, form as next from f union all select r.word, f.word, f.form from r join f on f.word = r.next)
select f.word, form, root, n, n_near, form_n from f join r on r.word = f.word and r.next is null
"""

OP13 = r"""
with n as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents),
g as (select doc_id, body, row_number() over (partition by body order by chars desc, doc_id nulls last) as place, count(*) over (partition by body) as group_size,
  first_value(doc_id) over (partition by body order by chars desc, doc_id nulls last) as keep_id from n)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(body) as text_sha256 from g
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express. op8's gives what must come of the tool traffic that its query adds to the conversations."""
    return {"op3_exact_top_k": OP3, "op4_mixing": OP4, "op8_chat_formatting": OP8, "op10_url_filters": OP10, "op11_importance_resampling": OP11, "op12_spelling_variants": OP12, "op13_exact_dedup": OP13}
