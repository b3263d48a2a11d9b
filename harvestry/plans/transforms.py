"""Column transforms and writes as queries over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import automaton, pay, text
from ..functions.catalog import DEFAULT, Catalog
from ..functions.roles import canonical_skill, role, skills, skills_native
from ..operators import enrich, store
from ..operators.quantiles import quantiles
from ..sources import cube
from .registry import model
from .standins import AS_OF, TABLES

#: A catalog over the given tables' words.
PARTS = Catalog(
    skills=(("License", "tool", (r"\blicen[sc]e\b",)), ("Open License", "tool", (r"\bapache license\b",)), ("Token", "language", (r"\btoken\b",)), ("That", "methodology", (r"\bthat\b",)), ("Of the", "database", (r"\bof the\b",)), ("The", "cloud", (r"\bthe\b",))),
    titles={"ring": ("ring", "rod"), "colour": ("blue", "red"), "gear": ("gear", "gizmo")}, texts={"metal": ("steel", "brass")}, outside=("old ",),
)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def clean_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.clean_lines(F.col("text")).alias("clean"))


def normalise_string(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.cut(text.normal(F.col("text")), 255).alias("title"))


def remote_flag(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.remote(F.col("text"), yes=[r"\bthe\b", r"\bder\b"], no=[r"\bde\b", r"\bof\b"]).alias("remote"))


def role_first_match(spark, d):
    return _t(spark, d, "part").select("p_partkey", role(F.col("p_name"), F.col("p_type"), PARTS).alias("role"))


def skill_longest_match(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(skills(F.col("text"), PARTS)).alias("s")).select("doc_id", "s.skill", "s.category")


def skill_longest_match_native(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(skills_native(F.col("text"), PARTS)).alias("s")).select("doc_id", "s.skill", "s.category")


def skill_full_catalog(spark, d):
    """All skills of the default catalog in texts that name three of them each."""
    i, names = F.col("o_orderkey"), F.array(*[F.lit(n) for n, _, _ in DEFAULT.skills])
    name = lambda k: F.element_at(names, (k % len(DEFAULT.skills) + 1).cast("int"))
    t = F.concat("o_orderpriority", F.lit(" with "), name(i), F.lit(", "), F.upper(name(i * 7 + 3)), F.lit(" and/or Apache "), F.lower(name(i * 5 + 1)), F.when(i % 3 == 0, " on AWS, go programming").otherwise("; git"))
    return _t(spark, d, "orders").select("o_orderkey", F.explode(skills(t)).alias("s")).select("o_orderkey", "s.skill", "s.category")


#: About a thousand phrases by a rule: numbers of three digits, in groups by their remainder.
NUMBERS = Catalog(skills=(), titles={f"g{g}": tuple(f"{n:03d}" for n in range(g, 1000, 16)) for g in range(15)}, texts={"text": ("build", "house")}, outside=("77", "4242"))


def role_many_phrases(spark, d):
    title = F.concat(F.lit("T_"), (F.col("c_custkey") * 7919).cast("string"))
    return _t(spark, d, "customer").select("c_custkey", automaton.role(F.when(F.col("c_custkey") % 50 != 0, title), F.col("c_mktsegment"), NUMBERS).alias("role"))


def skill_canonical(spark, d):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, " TOKEN ").when(k == 1, "the Apache license v2").when(k == 2, "x").when(k == 3, "one two three four five six").otherwise(F.col("p_name"))
    return _t(spark, d, "part").select("p_partkey", canonical_skill(raw, PARTS).alias("s")).select("p_partkey", "s.name", "s.category")


def pln_rules(spark, d):
    low, high = F.floor(F.col("o_totalprice") / 20).cast("int"), F.floor(F.col("o_totalprice") * 5).cast("int")
    country = F.when(F.col("o_orderkey") % 2 == 0, "pl").otherwise("de")
    a, b = pay.euros(country, F.when(F.col("o_orderkey") % 5 != 0, low), F.when(F.col("o_orderkey") % 3 == 0, high))
    return _t(spark, d, "orders").select("o_orderkey", a.alias("salary_min"), b.alias("salary_max"))


def salary_mid(spark, d):
    return _t(spark, d, "part").select("p_partkey", pay.middle(F.col("p_size"), F.floor("p_retailprice")).alias("mid"))


def contract_fields(spark, d):
    kind = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" Permanent "), "c_mktsegment")).when(F.col("c_custkey") % 4 == 1, "FREELANCE").when(F.col("c_custkey") % 4 == 2, "contract").otherwise(F.col("c_mktsegment"))
    time = F.when(F.col("c_custkey") % 3 == 0, "Full Time job").when(F.col("c_custkey") % 3 == 1, "teilzeit")
    return _t(spark, d, "customer").select("c_custkey", text.contract_type(kind).alias("contract_type"), text.contract_time(time).alias("contract_time"))


def content_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.content_hash(F.col("source"), F.lit("full"), F.lit("m1"), F.substring("text", 1, 1500)).alias("input_hash"))


def selected_text(spark, d):
    j = model(spark, d)["jobs"].withColumn("s", text.selected(F.col("description_full"), F.col("description_short"), 20))
    return j.select("id", "s.text", "s.text_source")


def merge_policy(spark, d):
    j = model(spark, d)["jobs"].select("id", enrich.merge_role(F.when(F.col("id") % 3 == 0, "other").when(F.col("id") % 3 == 1, "cloud"), F.when(F.col("id") % 5 == 0, "other").when(F.col("id") % 5 < 4, "devops").otherwise("nonsense"), F.col("id") % 4 != 0).alias("m"))
    return j.select("id", "m.write", "m.role")


def json_props(spark, d):
    return _t(spark, d, "events").select("event_id", text.first_object(F.concat(F.lit("Answer: "), "props"), "k int").getField("k").alias("k"))


def upsert_latest(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id", "event_type", "value").alias("r"), (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("old"))
    batch = lambda old: e.filter(F.col("old") == old).groupBy("id").agg(F.max("r").alias("r")).select("id", "r.event_id", "r.event_type", "r.value")
    return store.upsert_by_key(batch(True), batch(False), ["id"])


def upsert_load(spark, d):
    """A load of jobs by the rules of upsert_jobs and deactivate: some are there, some come back, some values are null."""
    j = model(spark, d)["jobs"].select("id", "title", "role_category", "is_active", "posted_at")
    seen = lambda day: F.lit(day).cast("timestamp_ntz")
    old = j.filter("id % 3 <> 0").withColumns({"first_seen_at": F.col("posted_at"), "last_seen_at": seen("2001-01-01"), "ingested_at": seen("2001-01-01")})
    new = j.filter("id % 4 = 0 or id % 3 = 0").select("id", F.concat(F.lit("new "), "title").alias("title"), F.when(F.col("id") % 8 != 0, F.col("role_category")).alias("role_category"), F.when(F.col("id") % 5 != 0, F.col("posted_at") + F.expr("interval 100 day")).alias("posted_at"))
    repeated = new.union(new.filter("id % 12 = 0").withColumn("title", F.lit("later"))).withColumn("batch_pos", (F.col("title") == "later").cast("int"))
    return store.deactivate(store.upsert_jobs(old, repeated, seen(AS_OF)), seen(AS_OF))


def exact_quantiles(spark, d):
    """Quantiles of prices by flag, whose groups hold a third of all rows and more, and whose values hardly repeat."""
    at = {"p05": 0.05, "p50": 0.5, "p99": 0.99}
    return quantiles(_t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", at, few=2_000).select("l_returnflag", *[F.round(k, 4).alias(k) for k in at])


def insert_ignore(spark, d):
    links = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id"), "l_linenumber")
    return store.insert_ignore(links.filter("l_linenumber <= 2").select("job_id", "skill_id").distinct(), links.filter("l_linenumber > 1").select("job_id", "skill_id"), ["job_id", "skill_id"])


def bulk_update(spark, d):
    j = model(spark, d)["jobs"]
    return store.update_values(j.select("id", "role_category"), j.filter("id % 6 = 0").select("id", F.when(F.col("id") % 12 == 0, "cloud").alias("role_category")), "role_category")


def resolve_ids(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    first = p.groupBy("name").agg(F.min("id").alias("id"))
    names = first.select(F.when(F.col("id") % 3 == 0, F.initcap("name")).otherwise(F.col("name")).alias("name")).distinct()
    return enrich.resolve_ids(names, first)


def sdmx_unravel(spark, d):
    n = _t(spark, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), (F.col("n_nationkey") * 1.5).alias("v")))).alias("value"))
    index = lambda *k: F.struct(F.struct(F.create_map(*[F.lit(x) for p in k for x in p]).alias("index")).alias("category"))
    c = n.select(F.array(*map(F.lit, ("freq", "geo", "time"))).alias("id"), F.array(F.lit(1), F.lit(5), F.lit(5)).alias("size"), "value", F.create_map(F.lit("freq"), index(("A", 0)), F.lit("geo"), index(*((f"G{k}", k) for k in range(5))), F.lit("time"), index(*((str(2019 + k), k) for k in range(5)))).alias("dimension"))
    return cube.unravel(c)


def deactivate_old(spark, d):
    return store.deactivate(model(spark, d)["jobs"], F.lit(AS_OF).cast("timestamp_ntz")).select("id", "is_active")


def relink_alias(spark, d):
    m = model(spark, d)
    s = m["skills"].groupBy("name").agg(F.min("id").alias("id"))
    links = m["job_skills"].join(m["skills"].select(F.col("id").alias("skill_id"), "name"), "skill_id").join(s, "name").select("job_id", F.col("id").alias("skill_id")).distinct()
    moved, _ = store.relink(links, s.select("id", "name"), spark.createDataFrame([("old ring", "blue ring"), ("hot gear", "blue ring")], "alias string, canonical string"))
    return moved


FUNCTIONS = (
    clean_lines, normalise_string, remote_flag, role_first_match, skill_longest_match, skill_longest_match_native, skill_full_catalog, role_many_phrases, skill_canonical, pln_rules, salary_mid, contract_fields, content_hash, selected_text, merge_policy, json_props,
    upsert_latest, upsert_load, exact_quantiles, insert_ignore, bulk_update, resolve_ids, sdmx_unravel, deactivate_old, relink_alias,
)


def queries() -> dict:
    return {f.__name__: f for f in FUNCTIONS}


_W = "[ \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: A character that no word has, as the engine's patterns know only ASCII word boundaries.
_NO = "[^\\p{L}\\p{M}\\p{N}_]"
_JOBS = f"with jobs as ({TABLES['jobs']})"


def _full_catalog() -> str:
    """Every pattern's first match in every text, then from the longest on those that overlap none before."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    names = ", ".join(quoted(n) for n, _, _ in DEFAULT.skills)
    patterns = ", ".join(f"({i}, {j}, {quoted(n)}, {quoted(k)}, {quoted(p)})" for i, (n, k, ps) in enumerate(DEFAULT.skills) for j, p in enumerate(ps))
    many = len(DEFAULT.skills)
    return f"""with recursive n as (select [{names}] as names), p(i, j, skill, kind, pattern) as (values {patterns}),
      o as (select o_orderkey, o_orderpriority || ' with ' || names[o_orderkey % {many} + 1] || ', ' || upper(names[(o_orderkey * 7 + 3) % {many} + 1]) || ' and/or Apache ' || lower(names[(o_orderkey * 5 + 1) % {many} + 1])
        || case when o_orderkey % 3 = 0 then ' on AWS, go programming' else '; git' end as t from orders, n),
      d as (select distinct t from o), h as (select t, i, min(j) as j from d, p where regexp_matches(t, '(?i)' || pattern) group by t, i),
      m as (select t, i, skill, kind, length(regexp_extract(t, '(?is)^(.*?)(?:' || pattern || ')', 1)) as a, length(regexp_extract(t, '(?i)' || pattern, 0)) as size from h join p using (i, j)),
      l as (select t, list(struct_pack(a := a, b := a + size, skill := skill, kind := kind) order by size desc, i) as ms from m group by t),
      g as (select t, ms, 1 as k, ms[1:1] as kept from l union all select t, ms, k + 1, case when len(list_filter(kept, lambda x: x.a < ms[k + 1].b and ms[k + 1].a < x.b)) = 0 then list_append(kept, ms[k + 1]) else kept end from g where k < len(ms)),
      r as (select t, unnest(kept) as x from g where k = len(ms)) select o_orderkey, x.skill as skill, x.kind as category from o join r using (t)"""


def oracle_sql() -> dict[str, str]:
    euro = lambda v: f"case when c = 'pl' then case when ref > 1500000 then null when ref >= 20000 then round_even({v} * 0.2342, 0) when ref < 5000 then round_even({v} * 220 * 0.2342, 0) else {v} end else {v} end"
    word = lambda x, w: f"regexp_matches({x}, '(?is)(^|{_NO})({w})({_NO}|$)')"
    at = lambda w: f"case when {word('text', w)} then length(regexp_extract(text, '(?is)^((?:.*?{_NO})??)(?:{w})(?:{_NO}|$)', 1)) end"
    # Whole words overlap only where one pattern's words are part of another's, whose first match then is longer.
    found = f"""with m as (select doc_id, {at('licen[sc]e')} as l, {at('apache license')} as al, {at('token')} as tk, {at('that')} as th, {at('of the')} as ot, {at('the')} as t from documents)
          select doc_id, 'License' as skill, 'tool' as category from m where l is not null and not coalesce(l >= al and l < al + 14, false)
          union all select doc_id, 'Open License', 'tool' from m where al is not null
          union all select doc_id, 'Token', 'language' from m where tk is not null
          union all select doc_id, 'That', 'methodology' from m where th is not null
          union all select doc_id, 'Of the', 'database' from m where ot is not null
          union all select doc_id, 'The', 'cloud' from m where t is not null and not coalesce(t >= ot and t < ot + 6, false)"""
    has = lambda x, *words: " or ".join(f"contains({x}, '{w}')" for w in words)
    return {
        "clean_lines": f"""with l as (select doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) as x, generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) as n from documents),
          s as (select doc_id, n, regexp_replace(x, '^{_W}+|{_W}+$', '', 'g') as x from l),
          k as (select doc_id, n, x, row_number() over (partition by doc_id, lower(regexp_replace(x, '{_W}+', ' ', 'g')) order by n) as r from s where length(x) >= 15),
          j as (select doc_id, string_agg(x, ' ' order by n) as x from k where r = 1 group by doc_id)
          select d.doc_id, nullif(trim(regexp_replace(j.x, '{_W}+', ' ', 'g')), '') as clean from documents d left join j on j.doc_id = d.doc_id""",
        "normalise_string": f"select doc_id, substr(nullif(trim(regexp_replace(text, '{_W}+', ' ', 'g')), ''), 1, 255) as title from documents",
        "role_first_match": f"""with p as (select p_partkey, lower(p_name) as t, lower(p_type) as d from part) select p_partkey, case when {has('t', 'old ')} then null when {has('t', 'ring', 'rod')} then 'ring'
          when {has('t', 'blue', 'red')} then 'colour' when {has('t', 'gear', 'gizmo')} then 'gear' when {has('d', 'steel', 'brass')} then 'metal' else 'other' end as role from p""",
        "remote_flag": f"""select doc_id, case when text is null or trim(regexp_replace(text, '{_W}+', ' ', 'g')) = '' then null when {word('text', 'the|der')} then true when {word('text', 'de|of')} then false end as remote from documents""",
        "skill_longest_match": found,
        "skill_longest_match_native": found,
        "skill_full_catalog": _full_catalog(),
        "role_many_phrases": """with c as (select c_custkey, case when c_custkey % 50 <> 0 then 't ' || cast(c_custkey * 7919 as varchar) end as t, lower(c_mktsegment) as d from customer),
          n as (select c_custkey, min(cast(substr(t, k, 3) as integer) % 16) as g from (select c_custkey, t, unnest(range(3, length(t) - 1)) as k from c) where cast(substr(t, k, 3) as integer) % 16 < 15 group by c_custkey)
          select c.c_custkey, case when t is null or contains(t, '77') or contains(t, '4242') then null when g is not null then 'g' || cast(g as varchar) when contains(d, 'build') or contains(d, 'house') then 'text' else 'other' end as role
          from c left join n on n.c_custkey = c.c_custkey""",
        "skill_canonical": """select p_partkey, case p_partkey % 5 when 0 then 'Token' when 1 then 'License' when 4 then p_name end as name,
          case p_partkey % 5 when 0 then 'language' when 1 then 'tool' when 4 then 'tool' end as category from part""",
        "resolve_ids": """with p as (select p_partkey as id, case when p_partkey % 2 = 0 then upper(p_name) else p_name end as name from part), f as (select name, min(id) as id from p group by name),
          n as (select distinct case when id % 3 = 0 then array_to_string(list_transform(string_split(lower(name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') else name end as name from f)
          select n.name, coalesce(min(e.id), min(l.id)) as id from n left join f e on e.name = n.name left join f l on lower(l.name) = lower(n.name) group by n.name having coalesce(min(e.id), min(l.id)) is not null""",
        "pln_rules": f"""with o as (select o_orderkey, case when o_orderkey % 2 = 0 then 'pl' else 'de' end as c, case when o_orderkey % 5 <> 0 then cast(floor(o_totalprice / 20) as double) end as a, case when o_orderkey % 3 = 0 then cast(floor(o_totalprice * 5) as double) end as b from orders),
          r as (select *, greatest(a, b) as ref from o) select o_orderkey, cast({euro('a')} as integer) as salary_min, cast({euro('b')} as integer) as salary_max from r""",
        "salary_mid": "select p_partkey, cast(round_even((p_size + floor(p_retailprice)) / 2, 0) as integer) as mid from part",
        "contract_fields": """select c_custkey, case c_custkey % 4 when 0 then 'permanent' when 1 then 'contract' when 2 then 'contract' end as contract_type, case c_custkey % 3 when 0 then 'full_time' when 1 then 'part_time' end as contract_time from customer""",
        "content_hash": "select doc_id, left(sha256(concat(coalesce(source, ''), chr(0), 'full', chr(0), 'm1', chr(0), substr(coalesce(text, ''), 1, 1500))), 16) as input_hash from documents",
        "selected_text": f"{_JOBS} select id, substr(coalesce(description_full, description_short), 1, 20) as text, case when description_full is not null then 'full' else 'short' end as text_source from jobs",
        "merge_policy": """with j as (select o_orderkey as id, case o_orderkey % 3 when 0 then 'other' when 1 then 'cloud' end as b, case when o_orderkey % 5 = 0 then 'other' when o_orderkey % 5 < 4 then 'devops' else 'nonsense' end as p, o_orderkey % 4 <> 0 as tech from orders),
          w as (select *, case when b = 'cloud' then false when not tech then true else p = 'devops' end as write from j) select id, write, case when write and tech then p when write then null else b end as role from w""",
        "json_props": "select event_id, cast(json_extract(props, '$.k') as integer) as k from events",
        "upsert_latest": "with e as (select *, row_number() over (partition by user_id order by ts >= timestamp '2024-01-15' desc, ts desc, event_id desc) as n from events) select user_id as id, event_id, event_type, value from e where n = 1",
        "upsert_load": f"""{_JOBS}, o as (select * from jobs where id % 3 <> 0), n as (select id, 'new ' || title as title, case when id % 8 <> 0 then role_category end as role_category, case when id % 5 <> 0 then posted_at + interval 100 day end as posted_at
            from jobs where id % 4 = 0 or id % 3 = 0),
          a as (select coalesce(n.id, o.id) as id, case when n.id is null then o.title else n.title end as title, case when n.id is null then o.role_category else n.role_category end as role_category, case when n.id is null then o.is_active else true end as is_active,
            case when n.id is null then o.posted_at else n.posted_at end as posted_at, case when o.id is null then timestamp '{AS_OF}' else o.posted_at end as first_seen_at, case when n.id is null then timestamp '2001-01-01' else timestamp '{AS_OF}' end as last_seen_at,
            case when o.id is null then timestamp '{AS_OF}' else timestamp '2001-01-01' end as ingested_at from o full join n on n.id = o.id)
          select * replace (is_active and coalesce(posted_at >= timestamp '{AS_OF}' - interval 90 day, true) as is_active) from a""",
        "exact_quantiles": "select l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) as p05, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.99), 4) as p99 from lineitem group by l_returnflag",
        "insert_ignore": "select distinct l_orderkey as job_id, l_partkey as skill_id from lineitem",
        "bulk_update": f"{_JOBS} select id, case when id % 12 = 0 then 'cloud' when id % 6 = 0 then null else role_category end as role_category from jobs",
        "sdmx_unravel": "select 'g' || cast(n_nationkey // 5 as varchar) as country_code, cast(2019 + n_nationkey % 5 as smallint) as year, cast(n_nationkey * 1.5 as double) as value from nation",
        "deactivate_old": f"{_JOBS} select id, is_active and not coalesce(posted_at < timestamp '{AS_OF}' - interval 90 day, false) as is_active from jobs",
        "relink_alias": """with s as (select p_name as name, min(p_partkey) as id from part group by p_name), l as (select distinct l_orderkey as job_id, p_name as name from lineitem join part on p_partkey = l_partkey where l_partkey % 50 <> 0)
          select distinct job_id, s.id as skill_id from l join s on s.name = case when l.name in ('old ring', 'hot gear') then 'blue ring' else l.name end""",
    }
