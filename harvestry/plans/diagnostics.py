"""The weekly load's diagnostics and the canonicalisation plan as functions of the job model's tables and the settings, and maintenance selections as texts.

Recent: ingested in the last 8 days. Ids of jobs are unique (constraint_violations counts those that are not), so links
are counted by job before the join. Medians over links and examples of a skill come from grouped counts and the first
three ranks: no task holds all links of one skill or period.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audit import Model, _roles, active
from .measures import links_by_job, n, pct, quantile, ratio, skill_links, with_links
from .settings import Canonical, Settings

c = F.col


def recent(s: Settings) -> Column:
    return c("ingested_at") >= s.since(days=8)


def week() -> Column:
    return F.date_trunc("week", "ingested_at").cast("date").alias("week")


def diag_d0_summary(m: Model, s: Settings) -> DataFrame:
    links = m["job_skills"].agg(n().alias("links"))
    told = (c("country_code") == s.country) & ~c("salary_is_predicted")
    out = active(m).agg(n().alias("total"), n(recent(s)).alias("recent"), pct(n(c("role_category") == "other")).alias("pct_other"), pct(n(c("role_category").isNull())).alias("pct_null"), quantile("salary_mid", 0.5, told).alias("median_one"))
    # Two single rows meet.
    return out.join(F.broadcast(links)).select("total", "recent", "pct_other", "pct_null", ratio(c("links"), c("total")).alias("links_per_job"), "median_one")


def diag_d1a_roles(m: Model, s: Settings) -> DataFrame:
    return _roles(active(m), [], "NULL").orderBy(c("n").desc(), "role")


def diag_d1b_gaps(m: Model, s: Settings) -> DataFrame:
    other, none = c("role_category") == "other", c("role_category").isNull()
    out = active(m).groupBy("country_code").agg(n(other).alias("n_other"), n(none).alias("n_null"), n().alias("total"), pct(n(other | none)).alias("pct_unclassified"))
    return out.orderBy(c("pct_unclassified").desc(), "country_code")


def diag_d1c_other_titles(m: Model, s: Settings) -> DataFrame:
    out = active(m).filter("role_category = 'other'").groupBy("title", "country_code").agg(n().alias("n"))
    return out.filter("n > 1").orderBy(c("n").desc(), "title", "country_code").limit(50)


def diag_d1d_weekly_other(m: Model, s: Settings) -> DataFrame:
    other = n(c("role_category") == "other")
    return m["jobs"].groupBy(week()).agg(n().alias("total"), other.alias("n_other"), pct(other).alias("pct_other")).orderBy(c("week").desc()).limit(8)


def diag_d2a_recent_vs_history(m: Model, s: Settings) -> DataFrame:
    """Recently ingested jobs against all, both with inactive ones; the median is over links, so a job counts once for each."""
    linked = m["jobs"].join(links_by_job(m["job_skills"]), m["jobs"].id == c("job_id"))
    periods = F.when(recent(s), F.array(F.lit("recent"), F.lit("history"))).otherwise(F.array(F.lit("history")))
    counted = linked.select(F.explode(periods).alias("period"), "links").groupBy("period", "links").agg(n().alias("jobs"))
    out = counted.groupBy("period").agg(F.sum("jobs").alias("jobs"), F.sum(c("jobs") * c("links")).alias("all"), F.percentile("links", 0.5, c("jobs") * c("links")).alias("median"))
    both = m["jobs"].sparkSession.createDataFrame([("recent",), ("history",)], "period string").join(out, "period", "left")
    zero = lambda k: F.coalesce(k, F.lit(0)).cast("long")
    return both.select("period", zero("jobs").alias("jobs"), zero("all").alias("links"), ratio(c("all"), c("jobs")).alias("avg_links"), F.bround("median", 0).cast("int").alias("median_links"))


def diag_d2b_histogram(m: Model, s: Settings) -> DataFrame:
    k = F.coalesce("links", F.lit(0))
    bucket = F.when(k <= 2, k.cast("string")).when(k <= 5, "3-5").when(k <= 10, "6-10").otherwise("11+")
    out = with_links(active(m), m["job_skills"]).groupBy(bucket.alias("bucket")).agg(n().alias("jobs"), F.min(k).alias("least"))
    # The window has no key: it runs over the six buckets.
    return out.withColumn("pct", pct(c("jobs"), F.sum("jobs").over(Window.partitionBy()))).orderBy("least").drop("least")


def diag_d2c_top_recent(m: Model, s: Settings) -> DataFrame:
    links = m["job_skills"].join(m["jobs"].filter(recent(s)).select(c("id").alias("job_id")), "job_id")
    out = skill_links(m["skills"], links).filter("links > 0").groupBy("name", "category").agg(F.sum("links").alias("n"))
    return out.orderBy(c("n").desc(), "name", "category").limit(30)


def diag_d2d_recent_text(m: Model, s: Settings) -> DataFrame:
    full = n(c("description_full").isNotNull())
    out = active(m).filter(recent(s)).groupBy("country_code").agg(n().alias("total"), full.alias("with_full"), pct(full).alias("pct_full"))
    return out.orderBy("pct_full", "country_code")


def diag_d3a_null_roles(m: Model, s: Settings) -> DataFrame:
    """The newest by date of posting; undated ones come first, as a descending order has nulls first there."""
    out = active(m).filter("role_category is null").orderBy(c("posted_at").desc_nulls_first(), "id").limit(50)
    return out.select("id", "title", "company", "country_code", c("posted_at").cast("date").alias("day"))


def diag_d3b_null_share(m: Model, s: Settings) -> DataFrame:
    none = n(c("role_category").isNull())
    return active(m).groupBy("country_code").agg(none.alias("n_null"), n().alias("total"), pct(none).alias("pct_null")).orderBy(c("pct_null").desc(), "country_code")


def diag_d3c_tool_skills(m: Model, s: Settings) -> DataFrame:
    found = m["skills"].filter((c("category") == s.tool_category) & (F.length("name") > 3))
    return skill_links(found, m["job_skills"]).filter("links > 0").groupBy("name").agg(F.sum("links").alias("n")).orderBy(c("n").desc(), "name").limit(40)


def diag_d4a_pay_range(m: Model, s: Settings) -> DataFrame:
    told = active(m).filter("salary_mid is not null and not salary_is_predicted")
    out = told.groupBy("country_code").agg(n().alias("n"), F.min("salary_mid").alias("low"), quantile("salary_mid", 0.5).alias("mid"), F.max("salary_mid").alias("high"))
    return out.orderBy(c("mid").desc(), "country_code")


def diag_d4b_pay_anomalies(m: Model, s: Settings) -> DataFrame:
    mid = c("salary_mid")
    kind = F.when(c("salary_min") > c("salary_max"), "min > max").when(c("salary_min") < 0, "negative").when(mid > s.week_high, "high").when((mid > 0) & (mid < s.week_low), "low")
    return active(m).select("id", "title", "country_code", "salary_min", "salary_max", "salary_mid", kind.alias("anomaly")).filter("anomaly is not null")


def diag_d5a_weekly_intake(m: Model, s: Settings) -> DataFrame:
    return m["jobs"].groupBy(week(), "country_code").agg(n().alias("n")).orderBy(c("week").desc(), "country_code")


def diag_d5b_undated(m: Model, s: Settings) -> DataFrame:
    undated = n(c("posted_at").isNull())
    out = active(m).filter(recent(s)).groupBy("country_code").agg(undated.alias("undated"), n().alias("total"), pct(undated).alias("pct_undated"))
    return out.orderBy(c("pct_undated").desc(), "country_code")


def diag_d5c_counts(m: Model, s: Settings) -> DataFrame:
    """Four single rows side by side: skills, links, active jobs, and the skills that an active job has."""
    used = m["job_skills"].join(active(m).select(c("id").alias("job_id")), "job_id", "left_semi").select("skill_id").distinct()
    parts = [m["skills"].agg(n().alias("skills")), m["job_skills"].agg(n().alias("links")), active(m).agg(n().alias("active_jobs")), used.agg(F.count("skill_id").alias("used"))]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)


def _compound(m: Model, s: Settings, blanks: bool) -> DataFrame:
    like = reduce(lambda a, b: a | b, [c("name").ilike(p) for p in s.compound])
    long = F.length("name") > s.compound_letters
    return m["skills"].filter(like & (long | c("name").like("% %") if blanks else long) & ~c("name").isin(*s.no_compound))


def canon_a3_compounds(m: Model, s: Settings) -> DataFrame:
    return skill_links(_compound(m, s, False), m["job_skills"]).filter("links > 0").orderBy(c("links").desc(), "id")


def _affected(m: Model, what: Canonical) -> DataFrame:
    alias = m["skills"].filter(what.alias(c("name"))).select(c("id").alias("skill_id"), c("name").alias("skill"))
    jobs = m["jobs"].select(c("id").alias("job_id"), "title")
    return m["job_skills"].join(alias, "skill_id").join(jobs, "job_id").select("job_id", "title", "skill", "skill_id").orderBy("job_id", "skill_id")


def canon_a4_affected(m: Model, s: Settings) -> DataFrame:
    return _affected(m, s.canonical[0])


def canon_a5_affected(m: Model, s: Settings) -> DataFrame:
    return _affected(m, s.canonical[1])


def canon_c_examples(m: Model, s: Settings) -> DataFrame:
    """Phrases with their links and the titles of their first three jobs by id; no group is gathered beyond these three."""
    found = skill_links(_compound(m, s, True), m["job_skills"].join(m["jobs"].select(c("id").alias("job_id")), "job_id", "left_semi")).filter("links > 0")
    rank = F.row_number().over(Window.partitionBy("skill_id").orderBy("job_id"))
    firsts = m["job_skills"].join(found.select(c("id").alias("skill_id")), "skill_id", "left_semi").join(m["jobs"].select(c("id").alias("job_id"), "title"), "job_id").withColumn("rank", rank).filter("rank <= 3")
    titles = firsts.groupBy("skill_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("t")).select(c("skill_id").alias("id"), F.array_join(c("t.title"), " | ").alias("examples"))
    return found.join(titles, "id").select("id", "name", "category", "links", "examples").orderBy(c("links").desc(), "id")


FRAMES = (
    diag_d0_summary, diag_d1a_roles, diag_d1b_gaps, diag_d1c_other_titles, diag_d1d_weekly_other, diag_d2a_recent_vs_history, diag_d2b_histogram, diag_d2c_top_recent, diag_d2d_recent_text, diag_d3a_null_roles,
    diag_d3b_null_share, diag_d3c_tool_skills, diag_d4a_pay_range, diag_d4b_pay_anomalies, diag_d5a_weekly_intake, diag_d5b_undated, diag_d5c_counts, canon_a3_compounds, canon_a4_affected, canon_a5_affected, canon_c_examples,
)

#: Canonical names and their alias by pattern, on the stand-ins: 'blue ring' takes over 'old ring'.
CANONICAL, ALIAS = "blue ring", "old ring"
_IDS = f"canon as (select min(id) as id from {{skills}} where name = '{CANONICAL}'), alias as (select id from {{skills}} where lower(name) = '{ALIAS}')"

CANONICALISATION = {
    "canon_a1_variants": "select s.id, s.name, coalesce(n.links, 0) as links from {skills} s left join (select skill_id, count(*) as links from {job_skills} group by skill_id) n on n.skill_id = s.id where s.name in ('blue ring', 'old ring') or s.name ilike 'new %ring'",
    "canon_a2_links": "select s.name, count(l.job_id) as links from {skills} s left join {job_skills} l on l.skill_id = s.id where s.name in ('blue ring', 'old ring', 'red ring') group by s.name",
    "canon_a6_exists": "select distinct name from {skills} where name in ('blue ring', 'red ring', 'violet ring')",
    "canon_b_relink": f"""
        with {_IDS}
        select distinct l.job_id, case when l.skill_id in (select id from alias) then (select id from canon) else l.skill_id end as skill_id from {{job_skills}} l""",
    "canon_b_dropped_skills": f"""
        with {_IDS}, left_over as (select distinct case when skill_id in (select id from alias) then (select id from canon) else skill_id end as skill_id from {{job_skills}})
        select s.id, s.name from {{skills}} s where s.id not in (select id from alias where id not in (select skill_id from left_over))""",
    "canon_b3_after": f"""
        with {_IDS}, links as (select distinct job_id, case when skill_id in (select id from alias) then (select id from canon) else skill_id end as skill_id from {{job_skills}})
        select 'alias links' as what, count(*) as n from links where skill_id in (select id from alias)
        union all select 'canonical links' as what, count(*) as n from links where skill_id in (select id from canon)""",
}

MAINTENANCE = {
    "retro_r1_candidates": "select count(*) as n from {jobs} where is_active and (role_category is null or role_category = 'other') and ingested_at >= now! - interval 60 day",
    "retro_p12_page": "select id, title, role_category from {jobs} where is_active and id > 1000 and (role_category is null or role_category = 'other') order by id limit 50",
    "retro_p14_titles": "select count(*) as n from {jobs} where is_active and (title ilike '%urgent%' or title ilike '%low mach%')",
    "repair_p13_backlog": "select id, url from {jobs} where is_active and url is not null and description_full is null and url not like '%/land/%' and country_code = '7' order by posted_at desc nulls first, id limit 100",
    "retro_r2_existing": "select l.job_id, joined!(s.name) as names from {jobs} j join {job_skills} l on l.job_id = j.id join (select id, lower(name) as name from {skills}) s on s.id = l.skill_id where j.is_active and j.role_category = 'other' group by l.job_id",
    "write_m4_deactivate": "select id, is_active and not coalesce(posted_at < now! - interval 90 day, false) as is_active from {jobs}",
    "write_m10_soft_delete": "select id, is_active and not (title ilike '%not specified%' or title ilike '%furniture%') as is_active from {jobs}",
    "constraint_violations": """
        select 'salary order' as rule, count(*) as n from {jobs} where salary_max < salary_min
        union all select 'negative pay' as rule, count(*) as n from {jobs} where salary_min < 0 or salary_max < 0
        union all select 'unknown country' as rule, count(*) as n from {jobs} j left join {countries} c on c.code = j.country_code where c.code is null
        union all select 'duplicate id' as rule, count(*) as n from (select id from {jobs} group by id having count(*) > 1) d
        union all select 'orphan link' as rule, count(*) as n from {job_skills} l left join {jobs} j on j.id = l.job_id where j.id is null""",
}
