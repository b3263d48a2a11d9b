"""What the audit, diagnostics and canonicalisation plans must give over the stand-ins, in the checking engine's SQL: written from the rules, not from the plans."""

from .standins import AS_OF

_DAYS = f"(timestamp '{AS_OF}' - interval {{}} day)"
RECENT = f"ingested_at >= {_DAYS.format(8)}"
#: One row a job that is active, with how many links it has.
JL = "(select j.*, (select count(*) from {job_skills} l where l.job_id = j.id) as k from {jobs} j where j.is_active)"
OF = "round(cast(100 * {} as decimal(20, 4)) / nullif({}, 0), 1)"


def of(part: str, whole: str = "count(*)") -> str:
    return f"cast({OF.format(part, whole)} as double)"


def _affected(where: str) -> str:
    return f"select job_id, (select title from {{jobs}} where id = job_id) as title, name as skill, skill_id from {{job_skills}} join {{skills}} on id = skill_id where {where}"


ORACLE = {
    "audit_q01_text_coverage": f"""select country_code, count(*) as total, count(description_full) as with_full, sum((description_full is null)::bigint)::bigint as without_full, count(description_short) as with_short,
      {of('count(description_full)')} as pct_full, {of('sum((coalesce(description_full, description_short) is null)::bigint)')} as pct_no_text from {{jobs}} where is_active group by 1""",
    "audit_q02_skill_coverage": f"""select country_code, count(*) as total, sum((k > 0)::bigint)::bigint as with_skills, sum((k = 0)::bigint)::bigint as without_skills, {of('sum((k > 0)::bigint)')} as pct_with_skills,
      round(sum(k)::double / nullif(sum((k > 0)::bigint), 0), 2) as avg_with_skills, round(sum(k)::double / count(*), 2) as avg_all from {JL} group by 1""",
    "audit_q06_skill_segments": f"""with a as (select k > 0 as linked from {JL}) select 'all active' as segment, count(*) as n from a
      union all select case when linked then 'with skills' else 'without skills' end, count(*) from a group by linked""",
    "audit_q07_unused_skills": "select id, name, category, cast(0 as bigint) as links from {skills} s where not exists (select 1 from {job_skills} l where l.skill_id = s.id)",
    "audit_q08a_prefix_variants": """select name, category, count(job_id) as jobs from {skills} left join {job_skills} on skill_id = id
      where starts_with(lower(name), 'blue') or starts_with(lower(name), 'hot g') or (starts_with(lower(name), 'old r') and not starts_with(lower(name), 'old ring')) group by name, category""",
    "audit_q08b_first_token": "select string_split(lower(name), ' ')[1] as token, count(distinct name) as variants, string_agg(name, ' | ' order by name) as names from {skills} group by 1 having count(distinct name) > 1",
    "audit_q03_role_share": f"""with k as (select coalesce(case role_category when 'other' then 'other' else role_category || '!' end, 'none') as r from {{jobs}} where is_active),
      t as (select count(*) as total, sum((r = 'other')::bigint)::bigint as n_other, sum((r = 'none')::bigint)::bigint as n_null, sum((right(r, 1) = '!')::bigint)::bigint as n_classified from k)
      select *, {of('n_other', 'total')} as pct_other, {of('n_null', 'total')} as pct_null, {of('n_classified', 'total')} as pct_classified from t""",
    "audit_q04_role_distribution": f"with a as (select coalesce(role_category, '(null)') as role from {{jobs}} where is_active) select role, count(*) as n, {of('count(*)', '(select count(*) from a)')} as pct from a group by role",
    "audit_q14_role_by_country": f"""with a as (select country_code, coalesce(role_category, '(null)') as role from {{jobs}} where is_active), t as (select country_code, count(*) as whole from a group by 1)
      select a.country_code, role, count(*) as n, {of('count(*)', 'max(whole)')} as pct from a join t on a.country_code = t.country_code group by 1, 2""",
    "audit_q05_salary_coverage": f"""select country_code, count(*) as total, count(salary_mid) as with_pay, {of('count(salary_mid)')} as pct_pay, count(case when not salary_is_predicted then salary_mid end) as declared,
      count(case when salary_is_predicted then salary_mid end) as predicted, sum((coalesce(salary_min, salary_max) is null)::bigint)::bigint as no_pay from {{jobs}} where is_active group by 1""",
    "audit_q09_country_pay": """with p as (select salary_mid as x, case when not salary_is_predicted then salary_mid end as told from {jobs} where country_code = '7' and is_active and salary_mid is not null)
      select count(told) as declared, count(*) - count(told) as predicted, round(quantile_cont(told, 0.5)) as median_declared, round(avg(told)) as mean_declared, round(quantile_cont(x, 0.5)) as median_all from p""",
    "audit_q10_pay_quartiles": """with p as (select country_code, case when not salary_is_predicted then salary_mid end as x from {jobs} where country_code = '7' and is_active and salary_mid is not null)
      select country_code, count(x) as declared, min(x) as low, round(quantile_cont(x, 0.25)) as p25, round(quantile_cont(x, 0.5)) as p50, round(quantile_cont(x, 0.75)) as p75, max(x) as high from p group by 1""",
    "audit_q15_pay_anomalies": """with j as (select * from {jobs} where is_active),
      f as (select id, 1 as rule, 'min > max' as anomaly from j where salary_max < salary_min union all select id, 2, 'negative' from j where least(salary_min, salary_max) < 0
        union all select id, 3, case when salary_is_predicted then 'high, predicted' else 'high, declared' end from j where salary_mid >= 400001 union all select id, 4, 'low' from j where salary_mid between 1 and 1999
        union all select id, 5, 'high for the country' from j where country_code = '7' and salary_mid >= 200001 and not salary_is_predicted),
      o as (select id, arg_min(anomaly, rule) as anomaly from f group by id)
      select j.id, title, company, country_code, salary_min, salary_max, salary_mid, salary_is_predicted, cast(posted_at as date) as day, anomaly from j join o on o.id = j.id""",
    "audit_q11_text_length": f"""select country_code, count(*) as total, count(description_full) as with_full, {of('count(description_full)')} as pct_full, round(sum(length(description_full)) / nullif(count(description_full), 0)) as mean_full,
      round(sum(length(description_short)) / nullif(count(description_short), 0)) as mean_short from {{jobs}} where is_active group by 1""",
    "audit_q12_coverage_rank": f"""select country_code, count(*) as total, sum((k > 0)::bigint)::bigint as with_skills, sum(k)::bigint as links, {of('sum((k > 0)::bigint)')} as pct_with_skills,
      round(sum(k)::double / nullif(sum((k > 0)::bigint), 0), 1) as avg_with_skills from {JL} group by 1""",
    "audit_q13_volume": f"""select country_code, (select name from {{countries}} where code = country_code) as country_name, count(*) as active, {', '.join(f"sum((coalesce(posted_at >= {_DAYS.format(d)}, false))::bigint)::bigint as last_{d}" for d in (7, 30, 90))},
      count(*) - count(posted_at) as undated, {of('(count(*) - count(posted_at))')} as pct_undated from {{jobs}} where is_active and country_code in (select code from {{countries}}) group by 1""",
    "health_h1_intake": f"""with a as (select (timestamp '{AS_OF}' - ingested_at) <= interval 30 day as late, (timestamp '{AS_OF}' - ingested_at) <= interval 60 day as known from {{jobs}}),
      t as (select count(*) as total, sum(late::bigint)::bigint as last_30, sum((known and not late)::bigint)::bigint as previous_30 from a) select *, case when previous_30 = 0 then 0.0::double else {of('(last_30 - previous_30)', 'previous_30')} end as growth_pct from t""",
    "health_h2_active": "select sum(is_active::bigint)::bigint as active, sum((not is_active)::bigint)::bigint as inactive from {jobs}",
    "health_h3_roles": "select case when role_category is null then 'null' else role_category end as role, count(*) as n from {jobs} group by 1",
    "health_h4_pay": f"with p as (select country_code, case when not salary_is_predicted then salary_mid end as x from {{jobs}}) select country_code, count(*) as total, count(x) as declared, {of('count(x)')} as pct_declared, round(quantile_cont(x, 0.5)) as median_declared from p group by 1",
    "health_h5_links": "select count(distinct job_id) as jobs_with_skills, count(*) as links, count(*)::double / nullif(count(distinct job_id), 0) as average from {job_skills}",
    "health_h6_top_skills": "select name, count(*) as n from {job_skills} join {skills} on skill_id = id group by name order by n desc, name limit 10",
    "notify_n1_total": "select count(id) as total from {jobs}",
    "notify_n2_recent": f"select country_code, count(*) as n from {{jobs}} where timestamp '{AS_OF}' - ingested_at <= interval 2 hour group by 1",
    "diag_d0_summary": f"""select count(*) as total, sum(({RECENT})::bigint)::bigint as recent, {of("sum((coalesce(role_category, '') = 'other')::bigint)")} as pct_other, {of('(count(*) - count(role_category))')} as pct_null,
      round((select count(*) from {{job_skills}})::double / count(*), 1) as links_per_job, round(quantile_cont(case when country_code = '7' and not salary_is_predicted then salary_mid end, 0.5)) as median_one from {{jobs}} where is_active""",
    "diag_d1a_roles": f"with a as (select coalesce(role_category, 'NULL') as role from {{jobs}} where is_active) select role, count(*) as n, {of('count(*)', '(select count(*) from a)')} as pct from a group by role",
    "diag_d1b_gaps": f"""with a as (select country_code, coalesce(role_category, '') as r from {{jobs}} where is_active) select country_code, sum((r = 'other')::bigint)::bigint as n_other, sum((r = '')::bigint)::bigint as n_null,
      count(*) as total, {of("sum((r in ('', 'other'))::bigint)")} as pct_unclassified from a group by 1""",
    "diag_d1c_other_titles": "with a as (select title, country_code, count(*) as n from {jobs} where is_active and role_category = 'other' group by all) select * from a where n >= 2 order by n desc, title, country_code limit 50",
    "diag_d1d_weekly_other": f"""with a as (select cast(ingested_at as date) - (isodow(ingested_at) - 1)::integer as week, coalesce(role_category = 'other', false) as o from {{jobs}})
      select week, count(*) as total, sum(o::bigint)::bigint as n_other, {of('sum(o::bigint)')} as pct_other from a group by week order by week desc limit 8""",
    "diag_d2a_recent_vs_history": f"""with r as (select l.job_id, j.ingested_at, count(*) over (partition by l.job_id) as k from {{job_skills}} l join {{jobs}} j on j.id = l.job_id),
      p as (select 'history' as period, job_id, k from r union all select 'recent', job_id, k from r where {RECENT})
      select period, count(distinct job_id) as jobs, count(*) as links, round(count(*)::double / count(distinct job_id), 1) as avg_links, cast(round_even(quantile_cont(k, 0.5), 0) as integer) as median_links from p group by period""",
    "diag_d2b_histogram": f"""with a as (select case when k >= 11 then '11+' when k >= 6 then '6-10' when k >= 3 then '3-5' else k::varchar end as bucket from {JL}) select bucket, count(*) as jobs, {of('count(*)', '(select count(*) from a)')} as pct from a group by 1""",
    "diag_d2c_top_recent": f"select s.name, s.category, count(*) as n from {{job_skills}} l, {{skills}} s where l.skill_id = s.id and l.job_id in (select id from {{jobs}} where {RECENT}) group by all order by n desc, name, category limit 30",
    "diag_d2d_recent_text": f"select country_code, count(*) as total, count(description_full) as with_full, {of('count(description_full)')} as pct_full from {{jobs}} where is_active and {RECENT} group by 1",
    "diag_d3a_null_roles": "select id, title, company, country_code, cast(posted_at as date) as day from (select * from {jobs} where is_active and role_category is null order by posted_at is not null, posted_at desc, id limit 50)",
    "diag_d3b_null_share": f"select country_code, count(*) - count(role_category) as n_null, count(*) as total, {of('(count(*) - count(role_category))')} as pct_null from {{jobs}} where is_active group by 1",
    "diag_d3c_tool_skills": "select name, count(*) as n from {job_skills} l join {skills} s on s.id = l.skill_id where s.category = 'PROMO' and length(name) >= 4 group by name order by n desc, name limit 40",
    "diag_d4a_pay_range": "select country_code, count(*) as n, min(salary_mid) as low, round(quantile_cont(salary_mid, 0.5)) as mid, max(salary_mid) as high from {jobs} where is_active and salary_mid is not null and salary_is_predicted = false group by 1",
    "diag_d4b_pay_anomalies": """with j as (select * from {jobs} where is_active), f as (select id, 1 as rule, 'min > max' as anomaly from j where salary_max < salary_min union all select id, 2, 'negative' from j where salary_min < 0
        union all select id, 3, 'high' from j where salary_mid >= 480001 union all select id, 4, 'low' from j where salary_mid between 1 and 2499), o as (select id, arg_min(anomaly, rule) as anomaly from f group by id)
      select j.id, title, country_code, salary_min, salary_max, salary_mid, anomaly from j join o on o.id = j.id""",
    "diag_d5a_weekly_intake": "select cast(ingested_at as date) - (isodow(ingested_at) - 1)::integer as week, country_code, count(*) as n from {jobs} group by all",
    "diag_d5b_undated": f"select country_code, count(*) - count(posted_at) as undated, count(*) as total, {of('(count(*) - count(posted_at))')} as pct_undated from {{jobs}} where is_active and {RECENT} group by 1",
    "diag_d5c_counts": """select (select count(id) from {skills}) as skills, (select count(job_id) from {job_skills}) as links, (select sum(is_active::bigint)::bigint from {jobs}) as active_jobs,
      (select count(distinct l.skill_id) from {job_skills} l join {jobs} j on j.id = l.job_id and j.is_active) as used""",
    "canon_a3_compounds": """select id, name, category, count(*) as links from {skills} join {job_skills} on skill_id = id where length(name) >= 10 and (contains(lower(name), 'ring') or contains(lower(name), 'gizmo'))
      and name not in ('blue ring', 'small ring', 'new gizmo') group by all""",
    "canon_a4_affected": _affected("(lower(name) in ('old ring', 'hot ring') or name in ('red rod', 'Red Ring')) and name <> 'blue ring' and not starts_with(name, 'hot')"),
    "canon_a5_affected": _affected("(lower(name) in ('old plate', 'new plate') or name = 'hot rod') and name <> 'red plate' and not contains(name, ' / ')"),
    "canon_c_examples": """with p as (select id, name, category from {skills} where (contains(lower(name), 'ring') or contains(lower(name), 'gizmo')) and name not in ('blue ring', 'small ring', 'new gizmo') and (length(name) >= 10 or contains(name, ' ')))
      select p.id, p.name, p.category, count(*) as links, array_to_string(list_slice(list(j.title order by j.id), 1, 3), ' | ') as examples from p join {job_skills} l on l.skill_id = p.id join {jobs} j on j.id = l.job_id group by all""",
}
