"""The dashboard's ten views."""

VIEWS = {
    "v_top_skills_by_country": """
        select c.code as country_code, c.name as country_name, j.role_category, s.name as skill, s.category as skill_category, count(*) as job_count,
          cast(round(100.0 * count(*) / sum(count(*)) over (partition by c.code, j.role_category), 2) as double) as pct_of_segment_jobs
        from {jobs} j join {job_skills} l on l.job_id = j.id join {skills} s on s.id = l.skill_id join {countries} c on c.code = j.country_code
        where j.is_active and j.posted_at >= now! - interval 90 day
        group by c.code, c.name, j.role_category, s.name, s.category""",
    "v_salary_stats_by_country": """
        select c.code as country_code, c.name as country_name, j.contract_type, count(*) as job_count, cast(round(avg(salary_min)) as double) as avg_salary_min,
          cast(round(avg(salary_max)) as double) as avg_salary_max, cast(round(avg(salary_mid)) as double) as avg_salary_mid, cast(round(median!(salary_mid)) as double) as median_salary_eur
        from {jobs} j join {countries} c on c.code = j.country_code where is_active and salary_mid is not null and not salary_is_predicted
        group by c.code, c.name, j.contract_type""",
    "v_remote_pct_by_country": """
        select c.code as country_code, c.name as country_name, count(*) as total_jobs, count(*) filter (where remote) as remote_jobs,
          cast(round(100.0 * count(*) filter (where remote) / count(*), 2) as double) as remote_pct
        from {jobs} j join {countries} c on c.code = j.country_code where is_active and remote is not null group by c.code, c.name""",
    "v_job_trends_monthly": """
        select cast(date_trunc('month', posted_at) as date) as month, c.code as country_code, c.name as country_name, count(*) as job_count
        from {jobs} j join {countries} c on c.code = j.country_code where is_active and posted_at is not null
        group by cast(date_trunc('month', posted_at) as date), c.code, c.name""",
    "v_salary_by_role_country": """
        select c.code as country_code, c.name as country_name, role_category, count(*) as job_count, cast(round(avg(salary_mid)) as double) as avg_salary_eur, cast(round(median!(salary_mid)) as double) as median_salary_eur
        from {jobs} j join {countries} c on c.code = j.country_code
        where is_active and role_category is not null and salary_mid is not null and not salary_is_predicted group by c.code, c.name, role_category""",
    "v_demand_by_role_monthly": """
        select cast(date_trunc('month', posted_at) as date) as month, c.code as country_code, c.name as country_name, role_category, count(*) as job_count
        from {jobs} j join {countries} c on c.code = j.country_code where is_active and posted_at is not null and role_category is not null
        group by cast(date_trunc('month', posted_at) as date), c.code, c.name, role_category""",
    "v_skill_cooccurrence": """
        with recent as (select l.job_id, l.skill_id, s.name, j.role_category from {jobs} j join {job_skills} l on l.job_id = j.id join {skills} s on s.id = l.skill_id
          where j.is_active and j.posted_at >= now! - interval 90 day)
        select a.name as skill, b.name as co_skill, a.role_category, count(distinct a.job_id) as co_count
        from recent a join recent b on a.job_id = b.job_id and a.skill_id < b.skill_id group by a.name, b.name, a.role_category""",
    "v_top_skills_global": """
        select s.name as skill, s.category as skill_category, count(*) as job_count, cast(round(100.0 * count(*) / sum(count(*)) over (), 2) as double) as pct_of_all_jobs
        from {jobs} j join {job_skills} l on l.job_id = j.id join {skills} s on s.id = l.skill_id where j.is_active and j.posted_at >= now! - interval 90 day
        group by s.name, s.category""",
    "v_offers_by_country": "select c.code as country_code, c.name as country_name, count(*) as total_jobs from {jobs} j join {countries} c on c.code = j.country_code where is_active group by c.code, c.name",
    "v_skills_with_market_context": """
        select s.name as skill, s.category, c.code as country_code, c.name as country_name, count(*) as demand, cast(round(avg(j.salary_mid)) as double) as avg_salary_eur, m.value as employment_rate, cast(m.year as int) as context_year
        from {jobs} j join {job_skills} l on l.job_id = j.id join {skills} s on s.id = l.skill_id join {countries} c on c.code = j.country_code
        left join {context} m on m.country_code = j.country_code and m.indicator = 'employment_rate_15_64' and m.year = extract(year from j.posted_at)
        where j.is_active group by s.name, s.category, c.code, c.name, m.value, m.year""",
}

#: In which order each view's rows come.
ORDERS = {
    "v_top_skills_by_country": "country_code, role_category, job_count desc",
    "v_salary_stats_by_country": "median_salary_eur desc nulls last",
    "v_remote_pct_by_country": "remote_pct desc",
    "v_job_trends_monthly": "month desc, job_count desc",
    "v_salary_by_role_country": "country_code, median_salary_eur desc nulls last",
    "v_demand_by_role_monthly": "month desc, country_code, job_count desc",
    "v_skill_cooccurrence": "co_count desc",
    "v_top_skills_global": "job_count desc",
    "v_offers_by_country": "total_jobs desc",
    "v_skills_with_market_context": "demand desc",
}
VIEWS = {name: f"{query} order by {ORDERS[name]}" for name, query in VIEWS.items()}
