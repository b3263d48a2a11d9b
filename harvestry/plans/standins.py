"""The job model over the given tables, which hold no adverts: orders stand for jobs, nations for countries, parts for skills."""

from __future__ import annotations

from .settings import Canonical, Settings

AS_OF = "2001-08-01 00:00:00"

TABLES = {
    "countries": "select cast(n_nationkey as string) as code, n_name as name, 'EUR' as currency from nation",
    "jobs": """
        select o_orderkey as id, concat(o_orderpriority, ' ', c_mktsegment) as title, c_name as company, cast(c_nationkey as string) as country_code,
          case when o_orderkey % 10 = 0 then 'other' else nullif(o_orderpriority, '4-NOT SPECIFIED') end as role_category,
          case when o_orderkey % 7 <> 0 then cast(floor(o_totalprice * 0.875) as int) end as salary_min,
          case when o_orderkey % 7 <> 0 then cast(floor(o_totalprice * 1.125) as int) end as salary_max,
          case when o_orderkey % 7 <> 0 then cast(floor(o_totalprice) as int) end as salary_mid,
          o_orderkey % 3 = 0 as salary_is_predicted,
          case when o_orderkey % 13 <> 0 then c_mktsegment end as contract_type,
          case o_orderkey % 5 when 0 then true when 1 then false when 2 then false end as remote,
          concat('short ', o_orderpriority) as description_short,
          case when o_orderkey % 4 <> 0 then concat('full ', c_name, ' ', o_orderpriority) end as description_full,
          case when o_orderkey % 17 <> 0 then concat('https://jobs.example.com/', case when o_orderkey % 3 = 0 then 'land/' else 'details/' end, cast(o_orderkey as string)) end as url,
          o_orderstatus <> 'F' as is_active,
          case when o_orderkey % 11 <> 0 then o_orderdate end as posted_at,
          o_orderdate + interval 1 day as ingested_at
        from orders join customer on o_custkey = c_custkey""",
    "skills": "select p_partkey as id, p_name as name, p_type as category from part",
    "job_skills": "select distinct l_orderkey as job_id, l_partkey as skill_id from lineitem where l_partkey % 50 <> 0",
    "context": """
        select cast(s_nationkey as string) as country_code, 1995 + 2 * (s_suppkey % 4) as year, 'employment_rate_15_64' as indicator, round(avg(s_acctbal) / 200, 2) as value
        from supplier group by s_nationkey, 1995 + 2 * (s_suppkey % 4)""",
}
SOURCES = ("nation", "orders", "customer", "part", "lineitem", "supplier")

#: The settings over the stand-ins, whose names and countries are others; two limits are, so that some rows exceed them.
SETTINGS = Settings(
    AS_OF, country="7", prefixes=(("blue%", None), ("old r%", "old ring%"), ("HOT g%", None)), compound=("%ring%", "%GIZMO%"), no_compound=("blue ring", "small ring", "new gizmo"), compound_letters=9,
    canonical=(Canonical("blue ring", ("old ring", "hot ring"), ("red rod", "Red Ring"), "hot%"), Canonical("red plate", ("old plate", "new plate"), ("hot rod",))), tool_category="PROMO", week_high=480_000, week_low=2_500,
)
