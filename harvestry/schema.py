"""Tables of the job model, their seeds and their constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTRIES = "code string not null, name string not null, currency string not null, endpoint string not null"
JOBS = (
    "id bigint not null, source string not null, title string not null, company string, location_display string, city string, country_code string not null, role_category string, "
    "salary_min int, salary_max int, salary_mid int, salary_is_predicted boolean not null, contract_type string, contract_time string, remote boolean, description_short string, description_full string, "
    "url string, is_active boolean, first_seen_at timestamp, last_seen_at timestamp, posted_at timestamp, ingested_at timestamp"
)
SKILLS = "id bigint not null, name string not null, category string"
JOB_SKILLS = "job_id bigint not null, skill_id bigint not null"
CONTEXT = "country_code string not null, year smallint not null, indicator string not null, value decimal(5,2)"
LEDGER = "job_id bigint, input_hash string, model string, text_source string, reviewed_at string, status string, role_category_before string, role_category_after string, skills_before_count int, skills_added int, error string"
RAW_ADVERT = (
    "id string, title string, description string, created string, redirect_url string, salary_is_predicted string, salary_min double, salary_max double, contract_type string, contract_time string, "
    "company struct<display_name:string>, location struct<display_name:string,area:array<string>>"
)
#: The countries that the model is seeded with, and the names of roles and skill kinds.
SEED = [("fr", "France"), ("es", "Spain"), ("nl", "Netherlands"), ("pl", "Poland"), ("de", "Germany"), ("it", "Italy"), ("at", "Austria"), ("be", "Belgium")]
ROLES = ["management", "ai_ml", "data_science", "data_engineering", "data_analyst", "mobile", "security", "qa_testing", "sysadmin", "erp_sap", "devops", "cloud", "fullstack", "frontend", "backend", "other"]
SKILL_KINDS = ["language", "framework", "cloud", "database", "tool", "methodology", "soft"]


def seed_countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, "EUR", c) for c, n in SEED], COUNTRIES)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(ddl))


def violations(jobs: DataFrame, countries: DataFrame, skills: DataFrame, links: DataFrame) -> DataFrame:
    """(rule, n): rows that break each constraint; what should be run before a publication."""
    c = F.col
    rules = {
        "title": c("title").isNull(), "country": c("country_code").isNull(), "role": c("role_category").isNotNull() & ~c("role_category").isin(ROLES), "pay_order": c("salary_max") < c("salary_min"),
        "pay_sign": (c("salary_min") < 0) | (c("salary_max") < 0), "contract_type": ~c("contract_type").isin("permanent", "contract"), "contract_time": ~c("contract_time").isin("full_time", "part_time"),
    }
    one = jobs.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c(k).alias("n")) for k in rules])).alias("x")).select("x.*")
    count = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    keys = [("job_key", jobs, ["id"]), ("skill_key", skills, ["name"]), ("link_key", links, ["job_id", "skill_id"])]
    for rule, df, key in keys:
        out = out.union(count(df.groupBy(*key).count().filter("count > 1"), rule))
    out = out.union(count(jobs.join(countries, jobs.country_code == countries.code, "left_anti"), "job_country"))
    out = out.union(count(links.join(jobs, links.job_id == jobs.id, "left_anti"), "link_job"))
    return out.union(count(links.join(skills, links.skill_id == skills.id, "left_anti"), "link_skill"))
