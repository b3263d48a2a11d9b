"""The data-quality audit and the reports' numbers, each a function of the job model's tables and the settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .measures import n, pct, quantile, ratio, rounded, skill_links, with_links
from .settings import Settings

Model = dict[str, DataFrame]
c = F.col


def active(m: Model) -> DataFrame:
    return m["jobs"].filter("is_active")


def audit_q01_text_coverage(m: Model, s: Settings) -> DataFrame:
    full, short = c("description_full").isNotNull(), c("description_short").isNotNull()
    out = active(m).groupBy("country_code").agg(
        n().alias("total"), n(full).alias("with_full"), n(~full).alias("without_full"), n(short).alias("with_short"), pct(n(full)).alias("pct_full"), pct(n(~full & ~short)).alias("pct_no_text")
    )
    return out.orderBy("pct_full", "country_code")


def audit_q02_skill_coverage(m: Model, s: Settings) -> DataFrame:
    some, links = F.count("links"), F.coalesce(F.sum("links"), F.lit(0))
    out = with_links(active(m), m["job_skills"]).groupBy("country_code").agg(
        n().alias("total"), some.alias("with_skills"), (n() - some).alias("without_skills"), pct(some).alias("pct_with_skills"), ratio(links, some, 2).alias("avg_with_skills"), ratio(links, n(), 2).alias("avg_all")
    )
    return out.orderBy("pct_with_skills", "country_code")


def audit_q06_skill_segments(m: Model, s: Settings) -> DataFrame:
    one = with_links(active(m), m["job_skills"]).agg(F.count("links").alias("some"), n().alias("whole"))
    parts = [("with skills", c("some")), ("without skills", c("whole") - c("some")), ("all active", c("whole"))]
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("segment"), v.alias("n")) for k, v in parts])))


def audit_q07_unused_skills(m: Model, s: Settings) -> DataFrame:
    return skill_links(m["skills"], m["job_skills"]).filter("links = 0").orderBy("name", "id")


def audit_q08a_prefix_variants(m: Model, s: Settings) -> DataFrame:
    hits = [c("name").ilike(yes) & ~c("name").ilike(no) if no else c("name").ilike(yes) for yes, no in s.prefixes]
    found = m["skills"].filter(reduce(lambda a, b: a | b, hits))
    return skill_links(found, m["job_skills"]).groupBy("name", "category").agg(F.sum("links").alias("jobs")).orderBy("name", "category")


def audit_q08b_first_token(m: Model, s: Settings) -> DataFrame:
    token = F.split_part(F.lower("name"), F.lit(" "), F.lit(1)).alias("token")
    out = m["skills"].groupBy(token).agg(F.count_distinct("name").alias("variants"), F.array_join(F.array_sort(F.collect_list("name")), " | ").alias("names"))
    return out.filter("variants > 1").orderBy(c("variants").desc(), "token")


def audit_q03_role_share(m: Model, s: Settings) -> DataFrame:
    other, none, known = c("role_category") == "other", c("role_category").isNull(), c("role_category") != "other"
    parts = {"other": other, "null": none, "classified": known}
    return active(m).agg(n().alias("total"), *[n(v).alias(f"n_{k}") for k, v in parts.items()], *[pct(n(v)).alias(f"pct_{k}") for k, v in parts.items()])


def _roles(jobs: DataFrame, by: list[str], label: str) -> DataFrame:
    out = jobs.groupBy(*by, "role_category").agg(n().alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*by))
    return out.select(*by, F.coalesce("role_category", F.lit(label)).alias("role"), "n", pct(c("n"), whole).alias("pct"))


def audit_q04_role_distribution(m: Model, s: Settings) -> DataFrame:
    return _roles(active(m), [], "(null)").orderBy(c("n").desc(), "role")


def audit_q14_role_by_country(m: Model, s: Settings) -> DataFrame:
    return _roles(active(m), ["country_code"], "(null)").orderBy("country_code", c("n").desc(), "role")


def audit_q05_salary_coverage(m: Model, s: Settings) -> DataFrame:
    paid, guess = c("salary_mid").isNotNull(), c("salary_is_predicted")
    out = active(m).groupBy("country_code").agg(
        n().alias("total"), n(paid).alias("with_pay"), pct(n(paid)).alias("pct_pay"), n(paid & ~guess).alias("declared"), n(paid & guess).alias("predicted"),
        n(c("salary_min").isNull() & c("salary_max").isNull()).alias("no_pay"),
    )
    return out.orderBy("pct_pay", "country_code")


def _country_pay(m: Model, s: Settings) -> DataFrame:
    return active(m).filter((c("country_code") == s.country) & c("salary_mid").isNotNull())


def audit_q09_country_pay(m: Model, s: Settings) -> DataFrame:
    guess = c("salary_is_predicted")
    return _country_pay(m, s).agg(
        n(~guess).alias("declared"), n(guess).alias("predicted"), quantile("salary_mid", 0.5, ~guess).alias("median_declared"), rounded(F.avg(F.when(~guess, c("salary_mid")))).alias("mean_declared"),
        quantile("salary_mid", 0.5).alias("median_all"),
    )


def audit_q10_pay_quartiles(m: Model, s: Settings) -> DataFrame:
    told = ~c("salary_is_predicted")
    mid = F.when(told, c("salary_mid"))
    return _country_pay(m, s).groupBy("country_code").agg(
        n(told).alias("declared"), F.min(mid).alias("low"), *[quantile("salary_mid", p, told).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)], F.max(mid).alias("high")
    )


def audit_q15_pay_anomalies(m: Model, s: Settings) -> DataFrame:
    low, high, mid, guess = (c(x) for x in ("salary_min", "salary_max", "salary_mid", "salary_is_predicted"))
    kind = (
        F.when(low > high, "min > max").when((low < 0) | (high < 0), "negative").when((mid > s.high) & ~guess, "high, declared").when((mid > s.high) & guess, "high, predicted")
        .when((mid > 0) & (mid < s.low), "low").when((c("country_code") == s.country) & (mid > s.country_high) & ~guess, "high for the country")
    )
    out = active(m).withColumn("anomaly", kind).filter("anomaly is not null")
    return out.select("id", "title", "company", "country_code", "salary_min", "salary_max", "salary_mid", "salary_is_predicted", c("posted_at").cast("date").alias("day"), "anomaly").orderBy("country_code", mid.desc_nulls_last(), "id")


def audit_q11_text_length(m: Model, s: Settings) -> DataFrame:
    full = c("description_full").isNotNull()
    out = active(m).groupBy("country_code").agg(
        n().alias("total"), n(full).alias("with_full"), pct(n(full)).alias("pct_full"), rounded(F.avg(F.length("description_full"))).alias("mean_full"), rounded(F.avg(F.length("description_short"))).alias("mean_short")
    )
    return out.orderBy(c("pct_full").desc(), "country_code")


def audit_q12_coverage_rank(m: Model, s: Settings) -> DataFrame:
    some, links = F.count("links"), F.coalesce(F.sum("links"), F.lit(0))
    out = with_links(active(m), m["job_skills"]).groupBy("country_code").agg(n().alias("total"), some.alias("with_skills"), links.alias("links"), pct(some).alias("pct_with_skills"), ratio(links, some).alias("avg_with_skills"))
    return out.orderBy(c("pct_with_skills").desc(), "country_code")


def audit_q13_volume(m: Model, s: Settings) -> DataFrame:
    undated = c("posted_at").isNull()
    recent = [n(c("posted_at") >= s.since(days=d)).alias(f"last_{d}") for d in (7, 30, 90)]
    out = active(m).groupBy("country_code").agg(n().alias("active"), *recent, n(undated).alias("undated"), pct(n(undated)).alias("pct_undated"))
    named = out.join(m["countries"].select(c("code").alias("country_code"), c("name").alias("country_name")), "country_code")
    return named.select("country_code", "country_name", "active", "last_7", "last_30", "last_90", "undated", "pct_undated").orderBy(c("active").desc(), "country_code")


def health_h1_intake(m: Model, s: Settings) -> DataFrame:
    at, month, before = c("ingested_at"), s.since(days=30), s.since(days=60)
    out = m["jobs"].agg(n().alias("total"), n(at >= month).alias("last_30"), n((at >= before) & (at < month)).alias("previous_30"))
    return out.withColumn("growth_pct", F.when(c("previous_30") == 0, 0.0).otherwise(pct(c("last_30") - c("previous_30"), c("previous_30"))))


def health_h2_active(m: Model, s: Settings) -> DataFrame:
    return m["jobs"].agg(n(c("is_active")).alias("active"), n(~c("is_active")).alias("inactive"))


def health_h3_roles(m: Model, s: Settings) -> DataFrame:
    return m["jobs"].groupBy(F.coalesce("role_category", F.lit("null")).alias("role")).agg(n().alias("n")).orderBy(c("n").desc(), "role")


def health_h4_pay(m: Model, s: Settings) -> DataFrame:
    told = c("salary_mid").isNotNull() & ~c("salary_is_predicted")
    return m["jobs"].groupBy("country_code").agg(n().alias("total"), n(told).alias("declared"), pct(n(told)).alias("pct_declared"), quantile("salary_mid", 0.5, told).alias("median_declared")).orderBy("country_code")


def health_h5_links(m: Model, s: Settings) -> DataFrame:
    by_job = m["job_skills"].groupBy("job_id").agg(F.count("skill_id").alias("links"))
    out = by_job.agg(n().alias("jobs_with_skills"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    return out.withColumn("average", F.try_divide("links", "jobs_with_skills"))


def health_h6_top_skills(m: Model, s: Settings) -> DataFrame:
    by_name = skill_links(m["skills"], m["job_skills"]).filter("links > 0").groupBy("name").agg(F.sum("links").alias("n"))
    return by_name.orderBy(c("n").desc(), "name").limit(10)


def notify_n1_total(m: Model, s: Settings) -> DataFrame:
    return m["jobs"].agg(n().alias("total"))


def notify_n2_recent(m: Model, s: Settings) -> DataFrame:
    return m["jobs"].filter(c("ingested_at") >= s.since(hours=2)).groupBy("country_code").agg(n().alias("n")).orderBy(c("n").desc(), "country_code")


FRAMES = (
    audit_q01_text_coverage, audit_q02_skill_coverage, audit_q06_skill_segments, audit_q07_unused_skills, audit_q08a_prefix_variants, audit_q08b_first_token, audit_q03_role_share, audit_q04_role_distribution,
    audit_q14_role_by_country, audit_q05_salary_coverage, audit_q09_country_pay, audit_q10_pay_quartiles, audit_q15_pay_anomalies, audit_q11_text_length, audit_q12_coverage_rank, audit_q13_volume,
    health_h1_intake, health_h2_active, health_h3_roles, health_h4_pay, health_h5_links, health_h6_top_skills, notify_n1_total, notify_n2_recent,
)
