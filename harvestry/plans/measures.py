"""Aggregates that the plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n(where: Column | None = None) -> Column:
    """Rows, or those that meet a condition."""
    return F.count("*") if where is None else F.count_if(where)


def ratio(part: Column, whole: Column, digits: int = 1) -> Column:
    """part / whole, in decimals so that halves round up; null where whole is 0."""
    return F.round(F.try_divide(part.cast("decimal(20,0)"), whole), digits).cast("double")


def pct(part: Column, whole: Column | None = None, digits: int = 1) -> Column:
    """part of whole (all rows, if not given) in hundredths."""
    return ratio(part * 100, F.count("*") if whole is None else whole, digits)


def rounded(x: Column) -> Column:
    return F.round(x, 0).cast("double")


def quantile(x: str, p: float, where: Column | None = None) -> Column:
    """The exact, interpolated quantile of x, among the rows that meet where if it is given."""
    return rounded(F.percentile(F.col(x) if where is None else F.when(where, F.col(x)), p))


def links_by_job(job_skills: DataFrame) -> DataFrame:
    """(job_id, links)."""
    return job_skills.groupBy("job_id").agg(F.count("skill_id").alias("links"))


def with_links(jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    """jobs with their links counted, null where there is none. Links are counted before the join, which then has a row a job."""
    return jobs.join(links_by_job(job_skills), jobs.id == F.col("job_id"), "left").drop("job_id")


def skill_links(skills: DataFrame, job_skills: DataFrame) -> DataFrame:
    """skills with links, 0 where there is none, counted before the join."""
    counted = job_skills.groupBy("skill_id").agg(F.count("job_id").alias("links"))
    return skills.join(counted, skills.id == F.col("skill_id"), "left").select(*[skills[c] for c in skills.columns], F.coalesce("links", F.lit(0)).alias("links"))
