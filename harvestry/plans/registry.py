"""All SQL plans by name: as DataFrames over the job model, and as SQL for the checking engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, diagnostics
from .diagnostics import CANONICALISATION, MAINTENANCE
from .dialect import DUCK, SPARK, render
from .oracle import ORACLE
from .maintained import affected, only, views
from .settings import Settings
from .standins import AS_OF, SETTINGS, SOURCES, TABLES
from .views import VIEWS

#: The time of the state before the loads in after_loads().
EARLIER = "2001-07-02 00:00:00"
#: Plans that are one text in both dialects.
PLANS: dict[str, str] = VIEWS | CANONICALISATION | MAINTENANCE
#: Plans of the tables and the settings; what checks them is written apart, in oracle.py.
FRAMES: dict[str, Callable[[dict[str, DataFrame], Settings], DataFrame]] = {f.__name__: f for f in (*audit.FRAMES, *diagnostics.FRAMES)}


def model(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The job model's tables over a directory of the given tables."""
    raw = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES}
    out = {}
    for name, query in TABLES.items():
        used = [t for t in SOURCES if re.search(rf"\b{t}\b", query)]
        for t in used:
            query = re.sub(rf"\b{t}\b", f"{{{t}}}", query)
        out[name] = spark.sql(query, **{t: raw[t] for t in used})
    return out


def plan(name: str, tables: dict[str, DataFrame], as_of: str = AS_OF) -> DataFrame:
    """A plan over any tables of the job model."""
    query = render(PLANS[name], SPARK, as_of)
    used = {t: df for t, df in tables.items() if f"{{{t}}}" in query}
    return next(iter(tables.values())).sparkSession.sql(query, **used)


def earlier(m: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The model as it was some loads before: jobs lack, have other values or are active still, and links lack or are others."""
    i = F.col("id")
    jobs = m["jobs"].filter(i % 5 != 0).withColumns({
        "role_category": F.when(i % 7 == 0, F.lit("2-HIGH")).otherwise(F.col("role_category")), "remote": F.when(i % 11 == 0, i % 2 == 0).otherwise(F.col("remote")),
        "is_active": F.col("is_active") | (i % 13 == 0), "salary_mid": F.when(i % 17 == 0, F.col("salary_mid") + 1000).otherwise(F.col("salary_mid")),
    })
    kept = m["job_skills"].filter((F.col("job_id") % 3 != 0) | (F.col("skill_id") % 4 != 0))
    more = m["job_skills"].filter(F.col("job_id") % 6 == 1).select("job_id", (F.col("skill_id") % 40 + 1).cast("long").alias("skill_id"))
    return m | {"jobs": jobs, "job_skills": kept.union(more).distinct()}


def after_loads(name: str, m: dict[str, DataFrame]) -> DataFrame:
    """A view from the state before the loads and the jobs that they changed."""
    view, was, now = views()[name], F.lit(EARLIER).cast("timestamp_ntz"), F.lit(AS_OF).cast("timestamp_ntz")
    before = earlier(m)
    ids = affected(before, m, was, now)
    return view.finish(view.changed(view.state(before, was), only(before, ids), was, only(m, ids), now), m)


def cooccurrence(m: dict[str, DataFrame], s: Settings) -> DataFrame:
    view = views()["v_skill_cooccurrence"]
    return view.finish(view.rows(m, s.now), m)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    texts = {name: lambda spark, sf_dir, name=name: plan(name, model(spark, sf_dir)) for name in PLANS}
    frames = {name: lambda spark, sf_dir, f=f: f(model(spark, sf_dir), SETTINGS) for name, f in (FRAMES | {"v_skill_cooccurrence": cooccurrence}).items()}
    return texts | frames | {f"after_loads_{name}": lambda spark, sf_dir, name=name: after_loads(name, model(spark, sf_dir)) for name in VIEWS}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, query in {k: render(q, DUCK, AS_OF) for k, q in (PLANS | ORACLE).items()}.items():
        used = [t for t in TABLES if f"{{{t}}}" in query]
        text = query
        for t in used:
            text = text.replace(f"{{{t}}}", f"m_{t}")
        head = ", ".join(f"m_{t} as ({TABLES[t]})" for t in used)
        text = text.strip()
        out[name] = f"with {head}, {text[5:]}" if text.startswith("with ") else f"with {head} {text}"
    return out | {f"after_loads_{name}": out[name] for name in VIEWS}
