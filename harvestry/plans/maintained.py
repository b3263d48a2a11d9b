"""The ten views as sums that loads change: a load's effect on a view is what its jobs add after it, less what they added before."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ids import settled
from ..operators.versions import Store, differing
from .measures import pct, rounded
from .pairs import skill_pairs

Model = dict[str, DataFrame]
c = F.col
WINDOW_DAYS = 90


@dataclass(frozen=True)
class View:
    """rows(model, as_of) are a view's contributions by dims, with sums that may be added and subtracted (n is one of them); finish(state, model) makes the view from their totals."""

    rows: Callable[[Model, Column], DataFrame]
    dims: tuple[str, ...]
    sums: tuple[str, ...]
    finish: Callable[[DataFrame, Model], DataFrame]

    def total(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.dims).agg(*[F.sum(s).alias(s) for s in self.sums])

    def state(self, m: Model, as_of: Column) -> DataFrame:
        return self.total(self.rows(m, as_of))

    def changed(self, state: DataFrame, before: Model, was: Column, after: Model, now: Column) -> DataFrame:
        """The state after a load, from the one before it and the changed jobs alone, as they were and as they are."""
        less = self.rows(before, was).withColumns({s: -c(s) for s in self.sums})
        columns = [*self.dims, *self.sums]
        return self.total(state.select(*columns).union(self.rows(after, now).select(*columns)).union(less.select(*columns))).filter("n <> 0")


def _active(m: Model, where: str = "true") -> DataFrame:
    return m["jobs"].filter("is_active").filter(where)


def _jobs(where: str, *dims: str | Column) -> Callable[[Model, Column], DataFrame]:
    return lambda m, as_of: _active(m, where).select(*dims, F.lit(1).cast("long").alias("n"))


def _recent(m: Model, as_of: Column) -> DataFrame:
    return _active(m).filter(c("posted_at") >= as_of - F.make_dt_interval(F.lit(WINDOW_DAYS)))


def _links(jobs: DataFrame, m: Model, *columns: str) -> DataFrame:
    return m["job_skills"].join(jobs.select(c("id").alias("job_id"), *columns), "job_id").withColumn("n", F.lit(1).cast("long"))


def _named(df: DataFrame, m: Model) -> DataFrame:
    """With country_name after country_code."""
    return df.join(m["countries"].select(c("code").alias("country_code"), c("name").alias("country_name")), "country_code")


def _with_skill(df: DataFrame, m: Model) -> DataFrame:
    return df.join(m["skills"].select(c("id").alias("skill_id"), c("name").alias("skill"), c("category").alias("skill_category")), "skill_id")


def _pay(m: Model, as_of: Column) -> DataFrame:
    one = F.lit(1).cast("long")
    some = lambda x: F.when(c(x).isNotNull(), 1).otherwise(0).cast("long")
    zero = lambda x: F.coalesce(c(x).cast("long"), F.lit(0))
    paid = _active(m, "salary_mid is not null and not salary_is_predicted")
    return paid.select("country_code", "contract_type", "salary_mid", one.alias("n"), zero("salary_min").alias("sum_min"), some("salary_min").alias("n_min"), zero("salary_max").alias("sum_max"), some("salary_max").alias("n_max"))


def _median() -> Column:
    return rounded(F.percentile("salary_mid", 0.5, c("n")))


def _mean() -> Column:
    return rounded(F.sum(c("salary_mid").cast("long") * c("n")) / F.sum("n"))


def _top_by_country(s: DataFrame, m: Model) -> DataFrame:
    keys = ["country_code", "country_name", "role_category", "skill", "skill_category"]
    out = _with_skill(_named(s, m), m).groupBy(*keys).agg(F.sum("n").alias("job_count"))
    share = pct(c("job_count"), F.sum("job_count").over(Window.partitionBy("country_code", "role_category")), 2)
    return out.withColumn("pct_of_segment_jobs", share).orderBy("country_code", "role_category", c("job_count").desc())


def _pay_by_country(s: DataFrame, m: Model) -> DataFrame:
    mean = lambda k: rounded(F.try_divide(F.sum(f"sum_{k}"), F.sum(f"n_{k}")))
    out = _named(s, m).groupBy("country_code", "country_name", "contract_type").agg(
        F.sum("n").alias("job_count"), mean("min").alias("avg_salary_min"), mean("max").alias("avg_salary_max"), _mean().alias("avg_salary_mid"), _median().alias("median_salary_eur")
    )
    return out.orderBy(c("median_salary_eur").desc_nulls_last())


def _remote(s: DataFrame, m: Model) -> DataFrame:
    out = _named(s, m).select("country_code", "country_name", c("n").alias("total_jobs"), c("n_remote").alias("remote_jobs"), pct(c("n_remote"), c("n"), 2).alias("remote_pct"))
    return out.orderBy(c("remote_pct").desc())


def _monthly(*keys: str) -> Callable[[DataFrame, Model], DataFrame]:
    return lambda s, m: _named(s, m).select("month", "country_code", "country_name", *keys, c("n").alias("job_count")).orderBy(c("month").desc(), *(["country_code"] if keys else []), c("job_count").desc())


def _pay_by_role(s: DataFrame, m: Model) -> DataFrame:
    out = _named(s, m).groupBy("country_code", "country_name", "role_category").agg(F.sum("n").alias("job_count"), _mean().alias("avg_salary_eur"), _median().alias("median_salary_eur"))
    return out.orderBy("country_code", c("median_salary_eur").desc_nulls_last())


def _top(s: DataFrame, m: Model) -> DataFrame:
    out = _with_skill(s, m).groupBy("skill", "skill_category").agg(F.sum("n").alias("job_count"))
    # The window has no key: it runs over one row a skill.
    return out.withColumn("pct_of_all_jobs", pct(c("job_count"), F.sum("job_count").over(Window.partitionBy()), 2)).orderBy(c("job_count").desc())


def _market(s: DataFrame, m: Model) -> DataFrame:
    rate = m["context"].filter("indicator = 'employment_rate_15_64'").select("country_code", c("year").alias("posted"), c("year").cast("int").alias("context_year"), c("value").alias("employment_rate"))
    s = _with_skill(_named(s, m), m).join(rate, ["country_code", "posted"], "left")
    out = s.groupBy("skill", c("skill_category").alias("category"), "country_code", "country_name", "employment_rate", "context_year").agg(F.sum("n").alias("demand"), rounded(F.try_divide(F.sum("sum_mid"), F.sum("n_mid"))).alias("avg_salary_eur"))
    return out.orderBy(c("demand").desc())


def _market_rows(m: Model, as_of: Column) -> DataFrame:
    mid = c("salary_mid")
    jobs = _active(m).withColumns({"posted": F.year("posted_at"), "sum_mid": F.coalesce(mid.cast("long"), F.lit(0)), "n_mid": F.when(mid.isNotNull(), 1).otherwise(0).cast("long")})
    return _links(jobs, m, "country_code", "posted", "sum_mid", "n_mid")


def _month() -> Column:
    return F.date_trunc("month", "posted_at").cast("date").alias("month")


def views() -> dict[str, View]:
    """The views by name."""
    remote = lambda m, as_of: _active(m, "remote is not null").select("country_code", F.lit(1).cast("long").alias("n"), c("remote").cast("long").alias("n_remote"))
    by_role = lambda m, as_of: _active(m, "role_category is not null and salary_mid is not null and not salary_is_predicted").select("country_code", "role_category", "salary_mid", F.lit(1).cast("long").alias("n"))
    pairs = lambda m, as_of: skill_pairs(_recent(m, as_of), m["job_skills"], m["skills"])
    pair_rows = lambda s, m: s.select("skill", "co_skill", "role_category", c("n").alias("co_count")).orderBy(c("co_count").desc())
    offers = lambda s, m: _named(s, m).select("country_code", "country_name", c("n").alias("total_jobs")).orderBy(c("total_jobs").desc())
    return {
        "v_top_skills_by_country": View(lambda m, as_of: _links(_recent(m, as_of), m, "country_code", "role_category"), ("country_code", "role_category", "skill_id"), ("n",), _top_by_country),
        "v_salary_stats_by_country": View(_pay, ("country_code", "contract_type", "salary_mid"), ("n", "sum_min", "n_min", "sum_max", "n_max"), _pay_by_country),
        "v_remote_pct_by_country": View(remote, ("country_code",), ("n", "n_remote"), _remote),
        "v_job_trends_monthly": View(_jobs("posted_at is not null", _month(), "country_code"), ("month", "country_code"), ("n",), _monthly()),
        "v_salary_by_role_country": View(by_role, ("country_code", "role_category", "salary_mid"), ("n",), _pay_by_role),
        "v_demand_by_role_monthly": View(_jobs("posted_at is not null and role_category is not null", _month(), "country_code", "role_category"), ("month", "country_code", "role_category"), ("n",), _monthly("role_category")),
        "v_skill_cooccurrence": View(pairs, ("skill", "co_skill", "role_category"), ("n",), pair_rows),
        "v_top_skills_global": View(lambda m, as_of: _links(_recent(m, as_of), m), ("skill_id",), ("n",), _top),
        "v_offers_by_country": View(_jobs("true", "country_code"), ("country_code",), ("n",), offers),
        "v_skills_with_market_context": View(_market_rows, ("skill_id", "country_code", "posted"), ("n", "sum_mid", "n_mid"), _market),
    }


def expired(jobs: DataFrame, was: Column, now: Column) -> DataFrame:
    """(id) of jobs that the window holds at one of the two times alone."""
    first, last = (F.least(was, now), F.greatest(was, now))
    days = F.make_dt_interval(F.lit(WINDOW_DAYS))
    return jobs.filter((c("posted_at") >= first - days) & (c("posted_at") < last - days)).select("id")


def affected(before: Model, after: Model, was: Column, now: Column) -> DataFrame:
    """(id) of jobs that differ, or whose links do, or that enter or leave the window, for tables at hand; a Store finds them by its changes()."""
    row = lambda df, side: df.select("id", F.struct(*sorted(df.columns)).alias(side))
    jobs = differing(row(before["jobs"], "before"), row(after["jobs"], "after"), ["id"]).select("id")
    link = lambda df, side: df.select("job_id", "skill_id", F.struct("skill_id").alias(side))
    links = differing(link(before["job_skills"], "before"), link(after["job_skills"], "after"), ["job_id", "skill_id"]).select("job_id")
    return jobs.union(links).union(expired(after["jobs"], was, now)).distinct()


def only(m: Model, ids: DataFrame) -> Model:
    """The model with the jobs of ids and their links alone."""
    return m | {"jobs": m["jobs"].join(ids, "id", "left_semi"), "job_skills": m["job_skills"].join(ids.select(c("id").alias("job_id")), "job_id", "left_semi")}


def maintain(store: Store, as_of: dt.datetime, key: str = "") -> str | None:
    """Bring the states of all views in the store (tables view_<name>) up to its current version, as one publication.

    What they were computed for is noted with them. From there on only jobs that changed since, and those that time
    moved across the window's edge, are read, as they were and as they are; where that version is gone, or there are no
    states, all is read. Names of skills never change, and categories and countries are joined in finish(). A crash
    leaves the states before, with their note. None if nothing is to be done.
    """
    version, note = store.version(), store.manifest()[""].get("views")
    kept = bool(note) and note["of"] in store.versions()
    of = store.manifest(note["of"]) if kept else {}
    if kept and note["as_of"] == as_of.isoformat() and all(of.get(t) == store.manifest().get(t) for t in ("jobs", "job_skills", "skills")):
        return None
    now = F.lit(as_of)
    full = lambda v: {t: store.read(t, v) for t in ("jobs", "job_skills", "skills")}
    found = views()
    if not kept:
        states = {k: v.state(full(version), now) for k, v in found.items()}
    else:
        was, old = F.lit(dt.datetime.fromisoformat(note["as_of"])), note["of"]
        jobs, links = (store.changes(t, old, version).select(k) for t, k in (("jobs", "id"), ("job_skills", "job_id")))
        ids = settled(jobs.union(links).union(expired(full(version)["jobs"], was, now)).distinct())
        part = lambda v: full(v) | {"jobs": store.lookup("jobs", ids, v), "job_skills": store.lookup("job_skills", ids.select(c("id").alias("job_id")), v)}
        states = {k: v.changed(store.read(f"view_{k}"), part(old), was, part(version), now) for k, v in found.items()}
    return store.publish({f"view_{k}": s for k, s in states.items()}, key, {"views": {"of": version, "as_of": as_of.isoformat()}})


def read_view(store: Store, name: str, countries: DataFrame, context: DataFrame) -> DataFrame:
    """A view from its state in the store."""
    return views()[name].finish(store.read(f"view_{name}"), {"skills": store.read("skills"), "countries": countries, "context": context})
