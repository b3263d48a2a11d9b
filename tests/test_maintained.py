"""Views after loads against the plans over whole tables, pairs against brute force, and the packs' rules on rows written by hand."""

import datetime as dt
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from harvestry.operators import store
from harvestry.operators.versions import Merge, Store
from harvestry.plans import audit, diagnostics, registry
from harvestry.plans.maintained import maintain, read_view, views
from harvestry.plans.pairs import skill_pairs
from harvestry.plans.settings import Settings
from harvestry.plans.standins import AS_OF

DATA = "/root/testdata/sf0.001"
NOW = dt.datetime(2026, 6, 22)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_views_follow_three_loads(spark, tmp_path):
    m = registry.model(spark, DATA)
    model = m | {"jobs": m["jobs"].filter("id % 8 < 4 and id < 2000 or id > 5500"), "job_skills": m["job_skills"].filter("skill_id < 40")}
    s = Store(spark, str(tmp_path / "s"), keep=4, rows_per_file=100)
    first = model["jobs"].filter("id % 3 <> 0")
    s.publish({"jobs": first, "job_skills": model["job_skills"].filter("job_id % 5 <> 0"), "skills": model["skills"]})
    as_of = dt.datetime.fromisoformat(AS_OF)
    assert maintain(s, as_of - dt.timedelta(60)) and maintain(s, as_of - dt.timedelta(60)) is None
    loads = [
        (model["jobs"].filter("id % 3 = 0 and id < 1000"), model["job_skills"].filter("job_id % 10 = 0"), 40),
        (model["jobs"].filter("id % 7 = 0").withColumns({"role_category": F.lit("x"), "salary_mid": F.lit(5), "is_active": F.col("id") % 2 == 0, "posted_at": F.col("posted_at") + F.expr("interval 9 day")}), model["job_skills"].filter("job_id % 5 = 0"), 0),
        (model["jobs"].filter("id > 5800").withColumn("country_code", F.lit("7")), model["job_skills"].filter("false"), 10),  # time goes back too
    ]
    for change, links, days in loads:
        add = lambda held, links=links: store.insert_ignore(held, links, held.columns)
        put = lambda held, change=change: store.upsert_by_key(held, change, ["id"])
        s.publish({"jobs": Merge(change.select("id"), put), "job_skills": Merge(links.select("job_id"), add)})
        now = as_of - dt.timedelta(days)
        assert maintain(s, now)
        held = model | {t: s.read(t) for t in ("jobs", "job_skills")}
        for name in ("v_salary_stats_by_country", "v_skill_cooccurrence", "v_top_skills_by_country", "v_remote_pct_by_country", "v_skills_with_market_context", "v_demand_by_role_monthly"):
            whole = registry.plan(name, held, now.isoformat(sep=" "))
            assert rows(read_view(s, name, m["countries"], m["context"]).select(*whole.columns)) == rows(whole), (name, days)
    for name in views():  # the others once
        whole = registry.plan(name, held, now.isoformat(sep=" "))
        assert rows(read_view(s, name, m["countries"], m["context"]).select(*whole.columns)) == rows(whole), name


@pytest.mark.parametrize("block, many", [(64, 8), (3, 2)])
def test_pairs(spark, block, many):
    jobs = spark.createDataFrame([(k, "ab"[k % 2] if k % 5 else None) for k in range(40)], "id long, role_category string")
    skills = [(k, f"s{k if k % 7 else k // 2}") for k in range(60)]  # some names twice
    links = {(j, (j * 7 + k * k) % 60) for j in range(40) for k in range(j)}
    names, role = dict(skills), {r.id: r.role_category for r in jobs.collect()}
    want = Counter()
    for j in range(40):
        mine = sorted(s for i, s in links if i == j)
        want.update({(names[a], names[b], role[j]) for a, b in combinations(mine, 2)})
    got = skill_pairs(jobs, spark.createDataFrame(sorted(links), "job_id long, skill_id long"), spark.createDataFrame(skills, "id long, name string"), block, many)
    assert {(r.skill, r.co_skill, r.role_category): r.n for r in got.collect()} == dict(want)


def test_pairs_of_a_job_with_thousands_of_skills(spark):
    skills = spark.range(3000).select("id", F.col("id").cast("string").alias("name"))
    pairs = skill_pairs(spark.createDataFrame([(1, "a")], "id long, role_category string"), skills.select(F.lit(1).cast("long").alias("job_id"), F.col("id").alias("skill_id")), skills)
    assert pairs.count() == 3000 * 2999 // 2


@pytest.fixture(scope="module")
def market(spark):
    day = lambda n: NOW - dt.timedelta(n)
    at = "id long, title string, company string, country_code string, role_category string, salary_min int, salary_max int, salary_mid int, salary_is_predicted boolean, description_short string, description_full string, is_active boolean, posted_at timestamp_ntz, ingested_at timestamp_ntz"
    jobs = [
        (1, "Dev", "A", "pl", "other", 10, 30, 20_000, False, "s", "full", True, day(3), day(1)), (2, "Dev", "A", "pl", "other", 50, 40, 250_000, False, None, None, True, day(20), day(3)),
        (3, "Dev", "B", "de", "other", None, None, None, False, "s", None, True, None, day(30)), (4, "Dev", "B", "pl", None, -5, 10, 900, True, None, "x", True, day(40), day(2)),
        (5, "Ops", "B", "pl", "devops", 1, 2, 600_000, True, "s", "xy", True, day(100), day(9)), (6, "Ops", "C", "pl", "devops", 1, 2, 30_000, False, "s", "xyz", False, day(1), day(0)),
        (7, "Dev", "C", "pl", "cloud", 1, 2, 40_000, False, "s", None, True, day(5), NOW - dt.timedelta(hours=1)),
    ]
    skills = [(1, "React", "framework"), (2, "reactjs", "tool"), (3, "React JS", "tool"), (4, "NodeJS", "tool"), (5, "Angular / React / Javascript", "tool"), (6, "Java", "language"), (7, "JavaScript", "language"), (8, "node", "tool")]
    links = [(1, 1), (1, 2), (1, 3), (2, 2), (2, 4), (6, 4), (6, 6), (6, 7), (4, 5), (7, 8), (1, 8)]
    return {
        "jobs": spark.createDataFrame(jobs, at), "skills": spark.createDataFrame(skills, "id long, name string, category string"), "job_skills": spark.createDataFrame(links, "job_id long, skill_id long"),
        "countries": spark.createDataFrame([("pl", "Poland"), ("de", "Germany")], "code string, name string"),
    }


WANT = {
    "audit_q01_text_coverage": [("de", 1, 0, 1, 1, 0.0, 0.0), ("pl", 5, 3, 2, 3, 60.0, 20.0)],
    "audit_q02_skill_coverage": [("de", 1, 0, 1, 0.0, None, 0.0), ("pl", 5, 4, 1, 80.0, 2.0, 1.6)],
    "audit_q06_skill_segments": [("with skills", 4), ("without skills", 2), ("all active", 6)],
    "audit_q08a_prefix_variants": [("Java", "language", 1), ("React", "framework", 1), ("React JS", "tool", 1), ("reactjs", "tool", 2)],
    "audit_q09_country_pay": [(3, 2, 40000.0, 103333.0, 40000.0)],
    "audit_q10_pay_quartiles": [("pl", 3, 20000, 30000.0, 40000.0, 145000.0, 250000)],
    "audit_q15_pay_anomalies": [(5, "high, predicted"), (2, "min > max"), (4, "negative")],
    "audit_q11_text_length": [("pl", 5, 3, 60.0, 2.0, 1.0), ("de", 1, 0, 0.0, None, 1.0)],
    "audit_q13_volume": [("pl", "Poland", 5, 2, 3, 4, 0, 0.0), ("de", "Germany", 1, 0, 0, 0, 1, 100.0)],
    "health_h3_roles": [("other", 3), ("devops", 2), ("cloud", 1), ("null", 1)],
    "notify_n2_recent": [("pl", 2)],
    "diag_d0_summary": [(6, 4, 50.0, 16.7, 1.8, 40000.0)],
    "diag_d1a_roles": [("other", 3, 50.0), ("NULL", 1, 16.7), ("cloud", 1, 16.7), ("devops", 1, 16.7)],
    "diag_d1c_other_titles": [("Dev", "pl", 2)],
    "diag_d2a_recent_vs_history": [("history", 5, 11, 2.2, 3), ("recent", 5, 11, 2.2, 3)],
    "diag_d3a_null_roles": [(4, "Dev", "B", "pl", dt.date(2026, 5, 13))],
    "diag_d4a_pay_range": [("pl", 3, 20000, 40000.0, 250000)],
    "diag_d4b_pay_anomalies": [(2, "min > max"), (4, "negative"), (5, "high")],
    "diag_d5b_undated": [("pl", 0, 4, 0.0)],
    "diag_d5c_counts": [(8, 11, 6, 6)],
    "canon_a3_compounds": [(5, "Angular / React / Javascript", "tool", 1)],
    "canon_a4_affected": [(1, "Dev", "reactjs", 2), (2, "Dev", "reactjs", 2)],
    "canon_a5_affected": [(1, "Dev", "node", 8), (2, "Dev", "NodeJS", 4), (6, "Ops", "NodeJS", 4), (7, "Dev", "node", 8)],
    "canon_c_examples": [(3, "React JS", "tool", 1, "Dev"), (5, "Angular / React / Javascript", "tool", 1, "Dev")],
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_rules_with_the_job_markets_settings(market, name):
    got = getattr(audit, name, None) or getattr(diagnostics, name)
    df = got(market, Settings(NOW.isoformat(sep=" ")))
    if "anomaly" in df.columns:
        df = df.select("id", "anomaly")
    found = [tuple(r) for r in df.collect()]
    assert (sorted(found) if name.startswith(("diag_d2a", "diag_d4b")) else found) == WANT[name]
