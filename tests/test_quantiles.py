"""Exact quantiles against percentile()."""

import random

import pytest
from pyspark.sql import functions as F

from harvestry.operators.quantiles import quantiles
from harvestry.plans import registry

AT = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("bins, few", [(1024, 50_000), (4, 3), (2, 1)])
def test_quantiles(spark, bins, few):
    r = random.Random(bins)
    rows = [("hot", float(r.choice([r.randint(0, 9), r.gauss(0, 1), 1e9 * r.random()]))) for _ in range(600)] + [(None, float(k % 7)) for k in range(50)] + [("one", 3.5), ("none", None), ("none", float("nan")), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: tuple(r)[1:] for r in quantiles(df, ["k"], "v", AT, bins, few).collect()}
    want = {r.k: tuple(r)[1:] for r in df.filter("not isnan(v)").groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in AT.items()]).collect()}
    assert set(got) == {"hot", None, "one", "same"} and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)
    assert quantiles(df.filter("false"), ["k"], "v", AT).count() == 0
    assert quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(df.filter("not isnan(v)").agg(F.percentile("v", 0.5)).first()[0])


def test_medians_of_the_pay_queries(spark):
    jobs = registry.model(spark, "/root/testdata/sf0.001")["jobs"].filter("is_active and salary_mid is not null and not salary_is_predicted")
    for keys in (["country_code"], ["country_code", "contract_type"], ["country_code", "role_category"]):
        got = {tuple(r) for r in quantiles(jobs, keys, "salary_mid", {"m": 0.5}, 8, 5).collect()}
        assert got == {tuple(r) for r in jobs.groupBy(*keys).agg(F.percentile("salary_mid", 0.5).alias("m")).collect()}
