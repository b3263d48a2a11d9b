"""The store: what a load rewrites, lookups and pages by ranges, changes between versions."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from harvestry.operators import store
from harvestry.operators.ids import numbered
from harvestry.operators.versions import Merge, Store
from harvestry.streaming import ingest

DAY = dt.datetime(2026, 1, 10)


def table(spark, ids, word="a"):
    return spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("id")).withColumn("word", F.lit(word))


def files(root):
    return {p: p.stat().st_size for p in Path(root).rglob("*.parquet") if not p.name.startswith(".")}


def test_a_load_rewrites_what_it_touches(spark, tmp_path):
    root = str(tmp_path / "s")
    s = Store(spark, root, rows_per_file=1000)
    s.publish({"jobs": spark.range(0, 200_000, 2).withColumn("word", F.sha2(F.col("id").cast("string"), 256)), "skills": spark.range(10).withColumn("name", F.col("id").cast("string"))})
    before = files(root)
    assert len(before) >= 100
    change = spark.range(50_000, 51_000).withColumn("word", F.lit("new"))  # 1000 ids, half of them new
    s.publish({"jobs": Merge(change.select("id"), lambda held: store.upsert_by_key(held, change, ["id"]))}, "load")
    wrote = {p: n for p, n in files(root).items() if p not in before}
    assert sum(wrote.values()) < 0.03 * sum(before.values()) and len(wrote) <= 4
    now = s.read("jobs")
    assert now.count() == 100_500 and now.filter("word = 'new'").count() == 1000 and s.read("skills").count() == 10
    found = sorted((f.low, f.high) for f in s.manifest()["jobs"][1])
    assert all(a[1] < b[0] for a, b in zip(found, found[1:])) and max(f.rows for f in s.manifest()["jobs"][1]) <= 1200
    assert sorted(r.id for r in s.lookup("jobs", table(spark, [50_001, 7, 3, 199_998]).select("id")).collect()) == [50_001, 199_998]
    paths = s.lookup("jobs", table(spark, [50_001]).select("id")).inputFiles()
    assert len(paths) == 1


def test_changes_between_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), rows_per_file=10)
    one = s.publish({"jobs": spark.range(100).withColumn("word", F.lit("a")), "job_skills": spark.createDataFrame([(1, 2), (1, 3), (9, 2)], "job_id long, skill_id long")})
    new = table(spark, [5, 200], "b")
    two = s.publish({"jobs": Merge(new.select("id").union(table(spark, [42]).select("id")), lambda held: store.upsert_by_key(held, new, ["id"]).filter("id <> 42"))})
    got = {r.id: (r.before and r.before.word, r.after and r.after.word) for r in s.changes("jobs", one).collect()}
    assert got == {5: ("a", "b"), 200: (None, "b"), 42: ("a", None)}
    assert s.changes("jobs", two).count() == 0 and s.changes("job_skills", one).count() == 0
    more = spark.createDataFrame([(1, 3), (1, 4)], "job_id long, skill_id long")
    s.publish({"job_skills": Merge(more.select("job_id"), lambda held: store.insert_ignore(held, more, held.columns))})
    assert [(r.job_id, r.skill_id, r.before) for r in s.changes("job_skills", two).collect()] == [(1, 4, None)]


def test_pages(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), rows_per_file=50)
    s.publish({"jobs": spark.range(0, 3000, 3).withColumn("word", F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).repartition(5)})
    seen, after = [], -1
    while page := [r.id for r in s.page("jobs", after, 70).collect()]:
        seen += page
        after = page[-1]
    assert seen == list(range(0, 3000, 3))
    page = s.page("jobs", 300, 10)
    assert len(page.inputFiles()) <= 2 and [r.id for r in page.collect()] == list(range(303, 333, 3))
    assert [r.id for r in s.page("jobs", 2000, 400, F.col("word") == "even").collect()] == [i for i in range(2001, 3000, 3) if i % 2 == 0]
    assert s.page("jobs", 2997, 5).count() == 0 and s.page("none", 0, 5) is None


def test_two_publishers(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    a.publish({"jobs": table(spark, [1])})
    late = Merge(table(spark, [1]).select("id"), lambda held: (b.publish({"jobs": table(spark, [2])}), held)[1])  # another one is faster
    with pytest.raises(OSError, match="there already"):
        a.publish({"jobs": late})
    assert [r.id for r in a.read("jobs").collect()] == [2]


def test_three_loads(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), rows_per_file=4)
    batch = lambda ids, title: spark.createDataFrame([(i, title, "de", False, dt.datetime(2026, 1, 1) if i != 3 else dt.datetime(2025, 1, 1)) for i in ids], "id bigint, title string, country_code string, salary_is_predicted boolean, posted_at timestamp").withColumn("source", F.lit("feed"))
    links = lambda *pairs: spark.createDataFrame(pairs, "job_id long, skill_id long")
    for n, (ids, title) in enumerate([(range(1, 9), "one"), ([4, 20], "two"), ([3, 21], "three")]):
        ingest.load(s, spark, batch(ids, title), links((ids[0], 1), (ids[-1], n)), F.lit(DAY + dt.timedelta(n)), f"b{n}")
    rows = {r.id: (r.title, r.is_active, r.first_seen_at.day, r.last_seen_at.day) for r in s.read("jobs").collect()}
    assert rows[4] == ("two", True, 10, 11) and rows[3] == ("three", False, 10, 12) and rows[20] == ("two", True, 11, 11) and len(rows) == 10
    assert sorted(map(tuple, s.read("job_skills").collect())) == [(1, 1), (3, 1), (4, 1), (8, 0), (20, 1), (21, 2)]
    ingest.load(s, spark, batch([30], "four"), now=F.lit(dt.datetime(2026, 6, 1)))
    assert s.read("jobs").filter("is_active").count() == 0


def test_numbers_without_gaps(spark):
    names = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("name")).repartition(7)
    got = sorted((r.id, r.name) for r in numbered(names, "name", 11).collect())
    assert [g[0] for g in got] == list(range(11, 5011)) and [g[1] for g in got] == sorted(g[1] for g in got)
    assert numbered(names.filter("false"), "name").count() == 0
