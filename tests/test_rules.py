import datetime as dt

import pytest
from pyspark.sql import functions as F

from harvestry import report
from harvestry.functions import pay, text
from harvestry.functions.roles import canonical_skill, role, skills, skills_native
from harvestry.operators import enrich, jobs, store
from harvestry.schema import JOBS, LEDGER, RAW_ADVERT, empty, seed_countries
from harvestry.sources import adverts, cube, pages
from harvestry.streaming import ingest


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", type(None): "string", list: "array<string>", bool: "boolean"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("country", "low", "high", "want"), [
    ("pl", 80000, 120000, (18736, 28104)), ("pl", 1800, 1800, (92743, 92743)), ("pl", 1500, 2000, (77286, 103048)), ("de", 70000, 90000, (70000, 90000)), ("pl", 500000, 1600000, (None, None)),
    ("pl", 4999, 4999, (257568, 257568)), ("pl", 5000, 5000, (5000, 5000)), ("pl", 19999, 19999, (19999, 19999)), ("pl", 20000, 20000, (4684, 4684)), ("pl", 1500000, 1500000, (351300, 351300)),
])
def test_pay(spark, country, low, high, want):
    a, b = pay.euros(F.col("c"), F.col("a"), F.col("b"))
    assert tuple(one(spark, F.struct(a.alias("a"), b.alias("b")), c=country, a=low, b=high)) == want


def test_middle_rounds_half_to_even(spark):
    assert one(spark, pay.middle(F.col("a"), F.col("b")), a=2, b=3) == 2
    assert one(spark, pay.middle(F.col("a"), F.col("b")), a=3, b=4) == 4


@pytest.mark.parametrize(("title", "body", "want"), [("ML Engineer", None, "ai_ml"), ("Product Manager", None, "management"), ("Werkstudent Java Developer", None, None), ("Specialist", "We need a data engineer with ETL experience", "data_engineering"), (None, "x", None), ("Florist", "", "other")])
def test_role(spark, title, body, want):
    assert one(spark, role(F.col("t"), F.col("d")), t=title, d=body) == want


@pytest.mark.parametrize("f", [skills, skills_native])
def test_longest_skill_wins(spark, f):
    got = {s["skill"] for s in one(spark, f(F.col("t")), t="Experience with GitHub Actions for CI/CD pipelines required. Python, PYTHON, python")}
    assert "GitHub Actions" in got and "GitHub" not in got and "Python" in got


def test_text_rules(spark):
    assert one(spark, text.normal(F.col("t")), t="  a \x1c b  ") == "a b"
    assert one(spark, text.normal(F.col("t")), t=" \t") is None
    assert one(spark, text.clean_lines(F.col("t")), t="A long enough line\r\nshort\na LONG  enough line\nAnother long enough line") == "A long enough line Another long enough line"
    assert one(spark, text.remote(F.col("t")), t="Home Office, vor Ort") is True
    assert one(spark, text.remote(F.col("t")), t="arbeit vor  Ort") is False
    assert one(spark, text.remote(F.col("t")), t="hybrid") is None
    assert one(spark, text.contract_type(F.col("t")), t="Indefinido") == "permanent"
    assert one(spark, text.contract_time(F.col("t")), t="Media Jornada") == "part_time"
    h = one(spark, text.content_hash(F.col("a"), F.lit("full"), F.lit("m"), F.lit(None)), a="x")
    assert len(h) == 16
    assert one(spark, text.first_object(F.col("t"), "a int")["a"], t='so: {"a": 3} done') == 3
    assert tuple(one(spark, canonical_skill(F.col("t")), t=" golang dev ")) == ("Go", "language")
    assert one(spark, canonical_skill(F.col("t")), t="a very long phrase of many words") is None


def test_flatten_validate_derive(spark):
    raw = spark.createDataFrame([("1", " Java  Developer ", "A text that is long enough", "2026-01-02T03:04:05Z", None, "1", 80000.0, 120000.0, "permanent", None, ("A",), ("W", ["PL", "W"])), ("1", "Twice", None, "2026-01-03T00:00:00Z", None, "0", None, None, None, None, None, None), ("x", "bad", *[None] * 10), ("3", " ", *[None] * 10)], RAW_ADVERT)
    flat = jobs.flatten(raw.withColumn("country_code", F.lit("pl")))
    good, bad = jobs.validate(flat, ["pl"])
    assert [(r.id, r.title, r.city, r.salary_min) for r in good.collect()] == [(1, "Java Developer", "W", 18736)]
    assert sorted(r.reason for r in bad.collect()) == ["duplicate", "id", "title"]
    out, links = jobs.derive(good)
    assert out.first().salary_mid == 23420 and out.first().role_category == "backend" and [r.skill_name for r in links.collect()] == ["Java"]


def test_upsert_is_idempotent_and_published_atomically(spark, tmp_path):
    old = empty(spark, JOBS)
    row = {"id": 1, "source": "feed", "title": "t", "country_code": "de", "salary_is_predicted": False, "role_category": "backend", "posted_at": dt.datetime(2026, 1, 1)}
    new = spark.createDataFrame([row], "id bigint, source string, title string, country_code string, salary_is_predicted boolean, role_category string, posted_at timestamp")
    day = lambda n: F.lit(dt.datetime(2026, 1, n))
    a = store.upsert_jobs(old, new, day(2))
    b = store.upsert_jobs(a, new.withColumn("role_category", F.lit(None).cast("string")), day(3))
    r = b.first()
    assert (r.first_seen_at.day, r.last_seen_at.day, r.role_category, r.is_active) == (2, 3, None, True)
    assert store.upsert_jobs(a, new.withColumn("role_category", F.lit(None).cast("string")), day(3), ("role_category",)).first().role_category == "backend"
    assert store.deactivate(b, F.lit(dt.datetime(2026, 6, 1))).first().is_active is False
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.version() is None
    s.publish({"jobs": a})
    with pytest.raises(Exception):  # noqa: B017
        s.publish({"jobs": b, "bad": b.select(F.raise_error(F.lit("no")))})
    assert s.read("jobs").first().last_seen_at.day == 2


def test_skills_links_relink(spark):
    s = store.upsert_skills(spark.createDataFrame([(1, "A", "tool")], "id bigint, name string, category string"), spark.createDataFrame([("C", "x"), ("B", "y"), ("A", "z")], "name string, category string"))
    assert sorted(map(tuple, s.collect())) == [(1, "A", "z"), (2, "B", "y"), (3, "C", "x")]
    moved, left = store.relink(spark.createDataFrame([(7, 2), (7, 1), (8, 2)], "job_id bigint, skill_id bigint"), s, spark.createDataFrame([("B", "A")], "alias string, canonical string"))
    assert sorted(map(tuple, moved.collect())) == [(7, 1), (8, 1)] and {r.name for r in left.collect()} == {"A", "C"}


def test_enrichment(spark):
    j = spark.createDataFrame([(1, "t", "full text", None, None), (2, "t", None, None, "cloud")], "id bigint, title string, description_full string, description_short string, role_category string")
    p = enrich.pending(j, empty(spark, LEDGER), "m")
    got = {r.id: r for r in enrich.classify(p, lambda rows: [{"role_category": "nope", "skills": ["ab", "abc"], "is_tech": "no"}]).collect()}
    assert got[1].role_category == "other" and got[1].skills == ["abc"] and not got[1].is_tech and len(got) == 2
    done = p.filter("id = 1").select(F.col("id").alias("job_id"), "input_hash", F.lit("m").alias("model"), "text_source", F.lit("2026").alias("reviewed_at"), F.lit("processed").alias("status"), *[F.lit(None).alias(c) for c in ("role_category_before", "role_category_after", "skills_before_count", "skills_added", "error")])
    assert [r.id for r in enrich.pending(j, enrich.ledger_put(empty(spark, LEDGER), done), "m").collect()] == [2]
    merge = lambda b, p, tech, **k: tuple(one(spark, enrich.merge_role(F.lit(b), F.lit(p), F.lit(tech), **k), x=1))
    assert merge(None, "cloud", False) == (True, None) and merge("cloud", "devops", False) == (False, "cloud") and merge("other", "cloud", True) == (True, "cloud")
    assert merge(None, "other", True) == (False, None) and merge(None, "other", True, everything=True) == (True, "other") and merge("cloud", "devops", True, update=True) == (True, "devops")


def test_sources(spark):
    c = spark.createDataFrame([(["geo", "time"], [2, 2], {"0": 1.0, "3": 4.0, "1": None}, {"geo": ((({"DE": 0, "FR": 1},)),), "time": (({"2020": 0, "2021": 1},),)})], cube.CUBE)
    assert sorted(map(tuple, cube.unravel(c).collect())) == [("de", 2020, 1.0), ("fr", 2021, 4.0)]
    body = "word " * 40
    assert pages.text_of(f"<body><nav>x</nav><article>{body}<script>no</script></article></body>").strip() == body.strip()
    assert one(spark, pages.embedded(F.col("h")), h='<script>{"description": "%s"}</script>' % ("d" * 120)) == "d" * 120
    calls = iter([b"bad", b'{"results": [{"id": 1}]}', b'{"results": []}'])
    assert list(adverts.pages(lambda url: next(calls), "u", lambda p: {"page": p}, sleep=lambda s: None)) == [{"id": 1}]
    assert seed_countries(spark).count() == 8
    with pytest.raises(ValueError, match="unknown"):
        adverts.read_json(spark, {"xx": "p"}, ["de"])


def test_remote_patterns(spark):
    flag = lambda t: one(spark, text.remote(F.col("t")), t=t)
    assert [flag(t) for t in ("inoffice", "in-office", "vorort", "vor ort", "unsur  placement", "on site", "onsite")] == [False] * 7
    assert [flag(t) for t in ("Remote or on-site", "100% remote", "TÉLÉTRAVAIL", "home  office")] == [True] * 4 and flag("remotely hybrid") is None


def test_remote_words_are_sought_in_the_text_as_it_is(spark):
    words = {"yes": [r"\bthe\b", r"\bder\b"], "no": [r"\bde\b", r"\bof\b"]}
    c, whole = F.col("t"), F.concat_ws(" ", text.normal(F.col("t")))
    has = lambda w: whole.rlike("(?iU)" + "|".join(w))
    made_normal = F.when(whole == "", F.lit(None)).when(has(words["yes"]), True).when(has(words["no"]), False)
    odd = [None, "", " \t\u2003\x1c", "the", "\x1cTHE\u3000", "the\u0301 of", "of \u0301the", "\u0301the", "the\u200bx", "the_ de", "DE\n\n\x1f OF", "othe r", "t\u2003he", "de\x85r", "thé", "der\u1680", "K\xa0of", "\ufffdthe", "x"]
    df = spark.createDataFrame([(t,) for t in odd], "t string").select("t", text.remote(c, **words).alias("got"), made_normal.alias("want"))
    assert [r.t for r in df.collect() if r.got != r.want] == [] and {r.got for r in df.collect()} == {None, True, False}
    assert "regexp_replace" not in df.select("got")._jdf.queryExecution().optimizedPlan().toString()
    mixed = text.remote(F.col("a"), F.col("b"), yes=[r"\bwfh\b", r"\bwork\s+from\s+home\b"], no=[r"\bof\b", r"\bon[-\s]?site\b"])
    assert [one(spark, mixed, a=a, b=b) for a, b in (("work \x1c from", "\nHOME"), (None, "on \t site"), (" ", None), ("of", "WFH"), ("work", "home"))] == [True, False, None, True, None]


def test_blanks_are_all_replaced_and_nothing_else(spark):
    every = "".join(chr(i) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000)
    assert one(spark, F.regexp_replace(F.col("t"), text.BLANK, ""), t=every) == "".join(x for x in every if x not in text.BLANKS)


def test_clean_lines_keeps_first(spark):
    lines = ["A line that is long enough", "short", "another long enough line", "a  LINE that is long enough", "Zebra line, long enough", "another long enough line "]
    assert one(spark, text.clean_lines(F.col("t")), t="\n".join(lines)) == "A line that is long enough another long enough line Zebra line, long enough"
    assert one(spark, text.clean_lines(F.col("t")), t="x\ny") is None


def test_resolve_ids_ties(spark):
    skills = spark.createDataFrame([(1, "go"), (2, "Go"), (3, "C"), (4, "c")], "id bigint, name string")
    names = spark.createDataFrame([("GO", "Go"), ("C", "C"), ("zz", "zz")], "name string, canonical string")
    assert {r.name: r.id for r in enrich.resolve_ids(names, skills).collect()} == {"GO": 2, "C": 3}
    assert {r.name: r.id for r in enrich.resolve_ids(names.select("name"), skills).collect()} == {"GO": 1, "C": 3}


def test_first_row_of_a_batch_counts(spark):
    flat = spark.createDataFrame([(5, "second", "de", 2, dt.datetime(2020, 1, 1)), (5, "first", "de", 1, dt.datetime(2021, 1, 1))], "id bigint, title string, country_code string, batch_pos bigint, posted_at timestamp")
    flat = flat.withColumns({c: F.lit(None).cast("string") for c in ("company", "location_display", "city")})
    good, bad = jobs.validate(flat, ["de"])
    assert [r.title for r in good.collect()] == ["first"] and [r.reason for r in bad.collect()] == ["duplicate"] and "batch_pos" not in good.columns


def test_store_survives_crashes(spark, tmp_path):
    row = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id bigint")
    s = store.Store(spark, str(tmp_path / "s"), keep=2)
    s.publish({"jobs": row(1), "other": row(9)}, "a")
    whole = s._fs

    class Crashing:
        def __init__(self, step):
            self.step = step

        def __getattr__(self, name):
            if name == self.step:
                raise RuntimeError("crash")
            return getattr(whole, name)

    for step in ("create", "rename"):
        s._fs = Crashing(step)
        with pytest.raises(RuntimeError):
            s.publish({"jobs": row(1, 2)}, "b")
        s._fs = whole
        assert s.read("jobs").count() == 1 and not s.published("b")
    s._fs = Crashing("delete")  # after the pointer: the version counts
    with pytest.raises(RuntimeError):
        s.publish({"jobs": row(1, 2)}, "b")
    s._fs = whole
    assert s.read("jobs").count() == 2 and s.published("b")
    for n in range(3):
        s.publish({"jobs": row(n)}, f"n{n}")
    assert s.read("other").count() == 1 and len(s._pointers()) == 2 and len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("v-")]) <= 3


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "title": "t"}\n')
    s = store.Store(spark, str(tmp_path / "s"))
    go = lambda: ingest.follow(spark, str(tmp_path / "in"), "id bigint, title string", s, str(tmp_path / "cp"), F.lit(dt.datetime(2026, 1, 2))).awaitTermination()
    go()
    (tmp_path / "in" / "b.json").write_text('{"id": 2, "title": "u"}\n')
    go()
    assert sorted((r.id, r.first_seen_at.day) for r in s.read("jobs").collect()) == [(1, 2), (2, 2)]
    assert ingest.load(s, spark, s.read("jobs").filter("false"), key="cp-1") is None


def test_relink_of_several_spellings(spark):
    skills = spark.createDataFrame([(1, "Node.js", "f"), (2, "nodejs", "f"), (3, "Node", "f"), (4, "node / react", "f")], "id bigint, name string, category string")
    links = spark.createDataFrame([(7, 2), (7, 3), (8, 4), (9, 1)], "job_id bigint, skill_id bigint")
    moved, left = store.relink(links, skills, store.spellings(skills, "Node.js", ["node", "nodejs", "node js"], ["node.js", "NodeJS"]))
    assert sorted(map(tuple, moved.collect())) == [(7, 1), (8, 4), (9, 1)] and sorted(r.id for r in left.collect()) == [1, 4]


def test_enrichment_writes(spark):
    skills = spark.createDataFrame([(1, "Go", "language")], "id bigint, name string, category string")
    links = spark.createDataFrame([(1, 1)], "job_id bigint, skill_id bigint")
    found = spark.createDataFrame([(1, "GO", "x"), (2, "go", "x"), (2, "Zig", "tool"), (3, "ZIG", "tool")], "job_id bigint, name string, category string")
    after, linked = enrich.add_skills(skills, links, found)
    assert sorted((r.id, r.name.lower(), r.category) for r in after.collect()) == [(1, "go", "language"), (2, "zig", "tool")]
    assert sorted(map(tuple, linked.collect())) == [(1, 1), (2, 1), (2, 2), (3, 2)]
    answers = spark.createDataFrame([(1, ["go", "Zig"], True), (2, ["Zig"], False)], "id bigint, skills array<string>, is_tech boolean")
    new = enrich.new_skills(answers, spark.createDataFrame([(1,), (2,)], "id bigint"), links, skills).collect()
    assert [(r.job_id, r.name) for r in new] == [(1, "Zig")]


def test_classifier_replies(spark):
    assert enrich.results('{"results": [{"a": 1}, 2]}') == [{"a": 1}] and enrich.results('so: {"1": {"a": 1}, "2": {"b": 2}} ok') == [{"a": 1}, {"b": 2}]
    assert enrich.results("no json") == enrich.results(None) == enrich.results("[1]") == []
    rows = spark.createDataFrame([(i, "t", "x") for i in range(3)], "id bigint, title string, text string").coalesce(1)

    def fails(part):
        raise OSError("down")

    assert {(r.role_category, r.is_tech, len(r.skills)) for r in enrich.classify(rows, fails).collect()} == {(None, True, 0)}
    got = enrich.classify(rows, enrich.llm_classifier(lambda q: '{"results": [{"role_category": "cloud", "skills": ["abc", 3]}]}' if q["options"]["temperature"] == 0 else "", "m", ["cloud"]))
    assert sorted((r.id, r.role_category) for r in got.collect()) == [(0, "cloud"), (1, None), (2, None)]


def test_crawl(spark, tmp_path):
    slept = []
    replies = {"ok": [(200, "page")], "busy": [(429, None), (503, None), (200, "late")], "never": [(429, None)] * 3, "gone": [(404, "x")]}
    get = pages.patient(lambda u: replies[u].pop(0), lambda p: p, slept.append)
    assert [get(u) for u in ("ok", "busy", "never", "gone")] == [("page", False), ("late", False), (None, True), (None, False)] and slept == [30, 120, 30, 120]
    jobs_ = spark.createDataFrame([(i, f"u{i}", "has" if i == 3 else None) for i in range(6)], "id bigint, url string, description_full string")
    fetch = lambda u: (f"text of {u}", False)
    got = {r.id: r.description_full for r in pages.crawl_in_steps(jobs_, fetch, str(tmp_path / "c"), 3, 0.0).collect()}
    assert got == {i: "has" if i == 3 else f"text of u{i}" for i in range(6)}

    def asked(u):
        raise AssertionError("asked again")

    assert pages.crawl_in_steps(jobs_, asked, str(tmp_path / "c"), 3, 0.0).filter("description_full is null").count() == 0
    many = spark.createDataFrame([(i, f"u{i}") for i in range(30)], "id bigint, url string").coalesce(1)
    assert pages.crawled(many, lambda u: (None, True), 0.0).count() == 0
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert pages.resume(spark, (a, None), (b, lambda: many)).count() == 30
    assert pages.resume(spark, (a, None), (b, None)).count() == 30


def test_page_text():
    body = "word " * 40
    assert pages.text_of(f"<div class='x adp-body'><p>one<p>two</div><footer>{body}</footer>") == "one\ntwo"
    assert pages.text_of(f"<section class=adp-body><li>{body}</section><footer>foot {body}</footer>") == body.strip()
    assert pages.text_of("<body><div data-automation='jobDescription'>short</div>rest</body>") == "short"
    assert pages.text_of("<body>a<br>b</body>") == "a\nb" and pages.text_of(None) is None and pages.text_of("") is None


def test_backlog_and_candidates(spark):
    day = lambda n: dt.datetime(2026, 1, n)
    j = spark.createDataFrame(
        [(1, True, "u", None, "de", day(1), None), (2, True, "u/land/x", None, "de", day(2), "other"), (3, True, "u", "", "pl", None, "cloud"), (4, True, "u", None, "de", day(9), "cloud"), (5, False, "u", None, "de", day(9), None)],
        "id bigint, is_active boolean, url string, description_full string, country_code string, posted_at timestamp, role_category string",
    ).withColumn("ingested_at", F.col("posted_at"))
    now = F.lit(day(10))
    assert [r.id for r in enrich.backlog(j, now).collect()] == [3, 4, 1] and [r.id for r in enrich.backlog(j, now, "de", 5, 1).collect()] == [4]
    assert sorted(r.id for r in enrich.candidates(j, now).collect()) == [1, 2] and sorted(r.id for r in enrich.candidates(j, now, "all", 5, True).collect()) == [4, 5]


def test_reports_and_summaries(spark, tmp_path):
    df = spark.createDataFrame([("<b>", 3), ("c", 2)], "k string, n int").orderBy(F.desc("n"))
    page = report.report("T & co", {"a": 1}, {"roles": df})
    assert "T &amp; co" in page and page.index("&lt;b&gt;") < page.index("<td>c</td>")
    assert report.growth(3, 2) == 50.0 and report.growth(3, 0) == 0.0
    store.write_summary(str(tmp_path / "s.json"), {"status": "ok"})
    assert store.read_summary(str(tmp_path / "s.json")) == {"status": "ok"} and store.read_summary(str(tmp_path / "none"))["status"] == "failed"


def test_throttled_pages_are_asked_again(spark, tmp_path):
    jobs_ = spark.createDataFrame([(i, f"u{i}", None) for i in range(30)], "id bigint, url string, description_full string").coalesce(1)
    path = str(tmp_path / "c")
    busy = pages.crawl_in_steps(jobs_, lambda u: (None, True), path, 2, 0.0)
    assert busy.filter("description_full is not null").count() == 0
    some = pages.crawl_in_steps(jobs_, lambda u: ("t", False) if u != "u7" else (None, u == "u7"), path, 2, 0.0)
    assert some.filter("description_full = 't'").count() == 29
    asked = str(tmp_path / "asked")

    def last(u):
        with open(asked, "a") as f:
            f.write(u + "\n")
        return "late", False

    assert pages.crawl_in_steps(jobs_, last, path, 2, 0.0).filter("description_full = 'late'").count() == 1 and open(asked).read() == "u7\n"
