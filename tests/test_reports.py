"""Reports with their limits, mail sent once, and rules that no other test covers."""

import datetime as dt
import json
import socketserver
import threading
from email import message_from_bytes
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from harvestry import report, schema
from harvestry.functions import pay
from harvestry.functions.catalog import Catalog
from harvestry.operators import store
from harvestry.operators.versions import Store
from harvestry.plans import registry
from harvestry.plans.standins import SETTINGS
from harvestry.sources import cube, pages

DATA = "/root/testdata/sf0.001"


class Smtp(socketserver.StreamRequestHandler):
    mails: list = []

    def handle(self):
        say = lambda x: self.wfile.write(x + b"\r\n")
        say(b"220 here")
        while line := self.rfile.readline():
            word = line[:4].upper()
            if word == b"DATA":
                say(b"354 go")
                body = b""
                while (line := self.rfile.readline()) != b".\r\n":
                    body += line
                self.mails.append(body)
                say(b"250 ok")
            elif word == b"QUIT":
                return say(b"221 bye")
            else:
                say(b"250 ok")


def test_mail_is_sent_once(spark, tmp_path):
    server = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Smtp)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = {"host": "127.0.0.1", "port": str(server.server_address[1]), "starttls": "false", "to": "a@x,b@x", "outbox": str(tmp_path / "out")}
    for _ in range(2):
        report.send(spark, "Grüße", "<b>body</b>", "load-1", **at)
    report.send(spark, "other", "y", "load-2", **at)
    server.shutdown()
    got = [message_from_bytes(m) for m in Smtp.mails]
    assert len(got) == 2 and got[0].get_payload()[0].get_payload(decode=True).decode() == "<b>body</b>"
    (tmp_path / "out" / "load-3.sending").touch()
    with pytest.raises(Exception, match="broke off"):
        report.send(spark, "x", "y", "load-3", **at)
    spark.dataSource.register(report.Mail)
    bad = spark.range(3).select(F.when(F.col("id") < 2, "s").otherwise(F.raise_error(F.lit("no"))).alias("subject"), F.lit("b").alias("body")).repartition(3)
    with pytest.raises(Exception):  # noqa: B017
        bad.write.format("mail").options(key="load-4", outbox=str(tmp_path / "files")).mode("append").save()
    assert not list(Path(tmp_path / "files").glob("*")) if (tmp_path / "files").exists() else True
    for _ in range(2):
        report.send(spark, "s", "b", "load-5", outbox=str(tmp_path / "files"))
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == ["load-5-0.eml", "load-5.sent"]


def test_limits():
    assert [report.over(x, report.STORAGE) for x in (None, 60, 60.1, 80.1)] == [report.GREY, report.GREEN, report.ORANGE, report.RED]
    subject, page = report.load_report({"status": "failure", "error": "<x>", "jobs_loaded": 5, "by_country": {"de": 1, "pl": 2}}, None)
    assert subject == "Load: FAILURE" and report.RED in page and "&lt;x&gt;" in page and page.index("PL") < page.index("DE")
    assert "FR" in report.load_report({}, 7, {"fr": 3})[1] and report.GREY in report.load_report({}, 7)[1]


def test_health_report(spark):
    m = registry.model(spark, DATA)
    page = report.health(m, SETTINGS, 450 << 20)
    assert f"color:{report.RED}'>450.0 MB" in page and "unknown" in report.health({k: v.limit(0) if k == "jobs" else v for k, v in m.items()}, SETTINGS, None)
    null = m["jobs"].filter("role_category is null").count() / m["jobs"].count() * 100
    assert f"({null:.1f}%)" in page and report.over(null, report.UNCLASSIFIED) in page


def test_store_sizes_and_summaries(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.size() is None
    s.publish({"jobs": spark.range(10)})
    assert s.size() >= sum(p.stat().st_size for p in (tmp_path / "s").rglob("*.parquet"))


def test_soft_delete(spark):
    jobs = spark.createDataFrame([(1, "Werkstudent IT", True), (2, "Dev", True), (3, None, True), (4, "WERKSTUDENT", False)], "id long, title string, is_active boolean")
    assert {r.id: r.is_active for r in store.soft_delete(jobs, ["werkstudent", "nurse"]).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_violations(spark):
    at = "id bigint, title string, country_code string, role_category string, salary_min int, salary_max int, contract_type string, contract_time string"
    jobs = spark.createDataFrame([(1, None, "zz", "nope", 9, 5, "x", "full_time"), (1, "t", "de", "cloud", -1, None, "permanent", "y"), (2, "t", None, None, 1, 2, None, None)], at)
    skills = spark.createDataFrame([(1, "a"), (2, "a")], "id bigint, name string")
    links = spark.createDataFrame([(1, 1), (1, 1), (8, 9)], "job_id bigint, skill_id bigint")
    got = {r.rule: r.n for r in schema.violations(jobs, schema.seed_countries(spark), skills, links).collect()}
    assert got == {"title": 1, "country": 1, "role": 1, "pay_order": 1, "pay_sign": 1, "contract_type": 1, "contract_time": 1, "job_key": 1, "skill_key": 1, "link_key": 1, "job_country": 2, "link_job": 1, "link_skill": 1}


def test_context(spark):
    c = spark.createDataFrame([(["geo", "time"], [2, 2], {"0": 1.005, "1": 2.0, "3": 4.449}, {"geo": (({"DE": 0, "XX": 1},),), "time": (({"2018": 0, "2020": 1},),)})], cube.CUBE)
    assert [tuple(map(str, r)) for r in cube.context(c, ["de"], "rate").collect()] == [("de", "2020", "rate", "2.00")]


def test_catalog_from_a_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"skills": [["Go", "language", ["\\bgolang\\b"]]], "titles": {"a": ["x"]}, "outside": ["nurse"]}))
    assert Catalog.read(str(tmp_path / "c.json")) == Catalog((("Go", "language", ("\\bgolang\\b",)),), {"a": ("x",)}, {}, ("nurse",))


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([("pl", nan, 1800.0), ("pl", nan, nan), ("de", 5.0, nan), ("de", 1.0, 4.0)], "c string, a double, b double")
    a, b = pay.euros(F.col("c"), F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(a.alias("x"), b.alias("y"), pay.middle(F.col("a"), F.col("b")).alias("m")).collect()] == [(None, 92743, None), (None, None, None), (5, None, None), (1, 4, 2)]


def test_embedded_descriptions(spark):
    long = "d" * 101
    rows = [
        f'<script>{{"description": " {long} "}}</script>', f'<script>self.push({{"a":{{"description":"{long}\\u00e9\\n\\"x\\""}}}})</script>', f'<script>{{"description": "short", "b": {{"description": "{long}"}}}}</script>',
        f'<script>{{"description": "{"e" * 60_000}"}}</script><SCRIPT type=x>{{"description": "{long}"}}</SCRIPT>', "<script>description</script>", None, f'<script>{{"jobs": [{{"description": "{long}!"}}]}}</script>',
    ]
    got = [r[0] for r in spark.createDataFrame([(k, h) for k, h in enumerate(rows)], "k int, h string").orderBy("k").select(pages.embedded(F.col("h"))).collect()]
    assert got == [long, long + 'é\n"x"', None, long, None, None, long + "!"]


def test_times():
    assert dt.datetime.fromisoformat(SETTINGS.as_of) == dt.datetime(2001, 8, 1)
