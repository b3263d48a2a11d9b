"""The REST sources and the crawl against a server on this machine."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from harvestry.sources import adverts, cube, register


class Stub:
    """pages: country -> list of pages of records; broken: paths that fail so many times; asked: what was asked, in order."""

    def __init__(self):
        self.pages, self.broken, self.asked, self.text, self.times, self.reply, self.slow = {}, Counter(), [], {}, [], "", 0
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                url = urlparse(self.path)
                stub.asked.append((url.path, {k: v[0] for k, v in parse_qs(url.query).items()}))
                stub.times.append(time.time())
                if stub.broken[url.path] > 0:
                    stub.broken[url.path] -= 1
                    self.send_response(429 if url.path.startswith("/page") else 500)
                    self.end_headers()
                    return
                if url.path in stub.text:
                    body = stub.text[url.path]
                elif url.path.startswith("/api/"):
                    _, _, country, _, page = url.path.split("/")
                    all_pages = stub.pages.get(country, [])
                    body = json.dumps({"count": 50 * len(all_pages), "results": all_pages[int(page) - 1] if int(page) <= len(all_pages) else []})
                else:
                    self.send_response(404)
                    self.end_headers()
                    return
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body.encode())

            def do_POST(self):  # noqa: N802
                asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                stub.asked.append((self.path, asked))
                time.sleep(stub.slow)
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps({"response": stub.reply}).encode())

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"


@pytest.fixture
def stub():
    s = Stub()
    yield s
    s.server.shutdown()


def options(stub, **more):
    return {"base": stub.url + "/api/{country}/search", "pause": "0", "waits": "0,0", "app_id": "me", "app_key": "k", "max_days_old": "7", "pages": "2"} | more


def test_parameters():
    assert adverts.parameters(3, {"app_id": "x"}, 9) == {"app_id": "x", "results_per_page": "50", "category": "it-jobs", "max_days_old": "9", "page": "3"}


def test_batch(spark, stub):
    stub.pages = {"de": [[{"id": f"d{p}{k}", "title": "t"} for k in range(3)] for p in range(5)], "fr": [[{"id": "f1"}]], "pl": []}
    stub.broken["/api/de/search/2"] = 2  # answered at the third try
    df = register(spark).read.format("adverts").options(**options(stub, countries="de, fr,pl")).load()
    got = adverts.parse(df).select("id", "country_code").collect()
    assert sorted(r.id for r in got) == sorted([f"d{p}{k}" for p in range(5) for k in range(3)] + ["f1"]) and Counter(r.country_code for r in got) == {"de": 15, "fr": 1}
    assert all(q["results_per_page"] == "50" and q["app_key"] == "k" and q["max_days_old"] == "7" for _, q in stub.asked)
    stub.asked.clear()
    assert df.filter("country_code = 'fr'").count() == 1 and {p.split("/")[2] for p, _ in stub.asked} == {"fr"}
    stub.asked.clear()
    assert df.filter("country_code in ('pl', 'xx')").count() == 0 and {p.split("/")[2] for p, _ in stub.asked} == {"pl"}
    stub.broken["/api/de/search/3"] = 10**6  # the range of pages 3 and 4 ends, the others don't
    assert df.filter("country_code = 'de'").count() == 9
    with pytest.raises(Exception, match="unknown countries"):
        spark.read.format("adverts").options(**options(stub, countries="de,zz")).load().count()


def test_stream_resumes(spark, stub, tmp_path):
    stub.pages = {"de": [[{"id": "1"}], [{"id": "2"}]], "fr": [[{"id": "9"}]]}
    register(spark)

    def run():
        stream = spark.readStream.format("adverts").options(**options(stub, countries="de,fr")).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    ids = lambda: sorted(json.loads(r.record)["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    run()
    assert ids() == ["1", "2", "9"]
    stub.pages["de"] += [[{"id": "3"}], [{"id": "4"}]]
    stub.broken["/api/de/search/4"], stub.asked = 10**6, []
    with pytest.raises(Exception, match="page 4"):
        run()
    assert ids() == ["1", "2", "9"]
    stub.broken.clear()
    run()
    run()
    assert ids() == ["1", "2", "3", "4", "9"]
    assert not [p for p, _ in stub.asked if p == "/api/de/search/2"]  # its batch had ended


def test_cubes(spark, stub):
    stub.text = {"/e": json.dumps({"id": ["geo", "time"], "size": [2, 2], "value": {"0": 71.256, "3": 4.0}, "dimension": {"geo": {"category": {"index": {"DE": 0, "XX": 1}}}, "time": {"category": {"index": {"2020": 0, "2018": 1}}}}})}
    load = lambda url: register(spark).read.format("cubes").options(**{"indicator.employment_rate_15_64": url, "waits": "0,0"}).load()
    got = cube.contexts(load(stub.url + "/e"), ["de"]).collect()
    assert [(r.country_code, r.year, r.indicator, float(r.value)) for r in got] == [("de", 2020, "employment_rate_15_64", 71.26)]
    with pytest.raises(Exception, match="nothing"):
        load(stub.url + "/nothing").count()


def test_crawl_stream(spark, stub, tmp_path):
    from harvestry.streaming.frontier import crawl_stream, http

    source = tmp_path / "in"
    source.mkdir()
    stub.text = {f"/page/{k}": f"<body>text {k}</body>" for k in range(8)}
    stub.broken.update({"/page/3": 2, "/page/4": 5, "/page/5": 10**6})  # the last is throttled until it is mended
    here = stub.url
    other = here.replace("127.0.0.1", "localhost")

    def run(more, until):
        (source / f"{len(list(source.iterdir()))}.json").write_text("".join(json.dumps({"id": i, "url": u}) + "\n" for i, u in more))
        wanted = spark.readStream.schema("id long, url string").json(str(source))
        out = crawl_stream(wanted, http(5), lambda page: (page or "").removeprefix("<body>").removesuffix("</body>"), 0.0, (0.0, 0.0), 3, 0.3, 4)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
        end = time.time() + 120
        try:
            while time.time() < end and q.isActive and not until():
                time.sleep(0.3)
        finally:
            q.stop()

    def answers():
        try:
            return [(r.id, r.found) for r in spark.read.schema("id long, url string, found string").parquet(str(tmp_path / "out")).collect()]
        except Exception:
            return []

    run([(k, f"{here}/page/{k}") for k in range(6)] + [(10, f"{other}/page/6"), (11, f"{other}/none"), (12, None), (13, "http://127.0.0.1:1/x")], lambda: len(answers()) >= 8)
    got = dict(answers())
    assert got == {0: "text 0", 1: "text 1", 2: "text 2", 3: "text 3", 4: "text 4", 10: "text 6", 11: None, 13: None} and len(answers()) == 8
    asked = Counter(p for p, _ in stub.asked)
    assert asked["/page/0"] == 1 and asked["/page/3"] == 3 and asked["/page/4"] == 6 and asked["/page/5"] >= 3
    stub.broken.clear()
    run([(20, f"{here}/page/7")], lambda: len(answers()) >= 10)
    assert dict(answers()) == got | {5: "text 5", 20: "text 7"} and len(answers()) == 10
    again = Counter(p for p, _ in stub.asked)
    assert all(again[p] == asked[p] for p in asked if p != "/page/5")  # nothing is asked twice


def test_classifier_over_http(spark, stub):
    from harvestry.operators.enrich import classify, http_post, llm_classifier
    from harvestry.schema import ROLES

    stub.reply = 'Here: {"results": [{"role_category": "cloud", "skills": ["AWS"], "is_tech": true}, {"role_category": "devops", "skills": [], "is_tech": "no"}]}'
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id bigint, title string, text string").coalesce(1)
    ask = lambda timeout: {r.id: r for r in classify(rows, llm_classifier(http_post(stub.url + "/generate", timeout), "m", ROLES), 2).collect()}
    got = ask(5)
    assert (got[1].role_category, got[1].skills, got[2].is_tech, got[3].role_category) == ("cloud", ["AWS"], False, "cloud")
    assert stub.asked[0][1]["model"] == "m" and stub.asked[0][1]["stream"] is False and len(stub.asked) == 2
    stub.slow = 1
    assert all(r.role_category is None for r in ask(0.2).values())


def test_context_is_loaded(spark, tmp_path):
    from harvestry.operators.versions import Store
    from harvestry.streaming.ingest import load_context

    s = Store(spark, str(tmp_path / "s"))
    rows = lambda *v: spark.createDataFrame(v, "country_code string, year int, indicator string, value double").select("country_code", F.col("year").cast("smallint").alias("year"), "indicator", F.col("value").cast("decimal(5,2)").alias("value"))
    load_context(s, rows(("de", 2020, "r", 1.0), ("fr", 2020, "r", 2.0)), "a")
    load_context(s, rows(("de", 2020, "r", 3.0), ("de", 2021, "r", 4.0)), "b")
    assert load_context(s, rows(("de", 2020, "r", 9.0)), "b") is None
    assert sorted((r.country_code, r.year, float(r.value)) for r in s.read("context").collect()) == [("de", 2020, 3.0), ("de", 2021, 4.0), ("fr", 2020, 2.0)]
