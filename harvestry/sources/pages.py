"""Advert pages: text by selectors, descriptions out of embedded JSON, and crawling through a given fetcher."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST, LARGEST, THROTTLES, BREAKER = 100, 50_000, (30, 120), 10
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Fixed values: (tag, attribute, value) of the elements that hold an advert's text, in order; a class is one of several.
SELECTORS = (
    ("section", "class", "adp-body"), ("div", "class", "adp-body"), (None, "data-automation", "jobDescription"), ("div", "class", "jobDescription"),
    ("div", "id", "job-description"), ("div", "class", "job-description"), ("article", None, None), ("main", None, None),
)
#: Start tags that end an open element of the same kind, and what keeps them from ending one further out.
_ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_HOLDS = {"ul", "ol", "table", "dl", "select", "div", "section", "article", "main", "body", "blockquote"}
_CLOSE_P = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ASIDE = {"nav", "header", "footer", "aside", "form", "button"}


class _Text(HTMLParser):
    """One parse of a page: the text nodes of the first element of each selector, of the body, and of the main content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[int]]] = []
        self.seen: set[int] = set()
        self.parts: list[list[str]] = [[] for _ in (*SELECTORS, "body", "main")]

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        ends = _ENDS.get(tag, set()) | ({"p"} if tag in _CLOSE_P else set())
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ends:
                del self.open[k:]
                break
            if self.open[k][0] in _HOLDS:
                break
        a, mine = dict(attrs), []
        for k, (name, key, value) in enumerate(SELECTORS):
            held = a.get(key) or "" if key else ""
            if k not in self.seen and name in (None, tag) and (key is None or (value in held.split() if key == "class" else value == held)):
                self.seen.add(k)
                mine.append(k)
        self.open.append((tag, mine))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        tags = {t for t, _ in self.open}
        if not (text := data.strip()) or tags & {"script", "style", "head"}:
            return
        for k in [k for _, mine in self.open for k in mine]:
            self.parts[k].append(text)
        self.parts[-2].append(text)
        if not tags & _ASIDE and tags & {"p", "li", "td", "h1", "h2", "h3", "blockquote"}:
            self.parts[-1].append(text)


def text_of(page: str | None) -> str | None:
    """Lines of the main content (prose outside menus, headers, footers, sidebars and forms) if it has over 100 characters, else of the first selector that the page has, else of the body; null if nothing stays."""
    p = _Text()
    p.feed(page or "")
    p.close()
    main = "\n".join(p.parts[-1])
    if len(main) > LEAST:
        return main
    chosen = next((k for k in range(len(SELECTORS)) if p.parts[k]), -2)
    return "\n".join(p.parts[chosen]) or None


def page_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with description_full, by Arrow batches: selectors need a parser."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(text_of)

    return pages.withColumn("description_full", extract(column))


def embedded(html: Column) -> Column:
    """The first description of over 100 characters in a script of at most 50 000 characters: the member of the JSON that the script is, else the first one anywhere in it, at any depth and also where the script isn't JSON, with its escapes resolved; trimmed."""
    scripts = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), lambda s: s.contains("description") & (F.length(s) <= LARGEST))
    inner = lambda s: F.nullif(F.regexp_extract(s, r'"description"\s*:\s*("(?:[^"\\]|\\.)*")', 1), F.lit(""))
    found = F.flatten(F.transform(scripts, lambda s: F.array(F.get_json_object(s, "$.description"), F.get_json_object(F.concat(F.lit('{"d":'), inner(s), F.lit("}")), "$.d"))))
    return F.btrim(F.get(F.filter(found, lambda d: F.length(d) > LEAST), F.lit(0)), F.lit(" \t\n\r"))


def patient(get: Callable[[str], tuple[int, str | None]], extract: Callable[[str | None], str | None] = text_of, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str | None, bool]]:
    """A fetcher(url) -> (text, throttled) over get(url) -> (status, page): 429 and 503 wait THROTTLES seconds and then count as throttled; other errors aren't tried again."""

    def fetch(url: str) -> tuple[str | None, bool]:
        for wait in (*THROTTLES, None):
            try:
                status, page = get(url)
            except OSError:
                return None, False
            if status not in (429, 503):
                return (extract(page) if status == 200 else None), False
            if wait is None:
                return None, True
            sleep(wait)
        return None, True

    return fetch


def crawled(wanted: DataFrame, fetcher: Callable[[str], tuple[str | None, bool]], pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, found) of wanted (id, url), a pause after each page. After BREAKER throttled pages in a row a task stops asking; what it leaves isn't in the result, so the next run asks for it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = 0
        for f in frames:
            ids, texts = [], []
            for i, url in zip(f["id"], f["url"], strict=True):
                if row >= BREAKER:
                    break
                got, throttled = fetcher(url)
                row = row + 1 if throttled else 0
                if not throttled:
                    ids.append(i)
                    texts.append(got)
                sleep(pause)
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "found": pd.Series(texts, dtype="object")})

    return wanted.select("id", "url").mapInPandas(run, "id bigint, found string")


def lacking(jobs: DataFrame) -> DataFrame:
    """Jobs with a url and no full text."""
    return jobs.filter("url is not null and nullif(description_full, '') is null")


def crawl(jobs: DataFrame, fetcher: Callable[[str], tuple[str | None, bool]], pause: float = 0.0) -> DataFrame:
    """jobs with description_full filled where it lacks and there is a url. fetcher(url) -> (text, throttled), see patient()."""
    found = crawled(lacking(jobs), fetcher, pause)
    return jobs.join(found, "id", "left").withColumn("description_full", F.coalesce(F.nullif("description_full", F.lit("")), "found")).drop("found")


def _done(spark: SparkSession, path: str) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def crawl_in_steps(jobs: DataFrame, fetcher: Callable[[str], tuple[str | None, bool]], path: str, steps: int, pause: float = 2.0) -> DataFrame:
    """As crawl(), in slices of ids whose answers are written to path one after the other.

    A run asks what no answer is there for: after a crash the slices that ended aren't asked again, and of a slice
    whose pages were throttled those are asked that were left; a page without text counts as answered.
    """
    spark = jobs.sparkSession
    answers = spark.createDataFrame([], "id bigint, found string")
    for k in range(steps):
        runs = 0
        while _done(spark, f"{path}/step={k}/run={runs}"):
            answers = answers.union(spark.read.schema("id bigint, found string").parquet(f"{path}/step={k}/run={runs}"))
            runs += 1
        left = lacking(jobs).filter(F.pmod(F.xxhash64("id"), F.lit(steps)) == k).join(answers.select("id"), "id", "left_anti")
        if not left.isEmpty():
            crawled(left, fetcher, pause).write.mode("overwrite").parquet(f"{path}/step={k}/run={runs}")
            answers = answers.union(spark.read.schema("id bigint, found string").parquet(f"{path}/step={k}/run={runs}"))
    return jobs.join(answers, "id", "left").withColumn("description_full", F.coalesce(F.nullif("description_full", F.lit("")), "found")).drop("found")


def resume(spark: SparkSession, *stages: tuple[str, Callable[[], DataFrame]]) -> DataFrame:
    """The first (path, make) stage whose table is there, read; if none is, the last one is made, written and read."""
    for path, _ in stages:
        if _done(spark, path):
            return spark.read.parquet(path)
    path, make = stages[-1]
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
