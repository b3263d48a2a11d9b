"""Adverts: JSON files, and a paginated REST source with retries as a Python data source, for batches and as a stream."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from ..schema import RAW_ADVERT, SEED

PAGE_ROWS, MAX_PAGES, WAITS = 50, 100, (2, 4)


def read_json(spark: SparkSession, paths: dict[str, str], known: list[str]) -> DataFrame:
    """Adverts of several countries, code -> path, one JSON object a line; ValueError for an unknown code."""
    if wrong := sorted(set(paths) - set(known)):
        raise ValueError(f"unknown countries: {wrong}")
    out = None
    for code, path in paths.items():
        df = spark.read.schema(RAW_ADVERT).json(path).withColumn("country_code", F.lit(code))
        out = df if out is None else out.unionByName(df)
    return out


def parameters(page: int, key: dict[str, str], max_days_old: int) -> dict[str, str]:
    return {**key, "results_per_page": str(PAGE_ROWS), "category": "it-jobs", "max_days_old": str(max_days_old), "page": str(page)}


def fetch(get: Callable[[str], bytes], url: str, sleep: Callable[[float], None] = time.sleep, waits: tuple[float, ...] = WAITS) -> dict | None:
    """A page as JSON; None after the first try and one more after each wait."""
    for wait in (*waits, None):
        try:
            return json.loads(get(url))
        except (OSError, ValueError):
            if wait is None:
                return None
            sleep(wait)
    return None


def pages(get: Callable[[str], bytes], base: str, params: Callable[[int], dict], pause: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Records until an empty page, a failed one, or MAX_PAGES."""
    for page in range(1, MAX_PAGES + 1):
        got = fetch(get, f"{base}/{page}?{urllib.parse.urlencode(params(page))}", sleep)
        if not got or not got.get("results"):
            return
        yield from got["results"]
        sleep(pause)


@dataclass
class PageRange(InputPartition):
    """Pages first to last of a country."""

    country: str
    first: int
    last: int


class RestAdverts(DataSource):
    """format("adverts"): options base (with {country} and without the page), countries (comma-separated, all of the model if not given), max_days_old (30), app_id, app_key, timeout (30 s), pause (0.5 s), and:

    pages (25) a partition, so that a country is read by several tasks. A range ends at its first empty page or at one
    that fails three times; the ranges after it ask one page more each.

    As a batch: a filter on country_code reads those countries alone. As a stream: the offset is the last page that each
    country had; a batch reads the pages that came since, and one that fails three times fails the batch, which then runs again.
    Countries that the model doesn't know are an error.
    """

    @classmethod
    def name(cls) -> str:
        return "adverts"

    def schema(self) -> str:
        return "country_code string, record string"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return _Stream(self.options)


class _Asking:
    """What both readers share: options, countries, requests."""

    def __init__(self, options: dict) -> None:
        self.base, self.days = options["base"], int(options.get("max_days_old", 30))
        self.timeout, self.pause, self.step = float(options.get("timeout", 30)), float(options.get("pause", 0.5)), int(options.get("pages", 25))
        self.waits = tuple(float(w) for w in options.get("waits", ",".join(map(str, WAITS))).split(","))
        self.key = {k: options[k] for k in ("app_id", "app_key") if k in options}
        known = [c for c, _ in SEED]
        self.countries = [c.strip() for c in options.get("countries", ",".join(known)).split(",")]
        if wrong := sorted(set(self.countries) - set(known)):
            raise ValueError(f"unknown countries: {wrong}")

    def get(self, url: str) -> bytes:
        return urllib.request.urlopen(url, timeout=self.timeout).read()  # noqa: S310

    def url(self, country: str, page: int) -> str:
        return f"{self.base.format(country=country)}/{page}?{urllib.parse.urlencode(parameters(page, self.key, self.days))}"

    def ranges(self, country: str, first: int, last: int) -> list[PageRange]:
        return [PageRange(country, k, min(last, k + self.step - 1)) for k in range(first, last + 1, self.step)]


class _Reader(_Asking, DataSourceReader):
    def pushFilters(self, filters):  # noqa: N802
        """Equality and IN on country_code choose the countries."""
        for f in filters:
            at = f.attribute if isinstance(f, (EqualTo, In)) else None
            if at == ("country_code",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.countries = [c for c in self.countries if c in wanted]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [r for c in self.countries for r in self.ranges(c, 1, MAX_PAGES)] or [PageRange("", 1, 0)]

    def read(self, partition: PageRange):
        for page in range(partition.first, partition.last + 1):
            got = fetch(self.get, self.url(partition.country, page), time.sleep, self.waits)
            if not got or not got.get("results"):
                return
            for record in got["results"]:
                yield partition.country, json.dumps(record)
            time.sleep(self.pause)


class _Stream(_Asking, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {c: 0 for c in self.countries}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last page of each country by the number of adverts that its first page states; 0 where that can't be had."""
        out = {}
        for c in self.countries:
            got = fetch(self.get, self.url(c, 1), time.sleep, self.waits)
            out[c] = min(MAX_PAGES, -(-int((got or {}).get("count", 0)) // PAGE_ROWS))
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [r for c in end for r in self.ranges(c, start.get(c, 0) + 1, end[c])]

    def read(self, partition: PageRange):
        for page in range(partition.first, partition.last + 1):
            got = fetch(self.get, self.url(partition.country, page), time.sleep, self.waits)
            if got is None:
                raise OSError(f"{partition.country}, page {page}")
            for record in got.get("results") or []:
                yield partition.country, json.dumps(record)
            time.sleep(self.pause)

    def commit(self, end: dict) -> None:
        pass


def parse(records: DataFrame) -> DataFrame:
    """Rows of RestAdverts as raw adverts."""
    return records.select(F.from_json("record", RAW_ADVERT).alias("r"), "country_code").select("r.*", "country_code")
