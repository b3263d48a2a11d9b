"""Crawling as a stream: what waits at each host is state, and timers keep one rate, one backoff and one breaker a host, across all tasks."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.pages import BREAKER, THROTTLES, text_of

FOUND = "id bigint, url string, found string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def http(timeout: float = 30.0, agent: str = "Mozilla/5.0") -> Callable[[str], tuple[int, str | None]]:
    """get(url) -> (status, page) for Frontier; OSError where nothing answers."""

    def get(url: str) -> tuple[int, str | None]:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:  # noqa: S310
                return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, None

    return get


class Frontier(StatefulProcessor):
    """Of each host: the pages that wait, in order, and how it has answered.

    A timer asks up to burst pages, pause apart. A page that is throttled (429, 503) is asked again after each of
    backoff's waits, then goes behind the others and is asked again later, so none is lost; breaker such pages in a row
    rest the host. Other errors are answers without text.
    """

    def __init__(self, get: Callable[[str], tuple[int, str | None]], extract: Callable[[str | None], str | None], pause: float, backoff: tuple[float, ...], breaker: int, rest: float, burst: int) -> None:
        self.get, self.extract, self.pause, self.backoff, self.breaker, self.rest, self.burst = get, extract, pause, backoff, breaker, rest, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "place long", "id long, url string, tries int")
        self.host = handle.getValueState("host", "head long, tail long, row int")

    def _state(self) -> list[int]:
        return list(self.host.get()) if self.host.exists() else [0, 0, 0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head, tail, row = self._state()
        idle = head == tail
        for frame in rows:
            for i, url in zip(frame["id"], frame["url"], strict=True):
                self.waiting.updateValue((tail,), (int(i), url, 0))
                tail += 1
        self.host.update((head, tail, row))
        if idle and head < tail:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)
        return iter(())

    def _ask(self, url: str) -> tuple[str | None, bool]:
        try:
            status, page = self.get(url)
        except OSError:
            return None, False
        return (None, True) if status in (429, 503) else (self.extract(page) if status == 200 else None, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head, tail, row = self._state()
        out, wait = [], self.pause
        for k in range(self.burst):
            if head == tail:
                break
            if k:
                time.sleep(self.pause)
            i, url, tries = self.waiting.getValue((head,))
            text, throttled = self._ask(url)
            if throttled and tries < len(self.backoff):
                self.waiting.updateValue((head,), (i, url, tries + 1))
                wait = self.backoff[tries]
                break
            self.waiting.removeKey((head,))
            head += 1
            row = row + 1 if throttled else 0
            if throttled:
                self.waiting.updateValue((tail,), (i, url, 0))
                tail += 1
                if row >= self.breaker:
                    wait = self.rest
                    break
            else:
                out.append((i, url, text))
        self.host.update((head, tail, row))
        if head < tail:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, int(1000 * wait)))
        yield pd.DataFrame({"id": pd.Series([r[0] for r in out], dtype="int64"), "url": pd.Series([r[1] for r in out], dtype="object"), "found": pd.Series([r[2] for r in out], dtype="object")})


def crawl_stream(
    wanted: DataFrame, get: Callable[[str], tuple[int, str | None]], extract: Callable[[str | None], str | None] = text_of, pause: float = 2.0, backoff: tuple[float, ...] = THROTTLES, breaker: int = BREAKER, rest: float = 600.0, burst: int = 10
) -> DataFrame:
    """(id, url, found) of a stream of pages (id, url), each once: answers and what waits are committed together, batch by batch.

    After a restart what was answered in a committed batch isn't asked again, and what waited goes on waiting. Give the
    query a trigger by processing time, as timers are what asks. State is kept by RocksDB, which this sets for the session.
    A host is one key, since its rate is one: a page each pause, however many tasks there are.
    """
    wanted.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = wanted.filter("url is not null").select(F.col("id").cast("long").alias("id"), "url", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"))
    return rows.groupBy("host").transformWithStateInPandas(Frontier(get, extract, pause, tuple(backoff), breaker, rest, burst), FOUND, "append", "processingTime")
