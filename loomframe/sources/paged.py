"""A paged source as a Python data source (SRC-05..07): partitions by year, pages in order.

It reads recorded responses, `<path>/<year>/<page>.json`, each {"page", "total_pages", "results"};
a live client would take the place of `fetch`, under the same throttle.
"""

from __future__ import annotations

import json
import os
import time
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Throttle:
    """At most `calls` per sliding period, and a least gap between two."""

    def __init__(self, calls: int = 40, period: float = 10.0, gap: float = 0.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.calls, self.period, self.gap, self.clock, self.sleep = calls, period, gap, clock, sleep
        self.times: deque[float] = deque()

    def wait(self) -> None:
        now = self.clock()
        while self.times and self.times[0] <= now - self.period:
            self.times.popleft()
        if len(self.times) >= self.calls:
            self.sleep(max(0.0, self.times[0] + self.period - now))
        if self.times and self.clock() - self.times[-1] < self.gap:
            self.sleep(self.gap - (self.clock() - self.times[-1]))
        self.times.append(self.clock())


def retry(call: Callable[[], dict], tries: int = 3, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Again after timeouts, with doubled pauses."""
    for n in range(tries):
        try:
            return call()
        except TimeoutError:
            if n == tries - 1:
                raise
            sleep(base * 2**n)
    raise AssertionError("unreachable")


class Year(InputPartition):
    def __init__(self, year: int) -> None:
        super().__init__(year)
        self.year = year


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.first, self.last = int(options.get("year_min", 1950)), int(options.get("year_max", 2025))
        self.cap = int(options.get("max_pages", 500))

    def partitions(self) -> list[Year]:
        return [Year(y) for y in range(self.first, self.last + 1)]

    def fetch(self, year: int, page: int) -> dict:
        with open(os.path.join(self.path, str(year), f"{page}.json"), encoding="utf-8") as f:
            return json.load(f)

    def read(self, partition: Year) -> Iterator[tuple]:
        throttle, page, total = Throttle(), 1, 1
        while page <= min(total, self.cap):
            throttle.wait()
            try:
                got = retry(lambda p=page: self.fetch(partition.year, p))
            except FileNotFoundError:
                return
            total = int(got.get("total_pages", 1))
            for film in got.get("results", []):
                yield (partition.year, page, json.dumps(film, ensure_ascii=False))
            page += 1


class Ids(InputPartition):
    def __init__(self, ids: list[str]) -> None:
        super().__init__(ids)
        self.ids = ids


class EntityReader(DataSourceReader):
    """SRC-06: one response per id of a resource (details, credits, keywords, ...), or one for the whole resource."""

    def __init__(self, options: dict) -> None:
        self.path, self.resource = options["path"], options.get("resource", "details")
        self.ids, self.block = [i for i in options.get("ids", "").split(",") if i], int(options.get("block", 100))

    def partitions(self) -> list[Ids]:
        return [Ids(self.ids[i : i + self.block]) for i in range(0, len(self.ids), self.block)] or [Ids([""])]

    def fetch(self, id_: str) -> str:
        with open(os.path.join(self.path, self.resource, f"{id_ or 'all'}.json"), encoding="utf-8") as f:
            return json.dumps(json.load(f), ensure_ascii=False)

    def read(self, partition: Ids) -> Iterator[tuple]:
        throttle = Throttle()
        for i in partition.ids:
            throttle.wait()
            try:
                yield (i, self.resource, retry(lambda i=i: self.fetch(i)))
            except FileNotFoundError:
                yield (i, self.resource, None)


class Entities(DataSource):
    """A missing entity gives a row with a null body."""

    @classmethod
    def name(cls) -> str:
        return "film_entities"

    def schema(self) -> str:
        return "id string, resource string, body string"

    def reader(self, schema) -> EntityReader:  # noqa: ANN001
        return EntityReader(self.options)


class PagedFilms(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_films"

    def schema(self) -> str:
        return "year int, page int, film string"

    def reader(self, schema) -> PagedReader:  # noqa: ANN001
        return PagedReader(self.options)
