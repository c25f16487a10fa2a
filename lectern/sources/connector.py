"""Paged services: answers are followed page by page, with retries, back-off and the waits that a service asks for.

A fetcher is a function from a request, a dict, to an Answer; opening connections is its business. Whoever asks is a task of
Spark's, in one of two ways:

* `fetched` takes a DataFrame of requests, each of which is followed to its end by one task;
* the data source `catalogue` makes its requests from its options and from the conditions of the query that reads it:

    connector.register(spark)
    spark.read.format("catalogue").option("fetch", "module:function").option("queries", "a;b").load().where("year < 1500")

  Conditions on query, identifier and year reach the requests, and partitions that they rule out are not made.

A request that is still refused after all tries fails its task, and Spark's own retries begin it anew from its first page; so a result
is whole or there is none. What the service does not have (404, 410) is no rows.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

GONE = (404, 410)
IDENTIFIERS = 100  # of one request
ITEM = "pos int, identifier string, year int, payload string"


class Answer(NamedTuple):
    status: int
    body: object = None
    headers: dict = {}


class Page(NamedTuple):
    """What a reader of bodies finds: the entries, the cursor of the next page, and how many entries there are in all, where it says so."""

    items: list
    cursor: str | None = None
    total: int | None = None


class RefusedError(Exception):
    pass


def plain_page(body: dict) -> Page:
    return Page(body.get("items") or [], body.get("next"), body.get("total"))


def inscriptions_page(body: dict) -> Page:
    """SRC-18: entries without an object are none, but count for the place of the next page."""
    entries = body.get("data") or []
    return Page([e["obj"] if isinstance(e, dict) and e.get("obj") else None for e in entries], None, body.get("recordsFiltered") or 0)


class Pager:
    """SRC-18, SRC-33, TOP-06: asks a fetcher until an answer comes, and for page after page until there is none or the limit is reached."""

    def __init__(
        self,
        fetch: Callable[[dict], Answer],
        page: Callable[[dict], Page] = plain_page,
        size: int = 100,
        limit: int | None = None,
        tries: int = 3,
        delay: float = 1.0,
        wait: float = 60.0,
        sleep: Callable[[float], None] = time.sleep,
    ):
        self.fetch, self.page, self.size, self.limit = fetch, page, size, limit
        self.tries, self.delay, self.wait, self.sleep = tries, delay, wait, sleep

    def ask(self, request: dict) -> object | None:
        """The body of the answer; None for what is gone. A failure waits longer each time, a full service for as long as it says."""
        problem: object = "no try"
        for attempt in range(1, self.tries + 1):
            pause = self.delay * attempt
            try:
                answer = self.fetch(request)
            except Exception as e:  # whatever a connection can come to
                problem = e
            else:
                if answer.status == 200:
                    return answer.body
                if answer.status in GONE:
                    return None
                problem = f"status {answer.status}"
                if answer.status == 429:
                    asked = str(answer.headers.get("Retry-After", ""))
                    pause = float(asked) if asked.isdigit() else self.wait
                elif answer.status < 500:
                    break
            if attempt < self.tries:
                self.sleep(pause)
        raise RefusedError(f"{request}: {problem}")

    def items(self, request: dict) -> Iterator[object]:
        """The entries of all pages in order, by cursors where the service gives them, else by places."""
        found = start = 0
        cursor: str | None = None
        while self.limit is None or found < self.limit:
            size = self.size if self.limit is None else min(self.size, self.limit - found)
            body = self.ask(request | {"start": start, "size": size} | ({"cursor": cursor} if cursor is not None else {}))
            page = self.page(body) if body else Page([])
            for item in page.items:
                if item is not None and (self.limit is None or found < self.limit):
                    yield item
                    found += 1
            start, cursor = start + size, page.cursor
            if not page.items or cursor is None and (page.total is None or start >= page.total):
                return


def fetched(requests: DataFrame, key: str, factory: Callable[[dict], Pager], entry: Callable[[object], dict] | None = None) -> DataFrame:
    """(key, pos, identifier, year, payload) of requests (key, request, ...): request is JSON; factory makes the pager of a row.

    entry names the identifier and year of an item, an item's own fields by default; the payload is the item as JSON.
    """
    kind = requests.schema[key].dataType.simpleString()
    arrow = pa.schema([(key, requests.select(key).limit(0).toArrow().schema.field(0).type), ("pos", pa.int32()), ("identifier", pa.string()), ("year", pa.int32()), ("payload", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                for pos, item in enumerate(factory(row).items(json.loads(row["request"]))):
                    rows.append(_named(item, entry) | {key: row[key], "pos": pos})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return requests.mapInArrow(run, f"{key} {kind}, {ITEM}")


def _named(item: object, entry: Callable[[object], dict] | None) -> dict:
    fields = entry(item) if entry else item if isinstance(item, dict) else {}
    year, name = fields.get("year"), fields.get("identifier")
    return {
        "identifier": None if name is None else str(name),
        "year": int(year) if year is not None else None,
        "payload": json.dumps(item, ensure_ascii=False),
    }


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Catalogue)


class Catalogue(DataSource):
    """Options: fetch and page (module:function), queries (by semicolons), years (from-to) and slices, size, limit, tries, delay, wait.

    Each query and each of the slices of the years is a partition; limit holds for each partition. Other options go to the fetcher with the request.
    """

    OWN = ("fetch", "page", "queries", "years", "slices", "size", "limit", "tries", "delay", "wait", "path")

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return f"query string, {ITEM}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _imported(name: str):
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.queries = [q for q in options.get("queries", "").split(";") if q] or [""]
        years = options.get("years", "").partition("-")
        self.low, self.high = (int(years[0]), int(years[2])) if years[1] else (None, None)
        self.identifiers: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Those on query are done with here; the service may take others loosely, so Spark looks again."""
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column == "query" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.queries = [q for q in self.queries if q in wanted]
                continue
            if column == "identifier" and isinstance(f, EqualTo | In):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.identifiers = [i for i in wanted if i is not None and (self.identifiers is None or i in self.identifiers)]
            if column == "year" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    low = f.value + isinstance(f, GreaterThan)
                    self.low = low if self.low is None else max(low, self.low)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    high = f.value - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(high, self.high)
            yield f

    def partitions(self) -> list[InputPartition]:
        ranges = [{k: v for k, v in (("from", self.low), ("to", self.high)) if v is not None}]
        if self.low is not None and self.high is not None:
            slices = min(int(self.options.get("slices", "1")), max(0, self.high - self.low + 1))
            width = self.high - self.low + 1
            cuts = [self.low + width * i // slices for i in range(slices + 1)] if slices else []
            ranges = [{"from": a, "to": b - 1} for a, b in zip(cuts, cuts[1:], strict=False)]
        named: list[dict] = [{}]
        if self.identifiers is not None:
            named = [{"identifiers": self.identifiers[i : i + IDENTIFIERS]} for i in range(0, len(self.identifiers), IDENTIFIERS)]
        made = [{"query": q} | r | n for q in self.queries for r in ranges for n in named]
        return [InputPartition(json.dumps(m)) for m in made] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        options, request = self.options, json.loads(partition.value)
        more = {k: v for k, v in options.items() if k not in Catalogue.OWN}
        pager = Pager(
            _imported(options["fetch"]),
            _imported(options["page"]) if "page" in options else plain_page,
            int(options.get("size", "100")),
            int(options["limit"]) if "limit" in options else None,
            int(options.get("tries", "3")),
            float(options.get("delay", "1")),
            float(options.get("wait", "60")),
        )
        for pos, item in enumerate(pager.items(more | request)):
            named = _named(item, None)
            yield request["query"], pos, named["identifier"], named["year"], named["payload"]
