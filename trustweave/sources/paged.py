"""Paged API responses as a data source, for batch and stream: a folder with one JSON response a page, each of which names the next.

``register(spark)`` and ``spark.read.format("paged_responses").option("path", folder)``. Pages are read where the tasks run, so the folder must be one that all
executors share, or the class's ``fetch`` another way to get a page by its name.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "id string, modified timestamp, page string, place int, payload string"
_ARROW = pa.schema([("id", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("page", pa.string()), ("place", pa.int32()), ("payload", pa.string())])


class Page(InputPartition):
    """Items of one page from ``start`` up to ``end`` (all where it is None)."""

    def __init__(self, name: str, start: int = 0, end: int | None = None):
        super().__init__(name)
        self.name, self.start, self.end = name, start, end


def _time(said: str | None) -> datetime | None:
    if not said:
        return None
    at = datetime.fromisoformat(said.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


class _Pages:
    """Options of the source and how its pages are read."""

    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("paged_responses needs a path")
        self.first = options.get("first", "page-1.json")
        self.items, self.next, self.id, self.modified = (options.get(k.lower(), v) for k, v in (("items", "value"), ("next", "next"), ("id", "id"), ("modified", "lastModifiedDateTime")))
        self.since = _time(options.get("since"))
        self.exact: list[tuple[str, object]] = []

    def fetch(self, name: str) -> dict:
        """A page by its name; one that is not there yet has no items and no next."""
        path = os.path.join(self.path.removeprefix("file://"), os.path.basename(name))
        if not os.path.exists(path):
            return {}
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def follow(self, name: str) -> Iterator[tuple[str, int]]:
        """Names of the pages from ``name`` on by their next links, with how many items they have; a link back ends it."""
        seen = set()
        while name and name not in seen:
            seen.add(name)
            page = self.fetch(name)
            if not page:
                return
            yield name, len(page.get(self.items) or [])
            name = page.get(self.next)

    def rows(self, part: Page) -> Iterator[pa.RecordBatch]:
        found = (self.fetch(part.name).get(self.items) or [])[part.start : part.end]
        rows = []
        for place, item in enumerate(found, part.start):
            at, key = _time(item.get(self.modified)), item.get(self.id)
            key = None if key is None else str(key)
            if (self.since is None or (at is not None and at >= self.since)) and all({"id": key, "page": part.name}.get(c) == v for c, v in self.exact):
                rows.append((key, at, part.name, place, json.dumps(item, ensure_ascii=False)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """``modified`` from a time on, and one id or page, are looked at where a page is read; a later time than asked for is checked again by Spark."""
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("modified",):
                at = f.value if f.value.tzinfo else f.value.astimezone(timezone.utc)
                self.pages.since = max(filter(None, (self.pages.since, at)))
                if isinstance(f, GreaterThan):
                    yield f
            elif isinstance(f, EqualTo) and f.attribute in (("id",), ("page",)):
                self.pages.exact.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Page]:
        only = {v for c, v in self.pages.exact if c == "page"}
        return [Page(name) for name, n in self.pages.follow(self.pages.first) if n and (not only or only == {name})] or [Page(self.pages.first)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        yield from self.pages.rows(partition)


class _Stream(DataSourceStreamReader):
    """Offsets name the last page and how many of its items were taken, so pages may still grow at their end."""

    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def initialOffset(self) -> dict:
        self.last = {"page": self.pages.first, "items": 0}
        return self.last

    def latestOffset(self) -> dict:
        end = getattr(self, "last", {"page": self.pages.first, "items": 0})
        for name, n in self.pages.follow(end["page"]):
            end = {"page": name, "items": n}
        self.last = end
        return end

    def partitions(self, start: dict, end: dict) -> list[Page]:
        out = []
        for name, n in self.pages.follow(start["page"]):
            out.append(Page(name, start["items"] if name == start["page"] else 0, end["items"] if name == end["page"] else n))
            if name == end["page"]:
                break
        return [p for p in out if p.end > p.start]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        yield from self.pages.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept but Spark's own checkpoint."""


class PagedResponses(DataSource):
    """Items of paged responses: id, modified, page, place (in the page) and payload (the item as JSON). Options: path, first, since, and the names of the fields items, next, id, modified."""

    @classmethod
    def name(cls) -> str:
        return "paged_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedResponses)


def responses(spark: SparkSession, path: str, schema: str, stream: bool = False, **options: str) -> DataFrame:
    """Items of the pages under ``path`` in the columns of ``schema``, besides modified; what the connectors' parsers take. Broken items have nulls."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format("paged_responses").options(path=path, **options)
    return reader.load().select("modified", F.from_json("payload", schema).alias("item")).select("modified", "item.*")
