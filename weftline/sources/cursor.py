"""A cursor-paged connector as a Python data source.

The fetch function is given by its import path, so any service (or a folder of pages in tests) can
stand behind it. Each partition is one query of a plan and pages through it on an executor.
"""

from __future__ import annotations

import importlib
import json
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FATAL = (401, 403)
RETRY = (429, 500, 502, 503, 504)


class FetchError(Exception):
    def __init__(self, status: int, message: str = ""):
        super().__init__(f"status {status} {message}".strip())
        self.status = status


def with_retries(fetch: Callable, *args, attempts: int = 5, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Call with exponential backoff and jitter on 429 and 5xx; 401 and 403 end at once."""
    for n in range(attempts):
        try:
            return fetch(*args)
        except FetchError as e:
            if e.status in FATAL or e.status not in RETRY or n == attempts - 1:
                raise
            sleep(base * 2**n * (1 + random.random()))
    raise AssertionError


def pages(fetch: Callable, query: str, start: str = "*", **kw) -> Iterator[tuple[int, str, dict]]:
    """(page number, cursor, page) until no next cursor; a repeated cursor or page is an error."""
    seen, bodies, cursor, n = set(), set(), start, 0
    while cursor:
        if cursor in seen:
            raise ValueError(f"cursor loop at {cursor!r}")
        seen.add(cursor)
        page = with_retries(fetch, query, cursor, **kw)
        body = json.dumps(page.get("results", []), sort_keys=True)
        if page.get("results") and body in bodies:
            raise ValueError(f"repeated page at {cursor!r}")
        bodies.add(body)
        yield n, cursor, page
        cursor, n = (page.get("meta") or {}).get("next_cursor"), n + 1


class QueryPartition(InputPartition):
    def __init__(self, query: str):
        super().__init__(query)
        self.query = query


class CursorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.queries = options["fetch"], json.loads(options["queries"])

    def partitions(self) -> list[InputPartition]:
        return [QueryPartition(q) for q in self.queries]

    def read(self, partition: QueryPartition) -> Iterator[tuple]:
        module, _, name = self.fetch.rpartition(":")
        fetch = getattr(importlib.import_module(module), name)
        for n, cursor, page in pages(fetch, partition.query):
            for i, r in enumerate(page.get("results") or []):
                yield partition.query, n, cursor, i, json.dumps(r, sort_keys=True)


class CursorSource(DataSource):
    """spark.read.format("cursor_pages").option("fetch", "package.module:function").option("queries", json list)"""

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return "query string, page int, cursor string, record_index int, record string"

    def reader(self, schema) -> CursorReader:
        return CursorReader(self.options)
