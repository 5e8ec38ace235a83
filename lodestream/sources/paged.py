"""A data source for services that hand out JSON lines page by page.

One partition for each (crawl, ending): pages are fetched until one is sparse (under half a page) or the
limit is reached; failed requests are repeated with doubling pauses. The fetching function is an option, a
``module:function`` that takes (crawl, ending, page, size) and returns (status, text), so the source itself
knows no service; ``folder_pages`` serves pages kept in a folder.
"""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_ROWS, RETRIED = 100, (502, 503, 504)
FIELDS = ("url", "status", "mime", "languages")


def page_address(base: str, ending: str, page: int, size: int) -> str:
    """The address of one page of a service: all hosts of an ending, no filters, which are applied to what comes back."""
    return f"{base}?url=*.{ending}&output=json&limit={min(size, MOST_ROWS)}&fl={','.join(FIELDS)}&page={page}"


def folder_pages(folder: str) -> Callable[[str, str, int, int], tuple[int, str]]:
    def fetch(crawl: str, ending: str, page: int, size: int) -> tuple[int, str]:
        path = f"{folder}/{crawl}-{ending}-{page}.jsonl"
        if not os.path.exists(path):
            return 404, ""
        with open(path, encoding="utf-8") as f:
            return 200, "".join(line for line, _ in zip(f, range(size), strict=False))

    return fetch


def fetch_page(fetch, crawl: str, ending: str, page: int, size: int, retries: int, pause: float) -> list[dict]:
    """The valid records of one page; none for a missing page. Raises when all tries failed."""
    for n in range(retries + 1):
        status, text = fetch(crawl, ending, page, size)
        if status == 404:
            return []
        if status == 200:
            break
        if n == retries or status not in RETRIED:
            raise OSError(f"page {page} of {crawl} {ending}: status {status}")
        time.sleep(pause * 2**n)
    out = []
    for line in text.splitlines():
        try:
            record = json.loads(line)
        except ValueError:
            continue
        if isinstance(record, dict):
            out.append(record)
    return out


class _Part(InputPartition):
    def __init__(self, crawl: str, ending: str) -> None:
        self.crawl, self.ending = crawl, ending


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        split = lambda k: [x for x in self.options.get(k, "").split(",") if x]
        return [_Part(c, e) for c in split("crawls") for e in split("endings")]

    def read(self, partition: _Part) -> Iterator[tuple]:
        module, _, name = self.options.get("fetch", "lodestream.sources.paged:folder_pages").partition(":")
        make = getattr(importlib.import_module(module), name)
        fetch, size = make(self.options["path"]), min(MOST_ROWS, int(self.options.get("pagesize", MOST_ROWS)))
        for page in range(int(self.options.get("pages", 3))):
            got = fetch_page(fetch, partition.crawl, partition.ending, page, size, int(self.options.get("retries", 2)), float(self.options.get("pause", 8)))
            for r in got:
                yield (partition.crawl, partition.ending, page, *(None if r.get(f) is None else str(r[f]) for f in FIELDS))
            if len(got) < size / 2:
                break


class PagedIndex(DataSource):
    """``spark.dataSource.register(PagedIndex)``, then ``spark.read.format("paged_index")`` with crawls, endings and path."""

    @classmethod
    def name(cls) -> str:
        return "paged_index"

    def schema(self) -> str:
        return "crawl string, ending string, page int, url string, status string, mime string, languages string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
