"""Searches of publication services as Spark data sources: tasks ask for the pages, and the year of a query's filter goes into the request.

``answers(spark, service)`` is a table (year, page, cursor, answer, cut) of raw answers. A filter on ``year`` by = or IN
is pushed into the requests and so is needed: ``answers(spark, s).filter("year = 2024")``. A repository that tells how
many pages there are is read with a partition a page; services that only tell where to go on (tokens, cursors) are read
one after the other, with a partition a year. An answer that doesn't come, or can't be read, fails the query: records
would be missing unseen. A search that is cut at ``max_pages`` says so in ``cut``.

Requests go through an opener (address -> bytes, None for no answer), ``harvest.Fetcher`` by default; it is sent to the
tasks, so tests and mirrors put in their own. A task that is run again asks again.
"""

from __future__ import annotations

import json
import re
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from corvane.sources import harvest

Opener = Callable[[str], bytes | None]
SCHEMA = "year int, page int, cursor string, answer string, cut boolean"


class NoAnswer(RuntimeError):
    """A page that wasn't answered, or not in a readable way."""


@dataclass(frozen=True)
class Dspace:
    """A DSpace 7 repository; its answers tell how many pages there are."""

    base_url: str
    query: str = "dc.year.issued:{year} AND dc.relation.doi:[* TO *]"
    size: int = 100

    def address(self, year: int, page: int) -> str:
        asked = {"query": self.query.format(year=year), "dsoType": "ITEM", "size": self.size, "page": page}
        return f"{self.base_url}/discover/search/objects?{urllib.parse.urlencode(asked)}"

    def pages(self, ask: Opener, year: int) -> int:
        """How many pages a year has, from the first."""
        return int(_json(ask, self.address(year, 0))["_embedded"]["searchResult"]["page"]["totalPages"])

    def page(self, ask: Opener, year: int, page: int) -> str:
        told = _json(ask, self.address(year, page))
        if "objects" not in told.get("_embedded", {}).get("searchResult", {}).get("_embedded", {}):
            raise NoAnswer(f"{self.base_url}: page {page} of {year} lists nothing")
        return json.dumps(told)


@dataclass(frozen=True)
class Oai:
    """An OAI-PMH endpoint; each answer names the token of the next."""

    base_url: str
    set_spec: str = "publications:year{year}"

    def walk(self, ask: Opener, year: int) -> Iterator[tuple[int, str, str, bool]]:
        token, page, seen = "", 0, set()
        while page == 0 or token:
            asked = {"verb": "ListRecords", "resumptionToken": token} if token else {"verb": "ListRecords", "metadataPrefix": "oai_dc", "set": self.set_spec.format(year=year)}
            body = ask(f"{self.base_url}?{urllib.parse.urlencode(asked, safe=':')}")
            if body is None:
                raise NoAnswer(f"{self.base_url}: no answer to page {page} of {year}")
            try:
                root = ET.fromstring(body)
            except ET.ParseError as e:
                raise NoAnswer(f"{self.base_url}: page {page} of {year} is no XML") from e
            yield page, token, body.decode("utf-8"), False
            seen.add(token)
            token = next((t for n in root.iter() if n.tag.rpartition("}")[2] == "resumptionToken" for t in [(n.text or "").strip()] if t), "")
            if token in seen and token:
                raise NoAnswer(f"{self.base_url}: page {page} of {year} leads back to an earlier one")
            page += 1


@dataclass(frozen=True)
class EuropePmc:
    """A search that goes on by cursors, for at most ``max_pages``."""

    base_url: str
    names: tuple[str, ...]
    place: str
    grants: tuple[str, ...] = ()
    max_pages: int = 20
    size: int = 1000

    def walk(self, ask: Opener, year: int) -> Iterator[tuple[int, str, str, bool]]:
        query, cursor = harvest.acknowledgement_query(self.names, self.grants, year, self.place), "*"
        for page in range(1, self.max_pages + 1):
            asked = {"query": query, "format": "json", "pageSize": max(1, min(self.size, 1000)), "cursorMark": cursor, "resultType": "lite"}
            told = _json(ask, f"{self.base_url}/search?{urllib.parse.urlencode(asked)}")
            if "resultList" not in told:
                raise NoAnswer(f"{self.base_url}: page {page} of {year} holds no results")
            after = told.get("nextCursorMark")
            goes_on = bool(told["resultList"].get("result")) and bool(after) and after != cursor
            yield page, cursor, json.dumps(told), goes_on and page == self.max_pages
            if not goes_on:
                return
            cursor = after


Service = Dspace | Oai | EuropePmc


def _json(ask: Opener, url: str) -> dict:
    body = ask(url)
    try:
        told = json.loads(body) if body else None
    except ValueError as e:
        raise NoAnswer(f"{url}: the answer is no JSON") from e
    if not isinstance(told, dict):
        raise NoAnswer(f"{url}: no answer")
    return told


@dataclass
class Part(InputPartition):
    """A year, or one page of it."""

    year: int
    page: int | None = None


@dataclass
class AnswerReader(DataSourceReader):
    """Turns the years that are asked for into partitions, and these into answers."""

    service: Service
    opener: Opener
    years: set[int] | None = field(default=None)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            asked = {EqualTo: lambda: {f.value}, In: lambda: set(f.value)}.get(type(f), lambda: None)() if getattr(f, "attribute", None) == ("year",) else None
            if asked is None:
                yield f
            else:
                named = {int(y) for y in asked if y is not None}
                self.years = named if self.years is None else self.years & named

    def partitions(self) -> list[Part]:
        if self.years is None:
            raise ValueError("which year? filter the answers by year = ... or year IN (...)")
        if not isinstance(self.service, Dspace):
            return [Part(y) for y in sorted(self.years)]
        return [Part(y, p) for y in sorted(self.years) for p in range(self.service.pages(self.opener, y))]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.page is not None:
            yield partition.year, partition.page, None, self.service.page(self.opener, partition.year, partition.page), False
        elif not isinstance(self.service, Dspace):
            for row in self.service.walk(self.opener, partition.year):
                yield (partition.year, *row)


def answers(spark: SparkSession, service: Service, opener: Opener | None = None) -> DataFrame:
    """(year, page, cursor, answer, cut): the answers of a service to the years that the query filters by."""
    ask = opener or harvest.Fetcher()
    named = f"corvane_{re.sub(r'[^a-z]', '', type(service).__name__.lower())}"

    class Answers(DataSource):
        """The answers of one service; it goes to the tasks with its opener."""

        @classmethod
        def name(cls) -> str:
            return named

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> AnswerReader:
            return AnswerReader(service, ask)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the year has to reach the requests
    spark.dataSource.register(Answers)
    return spark.read.format(named).load()


def candidates(spark: SparkSession, service: Service, years: list[int], opener: Opener | None = None, **settings) -> DataFrame:
    """The records of a service for some years, as candidates: the answers, read by what knows their form."""
    asked = answers(spark, service, opener).filter(F.col("year").isin(*years))
    if isinstance(service, Dspace):
        return harvest.dspace_items(asked, F.col("year"), base_url=service.base_url, **settings)
    if isinstance(service, Oai):
        prefix = settings.pop("file_prefix", service.base_url.rsplit("/oai", 1)[0] + "/files/")
        return harvest.oai_items(asked, file_prefix=prefix, **settings)
    return harvest.search_hits(asked, F.col("year"), service.max_pages)
