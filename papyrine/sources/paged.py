"""Paged sources: a Python data source that walks the pages of remote searches, and the same pages as a table.

A page is a row (source, stratum, page, status, body, error). What went wrong is data, never an exception: a status that is no
success, a body that is no JSON and a connection that broke each end their source's walk with a row that says so, and
the pages before it are kept. So one source that fails in the middle cannot end a job, and `outcomes` tells which sources answered.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = "source string, stratum string, page int, status int, body string, error string"


def fetch(url: str, tries: int = 3, pause: float = 1.5, timeout: float = 30.0) -> tuple[int, str]:
    """(status, body) of a GET. What may pass is tried again after 1, 2, .. pauses; a refusal by status 4xx is final, but for 429."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as error:
            if error.code < 500 and error.code != 429:
                return error.code, ""
            if k == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError, OSError, ValueError):
            if k == tries - 1:
                raise
        time.sleep(pause * (k + 1))
    raise AssertionError("unreachable")


def no_json(body: str) -> str | None:
    """What is wrong with a body that should be JSON; null if nothing."""
    try:
        json.loads(body)
    except ValueError:
        return f"no JSON ({len(body)} characters): {' '.join(body.split())[:200]}"
    return None


class Stratum(InputPartition):
    """One source and one stratum of it (a year, say): pages of one partition are walked in order."""

    def __init__(self, source: str, stratum: str | None, url: str):
        self.source, self.stratum, self.url = source, stratum, url


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.sources = json.loads(options["sources"])
        self.items, self.cursor = options.get("items", "items"), options.get("cursor", "next")
        self.most, self.pause, self.tries = int(options.get("most", 1 << 30)), float(options.get("pause", 1.5)), int(options.get("tries", 3))

    def partitions(self) -> list[Stratum]:
        return [Stratum(s["source"], x, s["url"]) for s in self.sources for x in s.get("strata") or [None]]

    def read(self, partition: Stratum) -> Iterator[tuple]:
        """Pages until the cursor ends, a page is empty or fails, or `most` items of the stratum are met."""
        cursor, met, page = "", 0, 0
        while met < self.most:
            own = (partition.source, partition.stratum, page)
            fill = {"{cursor}": cursor, "{stratum}": partition.stratum or ""}
            url = partition.url
            for name, value in fill.items():
                url = url.replace(name, urllib.parse.quote(value, safe=""))
            try:
                status, body = fetch(url, self.tries, self.pause)
            except Exception as error:  # what the source did is a row of the result
                yield (*own, None, None, f"{type(error).__name__}: {error}"[:400])
                return
            if status == 404:  # nothing there is an answer
                yield (*own, 404, None, None)
                return
            error = f"status {status}" if status >= 300 else no_json(body)
            yield (*own, status, None if error else body, error)
            if error:
                return
            found = json.loads(body)
            met += len(found.get(self.items) or [])
            cursor, page = found.get(self.cursor) or "", page + 1
            if not cursor or not found.get(self.items):
                return


class PagedSource(DataSource):
    """format("paged"): option sources, a JSON list of {source, url, strata}; {cursor} and {stratum} in a url are filled in. Options items and cursor name the two fields of a page, most bounds the items of a stratum."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def pages(spark: SparkSession, sources: list[dict], **options) -> DataFrame:
    """The pages of the sources ({source, url, strata}), one task a source and stratum."""
    from papyrine.session import reachable

    reachable(spark).dataSource.register(PagedSource)
    out = spark.read.format("paged").option("sources", json.dumps(sources))
    for name, value in options.items():
        out = out.option(name, str(value))
    return out.load()


def judged(recorded: DataFrame) -> DataFrame:
    """Recorded answers (source, stratum, page, status, body) as pages: those behind a failed one of their stratum were never met, and a body that is no JSON is an error."""
    said = F.regexp_replace(F.trim(F.regexp_replace("body", r"\s+", " ")), "^(.{200}).*$", "$1")
    parsed = F.try_parse_json("body")
    error = F.when(F.col("status") == 404, None).when(F.col("status") >= 300, F.concat(F.lit("status "), F.col("status").cast("string")))
    error = error.when(parsed.isNull(), F.concat(F.lit("no JSON ("), F.length("body").cast("string"), F.lit(" characters): "), said))
    rows = recorded.select("source", "stratum", "page", "status", "body", error.alias("error"))
    first = rows.where("error IS NOT NULL").groupBy("source", "stratum").agg(F.min("page").alias("_end"))
    same = F.col("s.source").eqNullSafe(F.col("f.source")) & F.col("s.stratum").eqNullSafe(F.col("f.stratum"))
    met = rows.alias("s").join(first.alias("f"), same, "left").where("_end IS NULL OR page <= _end")
    return met.select("s.source", "s.stratum", "page", "status", F.when(F.col("error").isNull() & (F.col("status") != 404), F.col("body")).alias("body"), "error")


def outcomes(met: DataFrame) -> DataFrame:
    """One row a source: whether it answered (no stratum of it failed), its first error, its pages."""
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("stratum", "page", "error")))["error"]
    return met.groupBy("source").agg((F.count("error") == 0).alias("answered"), first.alias("error"), F.count("body").alias("n_pages"))


def items(met: DataFrame, item: str, field: str = "items") -> DataFrame:
    """(source, stratum, place, item): the items of good pages in their order, parsed by the DDL `item`; place counts from 0 within the page, pages first."""
    rows = met.where("body IS NOT NULL").select("source", "stratum", "page", F.from_json("body", f"`{field}` array<{item}>").alias("b"))
    each = rows.select("source", "stratum", "page", F.posexplode(f"b.`{field}`").alias("n", "item"))
    return each.select("source", "stratum", F.struct("page", "n").alias("place"), "item")


def stratified(found: DataFrame, most: int) -> DataFrame:
    """The first `most` items of each stratum of each source."""
    from papyrine.operators.relational import top

    return top(found, ["source", "stratum"], [F.col("place")], most).drop("rank")
