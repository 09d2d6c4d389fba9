"""Upstreams that answer in pages: a Python data source that walks every request to its end, and what may be kept of a poll.

A request is a key such as a day or a list; each is one partition, so the pages of different requests are read side by
side. Rows are passed on as they come. The last row of a request says how it ended; a request that fails or meets its
page limit is a row of the table and not a failed job, so the requests before it still count. Land what was read (write it)
before it is asked which requests are complete, or the upstream is walked again for each question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Page:
    """Rows of a page; `cursor` leads to the next one (None or "": there is none), `total` is the upstream's count of all rows."""

    rows: list[tuple]
    cursor: str | None = None
    total: int | None = None


@dataclass
class Walk:
    """How the pages of a request end: 'short' page, 'total' reached, or no further 'cursor'."""

    rule: str
    page_size: int
    max_pages: int
    seen: int = field(default=0, init=False)

    def __post_init__(self):
        if self.rule not in ("short", "total", "cursor"):
            raise ValueError(f"unknown rule: {self.rule}")

    def ended(self, page: Page) -> bool:
        self.seen += len(page.rows)
        if self.rule == "short":
            return len(page.rows) < self.page_size
        if self.rule == "total":
            return self.seen >= (len(page.rows) if page.total is None else page.total)
        return not page.cursor


class Request(InputPartition):
    def __init__(self, key: str):
        self.key = key


def walked(key: str, fetch: Callable[[str, int, str | None], Page], walk: Walk, width: int) -> Iterator[tuple]:
    """(key, None, *row) of every row, then (key, outcome, nulls) with the outcome 'complete' or the error."""
    nothing, cursor = (None,) * width, None
    try:
        for number in range(walk.max_pages):
            page = fetch(key, number, cursor)
            yield from ((key, None, *row) for row in page.rows)
            if walk.ended(page):
                yield (key, "complete", *nothing)
                return
            cursor = page.cursor
        yield (key, f"page limit of {walk.max_pages} reached", *nothing)
    except Exception as error:  # whatever the upstream does is the outcome of this request
        yield (key, f"{type(error).__name__}: {error}", *nothing)


def page_source(name: str, ddl: str, width: int, fetch: Callable[[str, int, str | None], Page]) -> type[DataSource]:
    """A data source class for spark.dataSource.register; options: requests (comma-separated), rule, page_size (100), max_pages (50).

    fetch(request, page number, cursor) gives a page whose rows have the `width` columns of ddl. The table is request,
    outcome and those columns.
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.keys = [k for k in options.get("requests", "").split(",") if k]
            self.rule, self.size, self.pages = options.get("rule", "short"), int(options.get("page_size", 100)), int(options.get("max_pages", 50))
            Walk(self.rule, self.size, self.pages)

        def partitions(self):
            return [Request(k) for k in self.keys] or [Request("")]

        def read(self, partition) -> Iterator[tuple]:
            if partition.key:
                yield from walked(partition.key, fetch, Walk(self.rule, self.size, self.pages), width)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"request string, outcome string, {ddl}"

        def reader(self, schema):
            return Reader(self.options)

    return Source


def outcomes(read: DataFrame) -> DataFrame:
    """request, n_rows, outcome of every request; one that never said how it ended is 'unfinished'."""
    ended = F.coalesce(F.max("outcome"), F.lit("unfinished")).alias("outcome")
    return read.groupBy("request").agg(F.count_if(F.col("outcome").isNull()).alias("n_rows"), ended)


def kept(read: DataFrame, contiguous: bool = True) -> DataFrame:
    """The rows of requests that are complete; contiguous: and that come, in order of the request, before the first that is not.

    read is the landed table. The ends of requests are one row each and the first bad one a single row; rows are only filtered.
    """
    done = outcomes(read).withColumn("ok", F.col("outcome") == "complete")
    if contiguous:
        bad = done.agg(F.min(F.when(~F.col("ok"), F.col("request"))).alias("bad"))
        done = done.join(bad, F.col("bad").isNull() | (F.col("request") < F.col("bad")), "left_semi")
    return read.where("outcome IS NULL").join(done.where("ok").select("request"), "request", "left_semi").drop("outcome")


def cursor(read: DataFrame) -> DataFrame:
    """cursor: the last request before the first that is not complete; null if the first already fails or there is none."""
    done = outcomes(read).select("request", (F.col("outcome") == "complete").alias("ok"))
    bad = done.agg(F.min(F.when(~F.col("ok"), F.col("request"))).alias("bad"))
    reached = done.join(bad, F.col("bad").isNull() | (F.col("request") < F.col("bad")), "left_semi")
    return reached.agg(F.max("request").alias("cursor"))


def sampled(refreshes: Iterable[Iterable[list[tuple]]], limit: int, empty_rounds: int) -> Iterator[tuple]:
    """(rank, id, ...) of the distinct rows (id, ...) of a surface that is read in rounds, in the order in which they were seen.

    A refresh is left after so many rounds in a row without a new id; the whole ends at the limit. Rounds are drawn one by
    one, so none is asked for that the rule does not need. Rows with a null or empty id don't count.
    """
    seen: set = set()
    for rounds in refreshes:
        empty = 0
        for rows in rounds:
            before = len(seen)
            for row in rows:
                if not row[0] or row[0] in seen:
                    continue
                seen.add(row[0])
                yield (len(seen), *row)
                if len(seen) >= limit:
                    return
            empty = empty + 1 if len(seen) == before else 0
            if empty >= empty_rounds:
                break
