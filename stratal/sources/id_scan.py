"""An upstream that numbers its items: bounded id-range scans as a Python data source, batch and streaming.

The adapter gives two functions, the upstream's largest id and the rows of a range. A batch read deals the bounded
range out over tasks. A stream's offset is the last id read: each micro-batch takes at most `limit` ids after it, and
Spark commits the offset only after the batch is written, so a cursor advances only over what arrived.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

Rows = Iterable[tuple]


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def id_source(name: str, ddl: str, upstream_max: Callable[[], int], fetch: Callable[[int, int], Rows]) -> type[DataSource]:
    """A data source class for spark.dataSource.register; options: previous (0), limit (20000), per_task (1000)."""

    class Batch(DataSourceReader):
        def __init__(self, options):
            self.previous, self.limit, self.per_task = (int(options.get(k, d)) for k, d in (("previous", 0), ("limit", 20_000), ("per_task", 1_000)))

        def partitions(self):
            last = min(upstream_max(), self.previous + self.limit)
            return [Range(k, min(last, k + self.per_task - 1)) for k in range(self.previous + 1, last + 1, self.per_task)]

        def read(self, partition) -> Iterator[tuple]:
            if partition is not None:
                yield from fetch(partition.first, partition.last)

    class Stream(SimpleDataSourceStreamReader):
        def __init__(self, options):
            self.previous, self.limit = int(options.get("previous", 0)), int(options.get("limit", 20_000))

        def initialOffset(self):  # noqa: N802
            return {"id": self.previous}

        def read(self, start):
            last = max(start["id"], min(upstream_max(), start["id"] + self.limit))
            return iter(list(fetch(start["id"] + 1, last)) if last > start["id"] else []), {"id": last}

        def readBetweenOffsets(self, start, end):  # noqa: N802
            return iter(list(fetch(start["id"] + 1, end["id"])))

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ddl

        def reader(self, schema):
            return Batch(self.options)

        def simpleStreamReader(self, schema):  # noqa: N802
            return Stream(self.options)

    return Source
