"""An upstream of several lists, each with a cursor of its own: a streaming source whose offset is a map from list to cursor.

A micro-batch reads, for each list, what lies between its two cursors, and `overlap` cursors before it once more, as
upstreams add rows late; readers of the stream take a row once (by its id). A list that can't be asked keeps its cursor,
so that the next batch reads what this one could not, and the other lists go on. What was committed is kept in the
stream's own folder, so that a restarted stream knows the cursor of a list that fails at once; it is a batch behind, so
such a list may be read from there again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Span(InputPartition):
    def __init__(self, name: str, after: int, upto: int):
        self.name, self.after, self.upto = name, after, upto


class Cursors:
    """The last committed map, as one small file in a folder that driver restarts survive."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root)

    def load(self) -> dict[str, int]:
        try:
            with self.fs.open_input_stream(f"{self.root}/cursors.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {}

    def save(self, cursors: dict[str, int]) -> None:
        self.fs.create_dir(self.root, recursive=True)
        staged = f"{self.root}/{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(staged) as f:
            f.write(json.dumps(cursors, sort_keys=True).encode())
        self.fs.move(staged, f"{self.root}/cursors.json")


def list_source(name: str, ddl: str, lists: Callable[[], list[str]], newest: Callable[[str], int], fetch: Callable[[str, int, int], Iterable[tuple]]) -> type[DataSource]:
    """A data source class for spark.dataSource.register.

    lists() names the lists, newest(list) is its last cursor, fetch(list, after, upto) gives the rows with after < cursor <=
    upto; any of the last two may raise. Options: state (a folder, required), overlap (0), limit (10000 cursors of a list
    in a batch), per_task (2000).
    """

    class Reader(DataSourceStreamReader):
        def __init__(self, options):
            self.overlap, self.limit, self.per_task = (int(options.get(k, d)) for k, d in (("overlap", 0), ("limit", 10_000), ("per_task", 2_000)))
            self.cursors = Cursors(options["state"])
            self.last: dict[str, int] = self.cursors.load()

        def initialOffset(self):  # noqa: N802
            return {}

        def latestOffset(self):  # noqa: N802
            reached = dict(self.last)
            for one in lists():
                try:
                    reached[one] = max(reached.get(one, 0), min(newest(one), reached.get(one, 0) + self.limit))
                except Exception:  # noqa: BLE001  whatever the upstream raises, this list stays where it is
                    reached.setdefault(one, 0)
            return reached

        def partitions(self, start, end):
            self.last = {k: max(v, end.get(k, 0)) for k, v in self.last.items()} | {k: v for k, v in end.items() if k not in self.last}
            spans = []
            for one, upto in sorted(end.items()):
                after = start.get(one, 0)
                if upto > after:
                    first = max(0, after - self.overlap)
                    spans += [Span(one, k, min(upto, k + self.per_task)) for k in range(first, upto, self.per_task)]
            return spans

        def read(self, partition) -> Iterator[tuple]:
            yield from fetch(partition.name, partition.after, partition.upto)

        def commit(self, end):
            self.cursors.save(end)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ddl

        def streamReader(self, schema):  # noqa: N802
            return Reader(self.options)

    return Source
