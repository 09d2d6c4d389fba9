"""Greedy walks over sorted rows, in chunks: which rows begin a batch, or are accepted after a cooldown.

A walk goes from a start to the next: from row i to the first row that does not fit the batch begun at i, or that is a
cooldown after it. The next of every row comes from binary searches over sums or times of a chunk, the starts from
doubling these pointers, so no row is visited in turn. Rows lie in a range partitioning by (key, order): a key of any
length lies in many chunks.

What a chunk does to a walk that enters it is a function of the state it enters with: a table over the rows that may be
its first start. Tables of neighbouring chunks compose to one of the same kind. They are composed within groups of
chunks, group after group gives the state at each group, and within each group that at each chunk; with it the chunk's
first key is walked once more. All other keys of a chunk begin in it and are final at once.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stratal.sources.shared import written

CHUNK_ROWS = 500_000
GROUP = 256


def walk(following: np.ndarray, first: int) -> np.ndarray:
    """Whether each row is on the way first, following[first], ...; pointers lead forward, to len(following) at the end."""
    n = len(following)
    on = np.zeros(n + 1, dtype=bool)
    on[min(first, n)] = True
    jumps = [np.append(following, n)]
    while (jumps[-1][:-1] < n).any():  # 1, 2, 4, ... steps
        jumps.append(jumps[-1][jumps[-1]])
    for jump in reversed(jumps):
        on[jump[np.flatnonzero(on)]] = True
    return on[:-1]


def ends_of(following: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start the last row on its way, and how many steps lead there."""
    n = len(following)
    at, steps = starts.copy(), np.zeros(len(starts), dtype=np.int64)
    jumps = [np.append(following, n)]
    while (jumps[-1][:-1] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    for power in range(len(jumps) - 1, -1, -1):
        to = jumps[power][at]
        on = to < n
        at, steps = np.where(on, to, at), steps + np.where(on, 1 << power, 0)
    return at, steps


@dataclass(frozen=True)
class Batches:
    """A batch closes before the row that would be its max_rows + 1st or exceed max_size; a row above it stands alone.

    State: rows and size of the open batch, and its number. Values are sizes, null ones 0, none negative.
    """

    max_rows: int
    max_size: int

    label = "int"

    def following(self, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(sizes)])
        rows = np.arange(len(sizes))
        fits = np.searchsorted(sums, sums[:-1] + self.max_size, side="right") - 1
        return np.minimum(np.minimum(np.maximum(fits, rows + 1), rows + self.max_rows), ends)

    def labels(self, on: np.ndarray, starts: np.ndarray) -> np.ndarray:
        count = np.cumsum(on)
        return count - count[starts]

    def exit(self, sizes: np.ndarray, last: int, number: int):
        return np.array([len(sizes) - last, sizes[last:].sum(), number])

    def table(self, sizes: np.ndarray):
        """(rows, size, sums of the first rows, and by first start the open batch at the end: its rows, size, number)."""
        w, sums = min(len(sizes), self.max_rows), np.concatenate([[0], np.cumsum(sizes)])
        last, steps = ends_of(self.following(sizes, np.full(len(sizes), len(sizes))), np.arange(w))
        return len(sizes), int(sums[-1]), sums[: w + 1], np.stack([len(sizes) - last, sums[-1] - sums[last], steps])

    def apply(self, table, states: np.ndarray) -> np.ndarray:
        """The states (rows, size, number; a column each) after the chunk. No rows: nothing is open yet."""
        n, size, sums, out = table
        rows, held, number = states
        first = np.where(rows == 0, 0, np.minimum(self.max_rows - rows, np.searchsorted(sums, self.max_size - held, side="right") - 1))
        first = np.maximum(first, 0)
        inside = first < min(n, sums.size - 1)
        at = np.where(inside, first, 0)
        begun = number + np.where(rows == 0, 0, 1) + out[2][at]
        return np.where(inside, np.stack([out[0][at], out[1][at], begun]), np.stack([rows + n, held + size, number]))

    def compose(self, a, b):
        n, size = a[0] + b[0], a[1] + b[1]
        sums, out = a[2], self.apply(b, a[3])
        room = self.max_rows - (len(sums) - 1)
        if room and len(sums) - 1 == a[0]:  # starts in b come after all rows of a
            sums = np.concatenate([sums, a[1] + b[2][1 : room + 1]])
            out = np.concatenate([out, b[3][:, :room]], axis=1)
        return n, size, sums, out

    def fresh(self) -> np.ndarray:
        return np.zeros((3, 1), dtype=np.int64)

    def relabel(self, sizes: np.ndarray, state: np.ndarray) -> np.ndarray:
        rows, held, number = (int(x) for x in state)
        sums = np.cumsum(sizes)
        first = max(0, min(self.max_rows - rows, int(np.searchsorted(sums, self.max_size - held, side="right"))))
        on = walk(self.following(sizes, np.full(len(sizes), len(sizes))), first)
        return number + np.cumsum(on)


@dataclass(frozen=True)
class Cooldown:
    """A row is accepted if it is `length` after the last accepted one. State: that one's time. Values are times."""

    length: int

    label = "boolean"

    def following(self, times: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(times)
        inner = np.ones(n, dtype=bool)
        inner[ends[ends < n]] = False
        # gaps of a cooldown or more, and those between keys, all become one cooldown: no sum overflows, no answer changes
        gaps = np.where(inner[1:], np.minimum(times[1:] - times[:-1], self.length), self.length)
        at = np.concatenate([[0], np.cumsum(gaps)])[:n]
        return np.minimum(np.maximum(np.searchsorted(at, at + self.length, side="left"), np.arange(n) + 1), ends)

    def labels(self, on: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return on

    def exit(self, times: np.ndarray, last: int, number: int):
        return times[last : last + 1]

    def table(self, times: np.ndarray):
        """(bounds, last accepted): a walk whose next row may not be earlier than a bound, the least one, ends at that row."""
        last, _ = ends_of(self.following(times, np.full(len(times), len(times))), np.arange(len(times)))
        return self._short(times, times[last], times[0])

    def _short(self, bounds, lasts, first):
        """Without steps that no walk reaches: it was at most at `first` before; and one step for all that end alike."""
        n = int(np.searchsorted(bounds, first + self.length, side="left")) + 1
        bounds, lasts = bounds[:n], lasts[:n]
        keep = np.append(np.flatnonzero(lasts[1:] != lasts[:-1]), len(lasts) - 1)
        return bounds[keep], lasts[keep], first

    def apply(self, table, states: np.ndarray) -> np.ndarray:
        bounds, lasts, _ = table
        (held,) = states
        at = np.searchsorted(bounds, held + self.length, side="left")
        return np.where(at < len(bounds), lasts[np.minimum(at, len(bounds) - 1)], held)[None, :]

    def compose(self, a, b):
        later = b[0] > a[0][-1]
        return self._short(np.concatenate([a[0], b[0][later]]), np.concatenate([self.apply(b, a[1][None, :])[0], b[1][later]]), a[2])

    def fresh(self) -> np.ndarray:
        return np.full((1, 1), -(1 << 62))

    def relabel(self, times: np.ndarray, state: np.ndarray) -> np.ndarray:
        first = int(np.searchsorted(times, int(state[0]) + self.length, side="left"))
        return walk(self.following(times, np.full(len(times), len(times))), first)


def _numbers(table, name: str) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(table.column(name).cast("int64"), 0).to_numpy().astype(np.int64)


def _first_pass(rule, key: str, value: str, columns: list[str], kind):
    """A sorted chunk: rows with labels as if each key began here, and what its first and last key hand on."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table, chunk = pa.Table.from_batches(held), TaskContext.get().partitionId()
        n, values = table.num_rows, _numbers(table, value)
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        lengths = np.diff(np.append(starts, n))
        own, ends = np.repeat(starts, lengths), np.repeat(np.append(starts[1:], n), lengths)
        on = walk(rule.following(values, ends), 0)
        labels = rule.labels(on, own)
        done = table.select(columns).append_column("__label", pa.array(labels, kind.field("__label").type)).append_column("__chunk", pa.array(np.full(n, chunk), pa.int32()))
        done = done.append_column("__place", pa.array(np.where(own == 0, np.arange(n), -1), pa.int32()))
        for extra in ("__kind", "__function"):
            done = done.append_column(extra, pa.nulls(n, kind.field(extra).type))
        yield from done.cast(kind).to_batches(max_chunksize=10_000)
        functions = [(0, 1, rule.table(values[: lengths[0]]))]
        if len(starts) > 1:
            a = int(starts[-1])
            last = int(np.flatnonzero(on)[-1])
            functions.append((a, 0, rule.exit(values[a:], last - a, int(labels[-1]))))
        for at, which, function in functions:
            one = {"__chunk": chunk, "__place": None, "__label": None, "__kind": which, "__function": pickle.dumps(function)}
            row = {c: None for c in columns} | one
            row[key] = table.column(key)[at].as_py()
            yield pa.Table.from_pylist([row], schema=kind).to_batches()[0]

    return run


def _by_key(make):
    """A function on Arrow batches of sorted rows (key, group, at, kind, function) that calls make() at each new key; the
    result takes a row and gives rows to hand on, or, with None, the last ones."""

    def run(batches):
        import pyarrow as pa

        of, step, schema = object(), None, None
        for batch in batches:
            schema, out = batch.schema, []
            for row in batch.to_pylist():
                if row["key"] != of:
                    if step is not None:
                        out += step(None)
                    of, step = row["key"], make()
                out += step(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if step is not None and (out := step(None)):
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _composed(rule):
    """Seeds as they are; the functions of each key and group as one."""

    def make():
        held: list = []

        def step(row):
            out = []
            if held and (row is None or row["group"] != held[0]["group"]):
                out.append(held[0] | {"function": pickle.dumps(held[1])})
                held.clear()
            if row is None:
                return out
            if row["kind"] == 0:
                return [*out, row]
            function = pickle.loads(row["function"])
            if held:
                held[1] = rule.compose(held[1], function)
            else:
                held.extend([row, function])
            return out

        return step

    return _by_key(make)


def _states(rule):
    """For each function of a key, in order, the state it is entered with, as a seed (kind 0); none before the first seed or function."""

    def make():
        state: list = []

        def step(row):
            if row is None:
                return []
            if row["kind"] == 0:
                state[:] = [pickle.loads(row["function"])[:, None]]
                return []
            out = [row | {"kind": 0, "function": pickle.dumps(state[0][:, 0])}] if state else []
            state[:] = [rule.apply(pickle.loads(row["function"]), state[0] if state else rule.fresh())]
            return out

        return step

    return _by_key(make)


def entered(functions: DataFrame, rule, group: int = GROUP) -> DataFrame:
    """__chunk, state: what the first key of each chunk that goes on with an earlier chunk's last key is entered with.

    functions: key, at (chunk), kind (0: the state that a key's first chunk hands on, 1: a function), function.
    """
    rows = functions.select("key", (F.col("at") / group).cast("int").alias("group"), "at", "kind", "function")
    in_order = ["key", "group", "at", "kind"]  # a key has one seed at most, in a chunk before those of its functions
    composed = rows.repartition("key", "group").sortWithinPartitions(*in_order).mapInArrow(_composed(rule), rows.schema)
    at_groups = composed.repartition("key").sortWithinPartitions(*in_order).mapInArrow(_states(rule), rows.schema)
    within = rows.where("kind = 1").unionByName(at_groups).repartition("key", "group").sortWithinPartitions("key", "group", "kind", "at")
    return within.mapInArrow(_states(rule), rows.schema).select(F.col("at").alias("__chunk"), F.col("function").alias("__state"))


def labelled(rows: DataFrame, key: str, order: list[str], value: str, rule, chunk_rows: int = CHUNK_ROWS, group: int = GROUP) -> DataFrame:
    """Adds __label to the rows: what the rule says of each in its key's order. A null key is a key like any other."""
    columns = rows.columns
    n = max(1, -(-rows.count() // chunk_rows))
    extra = [("__label", T._parse_datatype_string(rule.label)), ("__chunk", T.IntegerType()), ("__place", T.IntegerType()), ("__kind", T.IntegerType()), ("__function", T.BinaryType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + [T.StructField(c, t) for c, t in extra])
    dealt = rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    done = dealt.mapInArrow(_first_pass(rule, key, value, columns, to_arrow_schema(schema)), schema)
    if n == 1:
        return done.where("__kind IS NULL").select(*columns, "__label")
    done = written(done, "walk")
    functions = done.where("__kind IS NOT NULL").select(F.col(key).alias("key"), F.col("__chunk").alias("at"), F.col("__kind").alias("kind"), F.col("__function").alias("function"))
    states = written(entered(functions, rule, group), "states")
    met = done.where("__kind IS NULL").join(states, "__chunk", "left")
    again = F.col("__state").isNotNull() & (F.col("__place") >= 0)
    final = T.StructType([f for f in schema if f.name in (*columns, "__label")])

    def relabel(table):
        import pyarrow as pa

        table = table.sort_by("__place")
        labels = rule.relabel(_numbers(table, value), pickle.loads(table.column("__state")[0].as_py()))
        return table.select(columns).append_column("__label", pa.array(labels, to_arrow_schema(final).field("__label").type))

    walked = met.where(again).groupBy("__chunk").applyInArrow(relabel, final)
    return met.where(~again).select(*columns, "__label").unionByName(walked)
