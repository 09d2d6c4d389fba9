"""Keyed state of the streams: value and map state in RocksDB, timers that expire it, and the state as a table.

The state of a key is read and written by its parts: of an item's revisions only those that a micro-batch asks for are
looked up, however many it has. A timer drops what has not been touched for a while; without one, state stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stratal.operators.ledger import HASH_DIGITS

ARRIVAL = "item_id string, content_hash string, observation_kind string, seq long"
ACCEPTED = "entity long, event_id long, t long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTING = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which this kind of state needs; the session's setting is back afterwards."""
    before = spark.conf.get(SETTING, None)
    spark.conf.set(SETTING, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(SETTING, before) if before else spark.conf.unset(SETTING)


class _Expiring(StatefulProcessor):
    """Clears a key's state when it was not touched for idle_ms of processing time (0: never)."""

    def __init__(self, idle_ms: int = 0):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _touch(self, timer_values) -> None:
        if self.idle_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)

    def close(self) -> None:
        pass


class Revisions(_Expiring):
    """The rows that put_items of the ledger would append: the first of an item, and each other content once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.base = handle.getValueState("base", "content_hash string, there boolean")
        self.seen = handle.getMapState("seen", "digits string", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        if self.base.exists():
            base = self.base.get()[0]
        else:
            first = next(arrived.itertuples(index=False))
            base = first.content_hash
            self.base.update((base, True))
            out.append((key[0], first.content_hash, first.observation_kind, first.seq))
        for r in arrived.itertuples(index=False):
            if base is None or r.content_hash is None or r.content_hash == base:
                continue
            digits = r.content_hash[:HASH_DIGITS]
            if not self.seen.containsKey((digits,)):
                self.seen.updateValue((digits,), (int(r.seq),))
                out.append((f"{key[0]}:rev:{digits}", r.content_hash, "content_revision", r.seq))
        self._touch(timerValues)
        yield pd.DataFrame(out, columns=["item_id", "content_hash", "observation_kind", "seq"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.base.clear()
        self.seen.clear()
        yield pd.DataFrame(columns=["item_id", "content_hash", "observation_kind", "seq"])


class Cooldown(_Expiring):
    """Events of an entity that are a cooldown after the last accepted one, in the order of t within a micro-batch."""

    def __init__(self, cooldown_micros: int, idle_ms: int = 0):
        super().__init__(idle_ms)
        self.cooldown = cooldown_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = pd.concat(list(rows)).sort_values(["t", "event_id"])
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for t in arrived["t"].tolist():
            ok = last is None or t - last >= self.cooldown
            keep.append(ok)
            last = t if ok else last
        self.last.update((last,))
        self._touch(timerValues)
        found = arrived.loc[keep]
        yield pd.DataFrame({"entity": [key[0]] * len(found), "event_id": found["event_id"].to_numpy(), "t": found["t"].to_numpy()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame({"entity": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "t": pd.Series(dtype="int64")})


def revisions(arrivals: DataFrame, idle_ms: int = 0) -> DataFrame:
    """The rows to append of a stream of arrivals (item_id, content_hash, observation_kind, seq). Late rows are never dropped."""
    return arrivals.groupBy("item_id").transformWithStateInPandas(Revisions(idle_ms), ARRIVAL, "append", "processingTime" if idle_ms else "none")


def accepted(events: DataFrame, cooldown_micros: int, idle_ms: int = 0) -> DataFrame:
    """entity, event_id, t of the accepted ones of a stream. A late row is judged against the last accepted time."""
    return events.groupBy("entity").transformWithStateInPandas(Cooldown(cooldown_micros, idle_ms), ACCEPTED, "append", "processingTime" if idle_ms else "none")


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The committed state of a variable (base, seen, last) as a table: key and value, for a map its entries in rows."""
    with rocks(spark):
        rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
        return rows.select("key.*", *(F.col(c) for c in rows.columns if c not in ("key", "partition_id")))
