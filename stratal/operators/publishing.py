"""Publishing a tree to a remote target from the executors, by a Python data source that writes and reads nodes.

A run compares what is wanted with what the target records and writes the difference, level by level: a level of the tree
is one job, parents before children, and deletions the other way round. Each task opens the target by itself; a node is
put with a token of run, key and content, so that a task that is repeated, or runs twice, writes it once. Then a second
job reads the target back. A run that breaks off leaves whole nodes, and the next one goes on from what is recorded.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from stratal.operators.selection import desired_diff
from stratal.sources.shared import written

NODES = "key string, parent string, content_hash string, content string, action string"
RECORDED = "key string, content_hash string"
MAX_LEVELS = 64


class Target(Protocol):
    """A connection to where nodes live, opened anew in each task."""

    def parts(self) -> list[str]:
        """Names of the parts that nodes can be listed by."""

    def listed(self, part: str) -> Iterator[tuple[str, str]]:
        """(key, content hash) of the nodes of a part."""

    def put(self, key: str, parent: str | None, content_hash: str, content: str | None, token: str) -> bool:
        """Creates or replaces a node; False, and no write, if the token was seen for it. A parent that is missing is an error."""

    def delete(self, key: str) -> bool:
        """False if there is no such node."""

    def receipt(self, run: str, told: dict) -> None:
        """Keeps what a job of the run has written, or that it was given up."""


@dataclass
class Written(WriterCommitMessage):
    put: int = 0
    deleted: int = 0
    repeated: int = 0


class Part(InputPartition):
    def __init__(self, name: str):
        self.name = name


def node_source(name: str, connect: Callable[[], Target]) -> type[DataSource]:
    """A data source class for spark.dataSource.register: reads RECORDED, writes NODES; option `run` names the run."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [Part(p) for p in connect().parts()]

        def read(self, partition) -> Iterator[tuple]:
            if partition is not None:
                yield from connect().listed(partition.name)

    class Writer(DataSourceWriter):
        def __init__(self, run: str):
            self.run = run

        def write(self, iterator) -> Written:
            target, told = connect(), Written()
            for row in iterator:
                if row["action"] == "delete":
                    told.deleted += target.delete(row["key"])
                elif target.put(row["key"], row["parent"], row["content_hash"], row["content"], f"{self.run}:{row['content_hash']}"):
                    told.put += 1
                else:
                    told.repeated += 1
            return told

        def commit(self, messages) -> None:
            done = [m for m in messages if m is not None]
            connect().receipt(self.run, {"put": sum(m.put for m in done), "deleted": sum(m.deleted for m in done), "repeated": sum(m.repeated for m in done)})

        def abort(self, messages) -> None:
            connect().receipt(self.run, {"given up": True, "tasks": sum(m is not None for m in messages)})

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return RECORDED

        def reader(self, schema):
            return Reader()

        def writer(self, schema, overwrite):
            return Writer(self.options["run"])

    return Source


def levels(desired: DataFrame) -> DataFrame:
    """desired (key, parent, ...) with level: 0 for nodes without a parent, else one more than the parent's.

    A join a level, each with the nodes of the level before only. A node whose parents lead nowhere, or in a circle, is an error.
    """
    level = desired.where("parent IS NULL").withColumn("level", F.lit(0))
    out = level
    for n in range(1, MAX_LEVELS):
        level = desired.join(level.select(F.col("key").alias("parent")), "parent", "left_semi").select(desired.columns).withColumn("level", F.lit(n))
        if not level.head(1):
            break
        out = out.unionByName(level)
    lost = desired.join(out.select("key"), "key", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"nodes without a way to the top: {[r['key'] for r in lost]}")
    return out


def differences(spark: SparkSession, source: str, desired: DataFrame) -> DataFrame:
    """key, action of what the target lacks, has with another content or should have lost."""
    recorded = spark.read.format(source).load()
    return desired_diff(desired.select("key", "content_hash"), recorded).where("action <> 'skip'")


def publish_tree(spark: SparkSession, source: str, desired: DataFrame, run: str | None = None) -> str:
    """Brings the target to desired (key, parent, content_hash, content) and returns the run's name; nothing is written for a
    target that is there already. Raises if the target, read back, differs."""
    run = run or uuid.uuid4().hex
    placed = written(levels(desired), "tree")
    todo = written(differences(spark, source, desired).join(placed, "key", "left"), "todo")  # the target is listed once
    depth = todo.where("action <> 'delete'").select("level").distinct().collect()  # MAX_LEVELS at most
    shape = ["key", "parent", "content_hash", "content", "action"]
    for level in sorted(r["level"] for r in depth):
        todo.where((F.col("level") == level) & (F.col("action") != "delete")).select(shape).write.format(source).mode("append").option("run", run).save()
    gone = todo.where("action = 'delete'").select(shape)
    if gone.head(1):  # a target deletes a node with what hangs below it; what is gone already counts as done
        gone.write.format(source).mode("append").option("run", run).save()
    wrong = differences(spark, source, desired).limit(5).collect()
    if wrong:
        raise RuntimeError(f"the target does not hold what was written: {[tuple(r) for r in wrong]}")
    return run


class FolderTarget:
    """Nodes as files in a folder that all tasks reach: a stand-in for a wiki, with its rules."""

    def __init__(self, root: str, parts: int = 16):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.n = parts

    def _name(self, key: str) -> str:
        digest = hashlib.sha256(key.encode()).hexdigest()
        return f"{self.root}/nodes/{int(digest[:8], 16) % self.n}/{digest}.json"

    def _read(self, path: str) -> dict | None:
        try:
            with self.fs.open_input_stream(path) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def _write(self, path: str, value: dict) -> None:
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        staged = f"{path}.{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(staged) as f:
            f.write(json.dumps(value).encode())
        self.fs.move(staged, path)

    def parts(self) -> list[str]:
        return [str(k) for k in range(self.n)]

    def listed(self, part: str) -> Iterator[tuple[str, str]]:
        from pyarrow import fs

        for found in self.fs.get_file_info(fs.FileSelector(f"{self.root}/nodes/{part}", allow_not_found=True)):
            if found.path.endswith(".json"):
                node = self._read(found.path)
                if node is not None:
                    yield node["key"], node["content_hash"]

    def put(self, key, parent, content_hash, content, token) -> bool:
        held = self._read(self._name(key))
        if held and held["token"] == token:
            return False
        if parent is not None and self._read(self._name(parent)) is None:
            raise LookupError(f"{key}: no parent {parent}")
        self._write(self._name(key), {"key": key, "parent": parent, "content_hash": content_hash, "content": content, "token": token, "writes": (held or {"writes": 0})["writes"] + 1})
        return True

    def delete(self, key: str) -> bool:
        try:
            self.fs.delete_file(self._name(key))
            return True
        except FileNotFoundError:
            return False

    def receipt(self, run: str, told: dict) -> None:
        self._write(f"{self.root}/receipts/{run}/{uuid.uuid4().hex}.json", told)

    def receipts(self, run: str) -> list[dict]:
        from pyarrow import fs

        return [self._read(f.path) for f in self.fs.get_file_info(fs.FileSelector(f"{self.root}/receipts/{run}", allow_not_found=True))]
