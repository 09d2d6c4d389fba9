"""Rendering and publishing: desired trees, navigation, status blocks, an idempotent sink protocol."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratal.functions.text import markdown_title


class Sink(Protocol):
    """What a publishing target offers; `apply` must do nothing for a key that it has with that content."""

    def recorded(self) -> dict[str, str]: ...

    def apply(self, action: str, key: str, content_hash: str | None) -> None: ...


class MemorySink:
    """A target in memory that counts its writes."""

    def __init__(self):
        self.nodes: dict[str, str] = {}
        self.writes = 0

    def recorded(self) -> dict[str, str]:
        return dict(self.nodes)

    def apply(self, action: str, key: str, content_hash: str | None) -> None:
        self.writes += 1
        if action == "delete":
            self.nodes.pop(key, None)
        else:
            self.nodes[key] = content_hash


def publish(desired: DataFrame, sink: Sink) -> int:
    """Brings the sink to the desired tree (key, content_hash) of one day, parents first; returns the number of writes.

    Afterwards the sink is read back: a node that it lacks, holds with other content or should have lost is an error.
    """
    from stratal.operators.selection import desired_diff

    recorded = desired.sparkSession.createDataFrame(list(sink.recorded().items()), "key string, content_hash string")
    todo = desired_diff(desired, recorded).where("action <> 'skip'").join(desired, "key", "left").orderBy(F.col("action") == "delete", "key")
    n = 0
    for row in todo.toLocalIterator():
        sink.apply(row["action"], row["key"], row["content_hash"])
        n += 1
    if n:
        found = desired.sparkSession.createDataFrame(list(sink.recorded().items()), "key string, content_hash string")
        wrong = desired_diff(desired, found).where("action <> 'skip'").limit(5).collect()
        if wrong:
            raise RuntimeError(f"the target does not hold what was written: {[tuple(r) for r in wrong]}")
    return n


def navigation(children: DataFrame, parent: str, title: str, token: str, base: str) -> DataFrame:
    """parent, index: its distinct titled children as a Markdown list, titles descending."""
    rows = children.where((F.trim(title) != "") & (F.trim(token) != "")).select(F.col(parent), F.trim(title).alias("t"), F.concat(F.lit(base.rstrip("/") + "/"), F.trim(token)).alias("u")).distinct()
    order = F.array_sort(F.collect_list(F.struct("t", "u")), lambda a, b: F.when(a["t"] > b["t"], -1).when(a["t"] < b["t"], 1).when(a["u"] < b["u"], -1).when(a["u"] > b["u"], 1).otherwise(0))
    lines = F.transform(order, lambda x: F.concat(F.lit("- ["), x["t"], F.lit("]("), x["u"], F.lit(")")))
    return rows.groupBy(parent).agg(F.array_join(lines, "\n").alias("index"))


def status_block(health: DataFrame, key: str) -> DataFrame:
    """key, n_ok, n_failed, block: one line of counts and the failed sources by name."""
    failed = F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("source"))))
    return health.groupBy(key).agg(F.count_if(F.col("status") == "success").alias("n_ok"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.array_join(failed, ", ").alias("names")).withColumn("block", F.concat_ws("", F.lit("ok: "), "n_ok", F.lit("; failed: "), "n_failed", F.when(F.col("names") != "", F.concat(F.lit(" ("), "names", F.lit(")"))))).drop("names")


def brief(reports: DataFrame, key: str, order: str, title: str, link: str) -> DataFrame:
    """key, brief: the reports in order, one line each; a report without a link is listed by its title."""
    line = F.when(F.col(link).isNotNull(), F.concat(F.lit("- ["), F.col(title), F.lit("]("), F.col(link), F.lit(")"))).otherwise(F.concat(F.lit("- "), F.col(title)))
    return reports.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("brief"))


def referenced_blobs(items: DataFrame, refs: str, extra: str) -> DataFrame:
    """Every distinct blob that an item refers to, in its list or as its full text."""
    return items.select(F.explode(F.concat(F.coalesce(refs, F.expr("CAST(array() AS array<string>)")), F.array(extra))).alias("ref")).where("ref IS NOT NULL").distinct()


def restored(node_hash: Column, same_tokens: Column, cached_hash: Column) -> Column:
    """The recorded content hash of a node that is still the same remote node, else its own."""
    return F.when(F.coalesce(same_tokens, F.lit(False)), cached_hash).otherwise(node_hash)


def ordered_digest(df: DataFrame, key: str, order: str, content: str, block: int) -> DataFrame:
    """key, digest of all its rows in order: each row by its order value and the hash of its content, then blocks of so many order values."""
    joined = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["line"]), "\n"), 256)
    line = F.concat_ws(":", order, F.sha2(content, 256)).alias("line")
    blocks = df.groupBy(key, F.floor(F.col(order) / block).alias("block")).agg(joined(F.struct(order, line)).alias("line"))
    return blocks.groupBy(key).agg(joined(F.struct("block", "line")).alias("digest"))


def recent_history(reports: DataFrame, now, current_run: str, days: int = 30) -> DataFrame:
    """date, attempt, package, target, title, line, content of the reports of the last days that are not of the current run.

    reports: date, attempt, package, name, modified_at, content. A package has one target, the last of its reports by name;
    the title is the first line that starts with "# ", else the package. A report of unknown age is left out.
    """
    run = F.concat_ws("/", "date", "attempt")
    recent = reports.where((F.col("modified_at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (run != current_run))
    last = recent.groupBy("date", "attempt", "package").agg(F.max_by(F.struct("content"), F.struct("name", "modified_at"))["content"].alias("content"))
    target = F.concat(F.concat_ws("-", "date", "attempt", "package"), F.lit(".md"))
    titled = last.withColumns({"target": target, "title": F.coalesce(markdown_title("content"), F.col("package").cast("string"))})
    line = F.concat(F.lit("- ["), "title", F.lit("](history/"), "target", F.lit(")"))
    return titled.select("date", "attempt", "package", "target", "title", line.alias("line"), "content")


def copy_history(history: DataFrame, path: str) -> None:
    """Writes the reports as path/history/target=<name> and, once they are all there, the list of them as path/history_index."""
    history.select("target", F.col("content").alias("value")).write.mode("overwrite").partitionBy("target").text(f"{path}/history")
    head = history.sparkSession.createDataFrame([("", "# Prior research reports"), ("", "")], "target string, line string")
    lines = head.unionByName(history.select("target", "line")).orderBy("target", F.desc("line"))
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/history_index")
