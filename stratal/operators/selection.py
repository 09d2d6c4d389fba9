"""Top-k, retention, merges and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_newest(rows: DataFrame, scope: str, order: str, tie: str, pinned: Column, keep: int) -> DataFrame:
    """Adds kept: pinned rows always, then the newest until `keep` are kept in the scope."""
    w = Window.partitionBy(scope).orderBy(F.col("__pinned").desc(), F.col(order).desc(), F.col(tie))
    out = rows.withColumn("__pinned", pinned).withColumn("__n", F.row_number().over(w))
    return out.withColumn("kept", F.col("__pinned") | (F.col("__n") <= keep)).drop("__pinned", "__n")


def top_newest(rows: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    """The n newest, rows without a time last."""
    return rows.orderBy(F.col(order).desc_nulls_last(), F.col(tie)).limit(n)


def capped_in_order(rows: DataFrame, scope: str, order: str, cap: int) -> DataFrame:
    """The first `cap` of each scope in arrival order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(order))).where(F.col("rank") <= cap)


def merge_candidates(rows: DataFrame, key: str, seq: str, attributes: list[str], lane: str) -> DataFrame:
    """One row a key: the latest non-null value of each attribute, the sorted union of lanes."""
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in attributes]
    return rows.groupBy(key).agg(*latest, F.array_sort(F.collect_set(lane)).alias("lanes"))


def merge_lists(rows: DataFrame, key: str, seq: str, list_id: str, columns: list[str]) -> DataFrame:
    """One row a post: its first copy and the sorted ids of all lists it came from."""
    return rows.groupBy(key).agg(*[F.min_by(c, seq).alias(c) for c in columns], F.array_sort(F.collect_set(list_id)).alias("list_ids"))


def argmax(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """value of the row of each key that is largest by `order`."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def stale(recorded: DataFrame, expected: DataFrame, prefixes: tuple[str, ...] = ("report:", "subreport:")) -> DataFrame:
    """Recorded report and subreport nodes that are expected no more, children before parents, then by key."""
    ours = F.lit(False)
    for p in prefixes:
        ours = ours | F.col("key").startswith(p)
    left = recorded.where(ours).join(expected.select("key"), "key", "left_anti")
    return left.withColumn("deletion_order", F.when(F.col("key").startswith("subreport:"), 0).otherwise(1))


def desired_diff(desired: DataFrame, recorded: DataFrame) -> DataFrame:
    """key, action: create, update (content differs), skip (equal), delete (no longer desired)."""
    d = desired.select("key", F.col("content_hash").alias("want"), F.lit(True).alias("d"))
    r = recorded.select("key", F.col("content_hash").alias("have"), F.lit(True).alias("r"))
    action = F.when(F.col("r").isNull(), "create").when(F.col("d").isNull(), "delete").when(F.col("want").eqNullSafe(F.col("have")), "skip").otherwise("update")
    return d.join(r, "key", "full").select("key", action.alias("action"))


def rotation(queries: list[str], slot: Column, budget: int) -> Column:
    """The search requests of a six-hour slot: (query, lane, sort, variant), the first `budget` of them.

    The list starts at slot mod n; every other emerging request is sorted by stars, the halves swap each slot; then
    the early lane, then the recent variant.
    """
    n = len(queries)
    every = F.array(*map(F.lit, queries))
    ordered = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("offset"), F.get(every, ((slot + i) % n).cast("int")).alias("query")))
    row = lambda x, lane, sort, variant: F.struct(x["query"].alias("query"), F.lit(lane).alias("lane"), sort.alias("sort"), F.lit(variant).alias("variant"))
    emerging = F.transform(ordered, lambda x: row(x, "emerging", F.when((slot + x["offset"]) % 2 == 0, "stars").otherwise("updated"), "standard"))
    early = F.transform(ordered, lambda x: row(x, "early", F.lit("updated"), "standard"))
    recent = F.transform(ordered, lambda x: row(x, "emerging", F.lit("updated"), "recent"))
    return F.slice(F.concat(emerging, early, recent), 1, max(0, min(budget, 30)))


def contiguous_cursor(days: DataFrame, key: str, day: str, ok: str) -> DataFrame:
    """key, cursor: the last day before the first failure; null if the first day fails."""
    bad = F.min(F.when(~F.col(ok), F.col(day)))
    grouped = days.groupBy(key).agg(bad.alias("bad"), F.min(day).alias("low"), F.max(day).alias("high"))
    return grouped.select(key, F.when(F.col("bad").isNull(), F.col("high")).when(F.col("bad") > F.col("low"), F.date_sub("bad", 1)).alias("cursor"))


def first_k(rows: DataFrame, key: str, order: str, k: int, name: str) -> DataFrame:
    """key, name: the k smallest order values of each key, ascending; a task passes on k rows a key at most, so no key is gathered whole."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.select(key, order).withColumn("_at", at).where(F.col("_at") <= k).groupBy(key).agg(F.array_sort(F.collect_list(order)).alias(name))


def overflow(rows: DataFrame, scope: str, cap: int) -> DataFrame:
    """scope, n_found, n_dropped of the scopes that a cap cuts: the warning beside capped_in_order."""
    return rows.groupBy(scope).agg(F.count(F.lit(1)).alias("n_found")).where(F.col("n_found") > cap).withColumn("n_dropped", F.col("n_found") - cap)
