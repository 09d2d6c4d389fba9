"""Scans of series that one task can't hold: chunks of a range partitioning, and what each chunk carries into the next.

A key with more rows than a chunk is dealt out by (key, order), so that its series lies in as many tasks as it has
chunks. Each chunk is scanned alone; a summary row a chunk is scanned in turn, which gives each chunk the state that it
starts from; that state meets the rows by (key, chunk). Other keys keep their one window. Chunks are written to the
shared folder before they are read twice, as the bounds of a range partitioning are sampled anew each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratal.sources.shared import written

CHUNK_ROWS = 2_000_000


def parted(df: DataFrame, key: str, chunk_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys within a chunk, rows of longer keys or None if there are none). Null is a key like any other."""
    hot = df.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > chunk_rows).select("__hot")
    if not hot.head(1):
        return df, None
    same = F.col(key).eqNullSafe(F.col("__hot"))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def chunked(df: DataFrame, key: str, order: list[str], chunk_rows: int) -> DataFrame:
    """Adds __chunk: rows in ascending (key, order) lie in ascending chunks, those that agree in both in one."""
    n = max(1, -(-df.count() // chunk_rows))
    return written(df.repartitionByRange(n, key, *order).withColumn("__chunk", F.spark_partition_id()), "chunks")


def entering(summary: DataFrame, key: str, state: Column, name: str = "__carry") -> DataFrame:
    """key, __chunk, name: an aggregate of the states of a key's chunks before each chunk."""
    earlier = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(F.col(key).alias("__key"), F.col("__chunk").alias("__at"), state.over(earlier).alias(name))


def meet(chunks: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    """The rows with what their chunk carries in."""
    return chunks.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__chunk") == F.col("__at"))).drop("__key", "__at")


def greatest_so_far(df: DataFrame, key: str, at: str, held: str, out: str, chunk_rows: int) -> DataFrame:
    """Adds out: the greatest `held` of the key's rows at or before `at`, rows at the same point included."""
    chunks = chunked(df, key, [at], chunk_rows)
    own = F.max(held).over(Window.partitionBy(key, "__chunk").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    summary = chunks.groupBy(key, "__chunk").agg(F.max(held).alias("__top"))
    found = meet(chunks.withColumn("__own", own), entering(summary, key, F.max("__top")), key)
    return found.withColumn(out, F.coalesce("__own", "__carry")).drop("__own", "__carry", "__chunk")


def as_of(df: DataFrame, key: str, at: str, held: Column, horizons: dict[str, int], chunk_rows: int) -> DataFrame:
    """Adds a column for each horizon: the greatest `held` of the key at or before `at` minus the horizon.

    Every row asks once a horizon: the questions lie in the series at their own points, and the answers meet the rows
    by number, a key that no series owns.
    """
    rows = written(df.withColumn("__row", F.monotonically_increasing_id()), "series")
    told = rows.select(key, at, held.alias("__held"), F.lit(None).cast("long").alias("__row"), F.lit(None).cast("string").alias("__h"))
    asked = [rows.select(key, (F.col(at) - length).alias(at), F.lit(None).cast(told.schema["__held"].dataType).alias("__held"), "__row", F.lit(h).alias("__h")) for h, length in horizons.items()]
    for more in asked:
        told = told.unionByName(more)
    met = greatest_so_far(told, key, at, "__held", "__base", chunk_rows).where(F.col("__row").isNotNull())
    answers = met.groupBy("__row").agg(*(F.max(F.when(F.col("__h") == h, F.col("__base"))).alias(h) for h in horizons))
    return rows.join(answers, "__row").drop("__row")


def lagged(df: DataFrame, key: str, order: list[str], value: Column, out: str, chunk_rows: int) -> DataFrame:
    """Adds out: `value` (a struct that starts with `order`) of the row before in the key's series; null for the first."""
    chunks = chunked(df, key, order, chunk_rows)
    chunks = chunks.withColumn("__own", F.lag(value).over(Window.partitionBy(key, "__chunk").orderBy(*order)))
    summary = chunks.groupBy(key, "__chunk").agg(F.max(value).alias("__top"))
    found = meet(chunks, entering(summary, key, F.max("__top")), key)
    return found.withColumn(out, F.coalesce("__own", "__carry")).drop("__own", "__carry", "__chunk")


def streaks(df: DataFrame, key: str, order: list[str], held: str, out: str, chunk_rows: int) -> DataFrame:
    """Adds out: how many rows in a row up to each one have `held` = 1 (0 or 1, no nulls).

    A chunk's first streak goes on from the last one of the chunks before: what they end with, back to the last chunk
    that holds a 0.
    """
    chunks = chunked(df, key, order, chunk_rows)
    sofar = Window.partitionBy(key, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.withColumn("__island", F.sum(1 - F.col(held)).over(sofar))
    chunks = chunks.withColumn("__own", F.sum(held).over(Window.partitionBy(key, "__chunk", "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    islands = chunks.groupBy(key, "__chunk", "__island").agg(F.sum(held).alias("__n"))
    ends = islands.groupBy(key, "__chunk").agg(F.max_by("__n", "__island").alias("__end"), F.max("__island").alias("__zeros"))
    run = ends.withColumn("__run", F.sum((F.col("__zeros") > 0).cast("int")).over(Window.partitionBy(key).orderBy("__chunk")))
    upto = F.sum("__end").over(Window.partitionBy(key, "__run").orderBy("__chunk"))
    carried = entering(run.withColumn("__upto", upto), key, F.max_by("__upto", "__chunk"))
    found = meet(chunks, carried, key)
    return found.withColumn(out, F.col("__own") + F.when(F.col("__island") == 0, F.coalesce("__carry", F.lit(0))).otherwise(0)).drop("__own", "__carry", "__chunk", "__island")
