"""Units of items that denote one entity, and size-bounded batches of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratal.functions.text import unit_id
from stratal.operators.greedy import CHUNK_ROWS, Batches, labelled

MAX_UNITS, MAX_BYTES = 160, 256 * 1024
REPAIR_UNITS, REPAIR_BYTES = 40, 64 * 1024
SUMMARY_CHARS = 500


def entity_key(source: Column, post_id: Column, conversation_id: Column, paper_id: Column, other: Column) -> Column:
    """A conversation that is not the post itself, the post, the paper whatever the source, or the own key."""
    conversation = F.nullif(conversation_id, F.lit(""))
    return (
        F.when(source.isin("x_list", "x_for_you"), F.when(conversation.isNotNull() & (conversation != post_id), F.concat(F.lit("x-conversation:"), conversation)).otherwise(F.concat(F.lit("x:"), post_id)))
        .when(source.isin("arxiv", "huggingface"), F.concat(F.lit("arxiv:"), paper_id))
        .otherwise(other)
    )


def unitise(items: DataFrame) -> DataFrame:
    """unit_id, entity_key, item_ids (by ready_at, item_id), sources, occurred_at, summary.

    items: entity_key, item_id, source, ready_at, occurred_at, text. The summary is the longest, then the greatest of
    the non-empty texts, cut to 500 characters; the key itself if there is none.
    """
    text = F.when(F.col("text") != "", F.col("text"))
    grouped = items.groupBy("entity_key").agg(
        F.array_sort(F.collect_list(F.struct("ready_at", "item_id"))).alias("rows"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.max("occurred_at").alias("occurred_at"),
        F.max_by(text, F.when(text.isNotNull(), F.struct(F.length(text), text))).alias("longest"),
    )
    return grouped.select(unit_id("entity_key").alias("unit_id"), "entity_key", F.transform("rows", lambda r: r["item_id"]).alias("item_ids"), "sources", "occurred_at", F.left(F.coalesce("longest", "entity_key"), F.lit(SUMMARY_CHARS)).alias("summary"))


def greedy_batches(rows: DataFrame, scope: str, order: str, size: str, max_rows: int = MAX_UNITS, max_size: int = MAX_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds batch (from 0, within its scope): in order, a batch closes before the row that would exceed either bound.

    A row larger than the bound stands alone; a null size is 0. A scope of any length is walked in chunks by as many
    tasks (see greedy).
    """
    return labelled(rows, scope, [order], size, Batches(max_rows, max_size), chunk_rows).withColumnRenamed("__label", "batch")


def stratified_batch_count(counts: list[int], size: int) -> int:
    """The least number B of batches, at least ceil(N / size), with sum of ceil(n_s / B) over the sources within size."""
    if size <= 0:
        raise ValueError("the batch size must be positive")
    if len(counts) > size:
        raise ValueError("more sources than a batch holds")
    low = max(1, -(-sum(counts) // size))
    high = max(low, max(counts, default=1))
    while low < high:
        middle = (low + high) // 2
        if sum(-(-n // middle) for n in counts) <= size:
            high = middle
        else:
            low = middle + 1
    return low


def stratified_batches(items: DataFrame, size: int, source: str = "source", order: str = "item_id") -> DataFrame:
    """Adds batch: each source's rows, in order, dealt round-robin. The driver sees one count a source."""
    counts = [r["n"] for r in items.groupBy(source).agg(F.count(F.lit(1)).alias("n")).collect()]
    batches = stratified_batch_count(counts, size)
    return items.withColumn("batch", ((F.row_number().over(Window.partitionBy(source).orderBy(order)) - 1) % batches).cast("int"))


def materialise_packages(plans: DataFrame, assignments: DataFrame) -> DataFrame:
    """package_id, unit_ids: the units of a plan's groups, in the order of its group_ids and of the unit ids."""
    listed = plans.select("package_id", F.posexplode("group_ids").alias("at", "group_id"))
    rows = listed.join(assignments, "group_id").groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("at", "unit_id"))).alias("r"))
    return rows.select("package_id", F.transform("r", lambda x: x["unit_id"]).alias("unit_ids"))


def route_items(units: DataFrame, packages: DataFrame) -> DataFrame:
    """item_id, unit_id, package_id through the exploded memberships; items of a unit in no package have none."""
    items = units.select("unit_id", F.explode("item_ids").alias("item_id"))
    members = packages.select("package_id", F.explode("unit_ids").alias("unit_id"))
    return items.join(members, "unit_id", "left").select("item_id", "unit_id", "package_id")


def missing_only(units: DataFrame, covered: DataFrame) -> DataFrame:
    """Units that no output covers yet: what the next repair batches are made of."""
    return units.join(covered.select("unit_id"), "unit_id", "left_anti")
