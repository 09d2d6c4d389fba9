"""Roll-ups of source health and run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much of a source one poll covers, and the order of severity.
COVERAGE = {"x_list": "complete_increment", "x_for_you": "sampled_surface", "github": "bounded_discovery", "arxiv": "complete_increment", "huggingface": "bounded_discovery", "hackernews": "complete_increment", "articles": "bounded_discovery"}
SEVERITY = {"success": 0, "quiet": 1, "partial": 2, "failed": 3}


def coverage_mode(source: Column, backfilled: Column) -> Column:
    out = F.when((source == "arxiv") & backfilled, "bounded_discovery")
    for name, mode in COVERAGE.items():
        out = out.when(source == name, mode)
    return out.otherwise("bounded_discovery")


def rollup(items: DataFrame, parsed: DataFrame) -> DataFrame:
    """source, parsed_count, new_count, duplicate_count, oldest and newest occurrence."""
    own = items.groupBy("source").agg(F.count(F.lit(1)).alias("new_count"), F.min("occurred_at").alias("oldest_occurred_at"), F.max("occurred_at").alias("newest_occurred_at"))
    joined = parsed.join(own, "source", "left").withColumn("new_count", F.coalesce("new_count", F.lit(0)))
    return joined.withColumn("duplicate_count", F.greatest(F.col("parsed_count") - F.col("new_count"), F.lit(0)))


def surface_status(surfaces: DataFrame) -> DataFrame:
    """source, status: success if all of its surfaces are, failed if none is, partial between."""
    grouped = surfaces.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("good"))
    return grouped.select("source", F.when(F.col("good") == F.col("n"), "success").when(F.col("good") > 0, "partial").otherwise("failed").alias("status"))


def worst(statuses: DataFrame, key: str, status: str = "status") -> DataFrame:
    """The gravest status of each key."""
    rank = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    return statuses.groupBy(key).agg(F.coalesce(F.max_by(status, F.try_element_at(rank, F.col(status))), F.lit("success")).alias("status"))


def phase_status(health: DataFrame, n_items: Column) -> DataFrame:
    """One row: failed without items but with failures, partial with failures, success otherwise; disabled sources don't count."""
    failures = F.count_if(F.col("status").isin("failed", "partial"))
    return health.where("status <> 'disabled'").agg(failures.alias("failures")).select(F.when((n_items == 0) & (F.col("failures") > 0), "failed").when(F.col("failures") > 0, "partial").otherwise("success").alias("status"))


def audit_manifest(rows: DataFrame, key: str) -> DataFrame:
    """key, item_count, item_ids_sha256 of the ordered ids, counts by source and by content status, number of files."""
    counted = lambda c: rows.groupBy(key, c).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(c + "_counts"))
    whole = rows.groupBy(key).agg(F.count(F.lit(1)).alias("item_count"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), "\n"), 256).alias("item_ids_sha256"), F.sum("n_files").alias("resolved_file_count"))
    return whole.join(counted("source"), key).join(counted("content_status"), key)
