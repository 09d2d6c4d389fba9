"""The input tables as observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratal.functions.text import canonical_url, source_group

OBSERVATION = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("item_id", T.StringType()), ("item_type", T.StringType()), ("source", T.StringType()), ("surface", T.StringType()), ("change", T.StringType()),
            ("occurred_at", T.TimestampType()), ("updated_at", T.TimestampType()), ("first_observed_at", T.TimestampType()), ("handoff_at", T.TimestampType()), ("ready_at", T.TimestampType()),
            ("observation_kind", T.StringType()), ("entity_key", T.StringType()), ("content_hash", T.StringType()), ("time_basis", T.StringType()), ("content_status", T.StringType()),
            ("raw_refs", T.ArrayType(T.StringType())), ("payload", T.StringType()), ("expires_at", T.TimestampType()), ("schema_version", T.IntegerType()),
        )
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_defaults(items: DataFrame) -> DataFrame:
    """Schema on read for older rows: ready_at and the kind take their defaults where they are missing or null."""
    for name, default in (("ready_at", F.col("first_observed_at")), ("observation_kind", F.lit("live_increment"))):
        items = items.withColumn(name, F.coalesce(name, default) if name in items.columns else default)
    return items


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 17 == 0, "bootstrap_snapshot").otherwise("live_increment")
    return e.select(F.concat(F.lit("ev:"), "event_id").alias("item_id"), F.col("event_type").alias("source"), F.concat(F.lit("user:"), "user_id").alias("entity_key"), F.sha2("event_type", 256).alias("content_hash"), F.col("ts").alias("ready_at"), F.col("ts").alias("occurred_at"), kind.alias("observation_kind"), F.col("event_id").alias("seq"), "value")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc:"), "doc_id").alias("item_id"), F.concat(F.lit("article:"), "source").alias("source"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("seq"), F.lit("live_increment").alias("observation_kind"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("page:"), "page_id").alias("item_id"), F.lit("article:web").alias("source"), canonical_url("url").alias("entity_key"), F.col("page_id").alias("seq"), F.lit("live_increment").alias("observation_kind"), F.sha2("html", 256).alias("content_hash"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    post = F.concat_ws(":", "conv_id", "turn")
    return c.select(F.concat(F.lit("x_list:"), post).alias("item_id"), F.lit("x_list").alias("source"), post.alias("post_id"), F.col("conv_id").cast("string").alias("conversation_id"), F.sha2("text", 256).alias("content_hash"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("live_increment").alias("observation_kind"), "text", "role")


def grouped(items: DataFrame) -> DataFrame:
    return items.withColumn("source_group", source_group("source"))
