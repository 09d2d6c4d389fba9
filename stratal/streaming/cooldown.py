"""Cooldown-limited events as a stateful stream: one accepted time per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.sources.shared import shared_root
from stratal.streaming.ledger import _folder
from stratal.streaming.processors import accepted, rocks

HOUR = 3_600_000_000


def with_cooldown(events: DataFrame, cooldown_micros: int, idle_ms: int = 0) -> DataFrame:
    """entity, event_id, t of the accepted ones; events: entity, event_id, t (microseconds).

    Rows of one micro-batch are taken in the order of t. Late rows are never dropped: one that arrives behind the last
    accepted time is judged against that time. idle_ms: an entity that was not heard of for so long is forgotten (0: never).
    """
    return accepted(events, cooldown_micros, idle_ms)


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratal.functions.times import micros

    root, source = shared_root(spark, "stream"), f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(_folder(spark, source, root))
    rows = stream.where("value > 50").select(F.col("user_id").alias("entity"), "event_id", micros("ts").alias("t"))
    with rocks(spark):
        query = with_cooldown(rows, 24 * HOUR).writeStream.format("parquet").option("path", f"{root}/accepted").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema("entity long, event_id long, t long").parquet(f"{root}/accepted")
    return out.select(F.col("entity").alias("user_id"), "event_id", F.expr("TIMESTAMP_NTZ'1970-01-01' + make_dt_interval(0, 0, 0, t / 1000000.0)").alias("ts"))
