"""The ledger as a stream: a micro-batch appends what is new, by the state of each item.

`keyed` is the stream for ledgers that grow: it keeps the state of an item in the state store. `appender` is the same for
a sink that takes whole batches (foreachBatch); it joins the batch with the ledger that is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.operators import ledger as L
from stratal.sources.shared import exists, shared_root
from stratal.streaming.processors import ARRIVAL, revisions, rocks


def state(spark: SparkSession, root: str) -> DataFrame:
    """All appended rows; an empty ledger is an empty table."""
    if not exists(spark, f"{root}/items"):
        return spark.createDataFrame([], ARRIVAL + ", batch long")
    return spark.read.schema(ARRIVAL + ", batch long").parquet(f"{root}/items")


def appender(root: str):
    """A foreachBatch function. A batch that is replayed after a crash replaces its own rows, so it counts once."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = state(spark, root).where(F.col("batch") != number)
        new = L.put_items(batch, known.drop("batch"))
        new.write.mode("overwrite").parquet(f"{root}/items/batch={number}")

    return append


def keyed(arrivals: DataFrame, idle_ms: int = 0) -> DataFrame:
    """The rows to append of a stream of arrivals, as put_items of the ledger says, with the state kept by item.

    A micro-batch looks up the first row's hash and the revisions that it asks about, however many an item has. Rows of
    one micro-batch are taken in the order of seq; late ones are never dropped. idle_ms: an item that was not heard of
    for so long is forgotten (0: never).
    """
    return revisions(arrivals, idle_ms)


def start(arrivals: DataFrame, root: str):
    """Starts the stream over what is there; the sink's log counts a batch that is replayed after a crash once."""
    with rocks(arrivals.sparkSession):
        return keyed(arrivals).writeStream.format("parquet").option("path", f"{root}/items").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, source = shared_root(spark, "stream"), f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, source, root))
    kind = F.lit("live_increment")
    arrivals = stream.select(F.concat(F.lit("user:"), "user_id").alias("item_id"), F.sha2("event_type", 256).alias("content_hash"), kind.alias("observation_kind"), F.col("event_id").alias("seq"))
    start(arrivals, root).awaitTermination()
    return spark.read.schema(ARRIVAL).parquet(f"{root}/items").select("item_id", "observation_kind", "seq")


def _folder(spark: SparkSession, source: str, root: str) -> str:
    """A streaming source reads folders: the table itself if it is one, else a copy in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(source)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return source
    spark.read.parquet(source).write.parquet(f"{root}/source")
    return f"{root}/source"
