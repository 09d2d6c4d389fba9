"""Posts of several lists from a stream whose offset has a cursor by list."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.sources.list_stream import list_source
from stratal.sources.observations import table
from stratal.sources.shared import shared_root
from stratal.sources.sinks import write_groups

POSTS = "list long, post_id long, seen long, text string"


def landed(root: str):
    """(lists, newest, fetch) of lists that lie as JSON lines (cursor, post_id, text) below root/groups/group=<list>."""

    def store():
        from pyarrow import fs

        return fs.FileSystem.from_uri(root)

    def lists() -> list[str]:
        from pyarrow import fs

        files, base = store()
        found = files.get_file_info(fs.FileSelector(f"{base}/groups", allow_not_found=True))
        return sorted(f.path.rsplit("=", 1)[1] for f in found if "group=" in f.path)

    def lines(name: str):
        from pyarrow import fs

        files, base = store()
        for f in files.get_file_info(fs.FileSelector(f"{base}/groups/group={name}")):
            if f.path.endswith(".txt"):
                with files.open_input_stream(f.path) as source:
                    yield from map(json.loads, filter(None, source.read().decode().split("\n")))

    def newest(name: str) -> int:
        return max((x["cursor"] for x in lines(name)), default=0)

    def fetch(name: str, after: int, upto: int):
        return [(int(name), x["post_id"], x["cursor"], x["text"]) for x in lines(name) if after < x["cursor"] <= upto]

    return lists, newest, fetch


def once(stream: DataFrame) -> DataFrame:
    """Each post of a list once, whatever the overlap and replays."""
    return stream.dropDuplicates(["list", "post_id"])


def advance(spark: SparkSession, source: str, root: str, **options) -> None:
    """Runs the stream over what there is now, into root/posts, and stops it."""
    stream = spark.readStream.format(source).option("state", f"{root}/state").options(**options).load()
    query = once(stream).writeStream.format("parquet").option("path", f"{root}/posts").option("checkpointLocation", f"{root}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def run_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_root(spark, "lists")
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 4).alias("list"), (F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"), "text")
    # a cursor is the arrival of a post in its list: here its number
    write_groups(c.withColumn("cursor", F.col("post_id") + 1), "list", f"{root}/upstream")
    spark.dataSource.register(list_source("posts_by_list", POSTS, *landed(f"{root}/upstream")))
    limit = c.agg(F.max("post_id")).first()[0] // 3 + 2
    for overlap in (0, 500):  # stopped and started again
        advance(spark, "posts_by_list", root, overlap=overlap, limit=limit, per_task=limit)
    return spark.read.schema(POSTS).parquet(f"{root}/posts").select("list", "post_id", "text")
