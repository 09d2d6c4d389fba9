"""Writers: JSON lines, groups of them with an index, blobs, revisions, receipts, staged hand-offs, and erasing.

Every writer goes through Spark's commit protocol, so a reader sees whole files only, and no group is gathered into one
task: a group that holds most rows is written by as many tasks as hold them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.sources.shared import exists


def canonical_json(x) -> Column:
    """JSON text with the keys of every object, nested ones too, sorted; compact, nulls and non-ASCII kept; null for no JSON."""
    return F.to_json(F.try_parse_json(x if isinstance(x, Column) else F.col(x)))


def line_of(df: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    """A row as one canonical JSON line."""
    row = F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns) if c not in leave))
    return canonical_json(F.to_json(row, {"ignoreNullFields": "false"}))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(line_of(df).alias("value")).write.mode("overwrite").text(path)


def write_groups(df: DataFrame, key: str, path: str) -> None:
    """One folder of JSON lines for each value of key below path/groups, and path/index: key, n, n_bytes. A null key is the group 'none'."""
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("none")).alias("group"), line_of(df).alias("value"))
    rows.write.mode("overwrite").partitionBy("group").text(f"{path}/groups")
    written = read_groups(df.sparkSession, path)
    index = written.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("n_bytes"))
    write_jsonl(index, f"{path}/index")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """group, value (a line) of everything below path/groups."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/groups/group=*")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p):
        return spark.createDataFrame([], "group string, value string")
    rows = spark.read.schema("value string, group string").option("lineSep", "\n").text(f"{path}/groups")
    return rows.select("group", "value")


def append_blobs(contents: DataFrame, content: str, root: str) -> None:
    """Stores every content that is not there yet under its digest; dealt by the first two digits."""
    spark = contents.sparkSession
    new = contents.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("digest"), F.col(content).alias("content")).dropDuplicates(["digest"])
    if exists(spark, root):
        new = new.join(blobs_in(spark, root).select("digest"), "digest", "left_anti")
    new.withColumn("prefix", F.left("digest", F.lit(2))).write.mode("append").partitionBy("prefix").parquet(root)


def blobs_in(spark: SparkSession, root: str) -> DataFrame:
    """digest, content, prefix of what is stored; content that is not what its digest says is left out."""
    return spark.read.schema("digest string, content string, prefix string").parquet(root).where(F.sha2("content", 256) == F.col("digest"))


def erase(spark: SparkSession, root: str, digests: DataFrame) -> None:
    """Rewrites the folders that hold one of the digests (digest) without them; the others are not touched."""
    stored = spark.read.schema("digest string, content string, prefix string").parquet(root)
    prefixes = digests.select(F.left("digest", F.lit(2)).alias("prefix")).distinct()
    kept = stored.join(F.broadcast(prefixes), "prefix", "left_semi").join(digests.select("digest"), "digest", "left_anti")  # 256 prefixes at most
    staged = f"{root}-erase-{uuid.uuid4().hex[:8]}"
    kept.write.partitionBy("prefix").parquet(staged)
    remaining = spark.read.schema("digest string, content string, prefix string").parquet(staged) if exists(spark, staged) else kept.limit(0)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    held = {r["prefix"] for r in remaining.select("prefix").distinct().collect()}
    for r in prefixes.collect():
        target = path(f"{root}/prefix={r['prefix']}")
        fs.delete(target, True)
        if r["prefix"] in held:
            fs.rename(path(f"{staged}/prefix={r['prefix']}"), target)
    fs.delete(path(staged), True)


def write_revisions(revisions: DataFrame, root: str) -> None:
    """Appends (source, item_id, revision, content); of several writes of one revision the first to be stored stays, within a call the smallest content."""
    spark, key = revisions.sparkSession, ["source", "item_id", "revision"]
    new = revisions.groupBy(*key).agg(F.min("content").alias("content"))
    if exists(spark, root):
        new = new.join(spark.read.parquet(root).select(*key), key, "left_anti")
    new.select("item_id", "revision", "content", "source").write.mode("append").partitionBy("source").parquet(root)


def write_receipts(receipts: DataFrame, source: str, at: str, root: str) -> None:
    """Appends receipts, dealt by source and day."""
    receipts.withColumns({"source": F.col(source), "day": F.to_date(at)}).write.mode("append").partitionBy("source", "day").parquet(root)


def hand_off(df: DataFrame, path: str) -> bool:
    """Writes to a staging folder beside path and renames it, so a reader sees all or nothing; False if path is there already."""
    spark = df.sparkSession
    if exists(spark, path):
        return False
    staged = f"{path}.staging-{uuid.uuid4().hex[:8]}"
    df.write.parquet(staged)
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.rename(p(staged), p(path)):
        return True
    fs.delete(p(staged), True)
    return False
