"""Numbered batches as files: one folder of one file for each batch, with a manifest, and workspaces of nested documents.

A batch is bounded by what numbered it (units.greedy_batches), so one task may hold one; rows go to the task of their
batch, which writes them in order through Spark's commit protocol. The manifest is made of the rows, not of the files, and
the files are read back whole against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.operators.units import MAX_BYTES, MAX_UNITS, greedy_batches
from stratal.sources.sinks import line_of

MANIFEST = "scope string, batch int, n_rows long, n_bytes long, sha256 string"
PART_ITEMS = 512


def write_batches(rows: DataFrame, path: str) -> None:
    """Writes rows (scope, batch, at, line) as path/shards/scope=<scope>/batch=<n>/part-*.txt, a line a row in the order of at,
    and path/manifest. Scopes are names of letters, digits and -_. only, so that a folder's name is the scope."""
    bad = rows.where(~F.coalesce(F.col("scope").rlike(r"\A[A-Za-z0-9._-]+\z"), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"no scope for a folder: {bad[0]['scope']!r}")
    # a scope that can't be null spares the writer a sort of its own, which would not keep the order of at
    sorted_ = rows.withColumn("scope", F.coalesce("scope", F.lit(""))).repartition("scope", "batch").sortWithinPartitions("scope", "batch", "at")
    sorted_.select("line", "scope", "batch").write.partitionBy("scope", "batch").text(f"{path}/shards")
    whole = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda r: r["line"]), F.lit(""))
    manifest = rows.groupBy("scope", "batch").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length("line") + 1).alias("n_bytes"), F.sha2(whole, 256).alias("sha256"))
    manifest.write.parquet(f"{path}/manifest")


def files(spark: SparkSession, path: str) -> DataFrame:
    """scope, batch, content: the whole text of every shard file; a batch of several files has several rows."""
    return spark.read.schema("value string, scope string, batch int").text(f"{path}/shards", wholetext=True).select("scope", "batch", F.col("value").alias("content"))


def problems(spark: SparkSession, path: str, max_rows: int = MAX_UNITS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """problem, scope, batch: shards that the manifest lacks, that lack a file, have several, differ from it, or are too large
    (but for a single row, which no batch can make smaller), and numbers that leave a gap."""
    held = files(spark, path).groupBy("scope", "batch").agg(F.count(F.lit(1)).alias("n_files"), F.min(F.sha2("content", 256)).alias("found"))
    told = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    both = told.join(held, ["scope", "batch"], "full")
    large = (F.col("n_rows") > max_rows) | ((F.col("n_bytes") > max_bytes) & (F.col("n_rows") > 1))
    problem = F.when(F.col("sha256").isNull(), "not named").when(F.col("found").isNull(), "missing").when(F.col("n_files") > 1, "several files").when(F.col("found") != F.col("sha256"), "changed").when(large, "too large")
    gaps = told.groupBy("scope").agg(F.max("batch").alias("last"), F.count(F.lit(1)).alias("n")).where("last + 1 <> n").select(F.lit("gap").alias("problem"), "scope", F.col("last").alias("batch"))
    return both.select(problem.alias("problem"), "scope", "batch").where("problem IS NOT NULL").unionByName(gaps)


def catalog_files(rows: DataFrame, scope: str, order: str, path: str, max_rows: int = MAX_UNITS, max_bytes: int = MAX_BYTES) -> None:
    """Every row as a canonical JSON line in the numbered shards of its scope, closed before max_rows or max_bytes is exceeded."""
    lines = rows.select(F.col(scope).cast("string").alias("scope"), F.col(order).alias("at"), line_of(rows).alias("line"))
    sized = lines.withColumn("__bytes", F.octet_length("line") + 1)
    write_batches(greedy_batches(sized, "scope", "at", "__bytes", max_rows, max_bytes), path)


def unit_documents(packages: DataFrame, units: DataFrame, items: DataFrame) -> DataFrame:
    """package_id, unit_id, part, document: each unit of a package with its items nested in it, in order, PART_ITEMS to a document.

    packages: package_id, unit_id; units: unit_id and what else the document shows; items: unit_id, item_id and what else. A
    unit of very many items is several documents, so none is gathered whole.
    """
    shown = [c for c in items.columns if c != "unit_id"]
    listed = greedy_batches(items.withColumn("__one", F.lit(0)), "unit_id", "item_id", "__one", PART_ITEMS, 1).withColumnRenamed("batch", "part")
    parts = listed.groupBy("unit_id", "part").agg(F.array_sort(F.collect_list(F.struct("item_id", *(c for c in shown if c != "item_id")))).alias("items"))
    whole = packages.select("package_id", "unit_id").join(units, "unit_id").join(parts, "unit_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    return whole.select("package_id", "unit_id", "part", line_of(whole, ("package_id",)).alias("document"))


def write_workspaces(packages: DataFrame, units: DataFrame, items: DataFrame, path: str) -> None:
    """The workspace of every package below path: documents in numbered shards, and a list of what is to be done, a unit a line."""
    made = unit_documents(packages, units, items)
    rows = made.select(F.col("package_id").cast("string").alias("scope"), F.concat_ws("#", "unit_id", F.lpad(F.col("part").cast("string"), 6, "0")).alias("at"), F.col("document").alias("line"))
    write_batches(greedy_batches(rows.withColumn("__bytes", F.octet_length("line") + 1), "scope", "at", "__bytes"), f"{path}/units")
    todo = packages.select(F.col("package_id").cast("string").alias("scope"), F.col("unit_id").alias("at"), F.concat(F.lit("- [ ] "), "unit_id").alias("line"))
    write_batches(greedy_batches(todo.withColumn("__bytes", F.octet_length("line") + 1), "scope", "at", "__bytes"), f"{path}/todo")
