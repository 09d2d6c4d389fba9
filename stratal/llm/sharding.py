"""Shards by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split on another bit.

DataFrame functions only. A bucket is a prefix of the bits of its documents' hashes. The bytes by prefix are summed
at eight more bits at a time, for the buckets that are still too large; within such a step a bucket is a leaf at the
first bit at which it fits. The directory stays a table that is joined on the prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratal.llm.common import remove, written

SHARD_BYTES = 1 << 20
BITS = 56  # of the hash: 14 hexadecimal digits
STEP = 8


def _prefix(depth: int) -> F.Column:
    return F.shiftright("h", BITS - depth)


HASH = f"CAST(conv(substring(md5(coalesce(CAST(doc_id AS STRING), '')), 1, {BITS // 4}), 16, 10) AS BIGINT)"
BYTES = "CAST(coalesce(octet_length(text), 0) AS BIGINT)"
SHARD = "lpad(conv(q, 10, 2), depth, '0')"


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text (0 for null), the hash of the id, and where the row stands."""
    return docs.select("doc_id", F.expr(BYTES).alias("n_bytes"), F.expr(HASH).alias("h"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))


def directory(sized: DataFrame, limit: int) -> tuple[list[tuple[int, DataFrame]], DataFrame | None]:
    """The leaves found at each step, as (bits of p, table of p, depth, q, total), and the hashes that no bit can part.

    sized: h and n_bytes of every row. A table that fits into one shard has no step.
    """
    if (sized.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0) <= limit:
        return [], None
    steps, depth, open_ = [], 0, None
    while depth < BITS:
        base, depth = depth, depth + STEP
        left = sized if open_ is None else sized.join(open_, _prefix(base) == open_["open"], "left_semi")
        sums, _ = written(left.groupBy(_prefix(depth).alias("p")).agg(F.sum("n_bytes").alias("bytes")), "buckets")
        cuts = F.explode(F.sequence(F.lit(base + 1), F.lit(depth)))
        by_cut = sums.select("p", "bytes", cuts.alias("depth")).select("p", "depth", F.expr(f"shiftright(p, {depth} - depth)").alias("q"), "bytes")
        totals = by_cut.groupBy("depth", "q").agg(F.sum("bytes").alias("total"))
        fits = by_cut.join(totals.where(F.col("total") <= limit), ["depth", "q"])
        # the shallowest cut that fits: all above it are too large
        leaf = fits.groupBy("p").agg(F.min(F.struct("depth", "q", "total")).alias("leaf")).select("p", "leaf.*")
        found, _ = written(sums.select("p").join(leaf, "p", "left"), "directory")
        steps.append((depth, found.where("total IS NOT NULL")))
        open_ = found.where("total IS NULL").select(F.col("p").alias("open"))
        if not open_.limit(1).count():
            return steps, None
    return steps, open_


def extendible_shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard (its prefix as text), depth (its number of bits), shard_bytes of every row of docs.

    Documents whose hashes agree in every bit (rows that repeat an id) would never part: such a bucket is chained,
    shard names get "+page". Running sums by writing task and offsets between tasks number the pages, each within the
    limit; a single document longer than half the limit gets a page alone, and only one longer than the limit
    exceeds it. An empty table gives no rows; null texts have no bytes, a null id is hashed like an empty one; other
    columns are not read, whatever their names.
    """
    if limit < 2:
        raise ValueError("the limit has to be 2 bytes at least")
    sized, _ = written(hashed(docs), "hashed")
    steps, open_ = directory(sized, limit)
    if not steps:
        return _single(sized)
    parts = [sized.join(leaf, _prefix(bits) == leaf["p"]).select("doc_id", "n_bytes", F.expr(SHARD).alias("shard"), "depth", F.col("total").alias("shard_bytes")) for bits, leaf in steps]
    if open_ is not None:
        placed = _chained(sized.join(open_, F.col("h") == open_["open"], "left_semi"), limit)
        totals = placed.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
        parts.append(placed.join(totals, "shard").select("doc_id", "n_bytes", "shard", F.lit(BITS).alias("depth"), "shard_bytes"))
    return _union(parts)


def _single(sized: DataFrame) -> DataFrame:
    total = sized.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    return sized.select("doc_id", "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(total).cast("long").alias("shard_bytes"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _chained(rows: DataFrame, limit: int) -> DataFrame:
    """rows (with h, part, row, n_bytes) and the page of the chain that each stands on, as shard."""
    half = limit // 2
    large = F.col("n_bytes") > half
    small = F.when(large, 0).otherwise(F.col("n_bytes"))
    sums = rows.groupBy("h", "part").agg(F.sum(small).alias("bytes"), F.sum(large.cast("long")).alias("large"))
    before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("h", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("large").over(before), F.lit(0)).alias("large_before"))
    own = Window.partitionBy("h", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"b": F.coalesce(F.sum(small).over(own), F.lit(0)), "l": F.coalesce(F.sum(large.cast("long")).over(own), F.lit(0))}).join(sums, ["h", "part"])
    # a page of small rows starts within one half and its last row ends at most half a limit later
    page = F.when(large, F.concat(F.lit("x"), F.col("l") + F.col("large_before"))).otherwise(F.floor((F.col("b") + F.col("bytes_before")) / max(1, half)).cast("string"))
    return placed.withColumn("shard", F.concat(F.expr(f"lpad(conv(h, 10, 2), {BITS}, '0')"), F.lit("+"), page))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Every row of docs once, with its columns, under shard=<prefix> folders; a shard is within its limit, so one task writes it.

    The shard travels with the row: the directory is looked up by the hash of the id, and rows of chained buckets are
    written with their place before they are dealt to pages. The folder column is named shard; a column of docs of
    that name comes back as doc_shard. Null ids and repeated rows are rows like any other.
    """
    own = docs.columns
    names = {c: f"c{k}" for k, c in enumerate(own)}
    back = {f"c{k}": "doc_shard" if c.lower() == "shard" else c for k, c in enumerate(own)}
    rows = docs.select(F.expr(HASH).alias("h"), F.expr(BYTES).alias("n_bytes"), F.struct(*(F.col(f"`{c}`").alias(n) for c, n in names.items())).alias("whole"))
    sized, place = written(rows.select("h", "n_bytes"), "hashed")
    steps, open_ = directory(sized, limit)
    if not steps:
        parts = [rows.select("whole", F.lit("all").alias("shard"))]
    else:
        parts = [rows.join(leaf, _prefix(bits) == leaf["p"]).select("whole", F.expr(SHARD).alias("shard")) for bits, leaf in steps]
    if open_ is not None:
        chain = rows.join(open_, F.col("h") == open_["open"], "left_semi")
        chain, _ = written(chain.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "chained")
        parts.append(_chained(chain, limit).select("whole", "shard"))
    out = _union(parts).select("whole.*", "shard").withColumnsRenamed(back)
    out.repartition("shard").write.partitionBy("shard").parquet(path)
    remove(docs.sparkSession, place)


SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 14) AS BIGINT) AS h FROM documents),
cuts AS (SELECT doc_id, n_bytes, d AS depth, h >> ({BITS} - d) AS q, h FROM docs, (SELECT unnest(range(0, 33)) AS d)),
totals AS (SELECT depth, q, sum(n_bytes)::BIGINT AS total FROM cuts GROUP BY depth, q),
leaves AS (SELECT c.doc_id, c.n_bytes, c.h, c.depth, t.total, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.depth) AS r
  FROM cuts c JOIN totals t ON c.depth = t.depth AND c.q = t.q WHERE t.total <= {SHARD_BYTES})
SELECT doc_id, n_bytes, substr(lpad(bin(h), {BITS}, '0'), 1, depth) AS shard, CAST(depth AS INT) AS depth, total AS shard_bytes FROM leaves WHERE r = 1
"""
