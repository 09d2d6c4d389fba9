"""What the operators share: the shared folder, written intermediates, hashing of words."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a fresh local folder serves a session whose executors run on this machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
        found = "file://" + tempfile.mkdtemp(prefix="stratal-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; whatever is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/stratal/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append((spark, path))
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables once their last reader is done, so that a long session does not fill the shared disk."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if (spark, path) in _WRITTEN:
            _WRITTEN.remove((spark, path))


@atexit.register
def _remove_written() -> None:
    for spark, path in [*_WRITTEN]:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session is already gone
            return


BATCH_BYTES = 4_000_000
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def keep_batches_small(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES from now on: what a lazy result needs, as it is read when the plan runs."""
    spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_BYTES for what runs inside; the session's own setting is back afterwards."""
    before = spark.conf.get(BATCH_KEY, None)
    keep_batches_small(spark)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_KEY)
        else:
            spark.conf.set(BATCH_KEY, before)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again: later stages survive the loss of the executors that made it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of numbers from the driver, as an Arrow table: a list would start Python workers on the executors, which stay a while."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    columns = zip(*rows, strict=True) if rows else [()] * len(kind)
    arrow = to_arrow_schema(kind)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), kind)


def forget_caches() -> None:
    home = sys.modules.get("stratal_worker_cache")
    for old in [k for k in vars(home) if not k.startswith("__")] if home else []:
        delattr(home, old)


def process_cache(name: str, make):
    """A value that a Python worker process keeps across its tasks, until an operator asks for another one: what was kept
    before is then given back to the system before anything else is made."""
    home = sys.modules.setdefault("stratal_worker_cache", types.ModuleType("stratal_worker_cache"))
    if not hasattr(home, name):
        forget_caches()
        release()
        setattr(home, name, make())
    return getattr(home, name)


def texts_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, null texts as empty ones."""
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def by_bytes(batches, column: int = 1, limit: int = 8_000_000):
    """Slices of Arrow batches whose text column holds about `limit` bytes at most (a longer single text stands alone).

    Spark itself bounds a batch by bytes (spark.sql.execution.arrow.maxBytesPerBatch) and rows.
    """
    for batch in batches:
        lengths = np.frombuffer(np.asarray(_byte_lengths(batch.column(column)), dtype=np.int64), dtype=np.int64)
        ends = np.cumsum(lengths)
        start, n = 0, batch.num_rows
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Gives memory that a task has freed back to the system: workers live on beside the executor's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def _byte_lengths(column):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class WordHashes(dict):
    """64-bit hash of a word (bytes); keeps what it has seen, up to a bound."""

    BOUND = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.BOUND and len(word) <= 64:
            self[word] = value
        return value


def word_hashes() -> WordHashes:
    return process_cache("word_hashes", WordHashes)


def hash_words(words: list[bytes], memo: dict) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=_U, count=len(words))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for every window of `width` words, by their order; fewer words are one window."""
    if not len(h):
        return h
    k = min(width, len(h))
    n = len(h) - k + 1
    out = mix64(h[:n] + _U(k))
    for j in range(1, k):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + h[j : j + n])
    return out


def fold_held_out(column) -> F.Column:
    """True for the fifth of documents that no classifier learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(column.cast("string")) % 5 == 0


BROADCAST_BYTES = 32_000_000
SLICE_ROWS = 500
MAX_SPLIT_KEYS = 200_000


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    """Whether counted rows, at row_bytes each and what a hash table adds, are within BROADCAST_BYTES."""
    return rows * (row_bytes + 32) <= BROADCAST_BYTES


def slice_size(total: int) -> int:
    """Rows of a slice of a hot key: it grows with the table, so that at most MAX_SPLIT_KEYS keys can own more than one."""
    return max(SLICE_ROWS, -(-total // MAX_SPLIT_KEYS))


def split_join(many: DataFrame, one: DataFrame, keys: list[str], total: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """many joined with `one` on keys, where one key may own a third of `many`: a hot key's rows are dealt into slices, and
    its rows of `one` are repeated for each slice.

    total: counted rows of many. counts: keys and _n, if they are known; else rows by key are counted, combined before
    the shuffle, so a hot key costs a row a task. The keys with more than a slice are gathered and broadcast:
    MAX_SPLIT_KEYS of them at most, a proven bound. Without any, this is a plain join.
    """
    size = slice_size(total)
    counts = counts if counts is not None else many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > size).select(*keys, F.ceil(F.col("_n") / size).cast("int").alias("_slices"))
    found = hot.toArrow()
    if not found.num_rows:
        return many.join(one, keys, how)
    hot = F.broadcast(many.sparkSession.createDataFrame(found, hot.schema))
    left = many.join(hot, keys, "left").withColumn("_slice", F.expr("CAST(pmod(xxhash64(monotonically_increasing_id()), coalesce(_slices, 1)) AS INT)")).drop("_slices")
    right = one.join(hot, keys, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))).drop("_slices")
    return left.join(right, [*keys, "_slice"], how).drop("_slice")


class Scratch:
    """Tables that one operator writes to the shared folder, and deletes when their last reader is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        df, path = written(df, name)
        self.paths.append(path)
        return df

    def drop(self) -> None:
        remove(self.spark, *self.paths)
        self.paths.clear()
