"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which goes when the driver ends; a local folder serves only a session whose
    executors run on this machine."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
        base = "file://" + tempfile.mkdtemp(prefix="stratal-")
    path = f"{base.rstrip('/')}/stratal/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _remove_made() -> None:
    for spark, path in _MADE:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is already gone
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which survives the executors that made it and goes when the driver ends."""
    path = shared_root(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@contextmanager
def single_owner(spark: SparkSession, path: str, stale_minutes: float = 60):
    """Holds path as a lock while the block runs; a second owner gets a RuntimeError.

    The lock holds its owner's token, and a thread renews its time while the block runs, however long. One that was not
    renewed for `stale_minutes` belongs to a driver that was lost: it is renamed away, which only one of several claimants
    can do, and then made anew. An owner that comes back to find another's token leaves that lock alone. Creating is as
    exclusive as the store's create without overwriting is; what must never be written late is fenced (Versions.claim).
    """
    p = spark._jvm.org.apache.hadoop.fs.Path
    lock, token = p(path), uuid.uuid4().hex
    fs = lock.getFileSystem(spark._jsc.hadoopConfiguration())

    def holder() -> str | None:
        if not fs.exists(lock):
            return None
        source = fs.open(lock)
        try:
            return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    if fs.exists(lock) and fs.getFileStatus(lock).getModificationTime() < (time.time() - 60 * stale_minutes) * 1000:
        old = p(f"{path}.stale-{uuid.uuid4().hex[:8]}")
        if fs.rename(lock, old):
            fs.delete(old, False)
    try:
        out = fs.create(lock, False)
    except Exception as e:
        if fs.exists(lock):
            raise RuntimeError(f"another owner holds {path}") from e
        raise
    out.write(token.encode())
    out.close()
    left = threading.Event()

    def renew() -> None:
        while not left.wait(15 * stale_minutes):
            if holder() != token:
                return
            fs.setTimes(lock, int(time.time() * 1000), -1)

    thread = threading.Thread(target=renew, daemon=True)
    thread.start()
    try:
        yield
    finally:
        left.set()
        thread.join()
        if holder() == token:
            fs.delete(lock, False)
