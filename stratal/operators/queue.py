"""A queue whose jobs are leased: claim, heartbeat, and results that only the present owner can write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.operators import handoff as H
from stratal.operators import ledger as L
from stratal.sources.versions import Lease, Versions

QUEUE = {"jobs": "job_id string, retry_at string, seq long", "results": "job_id string, outcome string, fence long"}
LASTS_S = 300


def open_queue(spark: SparkSession, root: str) -> Versions:
    return Versions(spark, root, QUEUE)


def enqueue(queue: Versions, jobs: DataFrame) -> int:
    """Adds jobs (job_id, retry_at) that are not there yet."""
    make = lambda read: {"jobs": jobs.join(read("jobs").select("job_id").distinct(), "job_id", "left_anti").select("job_id", "retry_at", F.lit(0).cast("long").alias("seq"))}
    return queue.commit(make, [("jobs", "job_id", "jobs")])


def waiting(queue: Versions) -> DataFrame:
    """job_id, retry_at of jobs without a result, by their newest row."""
    latest = L.last_write(queue.read("jobs"), "job_id", "retry_at")
    return latest.join(queue.read("results").select("job_id"), "job_id", "left_anti")


def due(queue: Versions, now) -> DataFrame:
    """job_id, retry_at, action of waiting jobs that nobody holds; unreadable times are for quarantine."""
    held = queue.spark.createDataFrame([(j,) for j in queue.held()], "job_id string")
    return H.requeue(waiting(queue).join(held, "job_id", "left_anti"), now).where("action <> 'wait'")


def take(queue: Versions, now, owner: str, lasts_s: float = LASTS_S) -> Lease | None:
    """A lease of the first job that is due, in the order of its id, and that no live worker holds; None if there is none."""
    candidates = H.requeue(waiting(queue), now).where("action = 'due'").orderBy("job_id").limit(len(queue.held()) + 1)
    for row in candidates.collect():
        lease = queue.claim(row["job_id"], owner, lasts_s)
        if lease:
            return lease
    return None


def finish(queue: Versions, lease: Lease, outcome: str) -> int:
    """The job's result, and the lease given back, as one version; Fenced if another worker has taken the job over."""
    row = [(lease.name, outcome, lease.fence)]
    return queue.commit(lambda read: {"results": queue.spark.createDataFrame(row, QUEUE["results"])}, [], lease, release=True)


def put_off(queue: Versions, lease: Lease, retry_at: str) -> int:
    """Back into the queue for a later time, and the lease given back, as one version."""

    def make(read):
        n = read("jobs").where(F.col("job_id") == lease.name).agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
        return {"jobs": queue.spark.createDataFrame([(lease.name, retry_at, n)], QUEUE["jobs"])}

    return queue.commit(make, [], lease, release=True)
