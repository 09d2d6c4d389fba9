"""The ledger's changes of several tables, each as one version: polls, seals, hand-offs and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.operators import handoff as H
from stratal.operators import ledger as L
from stratal.sources.versions import Versions

LEDGER = {
    "items": "item_id string, at timestamp_ntz",
    "markers": "entity long, at timestamp_ntz",
    "seals": "run_id string, item_id string",
    "runs": "run_id string, handoff_state string, seq long",
    "deliveries": "item_id string, run_id string",
}


def open_ledger(spark: SparkSession, root: str) -> Versions:
    return Versions(spark, root, LEDGER)


def commit_poll(ledger: Versions, polls: DataFrame) -> int:
    """New items and moved markers of whole polls (poll_id, item_id, entity, at) as one version; a poll with a broken row is
    left out. An item that another writer adds first is not added again, as the commit is then computed anew."""

    def make(read):
        known = current_markers(read("markers"))
        items, markers = H.poll_commit(polls, read("items").select("item_id"), known)
        had = known.select("entity", F.col("at").alias("had"))
        return {"items": items, "markers": markers.join(had, "entity", "left").where("had IS NULL OR at > had")}

    return ledger.commit(make, [("items", "item_id", "items"), ("markers", "entity", "markers")])


def current_markers(markers: DataFrame) -> DataFrame:
    """entity, at: a marker's newest row counts."""
    return markers.groupBy("entity").agg(F.max("at").alias("at"))


def states(runs: DataFrame) -> DataFrame:
    """run_id, handoff_state: the newest row of each run."""
    return L.last_write(runs, "run_id", "handoff_state")


def seal_run(ledger: Versions, run_id: str, wanted: DataFrame) -> int:
    """All wanted items (item_id) for the run, and its state, as one version; raises if one is unknown, delivered or another run's."""

    def make(read):
        rows = wanted.select(F.lit(run_id).alias("run_id"), "item_id")
        seals = L.seal(rows, read("items"), read("deliveries"), read("seals"))
        return {"seals": seals, "runs": _moved(read, run_id, None)}

    return ledger.commit(make, [("seals", "item_id", "seals"), ("seals", "item_id", "deliveries"), ("runs", "run_id", "runs")])


def move_run(ledger: Versions, run_id: str, event: str) -> int:
    """The run's next state; with `queue` or `complete_locally` the deliveries of all its items in the same version.

    Repeating an event that took effect adds nothing; one that the state doesn't allow raises.
    """

    def make(read):
        rows = {"runs": _moved(read, run_id, event)}
        if event != "publish":
            sealed = read("seals").where(F.col("run_id") == run_id).select("item_id", "run_id")
            rows["deliveries"] = sealed.join(read("deliveries").select("item_id"), "item_id", "left_anti")
        return rows

    return ledger.commit(make, [("deliveries", "item_id", "deliveries"), ("runs", "run_id", "runs")])


def _moved(read, run_id: str, event: str | None) -> DataFrame:
    """The row of `runs` that the event adds, none if it changes nothing; event None seals. The rows of one run are few."""
    own = read("runs").where(F.col("run_id") == run_id)
    last = own.orderBy(F.desc("seq")).limit(1).collect()
    state, seq = (last[0]["handoff_state"], last[0]["seq"]) if last else (None, 0)
    if event is None:
        if state not in (None, "sealed"):
            raise RuntimeError(f"{run_id} is {state} and can't be sealed")
        after, changed = "sealed", state is None
    elif state is None:
        raise KeyError(run_id)
    else:
        after, changed = L.next_state(state, event)
    return own.sparkSession.createDataFrame([(run_id, after, seq + 1)] if changed else [], LEDGER["runs"])
