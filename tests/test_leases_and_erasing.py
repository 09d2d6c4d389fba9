"""Leases with fences, locks with owners, tombstones that survive crashes, generations of checkpoints."""

import os
import time

import pytest
from pyspark.sql import functions as F

from stratal.operators import handoff as H
from stratal.operators import queue as Q
from stratal.sources.blobstore import BlobStore
from stratal.sources.shared import single_owner
from stratal.sources.versions import Fenced, Versions


def now():
    return F.expr("TIMESTAMP'2024-01-15'")


@pytest.fixture
def queue(spark, tmp_path):
    q = Q.open_queue(spark, f"file://{tmp_path}/q")
    Q.enqueue(q, spark.createDataFrame([("a", "2024-01-01T00:00:00Z"), ("b", "2024-01-02T00:00:00Z"), ("c", "2024-09-01T00:00:00Z"), ("d", "when?")], "job_id string, retry_at string"))
    return q


def test_jobs_are_taken_once_and_finished_by_their_owner(spark, queue):
    first, second = Q.take(queue, now(), "w1"), Q.take(queue, now(), "w2")
    assert (first.name, second.name) == ("a", "b") and Q.take(queue, now(), "w3") is None
    assert queue.claim("a", "w3") is None and queue.held() == {"a": "w1", "b": "w2"}
    assert {(r["job_id"], r["action"]) for r in Q.due(queue, now()).collect()} == {("d", "quarantine")}
    Q.finish(queue, first, "done")
    Q.put_off(queue, second, "2024-08-01T00:00:00Z")
    assert queue.held() == {} and Q.take(queue, now(), "w4") is None
    assert [tuple(r) for r in queue.read("results").collect()] == [("a", "done", 1)]
    assert {r["job_id"] for r in Q.waiting(queue).collect()} == {"b", "c", "d"}
    assert Q.enqueue(queue, Q.waiting(queue)) and queue.read("jobs").count() == 5
    with pytest.raises(Fenced):  # it was given back
        Q.finish(queue, first, "again")


def test_a_late_writer_is_refused(queue):
    old = Q.take(queue, now(), "slow")
    queue.beat(old)
    assert queue.claim(old.name, "other") is None  # it beats, so it lives
    new = queue.claim(old.name, "other", lasts_s=-1)  # not heard of for too long
    assert new.fence == old.fence + 1
    for late in (lambda: Q.finish(queue, old, "late"), lambda: queue.beat(old), lambda: Q.put_off(queue, old, "2024-08-01T00:00:00Z")):
        with pytest.raises(Fenced):
            late()
    assert queue.read("results").count() == 0
    Q.finish(queue, new, "done")
    assert [tuple(r) for r in queue.read("results").collect()] == [("a", "done", 2)]


def test_one_of_two_claimants_gets_the_lease(queue, monkeypatch):
    publish, raced = Versions._publish, []

    def second(self, version, manifest):
        if not raced:
            raced.append(1)
            raced.append(queue.claim("a", "quick"))
        return publish(self, version, manifest)

    monkeypatch.setattr(Versions, "_publish", second)
    assert queue.claim("a", "slow") is None and raced[1].owner == "quick"


def test_a_lock_is_renewed_and_left_alone_by_an_earlier_owner(spark, tmp_path):
    path = f"file://{tmp_path}/lock"
    with single_owner(spark, path, stale_minutes=0.02):
        time.sleep(2.5)  # longer than it takes to go stale
        with pytest.raises(RuntimeError), single_owner(spark, path, stale_minutes=0.02):
            pass
    assert not (tmp_path / "lock").exists()
    with single_owner(spark, path):
        past = time.time() - 7200
        os.utime(tmp_path / "lock", (past, past))
        second = single_owner(spark, path)
        second.__enter__()
    assert (tmp_path / "lock").exists()  # the second owner's
    second.__exit__(None, None, None)
    assert not (tmp_path / "lock").exists()


@pytest.fixture
def store(spark, tmp_path):
    made = BlobStore(spark, f"file://{tmp_path}/s")
    made.put(spark.createDataFrame([("x",), ("y",), ("x",), (None,), ("",)], "content string"))
    return made


def contents(store):
    return sorted(r["content"] for r in store.blobs().collect())


def digests(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.sha2("t", 256).alias("digest"))


def test_erased_contents_are_gone_for_readers_at_once_and_from_disk_after_a_purge(spark, store, tmp_path):
    store.put(spark.createDataFrame([("y",), ("z",)], "content string"))
    assert contents(store) == ["", "x", "y", "z"]
    store.erase(digests(spark, "x", "unknown"))
    store.erase(digests(spark, "x"))
    store.put(spark.createDataFrame([("x",), ("w",)], "content string"))
    assert contents(store) == ["", "w", "y", "z"] and store.damaged().count() == 0
    store.purge()
    store.log.forget(older_than_s=-60)
    assert contents(store) == ["", "w", "y", "z"]
    on_disk = spark.read.option("recursiveFileLookup", "true").schema("digest string, content string").parquet(f"file://{tmp_path}/s/data/blobs")
    assert "x" not in {r["content"] for r in on_disk.collect()}


@pytest.mark.parametrize("step", ["_write", "_publish"])
@pytest.mark.parametrize("act", ["erase", "purge", "put"])
def test_a_crash_at_any_step_loses_no_other_blob(spark, store, monkeypatch, step, act):
    store.erase(digests(spark, "y"))
    acts = {"erase": lambda: store.erase(digests(spark, "x")), "purge": store.purge, "put": lambda: store.put(spark.createDataFrame([("new",)], "content string"))}
    plain = getattr(Versions, step)
    monkeypatch.setattr(Versions, step, lambda self, *a: (step == "_write" and plain(self, *a), (_ for _ in ()).throw(OSError("lost")))[1])
    with pytest.raises(OSError):
        acts[act]()
    monkeypatch.undo()
    assert contents(store) == ["", "x"]
    acts[act]()  # started over
    assert contents(store) == {"erase": [""], "purge": ["", "x"], "put": ["", "new", "x"]}[act]


def test_items_are_erased_with_contents_that_are_theirs_alone(spark, tmp_path):
    store = BlobStore(spark, f"file://{tmp_path}/r")
    rows = [("s", "i", "1", "own"), ("s", "i", "2", "shared"), ("s", "j", "1", "shared"), ("s", "j", "1", "zz later"), ("t", "i", "1", None)]
    store.put_revisions(spark.createDataFrame(rows, "source string, item_id string, revision string, content string"))
    assert contents(store) == ["own", "shared"]
    store.erase_items(spark.createDataFrame([("s", "i"), ("s", "none")], "source string, item_id string"))
    assert contents(store) == ["shared"] and {(r["source"], r["item_id"]) for r in store.revisions().collect()} == {("s", "j"), ("t", "i")}
    store.put_revisions(spark.createDataFrame([("s", "i", "3", "back"), ("s", "j", "2", "more")], "source string, item_id string, revision string, content string"))
    assert contents(store) == ["more", "shared"]
    store.erase_items(spark.createDataFrame([("s", "j")], "source string, item_id string"))
    assert contents(store) == []  # the item that shared it is erased too


def test_generations(spark):
    phases = [("ok", "h", "h", True), ("input", "h", "g", True), ("session", "h", "h", False), ("fresh", "h", None, False), ("hole", "h", "h", True), ("lost", "h", "h", True), ("part", "h", "h", True), ("part rewinds", "h", "h", True), ("all", "h", "h", True), ("none", "h", "h", True)]
    yes = (True, True, True)
    batches = {
        "ok": [yes, yes, (False, False, True), (False, False, False)], "input": [yes], "session": [yes], "fresh": [(False, False, False)], "hole": [yes, (False, False, False), yes],
        "lost": [yes, (True, False, False)], "part": [yes, (True, False, True)], "part rewinds": [(True, False, True), yes], "all": [yes, yes],
    }
    rows = [(p, k + 1, *b) for p, own in batches.items() for k, b in enumerate(own)]
    got = H.generations(spark.createDataFrame(phases, "phase string, input_hash string, had_hash string, session boolean"), spark.createDataFrame(rows, "phase string, batch long, committed boolean, whole boolean, partial boolean"))
    rewind = "checkpoint_rewind_required"
    assert {r["phase"]: (r["cause"], r["reusable"]) for r in got.collect()} == {
        "ok": (None, 2), "input": ("generation_input_changed", 0), "session": ("missing_session_checkpoint", 0), "fresh": (None, 0), "hole": (rewind, 0),
        "lost": (rewind, 0), "part": (None, 1), "part rewinds": (rewind, 0), "all": (None, 2), "none": (None, 0),
    }
