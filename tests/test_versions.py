"""Commits of several tables: races, crashes, snapshots."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from stratal.operators import commits as C
from stratal.sources.versions import Conflict, Versions

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def log(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/log", {"a": "k long, v string", "b": "k long"})


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def test_a_commit_is_seen_as_a_whole_and_old_versions_stay(spark, log):
    assert log.latest() == 0 and log.read("a").count() == 0
    assert log.commit(lambda read: {"a": rows(spark, (1, "x")), "b": rows(spark, (1, "")).select("k")}, []) == 1
    assert log.commit(lambda read: {"a": read("a").selectExpr("k + 1 AS k", "v")}, []) == 2
    assert sorted(map(tuple, log.read("a").collect())) == [(1, "x"), (2, "x")] and log.read("b").count() == 1
    assert log.read("a", 1).count() == 1 and log.read("a", 0).count() == 0
    assert log.commit(lambda read: {}, []) == 3 and log.read("a").count() == 2


def test_the_second_of_two_writers_computes_anew_on_a_common_key(spark, log):
    seen = []

    def second(read):
        seen.append({r["k"] for r in read("a").collect()})
        if len(seen) == 1:  # the other writer is first, after this one has taken its snapshot
            log.commit(lambda _: {"a": rows(spark, (1, "first"))}, [("a", "k", "a")])
        return {"a": rows(spark, (1, "second")).join(read("a").select("k"), "k", "left_anti").select("k", "v")}

    assert log.commit(second, [("a", "k", "a")]) == 2
    assert seen == [set(), {1}] and [tuple(r) for r in log.read("a").collect()] == [(1, "first")]


def test_writers_of_other_keys_do_not_disturb_each_other(spark, log):
    calls = []

    def second(read):
        calls.append(1)
        if len(calls) == 1:
            log.commit(lambda _: {"a": rows(spark, (1, "first"))}, [("a", "k", "a")])
        return {"a": rows(spark, (2, "second"))}

    assert log.commit(second, [("a", "k", "a")]) == 2 and len(calls) == 1
    assert sorted(map(tuple, log.read("a").collect())) == [(1, "first"), (2, "second")]


def test_racing_threads_lose_nothing(spark, log):
    made = []

    def writer(n):
        made.append(log.commit(lambda read: {"a": rows(spark, (7, f"w{n}")).join(read("a").select("k"), "k", "left_anti").select("k", "v"), "b": rows(spark, (n, "")).select("k")}, [("a", "k", "a")]))

    threads = [threading.Thread(target=writer, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(made) == [1, 2, 3, 4] and log.read("a").count() == 1 and {r["k"] for r in log.read("b").collect()} == {0, 1, 2, 3}


def test_a_writer_that_always_loses_gives_up(spark, log):
    def make(read):
        log.commit(lambda _: {"a": rows(spark, (1, "other"))}, [])
        return {"a": rows(spark, (1, "mine"))}

    with pytest.raises(Conflict):
        log.commit(make, [("a", "k", "a")])
    assert {r["v"] for r in log.read("a").collect()} == {"other"}


def test_a_crash_between_data_and_version_leaves_the_old_snapshot(spark, log, monkeypatch, tmp_path):
    log.commit(lambda read: {"a": rows(spark, (1, "x"))}, [])
    monkeypatch.setattr(Versions, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        log.commit(lambda read: {"a": rows(spark, (2, "y")), "b": rows(spark, (2, "")).select("k")}, [])
    monkeypatch.undo()
    assert log.latest() == 1 and log.read("a").count() == 1 and log.read("b").count() == 0
    assert log.forget(older_than_s=-60) == 2 and log.read("a").count() == 1  # what the lost writer left
    assert log.commit(lambda read: {"b": rows(spark, (3, "")).select("k")}, []) == 2


def test_compacting_keeps_rows_and_those_added_meanwhile(spark, log, monkeypatch):
    for n in range(3):
        log.commit(lambda read, n=n: {"a": rows(spark, (n, "x"))}, [])
    publish, raced = Versions._publish, []

    def late(self, version, manifest):
        if not raced:
            raced.append(1)
            log.commit(lambda read: {"a": rows(spark, (9, "meanwhile"))}, [])
        return publish(self, version, manifest)

    monkeypatch.setattr(Versions, "_publish", late)
    version = log.compact("a")
    assert version == 5 and {r["k"] for r in log.read("a").collect()} == {0, 1, 2, 9} and len(log._manifest(5)["state"]["a"]) == 2
    assert log.forget(keep=1, older_than_s=-60) == 3 and log.read("a").count() == 4


@pytest.fixture
def ledger(spark, tmp_path):
    found = C.open_ledger(spark, f"file://{tmp_path}/ledger")
    polls = spark.createDataFrame([(1, f"i{k}", k % 3, DAY + dt.timedelta(hours=k)) for k in range(8)] + [(2, "j0", 5, DAY), (2, None, 5, DAY)], "poll_id long, item_id string, entity long, at timestamp_ntz")
    assert C.commit_poll(found, polls) == 1
    return found


def ids(df):
    return {r["item_id"] for r in df.collect()}


def test_seal_hand_off_and_delivery_are_one_version_each(spark, ledger):
    assert ids(ledger.read("items")) == {f"i{k}" for k in range(8)} and {r["entity"] for r in C.current_markers(ledger.read("markers")).collect()} == {0, 1, 2}
    wanted = spark.createDataFrame([("i1",), ("i2",)], "item_id string")
    assert C.seal_run(ledger, "r1", wanted) == 2
    assert ids(ledger.read("seals")) == {"i1", "i2"} and [tuple(r) for r in C.states(ledger.read("runs")).collect()] == [("r1", "sealed")]
    assert C.move_run(ledger, "r1", "queue") == 3
    assert ids(ledger.read("deliveries")) == {"i1", "i2"} and ids(ledger.read("deliveries", 2)) == set()
    assert [tuple(r) for r in C.states(ledger.read("runs", 3)).collect()] == [("r1", "queued")]
    C.move_run(ledger, "r1", "queue")
    assert ledger.read("deliveries").count() == 2 and ledger.read("runs").count() == 2
    with pytest.raises(RuntimeError):
        C.move_run(ledger, "r1", "publish")
    with pytest.raises(RuntimeError):
        C.seal_run(ledger, "r1", wanted)
    with pytest.raises(KeyError):
        C.seal_run(ledger, "r2", spark.createDataFrame([("unknown",)], "item_id string"))
    with pytest.raises(KeyError):
        C.move_run(ledger, "r9", "queue")


def test_two_runs_can_not_seal_one_item(spark, ledger, monkeypatch):
    """Both take their snapshot before either is done: the second computes anew, and then may not have the item."""
    from stratal.operators import ledger as L

    plain, first = L.seal, []

    def seal(*args):
        if not first:
            first.append(1)
            C.seal_run(ledger, "other", spark.createDataFrame([("i3",)], "item_id string"))
        return plain(*args)

    monkeypatch.setattr(L, "seal", seal)
    with pytest.raises(RuntimeError, match="sealed"):
        C.seal_run(ledger, "mine", spark.createDataFrame([("i3",), ("i4",)], "item_id string"))
    assert {tuple(r) for r in ledger.read("seals").collect()} == {("other", "i3")}


def test_polls_of_two_writers_add_each_item_once(spark, ledger, monkeypatch):
    from stratal.operators import handoff as H

    poll = lambda p, *names: spark.createDataFrame([(p, n, 1, DAY) for n in names], "poll_id long, item_id string, entity long, at timestamp_ntz")
    plain, first = H.poll_commit, []

    def slow(*args):
        if not first:
            first.append(1)
            C.commit_poll(ledger, poll(7, "n1", "n2"))
        return plain(*args)

    monkeypatch.setattr(H, "poll_commit", slow)
    C.commit_poll(ledger, poll(8, "n2", "n3"))
    new = ledger.read("items").where(F.col("item_id").startswith("n"))
    assert sorted(r["item_id"] for r in new.collect()) == ["n1", "n2", "n3"]
