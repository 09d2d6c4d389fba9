"""Operators against plain loops and the cases of their contracts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratal.operators import checks as K
from stratal.operators import events as E
from stratal.operators import ledger as L
from stratal.operators import publish as P
from stratal.operators import selection as S
from stratal.operators import units as U

BASE = dt.datetime(2026, 1, 10)


def model_put(arrivals):
    base, out = {}, {}
    for item, h, seq in arrivals:
        if item not in base:
            base[item] = h
            out[item] = seq
        elif h and base[item] and h != base[item]:
            out.setdefault(f"{item}:rev:{h[:12]}", seq)
    return out


def test_put_items_equals_row_by_row(spark):
    rng = random.Random(1)
    arrivals = [(f"i{rng.randrange(20)}", rng.choice([None, "a" * 64, "b" * 64, "c" * 64]), k) for k in range(300)]
    df = spark.createDataFrame([(i, h, "live_increment", k) for i, h, k in arrivals], "item_id string, content_hash string, observation_kind string, seq long")
    whole = {r["item_id"]: r["seq"] for r in L.put_items(df).collect()}
    assert whole == model_put(arrivals)
    first = L.put_items(df.where("seq < 140"))
    again = first.unionByName(L.put_items(df.where("seq >= 100"), first))
    assert {r["item_id"]: r["seq"] for r in again.collect()} == whole
    assert L.put_items(df, again).count() == 0


def test_pending_seal_and_repair(spark):
    items = spark.createDataFrame([("late", BASE - dt.timedelta(days=4), "live_increment"), ("boot", BASE - dt.timedelta(days=4), "bootstrap_snapshot"), ("edge", BASE, "live_increment")], "item_id string, ready_at timestamp_ntz, observation_kind string")
    assert [r["item_id"] for r in L.pending(items, F.lit(BASE).cast("timestamp_ntz")).collect()] == ["late"]
    none = spark.createDataFrame([], "item_id string")
    seals = spark.createDataFrame([("edge", "r0")], "item_id string, run_id string")
    wanted = items.select("item_id").withColumn("run_id", F.lit("r1"))
    assert {tuple(r) for r in L.seal_violations(wanted, items, none, seals).collect()} == {("edge", "sealed")}
    with pytest.raises(RuntimeError):
        L.seal(wanted, items, none, seals)
    with pytest.raises(KeyError):
        L.seal(wanted.unionByName(spark.createDataFrame([("ghost", "r1")], "item_id string, run_id string")), items, none, seals.limit(0))
    assert L.seal(wanted.where("item_id <> 'edge'"), items, none, seals).count() == 2
    assert L.next_state("sealed", "queue") == ("queued", True) and L.next_state("queued", "queue") == ("queued", False)
    with pytest.raises(RuntimeError):
        L.next_state("open", "queue")


def test_as_of_horizons(spark):
    hours = [(-169, 100), (-24, 150), (-6, 180), (0, 200)]
    df = spark.createDataFrame([(1, k, BASE + dt.timedelta(hours=h), v) for k, (h, v) in enumerate(hours)] + [(2, 9, BASE, 190), (2, 10, BASE + dt.timedelta(hours=5, minutes=59), 200)], "repo long, id long, ts timestamp_ntz, stars long")
    got = {r["id"]: (r["delta_6h"], r["delta_24h"], r["delta_7d"]) for r in E.as_of_deltas(df, "repo", "ts", "id", "stars").collect()}
    assert got[3] == (20, 50, 100) and got[10] == (None, None, None) and got[0] == (None, None, None)


def test_as_of_ties_take_the_highest_id(spark):
    df = spark.createDataFrame([(1, 1, BASE, 10), (1, 2, BASE, 20), (1, 3, BASE + dt.timedelta(hours=7), 50)], "repo long, id long, ts timestamp_ntz, stars long")
    got = {r["id"]: r["delta_6h"] for r in E.as_of_deltas(df, "repo", "ts", "id", "stars", {"6h": 6 * E.HOUR}).collect()}
    assert got[3] == 30
    assert {r["id"]: r["prior"] for r in E.latest_prior(df, "repo", "ts", "id", "stars").collect()} == {1: None, 2: None, 3: 20}


def test_crossing_happens_once_and_never_first(spark):
    values = [700, 490, 520, 480, 530]
    df = spark.createDataFrame([(1, k, BASE + dt.timedelta(hours=k), v) for k, v in enumerate(values)], "repo long, id long, ts timestamp_ntz, stars long")
    assert [(r["threshold"], r["id"]) for r in E.crossings(df, "repo", "ts", "id", "stars", [500, 600]).collect()] == [(500, 2)]


def test_cooldown_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), k, BASE + dt.timedelta(minutes=rng.randrange(10_000))) for k in range(400)]
    df = spark.createDataFrame(rows, "e long, id long, ts timestamp_ntz")
    want, last = set(), {}
    for e, k, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if e not in last or ts - last[e] >= dt.timedelta(hours=24):
            want.add(k)
            last[e] = ts
    assert {r["id"] for r in E.with_cooldown(df, "e", "ts", "id", 24 * E.HOUR).collect()} == want


def test_greedy_batches_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, rng.choice([10, 500, 6000, 300_000])) for k in range(450)]
    got = {r["k"]: r["batch"] for r in U.greedy_batches(spark.createDataFrame(rows, "s string, k long, b long"), "s", "k", "b").collect()}
    for scope in "ab":
        n = held = batch = 0
        for s, k, b in rows:
            if s == scope:
                if n and (n >= 160 or held + b > 256 * 1024):
                    n, held, batch = 0, 0, batch + 1
                n, held = n + 1, held + b
                assert got[k] == batch


def test_stratified_batches():
    rng = random.Random(4)
    for _ in range(300):
        counts = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 8))]
        size = rng.randrange(len(counts), 40)
        b = -(-sum(counts) // size)
        while sum(-(-n // b) for n in counts) > size:
            b += 1
        assert U.stratified_batch_count(counts, size) == b
    with pytest.raises(ValueError):
        U.stratified_batch_count([1, 1, 1], 2)


def test_unitise_merges_sources(spark):
    rows = [("k", "x_list:1", "x_list", 2, 5, "short"), ("k", "x_for_you:1", "x_for_you", 1, None, "the longest text"), ("m", "i", "s", 1, 1, "")]
    got = {r["entity_key"]: r for r in U.unitise(spark.createDataFrame(rows, "entity_key string, item_id string, source string, ready_at int, occurred_at int, text string")).collect()}
    k = got["k"]
    assert (k["item_ids"], k["sources"], k["occurred_at"], k["summary"]) == (["x_for_you:1", "x_list:1"], ["x_for_you", "x_list"], 5, "the longest text")
    assert got["m"]["summary"] == "m"


def test_exact_cover(spark):
    e, a = spark.createDataFrame([(1,), (2,), (3,)], "k long"), spark.createDataFrame([(2,), (3,), (3,), (4,)], "k long")
    assert {tuple(r) for r in K.exact_cover(e, a, "k").collect()} == {(1, "missing"), (3, "duplicate"), (4, "extra")}
    assert K.exact_cover(e, e, "k").count() == 0
    with pytest.raises(ValueError):
        K.require_empty(K.exact_cover(e, a, "k"), "units")


def test_publish_is_idempotent(spark):
    sink = P.MemorySink()
    desired = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, content_hash string")
    assert P.publish(desired, sink) == 2 and P.publish(desired, sink) == 0
    assert P.publish(spark.createDataFrame([("b", "3")], "key string, content_hash string"), sink) == 2 and sink.nodes == {"b": "3"}


def test_retention_keeps_pinned_rows(spark):
    df = spark.createDataFrame([("s", k, k) for k in range(6)], "s string, t long, id long")
    got = {r["id"] for r in S.keep_newest(df, "s", "t", "id", F.col("id").isin(0, 1), 3).where("kept").collect()}
    assert got == {0, 1, 5}


def test_rotation_plan(spark):
    plan = spark.range(1).select(S.rotation([f"q{k}" for k in range(13)], F.lit(100), 28).alias("r")).first()["r"]
    assert len(plan) == 28 and sum(x["variant"] == "recent" for x in plan) == 2 and {x["sort"] for x in plan} == {"stars", "updated"} and plan[0]["query"] == f"q{100 % 13}"
