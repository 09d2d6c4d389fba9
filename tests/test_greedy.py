"""Walks in chunks give what a fold over each key in order gives."""

import datetime as dt
import random

import numpy as np
import pytest

from stratal.operators import events as E
from stratal.operators import greedy as G
from stratal.operators import units as U

BASE = dt.datetime(2024, 1, 1)


def fold_batches(rows, max_rows, max_size):
    out, of, n, held, number = {}, object(), 0, 0, 0
    for key, order, size in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        size = size or 0
        if key != of:
            of, n, held, number = key, 0, 0, 0
        elif n and (n >= max_rows or held + size > max_size):
            n, held, number = 0, 0, number + 1
        n, held = n + 1, held + size
        out[order] = number
    return out


def fold_cooldown(rows, length):
    out, last = set(), {}
    for key, i, t in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        if key not in last or t - last[key] >= length:
            out.add(i)
            last[key] = t
    return out


def sized(seed, n, hot):
    rng = random.Random(seed)
    return [(("hot" if rng.random() < hot else rng.choice(["a", "b", None])), k, rng.choice([None, 0, 1, 5, 9, 30, 400])) for k in range(n)]


@pytest.mark.parametrize(("seed", "hot", "max_rows", "max_size"), [(1, 1.0, 7, 60), (2, 0.7, 5, 10**9), (3, 0.3, 1, 60), (4, 1.0, 90, 45), (5, 0.9, 200, 10**9)])
def test_batches_in_chunks_equal_the_fold(spark, monkeypatch, seed, hot, max_rows, max_size):
    rows = sized(seed, 900, hot)
    df = spark.createDataFrame(rows, "s string, k long, b int").selectExpr("*", "'x' AS more").repartition(3)
    want = fold_batches(rows, max_rows, max_size)
    for chunk_rows, group in ((30, 3), (70, 256), (10**6, 256)):
        got = G.labelled(df, "s", ["k"], "b", G.Batches(max_rows, max_size), chunk_rows, group)
        assert {r["k"]: r["__label"] for r in got.collect()} == want
    out = U.greedy_batches(df, "s", "k", "b", max_rows, max_size, chunk_rows=100)
    assert out.columns == ["s", "k", "b", "more", "batch"] and {r["k"]: r["batch"] for r in out.collect()} == want


@pytest.mark.parametrize(("seed", "span", "hot"), [(1, 100_000, 1.0), (2, 3_000, 1.0), (3, 400, 0.8), (4, 10**6, 0.4)])
def test_cooldown_in_chunks_equals_the_fold(spark, seed, span, hot):
    rng = random.Random(seed)
    rows = [(1 if rng.random() < hot else rng.choice([2, None]), k, rng.randrange(span)) for k in range(800)]
    df = spark.createDataFrame([(e, k, BASE + dt.timedelta(minutes=t)) for e, k, t in rows] + [(1, 9_999, None)], "e long, id long, ts timestamp_ntz").repartition(3)
    want = fold_cooldown(rows, 1_440)
    for chunk_rows in (40, 10**6):
        assert {r["id"] for r in E.with_cooldown(df, "e", "ts", "id", 24 * E.HOUR, chunk_rows=chunk_rows).collect()} == want


def chunks_of(values, rng):
    at = 0
    while at < len(values):
        n = rng.randrange(1, 9)
        yield np.array(values[at : at + n])
        at += n


@pytest.mark.parametrize("seed", range(40))
def test_functions_compose(seed):
    """Whatever the grouping, composed functions map the state before a run of chunks to that after it."""
    rng = random.Random(seed)
    if seed % 2:
        rule, values = G.Cooldown(rng.choice([1, 20, 300])), sorted(rng.randrange(500) for _ in range(60))
    else:
        rule, values = G.Batches(rng.choice([1, 3, 20, 70]), rng.choice([10, 60, 10**6])), [rng.choice([0, 1, 7, 90]) for _ in range(60)]
    tables = [rule.table(v) for v in chunks_of(values, rng)]
    state = rule.fresh()
    for t in tables:
        state = rule.apply(t, state)
    while len(tables) > 1:
        k = rng.randrange(len(tables) - 1)
        tables[k : k + 2] = [rule.compose(tables[k], tables[k + 1])]
    assert rule.apply(tables[0], rule.fresh()).tolist() == state.tolist()


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "s string, k long, b long")
    assert U.greedy_batches(df, "s", "k", "b").count() == 0
