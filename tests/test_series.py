"""Series in chunks give what one window gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratal.operators import events as E
from stratal.operators import series as S

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = [(1, k, BASE + dt.timedelta(minutes=rng.randrange(400)), float(rng.randrange(100))) for k in range(700)]  # many at one instant
    made += [(None, 1_000 + k, BASE + dt.timedelta(minutes=7 * k), float(k % 13)) for k in range(150)]
    made += [(k % 9 + 2, 2_000 + k, BASE + dt.timedelta(minutes=rng.randrange(400)), float(rng.randrange(100))) for k in range(60)]
    made += [(1, 5_000 + k, BASE + dt.timedelta(days=1, minutes=k), 1.0) for k in range(200)]  # whole chunks of failures
    rng.shuffle(made)
    return spark.createDataFrame(made, "e long, id long, ts timestamp_ntz, v double").repartition(3).cache()


OPERATORS = {
    "as_of": lambda df, n: E.as_of_deltas(df, "e", "ts", "id", "v", {"5m": E.HOUR // 12, "1h": E.HOUR}, chunk_rows=n),
    "prior": lambda df, n: E.latest_prior(df, "e", "ts", "id", "v", chunk_rows=n),
    "crossings": lambda df, n: E.crossings(df, "e", "ts", "id", "v", [20.0, 50.0, 98.0], chunk_rows=n),
    "changes": lambda df, n: E.changes(df, "e", "ts", "id", ["v"], chunk_rows=n).withColumn("changed", F.to_json("changed")),
    "failures": lambda df, n: E.failure_cooldown(df, "e", "ts", "id", F.col("v") < 40, chunk_rows=n),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_chunks_equal_one_window(rows, name):
    want, got = OPERATORS[name](rows, 10**9), OPERATORS[name](rows, 40)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_long_series_lies_in_many_tasks(rows):
    hot = S.parted(rows, "e", 100)[1]
    assert {r["e"] for r in hot.select("e").distinct().collect()} == {1, None}
    chunks = S.chunked(hot, "e", ["ts"], 100)
    sizes = {r["__chunk"]: r["count"] for r in chunks.groupBy("__chunk").count().collect()}
    assert len(sizes) > 6 and max(sizes.values()) < 300
    spans = chunks.where("e = 1").groupBy("__chunk").agg(F.min("ts"), F.max("ts")).orderBy("__chunk").collect()
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:], strict=False))


def test_short_series_keep_their_window(rows):
    assert S.parted(rows, "e", 10**6)[1] is None
