import datetime as dt
from collections import defaultdict

import pytest

from stratal.llm import sharding as S
from stratal.llm import url_lists as U

D = dt.date


def test_intervals(spark):
    rows = [("block", "host", "A.com", "add", D(2024, 1, 1)), ("block", "host", "a.com", "add", D(2024, 1, 5)), ("block", "host", "a.com", "remove", D(2024, 2, 1)), ("block", "host", "b.com", "add", D(2024, 1, 3)), ("block", "host", "b.com", "remove", D(2024, 1, 3)), ("block", "host", None, "add", D(2024, 1, 1)), ("block", "host", "c.com", "add", D(2024, 3, 1)), ("block", "host", "c.com", "add", D(2024, 3, 1))]
    got = {tuple(r)[2:] for r in U.validity_intervals(spark.createDataFrame(rows, "list string, kind string, pattern string, action string, day date")).collect()}
    assert got == {("a.com", D(2024, 1, 1), D(2024, 1, 5)), ("a.com", D(2024, 1, 5), D(2024, 2, 1)), ("c.com", D(2024, 3, 1), None)}


def test_captures_are_judged_as_of_their_day(spark):
    entries = spark.createDataFrame(
        [("block", "host", "example.com", "add", D(2024, 1, 10)), ("block", "host", "example.com", "remove", D(2024, 6, 1)), ("allow", "prefix", "www.example.com/en", "add", D(2024, 2, 1)), ("allow", "host", "tie.org", "add", D(2024, 1, 1)), ("block", "host", "tie.org", "add", D(2024, 1, 1))],
        "list string, kind string, pattern string, action string, day date",
    )
    cases = [
        ("http://www.example.com/x", D(2024, 1, 9), "none"), ("http://www.example.com/x", D(2024, 1, 10), "block"), ("HTTP://u:p@WWW.Example.com:80/EN/y?q#f", D(2024, 1, 31), "block"),
        ("HTTP://u:p@WWW.Example.com:80/EN/y?q#f", D(2024, 2, 1), "allow"), ("http://example.com", D(2024, 5, 31), "block"), ("http://example.com", D(2024, 6, 1), "none"),
        ("http://notexample.com", D(2024, 3, 1), "none"), ("http://tie.org/", D(2030, 1, 1), "allow"), (None, D(2024, 3, 1), "none"), ("http://example.com", None, "none"), ("/relative", D(2024, 3, 1), "none"), ("http://example.com./" + "a/" * 5000, D(2024, 3, 1), "block"),
    ]
    captures = spark.createDataFrame([(k, u, d) for k, (u, d, _) in enumerate(cases)], "page_id long, url string, day date").selectExpr("*", "'x' AS pattern", "'y' AS list")
    captures = captures.unionAll(captures.where("page_id = 1"))
    got = U.judge(captures, entries).collect()
    assert len(got) == len(cases) + 1
    assert all(r["verdict"] == cases[r["page_id"]][2] and r["kept"] == (r["verdict"] != "block") for r in got)
    assert U.judge(captures.limit(0), entries).count() == 0
    assert U.judge(captures, entries.limit(0)).where("kept").count() == len(cases) + 1


@pytest.mark.parametrize("limit", [400, 5000, 10**6])
def test_shards_fit_and_only_oversized_ones_split(spark, limit):
    rows = [(k, "x" * (k * 37 % 300)) for k in range(300)] + [(1000, None), (1001, ""), (None, "nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS shard", "8 AS h", "9 AS p")
    got = S.extendible_shards(docs.repartition(4), limit).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in got:
        size[r["shard"]] += r["n_bytes"]
    assert all(n <= limit for n in size.values()) and all(size[r["shard"]] == r["shard_bytes"] and len(r["shard"]) == r["depth"] for r in got)
    for shard in size:  # prefix-free, and the parent of every leaf was too large
        assert not any(o != shard and o.startswith(shard) for o in size)
        if shard:
            assert sum(n for o, n in size.items() if o.startswith(shard[:-1])) > limit


def test_equal_hashes_are_chained(spark):
    rows = [(7, "y" * 30) for _ in range(500)] + [(7, "z" * 90), (7, "q" * 500), (8, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = S.extendible_shards(docs, 100).collect()
    size = defaultdict(int)
    for r in got:
        size[r["shard"]] += r["n_bytes"]
    assert len(got) == len(rows) and sorted(n for n in size.values() if n > 100) == [500]
    assert len(size) < 320  # pages start within one half of the limit


def test_empty(spark):
    assert S.extendible_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_columns_and_addresses_in_brackets(spark):
    entries = spark.createDataFrame([("block", "host", "[::1]", "add", D(2024, 1, 1))], "list string, kind string, pattern string, action string, day date")
    rows = [(1, "http://[::1]:80/x", D(2024, 2, 1), "v", 7, "h", True), (2, "http://u@[2001:db8::2]/", D(2024, 2, 1), "v", 7, "h", True)]
    captures = spark.createDataFrame(rows, "page_id long, url string, day date, verdict string, n_active long, host string, kept boolean")
    got = {r["page_id"]: r for r in U.judge(captures, entries).collect()}
    assert got[1]["host"] == "[::1]" and got[1]["verdict"] == "block" and not got[1]["kept"] and got[1]["n_active"] == 1
    assert got[2]["host"] == "[2001:db8::2]" and got[2]["verdict"] == "none"
    assert all((r["capture_verdict"], r["capture_n_active"], r["capture_host"], r["capture_kept"]) == ("v", 7, "h", True) for r in got.values())


@pytest.mark.parametrize("limit", [100, 2000, 10**6])
def test_every_row_is_written_once(spark, tmp_path, limit):
    rows = [(7, "y" * 30, "a", 1)] * 50 + [(7, "q" * 500, "b", 2), (None, "nobody", "c", 3), (None, None, "d", 4), (None, "nobody", "c", 3)] + [(k, "x" * (k % 40), "e", k) for k in range(20, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, h long").repartition(5)
    S.write_shards(docs, str(tmp_path / "out"), limit)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, back.select("doc_id", "text", "doc_shard", "h").collect())) == sorted(map(key, rows))
    sizes = back.groupBy("shard").agg({"text": "count"}).count()
    assert sizes == 1 if limit == 10**6 else sizes > 1


def brute_directory(rows, limit):
    """shard and bytes of each row by splitting one bit at a time; equal hashes are chained, so they get None."""
    import hashlib

    items = [(int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:14], 16), len((t or "").encode())) for k, t in rows]
    out = [None] * len(rows)
    todo = [("", range(len(rows)))]
    while todo:
        prefix, own = todo.pop()
        total = sum(items[k][1] for k in own)
        if total <= limit:
            for k in own:
                out[k] = (prefix, total)
        elif len(prefix) < S.BITS:
            for bit in "01":
                todo.append((prefix + bit, [k for k in own if format(items[k][0], f"0{S.BITS}b")[len(prefix)] == bit]))
    return out


@pytest.mark.parametrize("limit", [40, 900])
def test_shards_equal_a_split_bit_by_bit(spark, limit):
    rows = [(k * 7919, "x" * (k % 90)) for k in range(150)] + [(5, "a" * 25)] * 6 + [(None, "b" * 10)] * 3
    want = sorted(w for w in brute_directory(rows, limit) if w)
    got = S.extendible_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    assert len(got) == len(rows)
    assert sorted((r["shard"], r["shard_bytes"]) for r in got if "+" not in r["shard"]) == want
    assert all(len(r["shard"]) > 40 for r in got if "+" in r["shard"])
