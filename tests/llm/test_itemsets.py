import hashlib
import random
from itertools import combinations

import pytest

from stratal.llm import itemsets as I

LINES = "sale_id long, item_id long, flag string"


def brute(rows, min_baskets, share, percent):
    """items -> (support, rules) by listing every itemset that some basket holds."""
    held = {}
    for sale, item, flag in rows:
        if sale is not None and item is not None and flag != "returned":
            held.setdefault(sale, set()).add(item)
    total = len(held)
    least = max(min_baskets, -(-total // share))
    count = {(): total}
    for items in held.values():
        for n in range(1, len(items) + 1):
            for x in combinations(sorted(items), n):
                count[x] = count.get(x, 0) + 1
    often = {x: n for x, n in count.items() if n >= least}
    every = {i for x in often for i in x}
    closed = {x: n for x, n in often.items() if x and not any(count.get(tuple(sorted({*x, i})), 0) == n for i in every - {*x})}
    out = {}
    for x, n in closed.items():
        found = []
        for c in x if len(x) > 1 else ():
            a, s = count[tuple(i for i in x if i != c)], count[(c,)]
            if 100 * n >= percent * a and n * total > a * s:
                found.append((c, a, s))
        out[x] = (n, found)
    return out


def got(df):
    return {tuple(r["items"]): (r["support"], [tuple(x) for x in r["rules"]]) for r in df.collect()}


def random_lines(seed, n_sales, n_items, groups):
    rng = random.Random(seed)
    rows = []
    for sale in range(n_sales):
        items = set(rng.choices(range(n_items), k=rng.randrange(1, 5)))
        for g in groups:
            if rng.random() < 0.3:
                items |= {i for i in g if rng.random() < 0.93}
        rows += [(sale, i, rng.choice(["kept", "kept", None, "swapped"])) for i in items]
        rows += [(sale, n_items + 1, "returned")] if rng.random() < 0.5 else []
    rows += [(0, i, "kept") for i in range(n_items)] * 2  # a long basket, each of its lines twice
    return [*rows, (None, 1, "kept"), (3, None, "kept"), (None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_closed_sets_and_rules_equal_brute_force(spark, seed):
    rows = random_lines(seed, 150, 12, [(0, 1, 2), (2, 3, 4, 5), (9, 10, 11)])
    df = spark.createDataFrame(rows, LINES).selectExpr("*", "1 AS items", "'x' AS support", "2 AS w").repartition(3)
    want = brute(rows, 4, 60, 10)
    assert max(map(len, want)) > 4
    assert got(I.closed_itemsets(df, min_baskets=4, share=60)) == want


def test_items_of_every_basket_close_all_sets(spark):
    rows = [(s, i, "kept") for s in range(12) for i in (7, 8, s % 2)]
    assert got(I.closed_itemsets(spark.createDataFrame(rows, LINES))) == brute(rows, 8, 2000, 10) == {(7, 8): (12, [])}
    assert got(I.closed_itemsets(spark.createDataFrame(rows, LINES), min_baskets=6)) == brute(rows, 6, 2000, 10)


def test_hot_items_are_dealt_in_slices(spark):
    rows = [(s, i, "kept") for s in range(2_400) for i in ([1, 2, 3] if s % 3 else [1, 4 + s % 5])]
    assert got(I.closed_itemsets(spark.createDataFrame(rows, LINES), min_baskets=50)) == brute(rows, 50, 2000, 10)


def test_digest_spells_rules_and_empty_tables_give_none(spark):
    rows = [(s, i, "kept") for s in range(20) for i in ((1, 10, 2) if s < 9 else (3,))]
    (row,) = [r for r in I.digest(I.closed_itemsets(spark.createDataFrame(rows, LINES))).collect() if r["n_items"] > 1]
    assert row["items"] == "1,2,10" and row["support"] == 9 and row["n_rules"] == 3 and row["best_item"] == 1
    assert row["rules_sha256"] == hashlib.sha256(b"1:9:9;2:9:9;10:9:9").hexdigest()
    (none,) = [r for r in I.digest(I.closed_itemsets(spark.createDataFrame(rows, LINES))).collect() if r["n_items"] == 1]
    assert none["rules_sha256"] == hashlib.sha256(b"").hexdigest() and none["best_item"] is None
    empty = I.digest(I.closed_itemsets(spark.createDataFrame([], LINES)))
    assert empty.count() == 0 and empty.columns[:2] == ["items", "n_items"]
    assert I.closed_itemsets(spark.createDataFrame([(1, 1, "returned"), (None, 2, "kept")], LINES)).count() == 0
