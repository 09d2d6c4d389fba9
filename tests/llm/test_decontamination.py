import random

import pytest

from stratal.llm import decontamination as D

RNG = random.Random(6)
ITEM = [f"t{k}" for k in range(30)]
OTHER = [f"o{k}" for k in range(12)]
SHORT = ["one", "two", "three"]


def filler(n):
    return [f"f{RNG.randrange(10**6)}" for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    reordered = ITEM[20:] + filler(4) + ITEM[:10] + filler(3) + ITEM[10:20]
    rows = [
        (1, " ".join(filler(100) + ITEM + filler(20))),
        (2, " ".join(filler(40) + reordered)),
        (3, " ".join(filler(200))),
        (4, " ".join(filler(30) + ITEM[:14] + filler(30))),
        (5, ", ".join(x.upper() + "!!" for x in ITEM)),
        (6, " ".join(ITEM[k] for k in range(0, 30, 2))),
        (7, None), (8, ""), (9, "  \n"),
        (10, "one two three"), (11, "one two"),
        (12, " ".join((ITEM + OTHER) * 300)),
        (None, " ".join(ITEM)), (1, " ".join(filler(3) + ITEM)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'c' AS coverage")
    items = spark.createDataFrame([(1, " ".join(ITEM)), (2, " ".join(OTHER)), (3, " ".join(SHORT)), (4, None), (5, "..."), (6, " ".join(ITEM))], "item_id long, text string").selectExpr("*", "9 AS doc_id")
    return docs.repartition(3), items


WANT = {(1, 1), (2, 1), (5, 1), (12, 1), (12, 2), (10, 3), (None, 1)}
WANT |= {(d, 6) for d, i in WANT if i == 1}


@pytest.mark.parametrize("bits", [10, 26])
def test_finds_reordered_and_whole_passages(tables, bits, monkeypatch):
    monkeypatch.setattr(D, "MAX_BITS", bits)  # a bitmap that is nearly full lets more through, and changes nothing
    got = D.tile(*tables).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == WANT
    two = next(r for r in got if (r["doc_id"], r["item_id"]) == (2, 1))
    assert two["coverage"] == 1.0 and sorted(t["length"] for t in two["tiles"]) == [10, 10, 10]


def test_filter_keeps_the_rest(tables):
    docs, items = tables
    kept = D.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7, 8, 9, 11]


def test_empty_tables(tables):
    docs, items = tables
    assert D.tile(docs.limit(0), items).count() == 0 and D.tile(docs, items.limit(0)).count() == 0
    assert D.decontaminated(docs, items.limit(0)).count() == docs.count()


def brute(item, text, least):
    item_marked, text_marked, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                k = 0
                while i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k] and i + k not in item_marked and t + k not in text_marked:
                    k += 1
                if k > best[0]:
                    best = (k, i, t)
        if best[0] < least:
            return tiles
        n, i, t = best
        tiles.append(best)
        item_marked |= set(range(i, i + n))
        text_marked |= set(range(t, t + n))


def words_of(text):
    return D.normal_words(text, D.CoreHashes())


@pytest.mark.parametrize("matches", [200_000, 0])
def test_tiling_equals_brute_force(matches, monkeypatch):
    monkeypatch.setattr(D, "MATCHES", matches)  # at 0 every pair is searched row by row
    rng = random.Random(12)
    for _ in range(200):
        item = [rng.choice("abcd") for _ in range(rng.randrange(1, 16))]
        text = [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]
        found = D.tiles_of(words_of(" ".join(item)), words_of(" ".join(text)), 3)
        assert sorted(found) == sorted(brute(item, text, min(3, len(item))))


def test_one_word_over_and_over_needs_little_memory():
    import tracemalloc

    item, text = words_of("la " * 800), words_of("la " * 40_000)
    tracemalloc.start()
    tiles = D.tiles_of(item, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiles == [(800, 0, 0)] and peak < 50_000_000


def test_tables_equal_brute_force(spark):
    rng = random.Random(31)
    item = lambda: [f"w{rng.randrange(40)}" for _ in range(rng.randrange(3, 25))]
    items = [(k % 7, item()) for k in range(9)]
    docs = []
    for k in range(60):
        text = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            _, own = rng.choice(items)
            cut = rng.randrange(len(own))
            text += own[cut:] + own[:cut] if rng.random() < 0.7 else own[: cut + 1]
        docs.append((k if k % 9 else None, text))
    want = []
    for d, text in docs:
        for i, own in items:
            covered = sum(t[0] for t in brute(own, text, min(5, len(own))))
            if covered >= 0.5 * len(own):
                want.append((str(d), i, covered))
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = [(str(r["doc_id"]), r["item_id"], r["covered_words"]) for r in D.tile(frame, bench).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    bad = sum(any(sum(t[0] for t in brute(own, text, min(5, len(own)))) >= 0.5 * len(own) for _, own in items) for _, text in docs)
    assert D.decontaminated(frame, bench).count() == len(docs) - bad


def test_columns_of_any_name_come_back(spark):
    rows = [(1, "a b c d e f", 5, "x", "y"), (None, "other words stand here now", 6, None, "z"), (2, None, 7, "q", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, words string, `c0 d` string")
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["row"] for r in kept.collect()) == [6, 7]
    assert D.decontaminated(docs, spark.createDataFrame([(1, "other words stand zz yy")], "item_id long, text string")).count() == 3


@pytest.mark.parametrize("seed", range(30))
def test_what_is_left_out_of_the_index_covers_too_little(seed):
    rng = random.Random(seed)
    size, width = rng.randrange(1, 60), rng.randrange(1, 6)
    width = min(width, size)
    seeds = [(rng.randrange(1, 50), rng.randrange(25), at) for at in range(size - width + 1)]
    often = {h: n for n, h, _ in seeds}
    seeds = [(often[h], h, at) for _, h, at in seeds]
    kept = set(D.needed_seeds(seeds, size, width, 0.5 * size))
    import numpy as np

    left = np.array([at for _, h, at in seeds if h not in kept], dtype=np.int64)
    assert D.covered_words(left, width, size) < 0.5 * size
    assert kept  # whoever covers the item has one of them


def test_a_common_opening_makes_no_pairs(spark):
    """300 items and 300 documents with one opening, of which every tenth document holds an item as a whole."""
    opening = " ".join(f"c{k}" for k in range(9))
    items = [(k, f"{opening} " + " ".join(f"i{k}w{j}" for j in range(21))) for k in range(300)]
    docs = [(k, f"{opening} " + " ".join(filler(30)) + (f" {items[k][1]}" if k % 10 == 0 else "")) for k in range(300)]
    search = D.Search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), D.MIN_MATCH, D.MIN_COVERAGE, ["doc_id"])
    assert search.pairs().count() == 30
    assert {(r["doc_id"], r["item_id"]) for r in search.tiled("c0").collect()} == {(k, k) for k in range(0, 300, 10)}
