"""The join against brute force, on sets and on tables."""

import random
import re

import numpy as np
import pytest

from stratal.llm import common
from stratal.llm import jaccard_join as jj


def _linked(a, b, percent=85):
    i = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * i >= percent * (len(a) + len(b) - i)


@pytest.mark.parametrize("counts", [{}, {k: 10**12 for k in range(20)}])
def test_every_linked_pair_shares_a_signature(counts):
    rng = np.random.default_rng(3)
    bands = jj.Bands(counts)
    assert not counts or bands.deletion[10]
    for _ in range(400):
        size = int(rng.integers(1, rng.choice([8, 30, 120, 600])))
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        gone = int(rng.integers(0, max(1, size // 6) + 1))
        new = int(rng.integers(0, max(1, size // 6) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)]))
        if not len(b) or not _linked(a, b) or np.array_equal(a, b):
            continue
        which, sig = jj.signatures([a, b], bands)
        assert set(sig[which == 0]) & set(sig[which == 1]), (len(a), len(b))


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    for size in (1, 40, 700, 5000):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[size // 5 :], rng.integers(0, 2**64, size // 5, dtype=np.uint64)]))
        x, y = jj.parity_sketches([a, b])
        apart = len(np.setxor1d(a, b))
        for words in {len(x), len(y), jj.SKETCH_WORDS}:
            k = min(words, len(x), len(y))
            bits = int(np.unpackbits((jj.folded(x, k) ^ jj.folded(y, k)).view(np.uint8)).sum())
            assert bits <= apart
        assert len(x) >= len(a) / 32


def brute_sets(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    return sets


def brute(rows):
    sets = brute_sets(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted((rows[k][0], len(sets[k]), min(groups[find(k)])) for k in range(len(rows)))


def _table():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for size in (3, 4, 9, 12, 15, 30, 60, 150, 400, 1500):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(5):
                copy = list(base)
                for _ in range(rng.randrange(0, 1 + size // 25)):
                    copy[rng.randrange(size)] = rng.choice(words)
                if rng.random() < 0.3:
                    copy = copy[: max(1, size - rng.randrange(0, 1 + size // 12))]
                rows.append((n := n + 1, " ".join(copy).title() if rng.random() < 0.2 else " ".join(copy)))
    common = " ".join(rng.choice(words) for _ in range(20))
    rows += [(1000 + k, common + " " + " ".join(rng.choice(words) for _ in range(10))) for k in range(30)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one"), (2004, "ONE"), (2005, "x " * 5000), (2006, "x " * 4000)]
    return rows


def test_components_equal_brute_force(spark):
    rows = _table()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'x' AS sig", "2 AS rep")
    got = sorted(tuple(r) for r in jj.jaccard_join(docs.repartition(5)).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)


def test_without_broadcasts_it_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "SLICE_ROWS", 3)  # and every group of more rows is dealt over tasks
    rows = _table()[::3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jj.jaccard_join(docs).select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


def brute_links(rows):
    """How many other rows each row links with, and the linked pairs of different sets by (shared, union)."""
    sets, n, apart = brute_sets(rows), [0] * len(rows), {}
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            union = len(sets[i]) + len(sets[j]) - both
            if sets[i] and sets[j] and 100 * both >= 85 * union:
                n[i] += 1
                n[j] += 1
                if both < union:
                    apart[frozenset((frozenset(sets[i]), frozenset(sets[j])))] = (both, union)
    return sorted((rows[k][0] or 0, len(sets[k]), n[k]) for k in range(len(rows))), sorted(apart.values())


@pytest.mark.parametrize("cell", [1000, 2])
def test_links_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(jj, "CELL_ROWS", cell)
    monkeypatch.setattr(common, "SLICE_ROWS", cell)
    rows = _table()[:: 1 if cell > 2 else 3]
    rows += [(3000, rows[0][1]), (3001, rows[0][1]), (3001, rows[5][1]), (None, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class_id", "'x' AS hub")
    counts, pairs = brute_links(rows)
    left = len(common._WRITTEN)
    found, members = jj.links(docs.repartition(3))
    assert len(common._WRITTEN) == left + 2  # the two results
    assert sorted((r["n_shared"], r["n_union"]) for r in found.collect()) == pairs
    assert found.where("class_a >= class_b").count() == 0 and members.count() == len(rows)
    got = jj.link_counts(docs)
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["n_links"]) for r in got.collect()) == counts


def test_one_of_each_group_keeps_whole_rows(spark):
    text, other = "a b c d e f g", "some words that stand alone here"
    rows = [(3, text, "x"), (1, text, "y"), (7, "other words in here", "z"), (7, "other words in here", "z"), (9, None, "n"), (None, text, "i"), (None, other, "j"), (None, other.upper(), "j"), (None, None, "k"), (9, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").selectExpr("*", "5 AS row", "6 AS component")
    kept = jj.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["extra"]) for r in kept.collect()) == [(0, "j"), (0, "k"), (1, "y"), (7, "z"), (9, "n")]


def test_a_document_without_an_id_links_two_others(spark):
    words = [f"w{k}" for k in range(60)]
    first, bridge, last = words, [*words[4:], "x", "y", "z"], [*words[8:], *"xyzuvq"]
    rows = [(5, " ".join(first)), (None, " ".join(bridge)), (9, " ".join(last)), (None, "nothing like it at all, of its own")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("5", 57, 5), ("9", 55, 5), ("None", 5, None), ("None", 56, 5)]


def test_a_group_of_thousands_and_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "SLICE_ROWS", 100)
    rng = random.Random(2)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for k in range(2500):  # near copies of one text: most pairs of them are not linked directly
        own = list(base)
        own[rng.randrange(80)] = f"x{k}"
        if k % 3 == 0:
            own[rng.randrange(80)] = f"y{k}"
        rows.append((10 + k, " ".join(own)))
    rows += [(20_000 + k % 500, "the very same text of some words") for k in range(2000)] + [(None, "the very same text of some words")] * 500
    rows += [(9, " ".join(base)), (50_000, " ".join(f"q{k}" for k in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = jj.jaccard_join(docs).collect()
    assert len(got) == len(rows)
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(77)} for k, t in rows[:2500]} | {9: {tuple(base[i : i + 4]) for i in range(77)}}
    near = [k for k, s in sets.items() if 100 * len(s & sets[9]) >= 85 * len(s | sets[9])]
    assert len(near) > 1500
    component = {r["doc_id"]: r["component_id"] for r in got}
    assert all(component[k] == 9 for k in near) and component[50_000] == 50_000
    assert all(r["component_id"] == 20_000 for r in got if r["doc_id"] is None or 20_000 <= r["doc_id"] < 20_500)


def test_nothing_written_on_the_way_is_left(spark):
    before = len(common._WRITTEN)
    assert jj.jaccard_join(spark.createDataFrame(_table()[:40], "doc_id long, text string")).count() == 40
    assert len(common._WRITTEN) == before + 1  # the result itself


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jj.jaccard_join(empty).count() == 0 and jj.one_of_each_group(empty).count() == 0 and jj.link_counts(empty).count() == 0
