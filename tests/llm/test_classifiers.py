import random
import zlib

import numpy as np
import pytest

from stratal.llm import quality as Q
from stratal.llm import toxicity as T
from stratal.llm.scoring import labelled_sample, temperature_of

WORDS = ["river", "stone", "light", "carry", "window", "paper", "garden", "silver", "morning", "quiet", "letters", "bridge"]
BAD = ["grobnik", "zlurpan"]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def corpus(n=600):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "er"]) for _ in range(rng.randrange(20, 120))]
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.8)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + rng.choice(["***", "###"]) for w in words]
        docs.append((k, " ".join(words)))
        labels.append((k, good, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    odd = [(9001, None), (9002, ""), (9003, "\n \t"), (9004, "x"), (9005, "calm water " * 40_000), (None, "no id"), (5, docs[5][1])]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "3 AS score", "'s' AS label")
    lab = spark.createDataFrame([*labels, (7, None, None), (88_888, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "'zzz' AS text")
    return docs, labels, d.repartition(4), lab


@pytest.mark.parametrize(("run", "at", "threshold"), [(Q.quality, 1, 0.3), (T.toxicity, 2, 0.5)])
def test_held_out_accuracy_and_shape(tables, run, at, threshold):
    docs, labels, d, lab = tables
    got = run(d, lab).collect()
    assert len(got) == len(docs) + 7
    rows = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (r["doc_id"] is not None and held_out(r["doc_id"])) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in got)
    tested = [x for x in labels if held_out(x[0])]
    assert len(tested) > 80 and np.mean([rows[x[0]]["predicted"] == x[at] for x in tested]) > 0.95


def test_filters_keep_whole_rows(tables):
    _, _, d, lab = tables
    for kept in (Q.good(d, lab), T.not_toxic(d, lab)):
        assert kept.columns == d.columns
    good = {r["doc_id"] for r in Q.quality(d, lab).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in Q.good(d, lab).collect()} == good
    clean = {r["doc_id"] for r in T.toxicity(d, lab).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in T.not_toxic(d, lab).collect()} == clean


def test_labels_of_the_held_out_fold_change_nothing(tables, spark):
    docs, labels, d, _ = tables
    turned = [(k, 1 - q, 1 - t) if held_out(k) else (k, q, t) for k, q, t in labels]
    for run in (Q.quality, T.toxicity):
        a = run(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas().sort_values(["doc_id", "score"])
        b = run(d, spark.createDataFrame(turned, "doc_id long, quality int, toxic int")).toPandas().sort_values(["doc_id", "score"])
        assert a.to_csv() == b.to_csv()


@pytest.mark.parametrize("run", [Q.quality, T.toxicity])
def test_without_labels_or_documents(tables, spark, run):
    _, _, d, lab = tables
    assert run(d, lab.limit(0)).where("score BETWEEN 0 AND 1").count() == d.count()
    assert run(d.limit(0), lab).count() == 0


def test_scores_do_not_depend_on_neighbours():
    model = {"bucket": np.arange(1 << T.BITS), "weight": np.random.default_rng(0).normal(0, 0.01, 1 << T.BITS), "bias": 0.0, "temperature": 1.3}
    score = T.scorer_of(model)()
    texts = ["ab", "hello world", "", "ÄÖÜ İstanbul", "x" * 5000]
    together, alone = score(texts), np.concatenate([score([t]) for t in texts])
    assert np.allclose(together, alone)
    vocabulary = np.sort(np.unique(Q.units_of(["hello world hello"])[0]))
    vectors = np.random.default_rng(1).normal(0, 1, (len(vocabulary), Q.DIMENSIONS)).astype(np.float32)
    texts += ["hello, world! hello", "WORLD " * 3000]
    assert np.allclose(Q.pooled(texts, vocabulary, vectors), np.concatenate([Q.pooled([t], vocabulary, vectors) for t in texts]), atol=1e-5)


def test_grams_are_those_of_the_whole_lower_cased_text():
    for text in ("", "ab", "abc", "Straße İst", "aaaa" * 9, "x\n\u00e9" * 7):
        codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
        want = {int(T.grams(codes[k : k + size], size)[0]) for size in T.SIZES for k in range(len(codes) - size + 1)}
        assert T.distinct_grams(text).tolist() == sorted(want)


def test_every_gram_of_the_sample_has_a_weight(tables):
    docs, labels, d, lab = tables
    model = T.train(d, lab)
    known = {k: t for k, t in docs} | {9001: "", 9002: "", 9003: "\n \t", 9004: "x"}
    seen = set().union(*(T.distinct_grams(known[k]).tolist() for k, _, _ in labels if not held_out(k)))
    assert set(model["bucket"].tolist()) == seen and len(model["weight"]) == len(seen)


def test_ratios_and_weights_equal_a_plain_computation():
    positive, negative = np.array([3.0, 0, 5, 0]), np.array([1.0, 4, 5, 0])
    total = positive.sum() + negative.sum()
    want = [np.log((p / positive.sum() + T.SMOOTHING / total) / (n / negative.sum() + T.SMOOTHING / total)) for p, n in zip(positive, negative, strict=True)]
    assert np.allclose(T.log_count_ratios(positive, negative), want) and want[3] == 0
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    y, scale = np.array([int(3 in x or rng.random() < 0.1) for x in rows]), rng.normal(0, 1, 30)
    weight, bias = T.fit_linear(rows, y, scale, cost=1.0, epochs=3000, close=1e-9)
    w, sign = weight / scale, np.where(y == 1, 1.0, -1.0)
    costs = 60 * np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    x = np.zeros((60, 30))
    for k, own in enumerate(rows):
        x[k, own] = scale[own]
    slack = np.maximum(0, 1 - sign * (x @ w + bias))  # the gradient of what it minimises is zero there
    assert np.allclose(w - x.T @ (2 * costs * sign * slack), 0, atol=1e-6) and np.isclose(bias - (2 * costs * sign * slack).sum(), 0, atol=1e-6)


def plain_units(text):
    """(core, form with whether the word stood among the BACK before it) of each word."""
    words = text.split()
    out = []
    for k, w in enumerate(words):
        edges = Q.EDGES.decode()
        core = w.lstrip(edges).rstrip(edges)
        case = "d" if not core.isalpha() and any(c.isdigit() for c in core) else "U" if len(core) > 1 and core.isupper() else "l" if core.islower() else "t" if core[:1].isupper() else "m" if core else "-"
        out += [("core", core.lower()), ("form", w != w.lstrip(edges), case, w.lstrip(edges)[len(core) :], w in words[max(0, k - Q.BACK) : k])]
    return out


def test_word_vectors_and_pooling_equal_a_plain_computation(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["river", "River", "STONE!!!!!", "(light)", "x9", "a-b,", "***", "new" + str(rng.randrange(50))]) for _ in range(rng.randrange(0, 40))) for _ in range(30)] + ["", "one"]
    key, index = {}, {}
    for t in texts:
        keys = Q.units_of([t])[0]
        for u, k in zip(plain_units(t), keys.tolist(), strict=True):
            assert key.setdefault(u, k) == k
    assert len(set(key.values())) == len(key)  # every unit has its own
    for u, k in key.items():
        places, signs = Q.index_vectors(np.array([k], dtype=np.uint64))
        index[u] = np.bincount(places[0], weights=signs[0], minlength=Q.DIMENSIONS)
    sums, counts = {u: np.zeros(Q.DIMENSIONS) for u in key}, dict.fromkeys(key, 0)
    for t in texts:
        units = plain_units(t)
        for i, u in enumerate(units):
            counts[u] += 1
            for j in range(max(0, i - Q.REACH), min(len(units), i + Q.REACH + 1)):
                if j != i:
                    sums[u] += index[units[j]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    share = 9 / sum(counts.values())
    vocabulary = Q.vocabulary_of(docs, share)
    assert vocabulary.tolist() == sorted(key[u] for u, n in counts.items() if n >= 9)
    vectors = Q.word_vectors(docs, vocabulary)
    unit = {k: u for u, k in key.items()}
    for k, v in zip(vocabulary.tolist(), vectors, strict=True):
        assert np.allclose(v, sums[unit[k]] / np.linalg.norm(sums[unit[k]]), atol=1e-6)
    x = Q.pooled(texts, vocabulary, vectors)
    direction = dict(zip(vocabulary.tolist(), vectors, strict=True))
    for t, own in zip(texts, x, strict=True):
        units = plain_units(t)
        want = sum((index[u] / np.sqrt(Q.NONZERO) + direction.get(key[u], 0) for u in units), np.zeros(Q.DIMENSIONS)) / max(1, len(units))
        assert np.allclose(own[:-1], want, atol=1e-5) and np.isclose(own[-1], np.log1p(len(units)))


def test_long_texts_are_cut_between_words_only(monkeypatch):
    rng = random.Random(14)
    texts = [" ".join(rng.choice(["Straße", "ÉTÉ!", "\U00020000x", "a", "b" * 90]) for _ in range(rng.randrange(60))) for _ in range(12)] + ["c" * 500, ""]
    whole = Q.units_of(texts)
    monkeypatch.setattr(Q, "LONGEST", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, Q.units_of(texts), strict=True))


def test_gradients_equal_differences():
    rng = np.random.default_rng(6)
    p = [rng.normal(0, 0.5, (5, 4)), rng.normal(0, 0.5, 4), rng.normal(0, 0.5, 4), rng.normal(0, 0.5, 1)]
    x, y = rng.normal(0, 1, (9, 5)), rng.integers(0, 2, 9).astype(float)

    def loss(q):
        z = np.tanh(x @ q[0] + q[1]) @ q[2] + q[3]
        return np.mean(np.logaddexp(0, z) - y * z) + 5e-5 * ((q[0] ** 2).sum() + (q[2] ** 2).sum())

    for k, g in enumerate(Q.gradients(p, x, y)):
        for at in np.ndindex(p[k].shape):
            up, down = [a.copy() for a in p], [a.copy() for a in p]
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert np.isclose((loss(up) - loss(down)) / 2e-6, g[at], atol=1e-6)


def test_the_temperature_calibrates():
    rng = np.random.default_rng(9)
    margins = rng.normal(0, 6, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-margins / 3))).astype(int)
    assert 2.5 < temperature_of(margins, y) < 3.5 and temperature_of(np.empty(0), np.empty(0)) == 1.0


def test_the_labelled_sample_is_bounded_in_rows_and_characters(spark):
    ids = [k for k in range(60) if not held_out(k)]
    rows = [(ids[0], f"text {k}") for k in range(3_000)] + [(ids[1], "same")] * 2_000 + [(k, "y" * 50) for k in ids[2:20]] + [(ids[20], "x" * 5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(ids[3], 1)], "doc_id long, quality int")
    found = {}
    for r in labelled_sample(docs, labels, "quality", max_chars=900)[0].collect():
        assert r["doc_id"] not in found
        found[r["doc_id"]] = r
    assert set(found) <= {*ids[:20]} and sum(len(r["text"]) for r in found.values()) <= 900 and len(found) > 12
    assert labelled_sample(docs, labels, "quality", max_rows=5)[0].count() <= 5
    again = {tuple(r) for r in labelled_sample(docs.repartition(2), labels, "quality", max_chars=900)[0].collect()}
    assert again == {tuple(r) for r in found.values()}
    assert labelled_sample(docs, labels, "quality", max_chars=0)[0].count() == 0
