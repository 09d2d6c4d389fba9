"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Every n-gram of the labelled sample has a weight. A feature is the presence of an n-gram, scaled by the logarithm of
the ratio of its counts in toxic and other documents; smoothing is in proportion to the classes, so an n-gram that
says nothing has the ratio 0. The weights are those of a support vector machine with squared hinge loss, found by
dual coordinate ascent; a fifth of the sample sets the temperature of the probabilities.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from stratal.llm.common import by_bytes, forget_caches, release, remove
from stratal.llm.scoring import MAX_TRAIN_ROWS, kept_by_score, labelled_sample, scored, sigmoid, temperature_of

SIZES = (3, 4, 5)
BITS = 22  # of an n-gram's hash; the sample has about 0.4 million different n-grams, 4.2 million buckets keep them apart
SMOOTHING = 10.0
COST = 0.1  # of a document's loss against the size of the weights
EPOCHS = 12
THRESHOLD = 0.5


def grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram at every position where one starts."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    h = codes[:n] * np.uint32(0x01000193)
    for j in range(1, size):
        h ^= codes[j : j + n]
        h *= np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D) + np.uint32(2 * size)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x297A2D39)
    return h >> np.uint32(32 - BITS)


def distinct_grams(text: str) -> np.ndarray:
    """The different n-gram buckets of a whole text, lower-cased, ascending."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    h = np.concatenate([grams(codes, size) for size in SIZES])
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def log_count_ratios(positive: np.ndarray, negative: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """ln of (share of the positive counts) / (share of the negative ones), both smoothed in proportion to their class."""
    p, n = positive.sum(), negative.sum()
    return np.log((positive / p + smoothing / (p + n)) / (negative / n + smoothing / (p + n)))


def fit_linear(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 3, close: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise (|w|^2 + bias^2) / 2 + sum of cost_i * max(0, 1 - sign_i * f_i)^2 over the rows.

    rows: the features present in each document; a feature's value is its scale. Both classes cost as much.
    """
    rng = np.random.default_rng(seed)
    sign = np.where(labels == 1, 1.0, -1.0)
    costs = cost * len(labels) * np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    squares = np.array([(scale[x] ** 2).sum() for x in rows]) + 1
    weight, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, s, c = rows[i], sign[i], 0.5 / costs[i]
            value = scale[x]
            gradient = s * (weight[x] @ value + bias) - 1 + alpha[i] * c
            if alpha[i] == 0 and gradient >= 0:
                continue
            new = max(0.0, alpha[i] - gradient / (squares[i] + c))
            step = (new - alpha[i]) * s
            alpha[i] = new
            weight[x] += step * value
            bias += step
            worst = max(worst, abs(gradient))
        if worst < close:
            break
    return weight * scale, bias


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> dict:
    """Learns from the labelled sample outside the held-out fold (see labelled_sample); without both classes, a constant.

    The driver gets the n-grams of the sampled documents, four bytes each, about one a character.
    """
    sample, path = labelled_sample(docs, labels, "toxic", max_rows)

    def extract(batches):
        import pyarrow as pa

        for batch in by_bytes(batches, limit=1_000_000):
            found = [distinct_grams(t) for t in batch.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint32), *found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(bounds, pa.array(flat))], names=["doc_id", "label", "grams"])

    found = []
    table = sample.mapInArrow(extract, "doc_id long, label int, grams array<int>").toArrow()
    remove(docs.sparkSession, path)
    for batch in table.to_batches():
        flat, bounds = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
        found += [(i, n, flat[low:high].copy()) for i, n, low, high in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bounds[:-1], bounds[1:], strict=True)]
    table = batch = flat = None
    # the order of the documents, and so the model, does not depend on where they were read
    found.sort(key=lambda d: (d[0], d[1], len(d[2]), zlib.crc32(d[2])))
    y, rows = np.array([n for _, n, _ in found], dtype=np.int64), [x for _, _, x in found]
    del found
    release()
    if len(set(y.tolist())) < 2:
        return {"bucket": np.empty(0, np.int64), "weight": np.empty(0), "bias": 5.0 if len(y) and y.all() else -5.0, "temperature": 1.0}
    number = np.zeros(1 << BITS, dtype=np.int32)
    for x in rows:
        number[x] = 1
    bucket = np.flatnonzero(number)
    number[bucket] = np.arange(len(bucket), dtype=np.int32)
    for k, x in enumerate(rows):
        rows[k] = number[x]
    counts = np.zeros((2, len(bucket)))
    for x, label in zip(rows, y, strict=True):
        counts[label][x] += 1
    if not counts[0].sum() or not counts[1].sum():
        return {"bucket": np.empty(0, np.int64), "weight": np.empty(0), "bias": -5.0, "temperature": 1.0}
    ratio = log_count_ratios(counts[1], counts[0])
    tested = np.random.default_rng(5).permutation(len(y))[: len(y) // 5]
    taught = np.setdiff1d(np.arange(len(y)), tested)
    temperature = 1.0
    if 0 < y[taught].sum() < len(taught):
        weight, bias = fit_linear([rows[i] for i in taught], y[taught], ratio)
        temperature = temperature_of(np.array([weight[rows[i]].sum() + bias for i in tested]), y[tested])
    weight, bias = fit_linear(rows, y, ratio)
    del rows, number
    release()
    return {"bucket": bucket, "weight": weight.astype(np.float32), "bias": bias, "temperature": temperature}


def scorer_of(model: dict):
    def scorer():
        forget_caches()
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[model["bucket"]] = model["weight"]

        def score(texts: list[str]) -> np.ndarray:
            margins = np.array([table[distinct_grams(t)].sum(dtype=np.float64) for t in texts]) + model["bias"]
            return sigmoid(margins / model["temperature"])

        return score

    return scorer


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (see scoring.scored for nulls, long texts and repeats)."""
    return scored(docs, scorer_of(train(docs, labels, max_rows)), THRESHOLD)


def not_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns (see scoring.kept_by_score for nulls and repeats)."""
    return kept_by_score(docs, scorer_of(train(docs, labels, max_rows)), lambda p: p < THRESHOLD)
