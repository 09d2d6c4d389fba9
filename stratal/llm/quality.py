"""Quality: random-indexing word vectors pooled per document, a two-layer network, calibrated by a temperature.

Every word gives two units: its core (lower-cased, without edge punctuation) and its form (case, trailing
punctuation, whether the word stood among the few before it). A unit has a sparse ternary index vector, fixed by a
hash of the whole unit. The word vector of a unit is that index vector plus, once the unit makes up MIN_SHARE of all
units of all documents, the direction of the sum of the index vectors of the units beside it, over all documents. The
share, unlike a count, means the same at every size, and at most 1 / MIN_SHARE units can have it: a proven bound for
what the driver holds and the executors are sent. Rarer units have their index vector alone, each its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratal.llm.common import by_bytes, mix64, process_cache, remove, texts_of, written
from stratal.llm.scoring import MAX_TRAIN_ROWS, kept_by_score, labelled_sample, scored, sigmoid, temperature_of

MIN_SHARE = 5e-6
DIMENSIONS = 64
NONZERO = 2
REACH = 2  # units to either side that are context
BACK = 8  # words back that make a word a repeated one
HIDDEN = 32
THRESHOLD = 0.3
SLICE_BYTES = 600_000  # of text at a time
SUM_BLOCK = 256  # units of a matrix block that is summed as one row
SUM_SPREAD = 1024  # partial sums of a block in the first of two rounds
COUNTED = 400_000  # different units that a task holds before it hands on their counts
CELLS = 4_000_000  # of a matrix of counts
_U = np.uint64
EDGES = bytes(c for c in range(33, 128) if not chr(c).isalnum())


class Letters:
    """What the code points are, by tables, and the powers that word hashes need."""

    SPACE, EDGE, UPPER, LOWER, DIGIT = 1, 2, 4, 8, 16
    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        plane = [chr(c) for c in range(1 << 16)]
        self.kind = np.zeros(1 << 16, dtype=np.uint8)
        self.lower = np.arange(1 << 16, dtype=np.uint32)
        for c, x in enumerate(plane):
            if x.isupper():
                self.kind[c] |= self.UPPER
                low = x.lower()
                self.lower[c] = ord(low) if len(low) == 1 else c
            elif x.islower():
                self.kind[c] |= self.LOWER
            elif x.isdigit():
                self.kind[c] |= self.DIGIT
        self.kind[[9, 10, 11, 12, 13, 32]] |= self.SPACE
        self.kind[list(EDGES)] |= self.EDGE
        self.powers = self.inverse = np.ones(1, dtype=_U)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            inverse = pow(self.BASE, -1, 1 << 64)
            self.powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, x, dtype=_U)])) for x in (self.BASE, inverse))

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of every word of these code points: its place, its hash, the key of its core, and the key of its form as a new word."""
        n = len(codes)
        self.grow(n + 1)
        plane = np.minimum(codes, 0xFFFF)  # what lies beyond the table has no case and is no edge
        kind = self.kind[plane]
        lower = np.where(codes < 0x10000, self.lower[plane], codes)
        space = (kind & self.SPACE).astype(bool)
        turn = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        start, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        inner = np.flatnonzero(~space & (kind & self.EDGE == 0))
        first, last = np.searchsorted(inner, start), np.searchsorted(inner, end)
        some = first < last
        padded = np.append(inner, 0)
        core, stop = np.where(some, padded[first], end), np.where(some, padded[last - 1] + 1, end)
        core = np.where(some, core, start)
        stop = np.where(some, stop, start)
        sums = lambda x: np.concatenate([np.zeros(1, _U), np.cumsum((x.astype(_U) + _U(977)) * self.powers[:n])])
        plain, low = sums(codes), sums(lower)
        part = lambda s, i, j: mix64((s[j] - s[i]) * self.inverse[i] + (j - i).astype(_U))
        count = lambda bit: (c := np.concatenate([[0], np.cumsum((kind & bit).astype(bool))]))[stop] - c[core]
        upper, lowers, digits, size = count(self.UPPER), count(self.LOWER), count(self.DIGIT), stop - core
        led = np.zeros(len(start), dtype=bool)
        led[some] = (kind[core[some]] & self.UPPER).astype(bool)
        case = np.select([digits > 0, (size > 1) & (upper > 0) & (lowers == 0), (lowers > 0) & (upper == 0), led, some], [1, 2, 3, 4, 5], 0)
        form = mix64(part(plain, stop, end) + _U(0xD6E8FEB86659FD93) * (2 * case + (core > start) + 1).astype(_U))
        return start, part(plain, start, end), part(low, core, stop) ^ _U(1), form


LONGEST = 1 << 20  # code points that are looked at together


def units_of(texts: list[str], vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the units of all texts in their order (core, form, core, ...), their vocabulary rows (-1: none) and the bounds of each text, counted in units."""
    letters = process_cache("quality_letters", Letters)
    whole = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    found, at = [], 0
    while at < len(whole):
        stop = len(whole)
        if stop - at > LONGEST:  # cut before the last white space there is, or after the word that is longer
            back = np.flatnonzero(letters.kind[np.minimum(whole[at : at + LONGEST], 0xFFFF)] & Letters.SPACE)
            ahead = at + LONGEST
            while not len(back) and ahead < len(whole) and not letters.kind[min(int(whole[ahead]), 0xFFFF)] & Letters.SPACE:
                ahead += 1
            stop = at + int(back[-1]) + 1 if len(back) else ahead
        start, *keys = letters.words(whole[at:stop])
        found.append((start + at, *keys))
        at = stop
    start, word, core, form = (np.concatenate([x[k] for x in found]) if found else np.empty(0, dtype=_U) for k in range(4))
    bounds = np.searchsorted(start, np.append(begin, len(whole) + 1))
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    repeated = np.zeros(len(word), dtype=bool)
    for k in range(1, BACK + 1):
        repeated[k:] |= (word[k:] == word[:-k]) & (doc[k:] == doc[:-k])
    keys = np.empty(2 * len(word), dtype=_U)
    keys[::2] = core
    keys[1::2] = form ^ (repeated.astype(_U) << _U(63))
    rows = np.full(len(keys), -1, dtype=np.int64)
    if vocabulary is not None and len(vocabulary):
        place = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
        rows = np.where(vocabulary[place] == keys, place, -1)
    return keys, rows, 2 * bounds


def index_vectors(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each unit's index vector."""
    h = np.stack([mix64(keys + _U((0x9E3779B97F4A7C15 * (j + 1)) % 2**64)) for j in range(NONZERO)], axis=1)
    return (h % _U(DIMENSIONS)).astype(np.int64), np.where(h >> _U(63), 1.0, -1.0)


def context_sums(keys: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary rows that occur, and the sum of the index vectors of the units within REACH of each."""
    places, signs = index_vectors(keys)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    known, local = np.unique(rows, return_inverse=True)
    first = int(len(known) > 0 and known[0] < 0)  # the units without a row come first
    total = np.zeros(len(known) * DIMENSIONS)
    for k in range(1, REACH + 1):
        same = np.flatnonzero(doc[k:] == doc[:-k])
        for of, beside in ((same, same + k), (same + k, same)):
            own = rows[of] >= 0
            of, beside = local[of[own]] * DIMENSIONS, beside[own]
            for j in range(NONZERO):
                total += np.bincount(of + places[beside, j], weights=signs[beside, j], minlength=len(total))
    return known[first:], total.reshape(-1, DIMENSIONS)[first:]


def unit_counts(docs: DataFrame) -> tuple[DataFrame, str]:
    """unit, n of every unit of all documents, written."""

    def count(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys = np.concatenate([np.empty(0, dtype=_U), *(k for k, _ in held)])
            unit, local = np.unique(keys, return_inverse=True)
            n = np.bincount(local, weights=np.concatenate([np.empty(0), *(c for _, c in held)]), minlength=len(unit))
            held[:] = [(unit, n)]
            return unit, n

        def out():
            unit, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(n.astype(np.int64))], names=["unit", "n"])

        for batch in by_bytes(batches, limit=SLICE_BYTES):
            keys, _, _ = units_of(batch.column(1).to_pylist())
            held.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in held) > COUNTED and len(merged()[0]) > COUNTED:
                yield out()
        if held:
            yield out()

    rows = texts_of(docs).select("doc_id", "text").mapInArrow(count, "unit long, n long")
    return written(rows.groupBy("unit").agg(F.sum("n").alias("n")), "units")


def vocabulary_of(docs: DataFrame, min_share: float = MIN_SHARE) -> np.ndarray:
    """Keys of the units that make up min_share of all units, ascending; at most 1 / min_share."""
    counts, path = unit_counts(docs)
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    found = [r["unit"] for r in counts.where(F.col("n") >= min_share * total).select("unit").collect()] if total else []
    remove(docs.sparkSession, path)
    return np.sort(np.array(found, dtype=np.int64).view(_U))


def word_vectors(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Directions of the context sums of the vocabulary from all documents; each task sends one matrix, summed in two rounds by blocks of units."""
    if not len(vocabulary):
        return np.zeros((0, DIMENSIONS), dtype=np.float32)
    blocks = -(-len(vocabulary) // SUM_BLOCK)

    def collect(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros((blocks * SUM_BLOCK, DIMENSIONS), dtype=np.int64)
        for batch in by_bytes(batches, limit=SLICE_BYTES):
            known, sums = context_sums(*units_of(batch.column(1).to_pylist(), vocabulary))
            total[known] += sums.astype(np.int64)
        own = total.reshape(blocks, -1)
        some = np.flatnonzero(own.any(axis=1))
        if len(some):
            part = pa.array([TaskContext.get().partitionId() % SUM_SPREAD] * len(some), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), part, pa.array([own[b].astype("<i8").tobytes() for b in some], pa.binary())], names=["block", "part", "sums"])

    def add(key, table):
        import pyarrow as pa

        total = np.zeros(SUM_BLOCK * DIMENSIONS, dtype=np.int64)
        for row in table.column("sums"):
            total += np.frombuffer(row.as_py(), dtype="<i8")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    partial = texts_of(docs).mapInArrow(collect, "block int, part int, sums binary")
    partial = partial.groupBy("block", "part").applyInArrow(add, "block int, sums binary")
    sums = np.zeros((blocks, SUM_BLOCK * DIMENSIONS))
    for row in partial.groupBy("block").applyInArrow(add, "block int, sums binary").collect():
        sums[row["block"]] = np.frombuffer(row["sums"], dtype="<i8")
    vectors = sums.reshape(-1, DIMENSIONS)[: len(vocabulary)]
    return (vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))).astype(np.float32)


def pooled(texts: list[str], vocabulary: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean of the word vectors of a text's units, and the logarithm of its length, by text."""
    keys, rows, bounds = units_of(texts, vocabulary)
    n, texts_n = np.diff(bounds), len(texts)
    doc = np.repeat(np.arange(texts_n), n)
    places, signs = index_vectors(keys)
    total = np.zeros(texts_n * DIMENSIONS)
    for j in range(NONZERO):
        total += np.bincount(doc * DIMENSIONS + places[:, j], weights=signs[:, j], minlength=len(total))
    total = total.reshape(texts_n, DIMENSIONS) / np.sqrt(NONZERO)
    own = rows >= 0
    known, local = np.unique(rows[own], return_inverse=True)
    if len(known):
        doc, step = doc[own], max(1, CELLS // len(known))
        for k in range(0, texts_n, step):
            low, high = np.searchsorted(doc, [k, k + step])
            size = min(step, texts_n - k)
            counts = np.bincount((doc[low:high] - k) * len(known) + local[low:high], minlength=size * len(known)).reshape(size, len(known))
            total[k : k + size] += counts.astype(np.float32) @ vectors[known]
    return np.concatenate([total / np.maximum(1, n)[:, None], np.log1p(n)[:, None]], axis=1)


def gradients(p: list[np.ndarray], x: np.ndarray, y: np.ndarray, decay: float = 1e-4) -> list[np.ndarray]:
    """Of the mean logistic loss of tanh(x p0 + p1) p2 + p3, with half the decay times the squares of both layers."""
    hidden = np.tanh(x @ p[0] + p[1])
    error = (sigmoid(hidden @ p[2] + p[3]) - y) / len(y)
    back = np.outer(error, p[2]) * (1 - hidden**2)
    return [x.T @ back + decay * p[0], back.sum(axis=0), hidden.T @ error + decay * p[2], np.array([error.sum()])]


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 7) -> dict:
    """Two layers by Adam over mini-batches; a fifth of the rows sets the temperature."""
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / spread
    order = rng.permutation(len(x))
    held, rest = order[: len(x) // 5], order[len(x) // 5 :]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        rng.shuffle(rest)
        for k in range(0, len(rest), 128):
            own, step = rest[k : k + 128], step + 1
            for i, g in enumerate(gradients(p, x[own], y[own])):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model = {"mean": mean, "spread": spread, "layers": p}
    return model | {"temperature": temperature_of(logits(model, x[held] * spread + mean), y[held])}


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    p = model["layers"]
    return np.tanh((x - model["mean"]) / model["spread"] @ p[0] + p[1]) @ p[2] + p[3]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> dict:
    """Vectors from all documents; the network from the labelled sample outside the held-out fold (see labelled_sample).

    Without labelled documents of both classes the model is the constant of the class there is (or 1).
    """
    vocabulary = vocabulary_of(docs)
    vectors = word_vectors(docs, vocabulary)
    sample, path = labelled_sample(docs, labels, "quality", max_rows)

    def features(batches):
        import pyarrow as pa

        for batch in by_bytes(batches, limit=SLICE_BYTES):
            x = pooled(batch.column(1).to_pylist(), vocabulary, vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    rows = sample.mapInArrow(features, "doc_id long, label int, x array<double>").collect()
    remove(docs.sparkSession, path)
    rows = sorted((r["doc_id"], r["label"], r["x"]) for r in rows)
    y = np.array([r[1] for r in rows], dtype=np.float64)
    model = {"vocabulary": vocabulary, "vectors": vectors}
    if len(set(y.tolist())) < 2:
        return model | {"constant": 0.02 if len(y) and not y.any() else 0.98}
    return model | fit_network(np.array([r[2] for r in rows]), y)


def scorer_of(model: dict):
    def scorer():
        def score(texts: list[str]) -> np.ndarray:
            if "constant" in model:
                return np.full(len(texts), model["constant"])
            return sigmoid(logits(model, pooled(texts, model["vocabulary"], model["vectors"])) / model["temperature"])

        return score

    return scorer


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (see scoring.scored for nulls, long texts and repeats)."""
    return scored(docs, scorer_of(train(docs, labels, max_rows)), THRESHOLD, SLICE_BYTES)


def good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of docs that are not predicted of low quality, all columns (see scoring.kept_by_score for nulls and repeats)."""
    return kept_by_score(docs, scorer_of(train(docs, labels, max_rows)), lambda p: p >= THRESHOLD, SLICE_BYTES)
