"""Quality rules on repetition inside a document, from a suffix array over its words.

The suffixes of all documents of a slice are sorted together by prefix doubling (two suffixes of different
documents never share a rank), neighbours give the longest common prefixes, and every interval of the
longest-common-prefix table is a repeated substring with its occurrences. The deepest interval that holds a suffix
is as long as the larger of its two neighbouring prefixes, so the union of all occurrences of repeats of at least
`min_words` words is the union of the spans [suffix, suffix + that length).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from stratal.llm.common import by_bytes, texts_of

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Production parameters of the verdict."""

    min_words: int = 8  # a repeat counts from this length on
    max_covered: float = 0.45  # of a document's words, inside repeats
    max_longest: int = 100  # words of the longest repeat


def doubled_ranks(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array and the rank of every window of 1, 2, 4, ... words; equal ranks are equal windows of one document."""
    n = len(words)
    key = (doc.astype(np.int64) << 32) | words
    order = np.argsort(key, kind="stable")
    rank = _ranks(key[order], order, n)
    levels, width = [rank], 1
    size = np.bincount(rank, minlength=n)
    active = np.flatnonzero(size[rank[order]] > 1)  # positions in the suffix array of groups that are not settled
    last = np.append(doc[1:] != doc[:-1], True)
    end = np.flatnonzero(last)[np.searchsorted(np.flatnonzero(last), np.arange(n))] + 1 if n else np.empty(0, np.int64)
    while len(active):
        suffix = order[active]
        ahead = suffix + width
        second = np.where(ahead < end[suffix], rank[np.minimum(ahead, n - 1)] + 1, 0).astype(np.int64)
        first = rank[suffix].astype(np.int64)
        sub = np.argsort(first * (n + 2) + second, kind="stable")
        suffix, first, second = suffix[sub], first[sub], second[sub]
        order[active] = suffix  # groups keep their places, so the active places stay sorted by group
        new = np.empty(len(suffix), dtype=bool)
        new[0] = True
        # a window that ends with its document equals no other one
        np.logical_or(first[1:] != first[:-1], second[1:] != second[:-1], out=new[1:])
        new[1:] |= second[1:] == 0
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank = rank.copy()
        rank[suffix] = active[starts][group]
        levels.append(rank)
        width *= 2
        active = active[np.diff(np.append(starts, len(suffix)))[group] > 1]
    return order, levels


def _ranks(sorted_keys: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    new = np.empty(n, dtype=bool)
    new[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return rank


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix, in words, of each suffix in the array and the one before it (0 for the first)."""
    n = len(order)
    out = np.zeros(n, dtype=np.int64)
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[pairs - 1].astype(np.int64), order[pairs].astype(np.int64)
    done = np.zeros(len(pairs), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + done, b + done
        inside = np.maximum(x, y) < n
        same = inside.copy()
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        done[same] += 1 << k
    out[pairs] = done
    return out


def repeat_lengths(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every word, the length of the longest substring that starts there and occurs elsewhere in its document."""
    if not len(words):
        return np.empty(0, dtype=np.int64)
    order, levels = doubled_ranks(words, doc)
    lcp = common_prefixes(order, levels)
    out = np.empty(len(words), dtype=np.int64)
    out[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def spans_of(lengths: np.ndarray, min_words: int) -> np.ndarray:
    """True for the words inside a repeat of at least min_words words."""
    n = len(lengths)
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(lengths >= min_words)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths[starts], -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str], limits: Limits = Limits()) -> dict:
    """The measures of whole texts, as columns; spans: the united repeats, with the text each is of, in words."""
    words: list[int] = []
    n_words, symbols, chars, dup_lines = [], [], [], []
    for text in texts:
        own = text.encode("utf-8", "surrogatepass").split()
        ids: dict[bytes, int] = {}
        words += [ids.setdefault(w, len(ids)) for w in own]
        n_words.append(len(own))
        symbols.append(sum(map(text.count, SYMBOLS)))
        chars.append(len(text) - sum(map(text.count, SPACE)))
        if "\n" in text:
            lines = [line for line in text.split("\n") if line.strip(SPACE)]
            dup_lines.append(len(lines) - len(set(lines)))
        else:
            dup_lines.append(0)
    n = np.array(n_words, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    lengths = repeat_lengths(np.array(words, dtype=np.int64), doc)
    bounds = np.concatenate([[0], np.cumsum(n)])
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])
    longest = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(longest, doc, lengths)
    covered = spans_of(lengths, limits.min_words)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    at = np.concatenate([starts, bounds[(bounds > 0) & (bounds < len(covered))]])  # a span ends with its document
    at = np.unique(at[covered[at]]) if len(at) else at
    until = np.minimum(ends[np.searchsorted(ends, at, side="right")], bounds[np.searchsorted(bounds, at, side="right")]) if len(at) else at
    owner = np.searchsorted(bounds, at, side="right") - 1
    spans = {"of": owner, "start": at - bounds[owner], "length": until - at}
    return {"n_words": n, "word_chars": np.array(chars, dtype=np.int64), "n_symbols": np.array(symbols, dtype=np.int64), "n_dup_lines": np.array(dup_lines, dtype=np.int64), "n_repeat_words": count(spans_of(lengths, 3)), "covered_words": count(covered), "longest_repeat": longest, "spans": spans}


def verdict(m: dict[str, np.ndarray], limits: Limits = Limits()) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    good = (m["covered_words"] <= limits.max_covered * m["n_words"]) & (m["longest_repeat"] <= limits.max_longest)
    return failed, ~failed & good


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long, spans array<struct<start:int,length:int>>"


def repetition_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row a document with its measures, verdict and the united spans of its repeats (in words), no shuffle; a slice of about a megabyte of text is sorted at a time, whole texts always.

    Null and empty texts have no words and fail the base rule. Null and repeated ids are rows like any other; other
    columns are not read. Memory is that of one slice, or of the longest text.
    """

    def run(batches):
        import pyarrow as pa

        for batch in by_bytes(batches, limit=1_500_000):
            m = measure(batch.column(1).to_pylist(), limits)
            failed, kept = verdict(m, limits)
            spans = m["spans"]
            inner = pa.StructArray.from_arrays([pa.array(spans["start"], pa.int32()), pa.array(spans["length"], pa.int32())], names=["start", "length"])
            lists = pa.ListArray.from_arrays(np.searchsorted(spans["of"], np.arange(batch.num_rows + 1)).astype(np.int32), inner)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k]) for k in names), pa.array(failed), pa.array(kept), pa.array(m["covered_words"]), pa.array(m["longest_repeat"]), lists], names=["doc_id", *names, "base_failed", "kept", "covered_words", "longest_repeat", "spans"])

    return texts_of(docs).mapInArrow(run, SCHEMA)
