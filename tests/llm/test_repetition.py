import random
import re
from collections import Counter

import numpy as np

from stratal.llm import repetition as R


def brute_lengths(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_repeat_lengths_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        docs = [[rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randrange(0, 25))] for _ in range(rng.randrange(1, 5))]
        words = np.array([w for d in docs for w in d], dtype=np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        assert R.repeat_lengths(words, doc).tolist() == [x for d in docs for x in brute_lengths(d)]


def maximal_repeats(words, least):
    """(length, starts) of the repeated substrings that no longer one with the same occurrences contains, by plain search."""
    places = {}
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            places.setdefault(tuple(words[i:j]), []).append(i)
    out = []
    for sub, starts in places.items():
        before = {tuple(words[s - 1 : s]) if s else None for s in starts}
        after = {tuple(words[s + len(sub) : s + len(sub) + 1]) or None for s in starts}
        wide = lambda ends: len(ends) > 1 or ends == {None}
        if len(starts) > 1 and len(sub) >= least and wide(before) and wide(after):
            out.append((len(sub), starts))
    return out


def test_spans_are_the_union_of_maximal_repeats():
    rng = random.Random(7)
    for _ in range(150):
        words = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(0, 22))]
        for least in (1, 2, 4):
            found = maximal_repeats(words, least)
            covered = {s + k for n, starts in found for s in starts for k in range(n)}
            lengths = R.repeat_lengths(np.array(words, dtype=np.int64), np.zeros(len(words), dtype=np.int64))
            assert set(np.flatnonzero(R.spans_of(lengths, least)).tolist()) == covered
            assert max(lengths, default=0) >= max((n for n, _ in found), default=0)


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_table(spark):
    rng = random.Random(2)
    clean = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    passage = " ".join(f"p{k}" for k in range(120))
    rows = [(1, clean), (2, None), (3, ""), (4, "spam eggs " * 200), (5, clean + "\n" + passage + "\n" + clean[::-1] + "\n" + passage), (6, "a b\n\n a b\n a b\n$|x y z\x0bq"), (7, clean), (7, clean), (None, "x" * 200_000), (9, "ab " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "true AS kept")
    got = {(r["doc_id"], r["n_words"]): r for r in R.repetition_rules(docs).collect()}
    for doc_id, text in rows:
        n, *rest = base(text)
        r = got[(doc_id, n)]
        assert [r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]] == rest
    assert R.repetition_rules(docs).count() == len(rows)
    assert got[(1, 300)]["kept"] and not any(r["kept"] for k, r in got.items() if k[0] in (2, 3, 4, 9))
    five = next(r for k, r in got.items() if k[0] == 5)
    assert not five["base_failed"] and five["longest_repeat"] == 120 and not five["kept"]
    assert [(x["start"], x["length"]) for x in five["spans"]] == [(300, 120), (720, 120)]
    assert all(sum(x["length"] for x in r["spans"]) == r["covered_words"] for r in got.values())
    assert R.repetition_rules(docs.limit(0)).count() == 0
