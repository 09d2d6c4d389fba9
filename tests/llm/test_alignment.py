import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stratal.llm import alignment as A

TEXTS = [
    None, "", "plain words in a row", "plain words in a row", "two\nlines\n\nand  two spaces", " leading", "trailing ", "\nfeed first", "tab\tand\r\nreturn",
    "Ünïcödé ß 漢字かな交じり文 emoji \U0001f600\U0001f468\u200d\U0001f469 done", "a ▁ literal ▁mark", "name <|endoftext|> and <s> </s> <unk> <0x0A> inside", "nul \0 byte \0  x \0", "\u2028line\u2029sep \x85 \xa0nbsp\u3000wide",
    "don't can't we'll 12345 67 it's;\r {x}\r", "x" * 4_000, "word " * 3_000, "  ", "\n", ".", "é", " \x1c odd \x1d", "the the the cat sat on the mat\nthe end", "ﬁ ligature ½ ①",
]


def spelt_a(tokenizer):
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    return lambda i: bytes(table[c] for c in tokenizer.id_to_token(i))


def tokens(texts):
    """Per text: the tokens of both sides as (id, bytes), or none, from whole texts and the libraries alone."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b, bytes_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), spelt_a(a)
    for text in texts:
        if not text:
            yield [], []
            continue
        own = [(i, bytes_of(i)) for i in a.encode(" " + text, add_special_tokens=False).ids]
        other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        want = (" " + text).encode()
        yield (own, other) if b"".join(x for _, x in own) == want == b"".join(x for _, x in other) else ([], [])


def brute(rows):
    links, out, counts = [], [], Counter()
    for a, b in tokens([t for _, t in rows]):
        found, groups, i, j, at_a, at_b = [], [], 0, 0, 0, 0
        group = ([], [])
        while i < len(a) and j < len(b):
            found.append((a[i][0], b[j][0]))
            end_a, end_b = at_a + len(a[i][1]), at_b + len(b[j][1])
            if end_a <= end_b:
                group[0].append(a[i][0])
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                group[1].append(b[j][0])
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append(group)
                group = ([], [])
        links.append((len(a), len(b), groups, found))
        counts.update(set(found))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    for (doc, _), (n_a, n_b, groups, found) in zip(rows, links, strict=True):
        digest = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if found else ""
        out.append((doc, n_a, n_b, len(groups), len(found), sum(counts[p] == best[p[0]] for p in found), sum(counts[p] for p in found), digest))
    return sorted(out, key=str), counts


def rows_of(seed):
    rng = random.Random(seed)
    words = [*"the of and cat-sat house, naïve über 漢字 \U0001f600x foo_bar 3.14 \n\n \t Don't ▁ <|endoftext|>".split(" "), *("".join(rng.choices("abcdeéßж", k=rng.randrange(1, 12))) for _ in range(40))]
    made = [rng.choice([" ", " ", "\n", "  "]).join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(60)]
    return [(k, t) for k, t in enumerate(TEXTS + made)] + [(None, "no id"), (3, "plain words again"), (None, None)]


@pytest.mark.parametrize("limits", [{}, {"stripe": 7, "block_links": 50, "block_docs": 3, "slice_bytes": 40}])
def test_links_and_counts_equal_whole_texts_by_the_libraries(spark, limits):
    rows = rows_of(3)
    want, counts = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "'x' AS stripe", "2 AS n_a").repartition(3)
    found, stripes = A.align_tokenizers(df, **limits)
    assert sorted(map(tuple, found.collect()), key=str) == want
    got = {(r["a"], r["b"]): r["count"] for r in A.pair_counts(stripes, 50257, 32000, limits.get("stripe", A.STRIPE)).collect()}
    assert got == dict(counts)


def test_words_that_are_forgotten_come_out_alike():
    texts = [t or "" for _, t in rows_of(4)]
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    small, large, whole = A.Aligner(*paths, bound=5), A.Aligner(*paths), A.Aligner(*paths)
    whole.cuts = False
    for k in range(0, len(texts), 7):
        a, b, c = (x.align(texts[k : k + 7]) for x in (small, large, whole))
        for other in (b, c):
            assert (a[0] == other[0]).all() and a[1] == other[1] and all((x == y).all() for x, y in zip(a[2], other[2], strict=True))
    assert len(small.slot) == len(small.spelt) == 5


def test_partial_counts_are_handed_on_when_a_task_is_full():
    import numpy as np
    import pyarrow as pa

    blobs = [(np.array(c, "<u4").tobytes(), np.ones(len(c), "<u4").tobytes()) for c in ([1, 2, 12], [2, 3, 14], [1, 15, 22], [2, 40, 41])]
    batches = [pa.RecordBatch.from_arrays([pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=["codes", "counts"]) for a, b in blobs]
    total = Counter()
    for out in A._partial_counts(10, task_pairs=2)(batches):
        for row in out.to_pylist():
            codes = np.frombuffer(row["codes"], "<u4")
            assert set(codes // 10) == {row["stripe"]}
            total.update(dict(zip(codes.tolist(), np.frombuffer(row["counts"], "<i8").tolist(), strict=True)))
    assert total == {1: 2, 2: 3, 12: 1, 3: 1, 14: 1, 15: 1, 22: 1, 40: 1, 41: 1}


def test_empty_table(spark):
    found, stripes = A.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"))
    assert found.count() == 0 and stripes.count() == 0
