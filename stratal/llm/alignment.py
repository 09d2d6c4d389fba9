"""Two tokenizers' ids of the same text, linked by the bytes that they cover, and how often the corpus links each pair.

A text's tokens of side A (byte-level BPE) and of side B (sentence pieces with byte fallback) both spell space + text, so
each is a row of byte ranges. Where tokens of both end, a group ends; every two tokens whose ranges overlap are linked.

Neither tokenizer merges over the start of a word: A because a pre-token begins at a space or line feed that stands alone
between two others, B because no entry of its table has a space behind another character or a line feed. (Entries are
checked; a table that has such is run on whole texts.) So a text's groups are those of its words in a row, and a worker
remembers words, up to a bound.

Counts: the distinct pairs of a block of documents are cut into stripes of A's ids, dealt in turn so that frequent (small)
ids spread over all stripes. A stripe's counts are a dense matrix, its ids x B's ids, to which np.add.at adds what the blocks hold; the maxima of its rows are the best of each A id. The
links of a stripe go to where its matrix is and are scored there; a stripe with many links is dealt into slices, each
with the matrix. Memory is that of a matrix and a block, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratal.llm.common import Scratch, by_bytes, process_cache, release, texts_of
from stratal.llm.tokens import LONGEST_PIECE, OTHER_SPACE, PieceEncoder, default_tokenizer

MEMO_WORDS = 200_000  # about 500 bytes each in a worker
STRIPE = 128  # ids of A in a matrix: 128 x 32,000 counts are 33 MB
BLOCK_LINKS = 1_500_000  # pairs by document after which a block of documents is written
BLOCK_DOCS = 65_000  # so that a place in a block takes two bytes
TASK_PAIRS = 3_000_000  # pairs that a counting task holds before it hands them on
SLICE_BYTES = 16_000_000  # links of a stripe that one task scores

CUT, SPACE = re.compile(r"(?<=\S)(?=[ \n]\S)"), re.compile(r"\s")

ROWS = (
    "block long, stripe int, codes binary, counts binary, docs binary, times binary, "
    "place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Texts to the ids of both sides and their links, each a code: (row of A's id) x entries of B + id of B.

    The rows of a stripe follow each other; id a of A is row a // stripes of stripe a % stripes.
    """

    def __init__(self, a_path: str, b_path: str, stripe: int = STRIPE, bound: int = MEMO_WORDS):
        import sentencepiece

        self.a = PieceEncoder(a_path, 0, special_tokens=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocabulary = self.a.tokenizer.get_vocab()
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        stripes = -(-self.n_a // stripe)
        if stripes * stripe * self.n_b >= 1 << 32:
            raise ValueError("the two tables have too many pairs for 32 bits")
        ids = np.arange(self.n_a)
        self.row = ids % stripes * stripe + ids // stripes
        byte_of = {chr(c): b for b, c in self.a.characters.items()} | {chr(b): b for b in range(256) if b not in self.a.characters}
        self.a_bytes = [b""] * self.n_a
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        plain = [p for i, p in enumerate(names) if not self.b.is_byte(i)]
        self.cuts = not self.a.names and not any("\n" in p or re.search("[^▁]▁", p) for p in plain)
        self.space = names.index("▁") if "▁" in names else -1
        self.bound, self.kept = bound, 0
        self.slot: dict[str, int] = {}
        self.spelt: list[str] = []
        self.sizes = np.zeros((4, 1024), dtype=np.int64)  # of each word: ids of A, of B, groups, links; ids are -1 if bytes differ
        self.first = np.zeros(1025, dtype=np.int64)
        self.codes = np.zeros(4096, dtype=np.uint32)

    def words(self, text: str) -> list[str]:
        """The words of space + text: what follows its space, or is led by a line feed; with more white space, behind a zero byte."""
        if not self.cuts:
            return ["\0 " + text]
        words = text.replace("\n", " \n").split(" ")
        if len(words) == len(text.split()) and not any(c in text for c in OTHER_SPACE):
            return words
        return ["\0" + s if SPACE.search(s, 1) or len(s) == 1 else s if s[0] == "\n" else s[1:] for s in CUT.split(" " + text)]

    @staticmethod
    def behind_zero(word: str) -> bool:
        return word[:2] in ("\0 ", "\0\n")

    def _learn(self, words: list[str]) -> None:
        """Adds the ids, groups and links of new words."""
        zero = [w for w in words if self.behind_zero(w)]
        near = [w for w in words if not self.behind_zero(w)]
        self.a._learn(set(near))
        a_of = self.a.later | dict(zip(zero, self.a._library([w[1:] for w in zero]), strict=True))
        self.a.later = {}
        raw = [w[1:] if self.behind_zero(w) else w if w[:1] == "\n" else " " + w for w in words]
        b_ids = self.b.encode([w if w[0] == "\n" else w[1:] for w in raw], num_threads=1)
        a_ids, n = [np.frombuffer(a_of[w], dtype="<u4").tolist() for w in words], len(self.spelt)
        while n + len(words) > self.sizes.shape[1]:
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)], axis=1)
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        good = []
        for k, (a, b, want) in enumerate(zip(a_ids, b_ids, raw, strict=True)):
            if want[0] == "\n":  # B puts a space before it
                b_ids[k] = b = b[1:] if b[:1] == [self.space] else []
            want = want.encode()
            good.append(b"".join([self.a_bytes[i] for i in a]) == want == b"".join([self.b_bytes[i] for i in b]))
        a_ids = [x if ok else [] for x, ok in zip(a_ids, good, strict=True)]
        b_ids = [x if ok else [] for x, ok in zip(b_ids, good, strict=True)]
        a_flat, b_flat = (np.array([i for x in side for i in x], dtype=np.int64) for side in (a_ids, b_ids))
        a_ends, b_ends = np.cumsum(self.a_size[a_flat]), np.cumsum(self.b_size[b_flat])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        every = np.union1d(a_ends, b_ends)
        codes = self.row[a_flat[np.searchsorted(a_ends, every)]] * self.n_b + b_flat[np.searchsorted(b_ends, every)] if len(every) else every
        a_upto, b_upto = np.searchsorted(a_ends, both, side="right").tolist(), np.searchsorted(b_ends, both, side="right").tolist()
        a_text, b_text = [str(i) for i in a_flat.tolist()], [str(i) for i in b_flat.tolist()]
        groups, i, j = [], 0, 0
        for p, q in zip(a_upto, b_upto, strict=True):
            groups.append(f"{a_text[i] if p == i + 1 else ','.join(a_text[i:p])}|{b_text[j] if q == j + 1 else ','.join(b_text[j:q])}")
            i, j = p, q
        n_a, n_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (a_ids, b_ids))
        ends = np.concatenate([[0], a_ends])[np.cumsum(n_a)]  # where each word ends, in bytes
        upto = np.searchsorted(both, ends, side="right")
        n_groups, n_links = np.diff(upto, prepend=0), np.diff(np.searchsorted(every, ends, side="right"), prepend=0)
        own = slice(n, n + len(words))
        self.sizes[:, own] = np.where(good, np.stack([n_a, n_b, n_groups, n_links]), np.array([[-1], [-1], [0], [0]]))
        at = 0
        for stop in upto.tolist():
            self.spelt.append(groups[at] if stop == at + 1 else ";".join(groups[at:stop]))
            at = stop
        base = int(self.first[n])
        self.first[n + 1 : n + 1 + len(words)] = base + np.cumsum(n_links)
        while base + len(codes) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        self.codes[base : base + len(codes)] = codes
        self.slot.update(zip(words, range(n, n + len(words)), strict=True))

    def _forget(self, words: list[str]) -> None:
        """Drops the words of this batch that are one too many."""
        keep = self.bound - self.kept
        if len(words) > keep:
            for w in words[keep:]:
                del self.slot[w]
            del self.spelt[self.kept + keep :]
        self.kept = len(self.spelt)

    def align(self, texts: list[str]):
        """(table of n_a, n_b, n_groups, n_links by text, digests of the groups, (text, code, times) of the links)."""
        words = [self.words(t) if t else [] for t in texts]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        flat = [w for own in words for w in own]
        new = sorted(set(flat).difference(self.slot), key=lambda w: len(w) > LONGEST_PIECE)  # long words are the first to go
        if new:
            self._learn(new)
        at = np.fromiter(map(self.slot.__getitem__, flat), dtype=np.int64, count=len(flat))
        of = np.repeat(np.arange(len(texts)), lengths)
        bad = np.zeros(len(texts), dtype=bool)
        bad[of[self.sizes[0, at] < 0]] = True
        table = np.stack([np.bincount(of, weights=s, minlength=len(texts)).astype(np.int64) for s in self.sizes[:, at]])
        table[:, bad] = 0
        ends, spelt, digests = np.cumsum(lengths).tolist(), self.spelt, []
        slots = at.tolist()
        for k, end in enumerate(ends):
            own = slots[ends[k - 1] if k else 0 : end]
            digests.append("" if bad[k] or not own else hashlib.sha256(";".join([spelt[s] for s in own]).encode()).hexdigest())
        at, of = at[~bad[of]], of[~bad[of]]
        n_links = self.sizes[3, at]
        where = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(n_links)[:-1]]) if len(at) else at, n_links) + np.arange(int(n_links.sum()))
        key, times = np.unique(np.repeat(of, n_links).astype(np.uint64) << np.uint64(32) | self.codes[where], return_counts=True)
        if new:
            self._forget(new)
        return table, digests, ((key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), times)


def _aligner(a_path: str, b_path: str, stripe: int) -> Aligner:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return process_cache(f"aligner_{abs(hash((a_path, b_path, stripe)))}", lambda: Aligner(a_path, b_path, stripe))


def _cut(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return starts, np.concatenate([starts[1:], [len(sorted_keys)]]) if len(starts) else starts


def _batch(rows: list[dict], kind):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist(rows, schema=kind)


def _schema(columns: str):
    """The Arrow schema of "name type, name type"."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, columns.split(", "))])


class _Block:
    """The documents and links that become one block."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_links = 0

    def rows(self, block: int, width: int, kind):
        """Batches of its rows: those of documents, and one a stripe with its pairs, their documents and how often each has them."""
        for k in range(0, len(self.docs), 4096):
            part = self.docs[k : k + 4096]
            yield _batch([dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), d, strict=True)) | {"block": block, "place": k + j} for j, d in enumerate(part)], kind)
        docs, codes, times = (np.concatenate([x[i] for x in self.links]) if self.links else np.zeros(0, np.uint32) for i in range(3))
        order = np.argsort(codes, kind="stable")
        docs, codes, times = docs[order].astype("<u2"), codes[order], times[order].astype("<u4")
        starts, ends = _cut(codes)
        pairs, counts = codes[starts], (ends - starts).astype("<u4")
        first, last = _cut(pairs // np.uint32(width))
        rows, held = [], 0
        for i, j in zip(first.tolist(), last.tolist(), strict=True):
            own = slice(int(starts[i]), int(ends[j - 1]))
            rows.append({"block": block, "stripe": int(pairs[i]) // width, "codes": pairs[i:j].astype("<u4").tobytes(), "counts": counts[i:j].tobytes(), "docs": docs[own].tobytes(), "times": times[own].tobytes()})
            held += own.stop - own.start
            if held > 300_000:
                yield _batch(rows, kind)
                rows, held = [], 0
        if rows:
            yield _batch(rows, kind)


def aligned(docs: DataFrame, a_path: str, b_path: str, stripe: int = STRIPE, block_links: int = BLOCK_LINKS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """ROWS: for each document its numbers and place in a block; for each block and stripe the links."""

    def run(batches):
        from pyspark import TaskContext

        align, kind = _aligner(a_path, b_path, stripe), _schema(ROWS)
        width = stripe * align.n_b
        block, number = _Block(), TaskContext.get().partitionId() << 32
        for batch in by_bytes(batches, limit=1_000_000):
            ids = batch.column(0).to_pylist()
            table, digests, (of, codes, times) = align.align(batch.column(1).to_pylist())
            for k in range(0, len(ids), block_docs):  # as a rule once
                if block.docs and len(block.docs) + min(block_docs, len(ids) - k) > block_docs:
                    yield from block.rows(number, width, kind)
                    block, number = _Block(), number + 1
                own = slice(*np.searchsorted(of, [k, k + block_docs]))
                block.links.append((of[own] - k + len(block.docs), codes[own], times[own]))
                block.n_links += own.stop - own.start
                block.docs += list(zip(ids, *table.tolist(), digests, strict=True))[k : k + block_docs]
            if block.n_links >= block_links:
                yield from block.rows(number, width, kind)
                block, number = _Block(), number + 1
        if block.docs:
            yield from block.rows(number, width, kind)
        release()

    return texts_of(docs).mapInArrow(run, ROWS)


COUNTS = "stripe int, codes binary, counts binary"


def _partial_counts(width: int, task_pairs: int = TASK_PAIRS):
    """What a task's blocks add up to, by stripe."""

    def run(batches):
        kind, held, n = _schema(COUNTS), [], 0

        def summed():
            codes = np.concatenate([c for c, _ in held])
            pairs, at = np.unique(codes, return_inverse=True)
            total = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(total, at, np.concatenate([c for _, c in held]))
            return pairs, total

        def rows(pairs, total):
            first, last = _cut(pairs // np.uint32(width))
            for k in range(0, len(first), 64):
                yield _batch([{"stripe": int(pairs[i]) // width, "codes": pairs[i:j].astype("<u4").tobytes(), "counts": total[i:j].tobytes()} for i, j in zip(first[k : k + 64].tolist(), last[k : k + 64].tolist(), strict=True)], kind)

        for batch in batches:
            for codes, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((np.frombuffer(codes, dtype="<u4"), np.frombuffer(counts, dtype="<u4").astype(np.int64)))
                n += len(held[-1][0])
                if n >= 2 * task_pairs:
                    held = [summed()]
                    n = len(held[0][0])
                    if n >= task_pairs:
                        yield from rows(*held[0])
                        held, n = [], 0
        if held:
            yield from rows(*summed())

    return run


def _stripe_counts(width: int):
    """Rows sorted by stripe to one row a stripe: the pairs of its matrix that some document links, and their counts."""

    def run(batches):
        kind, of, matrix = _schema(COUNTS), None, np.zeros(width, dtype=np.int64)

        def row():
            found = np.flatnonzero(matrix)
            return _batch([{"stripe": of, "codes": (found + of * width).astype("<u4").tobytes(), "counts": matrix[found].tobytes()}], kind)

        for batch in batches:
            for stripe, codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of is not None and stripe != of:
                    yield row()
                    matrix[:] = 0
                of = stripe
                np.add.at(matrix, np.frombuffer(codes, dtype="<u4").astype(np.int64) - of * width, np.frombuffer(counts, dtype="<i8"))
        if of is not None:
            yield row()

    return run


SCORES = "block long, docs binary, best binary, sums binary"


def _scored(width: int, n_b: int):
    """Rows sorted by stripe and slice, the matrix before its links, to each block's sums over the links of a stripe."""

    def run(batches):
        kind, matrix = _schema(SCORES), np.zeros(width, dtype=np.int64)
        best = None
        for batch in batches:
            rows = []
            for stripe, block, codes, counts, docs, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = np.frombuffer(codes, dtype="<u4").astype(np.int64) - stripe * width
                if block is None:
                    matrix[:] = 0
                    np.add.at(matrix, codes, np.frombuffer(counts, dtype="<i8"))
                    best = matrix.reshape(-1, n_b).max(axis=1)
                    continue
                each = np.frombuffer(counts, dtype="<u4").astype(np.int64)
                count = matrix[codes]
                is_best = np.repeat(count == best[codes // n_b], each)
                count, times = np.repeat(count, each), np.frombuffer(times, dtype="<u4").astype(np.int64)
                docs, at = np.unique(np.frombuffer(docs, dtype="<u2"), return_inverse=True)
                n_best, sums = np.zeros(len(docs), dtype=np.int64), np.zeros(len(docs), dtype=np.int64)
                np.add.at(n_best, at, times * is_best)
                np.add.at(sums, at, times * count)
                rows.append({"block": block, "docs": docs.astype("<u2").tobytes(), "best": n_best.astype("<u4").tobytes(), "sums": sums.tobytes()})
            if rows:
                yield _batch(rows, kind)

    return run


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _gathered(batches):
    """Rows sorted by block, sums before documents, to the documents with their sums."""
    kind, of = _schema(OUT), None
    n_best, sums = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        rows = []
        for block, docs, best, total, place, *numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != of:
                of = block
                n_best[:], sums[:] = 0, 0
            if place is None:
                docs = np.frombuffer(docs, dtype="<u2")
                n_best[docs] += np.frombuffer(best, dtype="<u4")
                sums[docs] += np.frombuffer(total, dtype="<i8")
            else:
                doc_id, n_a, n_b, n_groups, n_links, digest = numbers
                rows.append({"doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "n_best": int(n_best[place]), "count_sum": int(sums[place]), "groups_sha256": digest})
        if rows:
            yield _batch(rows, kind)


def align_tokenizers(
    docs: DataFrame, a_path: str | None = None, b_path: str | None = None, stripe: int = STRIPE,
    block_links: int = BLOCK_LINKS, block_docs: int = BLOCK_DOCS, slice_bytes: int = SLICE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(OUT for every document, counts of the linked pairs by stripe as COUNTS).

    A null or empty text, or one that a side can't spell byte by byte, has no tokens: zeros and no digest. Special
    tokens' names in a text are plain text. Texts are aligned whole, however long. Rows that repeat an id or a text, or
    have no id, are documents of their own; other columns are not read; an empty table gives none.
    """
    import sentencepiece

    spark = docs.sparkSession
    a_path, b_path = a_path or default_tokenizer(), b_path or default_pieces()
    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    width, keep = stripe * n_b, Scratch(spark)
    rows = keep(aligned(docs, a_path, b_path, stripe, block_links, block_docs), "aligned")
    links = rows.where(F.col("stripe").isNotNull())
    partial = links.select("codes", "counts").mapInArrow(_partial_counts(width), COUNTS)
    counts = keep(partial.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_stripe_counts(width), COUNTS), "stripes")
    # one row a stripe of the vocabulary comes to the driver, however large the corpus
    slices = [(r["stripe"], max(1, -(-r["b"] // slice_bytes))) for r in links.groupBy("stripe").agg(F.sum(F.octet_length("docs")).alias("b")).collect()]
    dealt = F.broadcast(spark.createDataFrame(slices, "stripe int, slices long"))
    near = links.join(dealt, "stripe").select("stripe", F.pmod(F.xxhash64("block"), "slices").cast("int").alias("slice"), "block", "codes", "counts", "docs", "times")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("docs", "binary"), ("times", "binary"))]
    matrices = counts.join(dealt, "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("slices").cast("int") - 1)).alias("slice"), F.lit(None).cast("long").alias("block"), "codes", "counts", *nothing)
    met = matrices.unionByName(near).repartition("stripe", "slice").sortWithinPartitions("stripe", "slice", F.col("block").asc_nulls_first())
    scores = keep(met.select("stripe", "block", "codes", "counts", "docs", "times").mapInArrow(_scored(width, n_b), SCORES), "scores")
    numbers = ["place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    own = rows.where(F.col("place").isNotNull()).select("block", *(F.lit(None).cast("binary").alias(c) for c in ("docs", "best", "sums")), *numbers)
    both = scores.select("*", *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in numbers)).unionByName(own)
    found = both.repartition("block").sortWithinPartitions("block", F.col("place").asc_nulls_first()).mapInArrow(_gathered, OUT)
    return keep(found, "links"), counts


def pair_counts(counts: DataFrame, n_a: int, n_b: int, stripe: int = STRIPE) -> DataFrame:
    """a, b, count of the stripes of align_tokenizers; n_a, n_b: entries of the two tables."""
    stripes = -(-n_a // stripe)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for codes, numbers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                row, b = np.divmod(np.frombuffer(codes, dtype="<u4").astype(np.int64), n_b)
                yield pa.RecordBatch.from_arrays([pa.array(row % stripe * stripes + row // stripe), pa.array(b), pa.array(np.frombuffer(numbers, dtype="<i8"))], names=["a", "b", "count"])

    return counts.mapInArrow(run, "a long, b long, count long")
