"""Best-fit packing of documents into fixed-length sequences by minimum bin slack.

The packing sees lengths only, so the plan is made over the histogram of piece lengths (as many entries as a
sequence has tokens, whatever the corpus): for each bin the longest piece left is fixed, a subset-sum dynamic
programme over bitsets finds the fullest feasible combination of the lengths that are left, and that combination
is removed as many times as the counts allow - which is what repeating the search would find. Pieces then find
their place by their rank among the pieces of the same length.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratal.llm.common import by_bytes, texts_of, written
from stratal.llm.tokens import END_ID, MEMO_PIECES, default_tokenizer, encoder

CAPACITY = 1024


def fullest(counts: list[int], longest: int, room: int) -> dict[int, int]:
    """Lengths (with how many of each) whose sum is the largest that fits into room, from counts; long ones first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in range(min(longest, room), 0, -1):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, {length: pieces in each}) until no piece is left."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit into {capacity}")
        counts[length] = n
    plan, longest = [], capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return plan
        counts[longest] -= 1
        used = fullest(counts, longest, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in used.items())
        for length, n in used.items():
            counts[length] -= times * n
        plan.append((times, used))


def plan_lookup(plan: list[tuple[int, dict[int, int]]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the piece of a length with a rank goes: rows by (length, first rank), sorted."""
    seen = [0] * (capacity + 1)
    rows, base = [], 0
    for times, used in plan:
        at = 0
        for length in sorted(used, reverse=True):
            rows.append((length, seen[length], base, used[length], at))
            seen[length] += times * used[length]
            at += length * used[length]
        base += times
    rows.sort()
    columns = np.array(rows or [(0, 0, 0, 1, 0)], dtype=np.int64).T
    return dict(zip(("length", "rank", "sequence", "each", "offset"), columns, strict=True))


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, memo_pieces: int = MEMO_PIECES, special_tokens: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, with the writing task, the rank among its pieces of that length, and their ids (null unless kept)."""
    tokenizer = tokenizer or default_tokenizer()

    def make(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, ranks, enc = TaskContext.get().partitionId(), {}, encoder(tokenizer, memo_pieces, special_tokens)
        end = np.array([end_id], dtype="<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in by_bytes(batches, limit=2_000_000):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rank = ranks[length] = ranks.get(length, -1) + 1
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), part, rank, own if keep_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], names=names)

    return texts_of(docs).mapInArrow(make, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long, ids binary")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, memo_pieces: int = MEMO_PIECES, special_tokens: bool = True) -> DataFrame:
    """One row a piece with its sequence and its place there; see the module.

    Null texts are empty (one end id), null and repeated ids are kept as rows of their own, an empty table gives
    none, texts are encoded whole, however long, and other columns are not read. The name of a special token in a text
    becomes its id, as the library does it, unless special_tokens is off. Pieces of one length are alike to the packing:
    which of them goes where follows the task that wrote it and its order there, so it depends on how the table is dealt;
    the number of sequences and their lengths do not. The pieces are written once, so a piece keeps its rank whatever is lost later. The driver gets the
    histogram: at most `capacity` rows. Counts by task and length shift the ranks, so no group is gathered anywhere.
    """
    pieces, _ = written(pieces_of(docs, tokenizer, capacity, keep_ids=keep_ids, memo_pieces=memo_pieces, special_tokens=special_tokens), "pieces")
    by_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    by_task, _ = written(by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", "n", F.coalesce("before", F.lit(0)).alias("before")), "ranks")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    look = plan_lookup(minimum_bin_slack(histogram, capacity), capacity)
    key = (look["length"] << 44) | look["rank"]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            row = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            nth, each = rank - look["rank"][row], look["each"][row]
            sequence = look["sequence"][row] + nth // each
            offset = look["offset"][row] + nth % each * length
            kept = batch.columns[6:] if keep_ids else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), *kept], names=[*batch.schema.names[:5], "sequence_id", "offset", "ids"][: 7 + len(kept)])

    ranked = pieces.join(by_task.drop("n"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"), *["ids"][: int(keep_ids)])
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian u32) of what pack() with kept ids gives: the training sequences themselves."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"])).alias("ids"))
