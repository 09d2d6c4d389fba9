"""Token ids of all documents in binary shards of patched frame-of-reference blocks.

A shard file is a run of segments, a document table and a block index:

    b"PFORBLK1"
    segment*    packed words (u64), exception positions (u32), exception values (u32)
    footer      block minima (u32), widths (u8), exception counts (u8), word starts of the blocks (u64, within
                their segment), doc ids (i64), null flags of the doc ids (u8), token counts (u64),
                segment table (offset, blocks, words, exceptions: u64 each)
    trailer     counts of blocks, documents, segments, values (u64 each), footer offset (u64), b"PFORBLK1"

A block has 128 values (the last of a segment is padded with its last value). Its minimum is subtracted, the width
is that of the value at PERCENTILE of the block, low bits are packed at that width and every wider value stands
whole in the exception list.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.llm.common import by_bytes, fresh_path, small_batches, texts_of
from stratal.llm.tokens import END_ID, default_tokenizer, encoder

MAGIC = b"PFORBLK1"
BLOCK = 128
SEGMENT = 4096 * BLOCK
PERCENTILE = 0.92
_U64 = np.uint64


def encode_segment(values: np.ndarray, percentile: float = PERCENTILE) -> tuple[dict, list[bytes]]:
    """Packs u32 values (a segment at most); index columns by block, and the segment's three byte runs."""
    n_blocks = -(-len(values) // BLOCK)
    padded = np.empty(n_blocks * BLOCK, dtype=np.uint32)
    padded[: len(values)] = values
    padded[len(values) :] = values[-1]
    rows = padded.reshape(n_blocks, BLOCK)
    minima = rows.min(axis=1)
    deltas = rows - minima[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile))
    widths = np.ceil(np.log2(np.partition(deltas, at, axis=1)[:, at].astype(np.float64) + 1)).astype(np.uint8)
    starts = np.concatenate([[0], np.cumsum(widths.astype(np.int64) * 2)])
    words = np.zeros(int(starts[-1]), dtype=_U64)
    wide = (deltas.astype(_U64) >> widths.astype(_U64)[:, None]) != 0
    for width in np.unique(widths).tolist():
        if not width:
            continue
        own = np.flatnonzero(widths == width)
        low = (deltas[own].T.astype(_U64)) & _U64((1 << width) - 1)
        packed = np.zeros((2 * width, len(own)), dtype=_U64)
        for j in range(BLOCK):
            word, shift = divmod(j * width, 64)
            packed[word] |= low[j] << _U64(shift)
            if shift + width > 64:
                packed[word + 1] |= low[j] >> _U64(64 - shift)
        words[starts[own][:, None] + np.arange(2 * width)] = packed.T
    where = np.flatnonzero(wide.ravel()).astype("<u4")
    index = {"minima": minima, "widths": widths, "exceptions": wide.sum(axis=1).astype(np.uint8), "starts": starts[:-1].astype(_U64)}
    return index, [words.astype("<u8").tobytes(), where.tobytes(), deltas.ravel()[where].astype("<u4").tobytes()]


def decode_segment(minima, widths, starts, words, positions, values) -> np.ndarray:
    """The inverse of encode_segment, padding included."""
    out = np.empty((len(minima), BLOCK), dtype=np.uint32)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        if not width:
            out[own] = 0
            continue
        packed = np.ascontiguousarray(words[starts[own].astype(np.int64)[:, None] + np.arange(2 * width)].T)
        low = np.empty((BLOCK, len(own)), dtype=np.uint32)
        mask = _U64((1 << width) - 1)
        for j in range(BLOCK):
            word, shift = divmod(j * width, 64)
            got = packed[word] >> _U64(shift)
            if shift + width > 64:
                got |= packed[word + 1] << _U64(64 - shift)
            low[j] = got & mask
        out[own] = low.T
    out.ravel()[positions] = values
    out += minima[:, None]
    return out.ravel()


class ShardWriter:
    """Writes one shard to an open binary file, holding a segment of ids at a time."""

    def __init__(self, sink, percentile: float = PERCENTILE):
        self.sink, self.percentile, self.at = sink, percentile, len(MAGIC)
        self.index: list[dict] = []
        self.table: list[tuple[int, int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []
        self.pending: list[bytes] = []
        self.held = self.n_values = 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.pending.append(ids)
        self.held += len(ids) // 4
        if self.held >= SEGMENT:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.pending), dtype="<u4")
        stop = len(values) if last else len(values) // SEGMENT * SEGMENT
        for start in range(0, stop, SEGMENT):
            part = values[start : min(stop, start + SEGMENT)]
            index, runs = encode_segment(part, self.percentile)
            self.index.append(index)
            self.table.append((self.at, len(index["minima"]), len(runs[0]) // 8, len(runs[1]) // 4))
            for run in runs:
                self.sink.write(run)
                self.at += len(run)
        self.n_values += stop
        self.pending, self.held = [values[stop:].tobytes()], len(values) - stop

    def close(self) -> None:
        self._flush(True)
        column = lambda name, kind: np.concatenate([np.empty(0, kind), *(x[name] for x in self.index)]).astype(kind).tobytes()
        footer = column("minima", "<u4") + column("widths", "u1") + column("exceptions", "u1") + column("starts", "<u8")
        footer += np.array([d or 0 for d, _ in self.docs], dtype="<i8").tobytes() + np.array([d is None for d, _ in self.docs], dtype="u1").tobytes()
        footer += np.array([n for _, n in self.docs], dtype="<u8").tobytes() + np.array(self.table, dtype="<u8").tobytes()
        self.sink.write(footer + struct.pack("<5Q", sum(t[1] for t in self.table), len(self.docs), len(self.table), self.n_values, self.at) + MAGIC)


def read_shard(source, size: int):
    """(doc_id, start within the shard, ids as u32) of every document of an open shard file, a segment at a time."""
    source.seek(size - 48)
    tail = source.read(48)
    if tail[40:] != MAGIC:
        raise ValueError("not a finished shard")
    blocks, docs, segments, total, at = struct.unpack("<5Q", tail[:40])
    source.seek(at)
    raw, pos = source.read(size - 48 - at), 0

    def take(kind, n):
        nonlocal pos
        out = np.frombuffer(raw, dtype=kind, count=n, offset=pos)
        pos += out.nbytes
        return out

    minima, widths, counts, starts = take("<u4", blocks), take("u1", blocks), take("u1", blocks), take("<u8", blocks)
    doc_ids, nulls, lengths, table = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u8", segments * 4).reshape(-1, 4)
    ends = np.cumsum(lengths.astype(np.int64))
    held, first, done, block = np.empty(0, dtype=np.uint32), 0, 0, 0
    for offset, n_blocks, n_words, n_exceptions in table.tolist():
        source.seek(offset)
        words = np.frombuffer(source.read(8 * n_words), dtype="<u8")
        positions = np.frombuffer(source.read(4 * n_exceptions), dtype="<u4")
        values = np.frombuffer(source.read(4 * n_exceptions), dtype="<u4")
        own = slice(block, block + n_blocks)
        assert int(counts[own].sum()) == n_exceptions
        ids = decode_segment(minima[own], widths[own], starts[own], words, positions, values)
        held = np.concatenate([held, ids[: min(len(ids), total - first - len(held))]])
        block += n_blocks
        upto = int(np.searchsorted(ends, first + len(held), side="right"))
        base = first
        for k in range(done, upto):
            start, end = int(ends[k] - lengths[k]), int(ends[k])
            yield None if nulls[k] else int(doc_ids[k]), start, held[start - base : end - base]
        if upto > done:
            first = int(ends[upto - 1])
            held = held[first - base :]
        done = upto


def _store(path: str):
    """File system and root of a path; Hadoop's names for object stores are pyarrow's without the last letter."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if path.startswith("s3a://") else path)


def write_token_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, percentile: float = PERCENTILE, special_tokens: bool = True) -> list[tuple[str, int, int, int]]:
    """Encodes every text and writes shards in ascending doc_id order; returns (file, documents, tokens, tokens before it) by shard.

    A range shuffle deals the documents out by doc_id, each task sorts and writes one shard. A task writes under a
    name of its own and renames the file when it is whole, so a repeated or speculative task leaves one good file.
    Null texts are empty ones (only the end id), null ids come first, rows with the same id stay together in the
    order of their texts. The name of a special token in a text becomes its id, as the library does it, unless
    special_tokens is off. The driver gathers one row a shard.
    """
    tokenizer = tokenizer or default_tokenizer()

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        sink = None
        for batch in by_bytes(batches, limit=2_000_000):
            if sink is None:
                store, root = _store(path)
                store.create_dir(root, recursive=True)
                shard = TaskContext.get().partitionId()
                name = f"{root}/shard-{shard:07d}.pfor"
                temporary = f"{name}.{uuid.uuid4().hex}.part"
                sink = store.open_output_stream(temporary)
                writer, enc = ShardWriter(sink, percentile), encoder(tokenizer, special_tokens=special_tokens)
                end = np.array([end_id], dtype="<u4").tobytes()
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                writer.add(doc_id, ids + end)
        if sink is not None:
            writer.close()
            sink.close()
            store.move(temporary, name)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": f"shard-{shard:07d}.pfor", "docs": len(writer.docs), "tokens": writer.n_values}])

    dealt = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    with small_batches(docs.sparkSession):
        rows = sorted(dealt.mapInArrow(write, "shard long, file string, docs long, tokens long").collect())
    before, out = 0, []
    for _, file, n_docs, tokens in rows:
        out.append((file, n_docs, tokens, before))
        before += tokens
    return out


def read_token_shards(spark: SparkSession, path: str, manifest: list[tuple[str, int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian u32) of every document, from the files; a task a shard."""

    def read(batches):
        import pyarrow as pa

        kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        store, root = _store(path)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/{row['file']}"
                with store.open_input_file(name) as source:
                    held, weight = [], 0
                    for doc_id, start, ids in read_shard(source, source.size()):
                        held.append((doc_id, row["before"] + start, len(ids), ids.astype("<u4").tobytes()))
                        weight += ids.nbytes
                        if weight > 8_000_000 or len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kind.types, strict=True)], schema=kind)
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kind.types, strict=True)], schema=kind)

    files = spark.createDataFrame([(f, b) for f, _, _, b in manifest], "file string, before long")
    return files.repartition(max(1, len(manifest))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_output(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, special_tokens: bool = True) -> DataFrame:
    """Writes the shards and returns what the files hold by document (an empty table: no rows, no files).

    A null text is an empty one, its end id alone; null ids come first; rows that repeat an id are documents of their
    own; a text is encoded whole, however long; other columns are not read. A tokenizer that is no plain byte-level
    BPE file is refused.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    return read_token_shards(spark, path, write_token_shards(docs, path, tokenizer, special_tokens=special_tokens))


def ids_digest(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows of read_token_shards."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["decode_segment", "encode_segment", "ids_digest", "read_shard", "read_token_shards", "token_output", "write_token_shards", "ShardWriter"]
