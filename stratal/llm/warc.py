"""WARC archives of Zstandard frames: a shared dictionary in a leading skippable frame, then one frame a record.

Files of this kind are read without knowing how they were cut: the reader takes the dictionary from the first frame
(itself a Zstandard frame, or plain), decodes one frame at a time from a stream, and checks each record: version line,
named fields, their repeats, the stated length against the block, the closing line ends, and the digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.llm.common import Scratch, by_bytes, fits_broadcast, fresh_path, small_batches, split_join
from stratal.llm.token_output import _store

# fixed values of the formats: the skippable frame of a dictionary, a frame of Zstandard
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")

MIN_PAYLOAD = 0
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of their own
FILE_BYTES = 64_000_000  # compressed bytes after which a task begins another archive
CHUNK, STEP = 1 << 20, 1 << 14  # read at once; fed to a frame at once, so that little is copied at its end
MAX_HEADER = 1 << 20
SAMPLE_PAGES = 400
SAMPLE_BYTES = 20_000  # pages longer than this are no sample; so the driver holds 8 MB of pages at most
DICTIONARY = 112_640

RECORDS = "file string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, fault string"


class BadRecord(ValueError):
    pass


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    """A header's value on one line: what would end the line or be trimmed is percent-encoded."""
    safe = "".join(f"%{ord(c):02X}" if c in "\r\n\x00" else c for c in value)
    inner = safe.strip()
    at = safe.find(inner) if inner else len(safe)
    return "".join(f"%{b:02X}" for b in safe[:at].encode()) + inner + "".join(f"%{b:02X}" for b in safe[at + len(inner) :].encode())


def record_uri(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record. A revisit holds the HTTP headers only, whose Content-Length is that of the payload left out."""
    digest = digest32(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id, digest)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}",
        *([f"WARC-Target-URI: {_field(url)}"] if url is not None else []),
        *([f"WARC-Refers-To: {record_uri(refers_to, digest)}", f"WARC-Profile: {PROFILE}"] if revisit else []), f"Content-Length: {len(block)}",
    ]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(uri: str) -> tuple[int | None, str]:
    parts = uri.removeprefix("<urn:page:").removesuffix(">").split(":")
    if not uri.startswith("<urn:page:") or not uri.endswith(">") or len(parts) != 2:
        raise BadRecord(f"{uri[:80]} names no page")
    return (int(parts[0]) if parts[0] else None), parts[1]


def parse_record(raw: bytes) -> dict:
    """The fields of RECORDS but the file's; BadRecord says what is wrong."""
    end = raw.find(b"\r\n\r\n", 0, MAX_HEADER)
    if end < 0:
        raise BadRecord("the header has no end")
    version, *lines = raw[:end].decode("utf-8", "strict").split("\r\n")
    if version.encode() not in (VERSION, b"WARC/1.0"):
        raise BadRecord(f"version {version[:20]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        name = name.lower()
        if not colon or not name or name != name.strip():
            raise BadRecord(f"header line {line[:40]!r}")
        if name in fields and name != "warc-concurrent-to":
            raise BadRecord(f"{name} is repeated")
        fields[name] = value.strip()
    for name in REQUIRED:
        if name not in fields:
            raise BadRecord(f"{name} is missing")
    if fields["warc-type"] not in TYPES:
        raise BadRecord(f"type {fields['warc-type'][:20]!r}")
    if not fields["content-length"].isdecimal():
        raise BadRecord("content-length is no number")
    length, start = int(fields["content-length"]), end + 4
    if len(raw) != start + length + 4:
        raise BadRecord(f"content-length {length}, but the frame holds {len(raw) - start - 4}")
    if raw[start + length :] != b"\r\n\r\n":
        raise BadRecord("the record does not end in two line ends")
    block = raw[start : start + length]
    if fields.get("warc-block-digest", sha := f"sha1:{digest32(block)}") != sha:
        raise BadRecord("the block digest differs")
    out = {"url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "page_id": None, "refers_to": None, "payload": None, "payload_bytes": None, "payload_digest": None}
    if out["record_type"] not in ("response", "revisit"):
        return out
    out["page_id"], named = _page(fields["warc-record-id"])
    head, blank, payload = block.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/"):
        raise BadRecord("the block is no HTTP response")
    stated = [x.partition(b":")[2].strip() for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if len(stated) != 1 or not stated[0].isdigit():
        raise BadRecord("the response has not one length")
    out["payload_bytes"], out["payload_digest"] = int(stated[0]), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if out["payload_digest"] != named:
        raise BadRecord("the payload digest is not that of the record's name")
    if out["record_type"] == "response":
        if len(payload) != out["payload_bytes"]:
            raise BadRecord(f"payload of {len(payload)} bytes, {out['payload_bytes']} stated")
        if digest32(payload) != named:
            raise BadRecord("the payload digest differs")
        out["payload"] = payload
        return out
    if payload:
        raise BadRecord("a revisit holds a payload")
    if fields.get("warc-profile") != PROFILE:
        raise BadRecord("a revisit of another profile")
    out["refers_to"], same = _page(fields.get("warc-refers-to", ""))
    if same != named:
        raise BadRecord("a revisit of another payload")
    return out


class ArchiveWriter:
    """Writes the dictionary's frame and then a frame a record to an open binary file."""

    def __init__(self, sink, dictionary: bytes, level: int = 3):
        import zstandard

        self.sink, self.records = sink, 0
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True, write_checksum=True).compress
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
        self.at = sink.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)

    def add(self, record: bytes) -> int:
        """Writes one record and returns where its frame begins."""
        start = self.at
        self.at += self.sink.write(self.compress(record))
        self.records += 1
        return start


def read_frames(source):
    """(offset, bytes of the record or None, fault) of every frame of an open stream, which is read CHUNK by CHUNK.

    A frame that can't be decoded is a fault, and what follows it is lost with it, as nothing says where it ends.
    """
    import zstandard

    held, pos, at = b"", 0, 0  # bytes read, how many of them are done, where the next frame begins

    def have(n: int) -> bool:
        nonlocal held, pos
        while len(held) - pos < n:
            more = source.read(CHUNK)
            if not more:
                return False
            held, pos = held[pos:] + more, 0
        return True

    def magic() -> int:
        return struct.unpack_from("<I", held, pos)[0]

    known = decoder = None
    first = True
    while have(1):
        if not have(8):
            yield at, None, "shorter than a frame"
            return
        if magic() & ~15 == SKIPPABLE & ~15:
            size = struct.unpack_from("<I", held, pos + 4)[0]
            if not have(8 + size):
                yield at, None, "a skippable frame is cut off"
                return
            raw = held[pos + 8 : pos + 8 + size]
            if first and magic() == SKIPPABLE and raw:
                try:
                    if raw[:4] == struct.pack("<I", FRAME):
                        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                    known = zstandard.ZstdCompressionDict(raw)
                except zstandard.ZstdError as e:
                    yield 0, None, f"dictionary: {e}"
                    return
            pos, at, first = pos + 8 + size, at + 8 + size, False
            continue
        if decoder is None:
            decoder = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
        first, frame, parts, start = False, decoder.decompressobj(), [], at
        try:
            while not frame.eof:
                if not have(1):
                    yield start, None, "the frame is cut off"
                    return
                part = held[pos : pos + STEP]
                parts.append(frame.decompress(part))
                done = len(part) - (len(frame.unused_data) if frame.eof else 0)
                pos, at = pos + done, at + done
        except zstandard.ZstdError as e:
            yield start, None, f"frame: {e}"
            return
        yield start, b"".join(parts), None


def sample_dictionary(pages: DataFrame, samples: int = SAMPLE_PAGES, size: int = DICTIONARY) -> bytes:
    """A dictionary trained on `samples` records at most of pages within SAMPLE_BYTES, those of the least hashes; empty if
    they are too few to train on. Only this many pages go to the driver; texts that repeat count once.
    """
    import zstandard

    html = F.col("html").cast("string")
    short = pages.where((F.octet_length(html) <= SAMPLE_BYTES) & (F.length(html) > 0)).select(F.xxhash64(html).alias("h"), html.alias("html"))
    parts = [record_bytes(0, None, r["html"].encode("utf-8", "surrogatepass")) for r in short.groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(samples).collect()]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, parts)) // 8), parts).as_bytes() if len(parts) >= 8 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def with_roles(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, payload (binary), refers_to, revisit: which rows hold their payload and which point at another page.

    Payloads are equal if length and SHA-256 are. Only the digests of payloads that more than one row has are joined: as
    a broadcast within its bound, else dealt out in slices, so a payload of a third of all rows meets no single task.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(html, "UTF-8").alias("payload"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2("payload", 256))).withColumn("_bytes", F.octet_length("payload"))
    keep = Scratch(pages.sparkSession)
    several = rows.where(F.col("_bytes") >= min_payload).groupBy("_digest", "_bytes").agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_first")).where("_n > 1")
    several = keep(several, "payloads")
    n, total = several.agg(F.count(F.lit(1)), F.sum("_n")).first()
    known = several.select("_digest", "_bytes", "_first")
    if fits_broadcast(n, 64):
        met = rows.join(F.broadcast(known), ["_digest", "_bytes"], "left")
    else:
        met = split_join(rows, known, ["_digest", "_bytes"], total, "left", counts=several.select("_digest", "_bytes", "_n"))
    revisit = F.coalesce(F.col("page_id") < F.col("_first"), F.col("page_id").isNull() & F.col("_first").isNotNull())
    return met.select("page_id", "url", "payload", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, dictionary: bytes | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record a row of pages and returns the manifest: file, records, bytes. The files are whole when it returns.

    A task writes its rows as they come, beginning another file once file_bytes are reached, under names of its own, and
    hands on the names of what it finished. A failing task deletes its files; those of a lost one are in no manifest and
    never read.
    """
    known = sample_dictionary(pages) if dictionary is None else dictionary

    def write(batches):
        import pyarrow as pa

        store = sink = None
        rows = []
        try:
            for batch in by_bytes(batches, column=2, limit=4_000_000):
                for record in map(record_bytes, *(c.to_pylist() for c in batch.columns)):
                    if sink is None:
                        store, root = _store(path)
                        store.create_dir(root, recursive=True)
                        name = f"pages-{uuid.uuid4().hex}.warc.zst"
                        sink = store.open_output_stream(f"{root}/{name}", compression=None)  # the name must not make the store compress
                        archive = ArchiveWriter(sink, known)
                    archive.add(record)
                    if archive.at >= file_bytes:
                        sink.close()
                        rows.append((name, archive.records, archive.at))
                        sink = None
            if sink is not None:
                sink.close()
                rows.append((name, archive.records, archive.at))
        except BaseException:
            for name in [*(r[0] for r in rows), *([name] if sink is not None else [])]:
                store.delete_file(f"{root}/{name}")
            raise
        kind = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], schema=kind)

    with small_batches(pages.sparkSession):
        return Scratch(pages.sparkSession)(with_roles(pages, min_payload).mapInArrow(write, "file string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, path: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The columns of RECORDS for every record of the manifest's files; `fault` says what is wrong with a record, or how
    many a file lacks, and is null for good ones. payloads: whether to hand on the payloads, once they are checked.

    A file is read as a stream by one task: it is as long as its writer's file_bytes at most.
    """
    import pyarrow as pa

    kind = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("fault", pa.string())])

    def records(store, root, file, count):
        found = 0
        with store.open_input_stream(f"{root}/{file}", compression=None) as source:
            for offset, raw, fault in read_frames(source):
                row = {"file": file, "offset": offset, "fault": fault}
                if fault is None:
                    found += 1
                    try:
                        row |= parse_record(raw)
                    except (BadRecord, UnicodeDecodeError) as e:
                        row["fault"] = str(e)[:200]
                yield row
        if found != count:
            yield {"file": file, "offset": None, "fault": f"{found} records, {count} written"}

    def read(batches):
        for batch in batches:
            held, weight = [], 0
            store, root = _store(path)
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in records(store, root, name, count):
                    weight += len(row.get("payload") or b"") if payloads else 0
                    held.append(row if payloads else row | {"payload": None})
                    if weight > 4_000_000 or len(held) == 4096:
                        yield pa.RecordBatch.from_pylist(held, schema=kind)
                        held, weight = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=kind)

    n, size = manifest.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    parts = max(1, min(n, int(np.ceil((size or 0) / 8_000_000))))
    return manifest.select("file", "records").repartition(parts, "file").mapInArrow(read, RECORDS)


def dangling(records: DataFrame) -> DataFrame:
    """Revisits whose page and payload no response of the records has; pages with many revisits are dealt out."""
    held = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct().withColumn("_held", F.lit(True))
    again = records.where("record_type = 'revisit'")
    named = again.where(F.col("refers_to").isNotNull())
    met = split_join(named, held, ["refers_to", "payload_digest"], named.count(), "left").where(F.col("_held").isNull()).drop("_held")
    without = again.where(F.col("refers_to").isNull()).join(held.where(F.col("refers_to").isNull()).select("payload_digest"), "payload_digest", "left_anti")
    return met.select(records.columns).unionByName(without.select(records.columns))


def warc_roundtrip(pages: DataFrame, path: str | None = None, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back.

    A null html is an empty payload; payloads are whole, however long. Of equal payloads of min_payload bytes or more the
    rows of the largest page_id are responses (all of them, if the id is repeated), null ids being the least: they
    revisit, and where no row of a payload has an id all are responses. An empty table gives no rows and no files; other
    columns are not read. A record that fails a check on reading stops the query.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    found = read_archives(spark, path, write_archives(pages, path, min_payload), payloads=False)
    good = F.when(F.col("fault").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat_ws(": ", "file", "fault")).cast("long"))
    return found.select(good.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS first FROM p
), bits AS (
  SELECT page_id, payload_bytes, first, hex, list_transform(range(0, 40, 5), lambda k: CAST('0x' || substr(hex, CAST(k AS INT) + 1, 5) AS BIGINT)) AS words FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((words[CAST(k // 4 AS INT) + 1] >> CAST(15 - 5 * (k % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM bits
"""
