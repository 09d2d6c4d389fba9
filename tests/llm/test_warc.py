import base64
import hashlib
import io
import struct

import pytest
import zstandard

from stratal.llm import warc as W

ROWS = [
    (1, "http://a/1", "<p>same</p>"), (7, "http://a/7", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "http://b/\r\nWARC-Type: x", "WARC/1.1\r\n\r\nTitle é\U0001f600\r\n\r\n"),
    (4, " spaced ", ""), (5, "", None), (7, "http://a/7", "<p>same</p>"), (None, "http://n", "<p>same</p>"), (None, "u", "only here"), (None, "u", "only here"),
    (11, "http://long", "<div>" + "long text \n" * 60_000), (12, "http://c/\u2028", "x" * 3_000), (7, "http://a/7", "another one of the same id"),
]


def brute(rows, least):
    first, out = {}, []
    for page, _, html in rows:
        key = html or ""
        first[key] = max(first.get(key, -1), -1 if page is None else page)
    for page, _, html in rows:
        payload = (html or "").encode()
        to = first[html or ""]
        again = len(payload) >= least and (-1 if page is None else page) < to
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "'x' AS revisit", "2 AS _digest").repartition(3)


@pytest.mark.parametrize("least", [0, 12])
def test_roundtrip_equals_brute_force(pages, least):
    assert sorted(map(tuple, W.warc_roundtrip(pages, min_payload=least).collect()), key=str) == brute(ROWS, least)


def test_payloads_and_addresses_survive(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    manifest = W.write_archives(pages, path, file_bytes=500)
    found = W.read_archives(spark, path, manifest)
    rows = found.collect()
    assert manifest.count() > 3 and all(r["fault"] is None for r in rows) and W.dangling(found).count() == 0
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in rows if r["record_type"] == "response"} == {(p, h or "") for p, _, h in ROWS if (h or "") not in ("<p>same</p>", "") or (p, h or "") in ((7, "<p>same</p>"), (5, ""))}
    assert {r["url"] for r in rows} == {None, "http://a/1", "http://a/7", "http://b/%0D%0AWARC-Type: x", "%20spaced%20", "", "http://n", "u", "http://long", "http://c/%E2%80%A8"}
    for name in {r["file"] for r in rows}:  # what lies there is the format itself
        raw = (tmp_path / "w" / name).read_bytes()
        assert struct.unpack_from("<I", raw)[0] == W.SKIPPABLE and all(x[2] is None for x in W.read_frames(io.BytesIO(raw)))
    short = [r for r in rows if r["page_id"] != 7]
    assert W.dangling(spark.createDataFrame(short, found.schema)).count() == 3


def test_hot_payloads_are_joined_in_slices(spark, monkeypatch):
    rows = [(k, "u", "hot" if k % 3 else f"own {k}") for k in range(1_500)]
    monkeypatch.setattr(W, "fits_broadcast", lambda *_: False)
    got = W.warc_roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 0)


def test_empty_table(spark):
    assert W.warc_roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def archive(records, dictionary=b""):
    sink = io.BytesIO()
    writer = W.ArchiveWriter(sink, dictionary)
    return [writer.add(r) for r in records], sink.getvalue()


def dictionary():
    return zstandard.train_dictionary(2_000, [W.record_bytes(k, f"http://host/{k}", f"<html><p>page {k} of many</p></html>".encode() * 3) for k in range(200)]).as_bytes()


def test_dictionary_leads_and_every_record_is_a_frame_of_its_own():
    known = dictionary()
    records = [W.record_bytes(k, f"http://host/{k}", f"<html><p>page {k}</p></html>".encode()) for k in range(5)]
    starts, raw = archive(records, known)
    magic, size = struct.unpack_from("<II", raw)
    assert magic == W.SKIPPABLE and zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size], max_output_size=1 << 20) == known and starts[0] == 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known))
    for a, b, want in zip(starts, [*starts[1:], len(raw)], records, strict=True):
        assert reader.decompress(raw[a:b]) == want
    assert list(W.read_frames(io.BytesIO(raw))) == [(a, r, None) for a, r in zip(starts, records, strict=True)]
    plain = struct.pack("<II", W.SKIPPABLE, len(known)) + known + raw[8 + size :]
    assert [x[1] for x in W.read_frames(io.BytesIO(plain))] == records
    middle = raw[: starts[1]] + struct.pack("<II", W.SKIPPABLE - 3, 5) + b"notes" + raw[starts[1] :]
    assert [x[1] for x in W.read_frames(io.BytesIO(middle))] == records


@pytest.mark.parametrize("step", [1, 7, 1 << 14])
def test_frames_are_found_however_the_stream_is_cut(monkeypatch, step):
    monkeypatch.setattr(W, "STEP", step)
    monkeypatch.setattr(W, "CHUNK", 50)
    records = [W.record_bytes(k, None, b"x" * k) for k in range(4)]
    _, raw = archive(records, dictionary())
    assert [x[1] for x in W.read_frames(io.BytesIO(raw))] == records


def test_broken_archives_are_reported():
    records = [W.record_bytes(k, None, b"text %d" % k) for k in range(3)]
    starts, raw = archive(records, dictionary())
    cut = list(W.read_frames(io.BytesIO(raw[:-3])))
    assert [x[1] for x in cut[:2]] == records[:2] and cut[2][2] == "the frame is cut off"
    bad = bytearray(raw)
    bad[starts[1] + 12] ^= 255
    got = list(W.read_frames(io.BytesIO(bytes(bad))))
    assert got[0][1] == records[0] and got[1][2].startswith("frame") and len(got) == 2
    assert [x[2] for x in W.read_frames(io.BytesIO(raw[:20]))] == ["a skippable frame is cut off"]
    assert [x[2] for x in W.read_frames(io.BytesIO(b"abc"))] == ["shorter than a frame"]
    assert list(W.read_frames(io.BytesIO(b""))) == []


GOOD = W.record_bytes(5, "http://a", b"hello")
AGAIN = W.record_bytes(5, "http://a", b"hello", refers_to=9, revisit=True)


@pytest.mark.parametrize(
    ("raw", "why"),
    [
        (GOOD.replace(b"WARC/1.1", b"WARC/9.9"), "version"), (GOOD[:-2], "content-length"), (GOOD + b"x", "content-length"), (GOOD[:-4] + b"abcd", "two line ends"),
        (GOOD.replace(b"WARC-Date: ", b"WARC-Type: "), "repeated"), (GOOD.replace(b"WARC-Date", b"WARC-Other"), "warc-date is missing"), (GOOD.replace(b"hello\r", b"hullo\r"), "block digest"),
        (GOOD.replace(b"WARC-Type: response", b"WARC-Type: answered"), "type"), (b"WARC/1.1\r\nno end", "no end"), (GOOD.replace(b"WARC-Date: ", b"WARC-Date "), "is missing"),
        (GOOD.replace(b"\r\nWARC-Date: ", b"\r\nnocolon\r\nWARC-Date: "), "header line"), (AGAIN.replace(b"WARC-Profile", b"WARC-Profit"), "profile"), (AGAIN.replace(b"WARC-Refers-To", b"WARC-Ref"), "names no page"),
    ],
)
def test_faults_of_records(raw, why):
    with pytest.raises(W.BadRecord, match=why):
        W.parse_record(raw)


def test_records_parse():
    assert W.parse_record(GOOD) == {"url": "http://a", "record_type": "response", "page_id": 5, "refers_to": None, "payload": b"hello", "payload_bytes": 5, "payload_digest": W.digest32(b"hello")}
    assert W.parse_record(AGAIN)["refers_to"] == 9 and W.parse_record(AGAIN)["payload_bytes"] == 5
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: d\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert W.parse_record(info)["page_id"] is None


def test_a_bad_record_stops_the_query(spark, tmp_path):
    (tmp_path / "x.warc.zst").write_bytes(archive([GOOD, GOOD[:-1]])[1])
    manifest = spark.createDataFrame([("x.warc.zst", 3, 10)], "file string, records long, bytes long")
    faults = [r["fault"] for r in W.read_archives(spark, f"file://{tmp_path}", manifest).collect()]
    assert faults[0] is None and "content-length" in faults[1] and faults[2] == "2 records, 3 written"
