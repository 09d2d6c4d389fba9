import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from stratal.llm import packing as P
from stratal.llm import token_output as O
from stratal.llm.tokens import PieceEncoder, default_tokenizer, single_spaced

ODD = ["a  b", "a\n\nb", "a \nb ", " a", "a\n", "\n", "  ", "a\tb", "don't x, foo.*? b9!! 's.", "<|endoftext|> z", "", "é　b", "a\x1cb", "x" * 300 + " y", "a\n b", "über straße. Ähm!!", "a\r\nb c", "it's we'll 'tis", "𝔘𝔫 中文 字", "9th 10 a1b2"]


LIBRARY = Tokenizer.from_file(default_tokenizer())


def ids_of(text):
    return [*LIBRARY.encode(text, add_special_tokens=False).ids, 2]


def test_pieces_equal_the_library():
    rng = random.Random(4)
    alphabet = ["a", "B", "é", " ", " ", "\n", "'", ".", "*", "9", "\t", "  ", "word", "ß", "s"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    enc = PieceEncoder(default_tokenizer())
    for _ in range(2):  # the second time from memory
        assert enc.encode(texts) == [np.array(ids_of(t)[:-1], dtype="<u4").tobytes() for t in texts]


def test_single_spaced_texts_are_those_that_words_make_up():
    rng = random.Random(5)
    for _ in range(3_000):
        text = "".join(rng.choices(["a", "bc", " ", "\n", "\t", "\xa0", "\x1c", "\u3000", "é"], [6, 6, 5, 2, 0.2, 0.2, 0.2, 0.2, 2], k=rng.randrange(1, 9)))
        pieces = text.replace("\n", " \n").split(" ")
        assert single_spaced(text) == (len(pieces) == len(text.split()) and not any(c.isspace() and c not in " \n" for c in text))


@pytest.mark.parametrize("special", [True, False])
def test_names_of_special_tokens_are_as_the_library_has_them(special):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer())
    library.encode_special_tokens = not special
    texts = ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|>\n<|endoftext|> ", "no <|endof text|>", "<|endoftext|", "tail<|endoftext|>."]
    enc = PieceEncoder(default_tokenizer(), special_tokens=special)
    for _ in range(2):
        assert enc.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert (enc.encode(texts[:1])[0] == np.array([31373, 220, 50256, 2124], dtype="<u4").tobytes()) == special


def test_memory_of_pieces_is_bounded():
    enc = PieceEncoder(default_tokenizer(), 50)
    texts = [f"word{k} other{k}, third" for k in range(500)]
    assert enc.encode(texts) == [np.array(ids_of(t)[:-1], dtype="<u4").tobytes() for t in texts]
    assert len(enc.later) <= 50


@pytest.mark.parametrize("values", [[0], [5] * 128, list(range(129)), [7, 2**32 - 1, 0] * 50, [3] * 127 + [2**31]])
def test_segment_round_trip(values):
    v = np.array(values, dtype=np.uint32)
    index, runs = O.encode_segment(v)
    back = O.decode_segment(index["minima"], index["widths"], index["starts"], *(np.frombuffer(r, dtype=k) for r, k in zip(runs, ("<u8", "<u4", "<u4"), strict=True)))
    assert back[: len(v)].tolist() == values


def test_shard_round_trip_over_segments(monkeypatch):
    monkeypatch.setattr(O, "SEGMENT", 4 * O.BLOCK)
    rng = np.random.default_rng(1)
    docs = [(None if k == 0 else k, rng.integers(0, 50257 if k % 7 else 2**32, int(rng.integers(0, 900)), dtype=np.uint64).astype("<u4")) for k in range(60)]
    sink = io.BytesIO()
    writer = O.ShardWriter(sink)
    for doc_id, ids in docs:
        writer.add(doc_id, ids.tobytes())
    writer.close()
    got, start = list(O.read_shard(sink, len(sink.getvalue()))), 0
    assert len(got) == len(docs)
    for (doc_id, ids), (d, s, i) in zip(docs, got, strict=True):
        assert (d, s, i.tolist()) == (doc_id, start, ids.tolist())
        start += len(ids)


def _docs(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["alpha", "beta,", "gamma.", "δ"]) for _ in range(rng.choice([1, 5, 60, 700, 1500])))) for k in range(40)]
    rows += [(100 + k, t) for k, t in enumerate(ODD)] + [(200, None), (201, "long " * 40_000), (None, "nobody"), (3, "again"), (3, "again")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS start", "1 AS ids_crc32", "2 AS part")


def test_token_output(spark):
    rows, docs = _docs(spark)
    out = O.ids_digest(O.token_output(docs.repartition(6))).collect()
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(text or "")
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    assert O.token_output(docs.limit(0)).count() == 0


def test_packing(spark):
    rows, docs = _docs(spark)
    out = P.pack(docs.repartition(5)).toPandas()
    by_id = {d: ids_of(t or "") for d, t in rows}
    for r in out.itertuples():
        if r.doc_id == r.doc_id and r.doc_id != 3:
            assert zlib.crc32(np.array(by_id[int(r.doc_id)][r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
    assert out["length"].sum() == sum(len(ids_of(t or "")) for _, t in rows)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 1024 and (s["offset"].to_numpy() == np.cumsum(s["length"]) - s["length"]).all()
    for doc_id, p in out.dropna(subset="doc_id").query("doc_id != 3").groupby("doc_id"):
        n, p = len(by_id[int(doc_id)]), p.sort_values("piece")
        assert p["piece"].tolist() == list(range(-(-n // 1024))) and (p["length"].to_numpy()[1:] == 1024).all()
    assert P.pack(docs.limit(0)).count() == 0
    with_ids = P.pack(docs.repartition(5), keep_ids=True)
    lengths = out.groupby("sequence_id")["length"].sum()
    got = {r["sequence_id"]: bytes(r["ids"]) for r in P.sequences(with_ids).collect()}
    assert sorted(len(x) // 4 for x in got.values()) == sorted(lengths) and sum(map(len, got.values())) == 4 * out["length"].sum()
    first = with_ids.where("doc_id = 1 AND piece = 0").first()
    assert got[first["sequence_id"]][4 * first["offset"] :].startswith(np.array(by_id[1][: first["length"]], dtype="<u4").tobytes())


def test_fullest_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        room = rng.randrange(1, 40)
        counts = [0] + [rng.choice([0, 0, 1, 2, 5]) for _ in range(room)]
        sums = {0}
        for length, n in enumerate(counts):
            for _ in range(n):
                sums |= {s + length for s in sums if s + length <= room}
        used = P.fullest(counts, room, room)
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


def test_plan_uses_every_piece_once_and_is_near_the_bound():
    rng = random.Random(5)
    lengths = {k: rng.randrange(0, 400) for k in range(1, 1025)}
    plan = P.minimum_bin_slack(lengths)
    used = {}
    for times, pattern in plan:
        assert sum(k * n for k, n in pattern.items()) <= 1024
        for k, n in pattern.items():
            used[k] = used.get(k, 0) + times * n
    assert used == {k: n for k, n in lengths.items() if n}
    # pieces over half a sequence need one each, whatever the method
    bound = max(-(-sum(k * n for k, n in lengths.items()) // 1024), sum(n for k, n in lengths.items() if k > 512))
    assert sum(t for t, _ in plan) <= bound * 1.01 + 1


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}])
def test_other_tokenizers_are_refused(change, tmp_path):
    import json

    small = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": None, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": {"a": 0, "\u010a": 1}, "merges": []}}
    from stratal.llm.tokens import PieceEncoder

    plain, other = tmp_path / "plain.json", tmp_path / "other.json"
    plain.write_text(json.dumps(small))
    other.write_text(json.dumps(small | change))
    PieceEncoder(str(plain))
    with pytest.raises(ValueError):
        PieceEncoder(str(other))
