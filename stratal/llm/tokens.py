"""Ids of whole texts by a public byte-level BPE file, through the tokenizers library."""

from __future__ import annotations

from itertools import filterfalse

END_ID = 2
MEMO_PIECES = 800_000  # about 200 bytes each in a worker; fewer cost time
LONGEST_PIECE = 48
OTHER_SPACE = tuple(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")
TAILS = ".,;:!?*$%#&|"  # after a letter or digit, a run of these is a pre-token of its own


def single_spaced(text: str) -> bool:
    """Whether all white space of a text, which is not empty, is single spaces and line feeds between words."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        return False
    return not any(c in text for c in OTHER_SPACE)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def check_kind(described: str, path: str) -> None:
    """Refuses a tokenizer that cuts or spells texts in another way than PieceEncoder counts on."""
    import json

    kind = json.loads(described)
    cutter, model = kind.get("pre_tokenizer") or {}, kind.get("model") or {}
    plain = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    if kind.get("normalizer") or kind.get("truncation") or kind.get("padding") or not plain or not merges:
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer without normaliser")


class PieceEncoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes.

    Byte-level BPE never merges across pre-tokens, and one always starts at a space or line feed that stands
    alone between two words. So a text whose white space is only such single ones is the sequence of its
    space-separated pieces, and each distinct piece goes through the tokenizers library once and is then
    remembered (up to a bound). Every other text goes through the library as a whole, as does one that names a special
    token where special_tokens is set. The ids are the library's: with special_tokens, its default, the name of a special
    token in a text becomes its id; without, it is ordinary text.
    """

    def __init__(self, path: str, bound: int = MEMO_PIECES, special_tokens: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        check_kind(self.tokenizer.to_str(), path)
        self.tokenizer.encode_special_tokens = not special_tokens
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.names = [t.content for t in added if special_tokens or not t.special]
        # a byte-level vocabulary spells the bytes that don't print as characters from 256 on
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.characters = {b: 256 + k for k, b in enumerate(odd)}
        self.space = chr(self.characters[32])
        self.bound = bound
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.later: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        from array import array

        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """The pieces after a space each, in one call: a line feed between them is a token of its own and nothing else holds one."""
        import numpy as np

        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(" " + p for p in pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.append(np.flatnonzero(ids == self.line_feed), len(ids)) * 4
        raw, out, start = ids.tobytes(), [], 0
        for end in ends.tolist():
            out.append(raw[start:end])
            start = end + 4
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Words of letters only, after a space each: every one is a pre-token, so the model itself takes it, bytes as its characters."""
        from array import array

        merge, table = self.tokenizer.model.tokenize, self.characters
        spelt = [w if w.isascii() else w.encode().decode("latin-1").translate(table) for w in words]
        return [array("I", [t.id for t in merge(self.space + w)]).tobytes() for w in spelt]

    def _learn(self, pieces: set[str]) -> list[str]:
        """Adds pieces that follow a space or are led by a line feed; returns those to forget after this batch."""
        memo = self.later
        missing = pieces.difference(memo) if memo else pieces
        room = self.bound - len(memo)
        new, whole, tailed = [], [], []
        for p in missing:
            core = p.rstrip(TAILS)
            if p[:1] == "\n" or not p:
                whole.append(p)
            elif len(core) == len(p) or not core[-1:].isalnum():
                new.append(p)
            else:
                tailed.append((p, core))
        cores = {c for _, c in tailed if c not in memo}.difference(new)
        new.extend(cores)
        words = [p for p in new if p.isalpha()]
        memo.update(zip(words, self._words(words), strict=True))
        other = [p for p in new if not p.isalpha()]
        for k in range(0, len(other), 2_000):
            memo.update(zip(part := other[k : k + 2_000], self._joined(part), strict=True))
        memo.update(zip(whole, self._library([p or " " for p in whole]), strict=True))
        ends = [*{p[len(c) :] for p, c in tailed}]
        end = dict(zip(ends, self._library(ends), strict=True))
        for p, c in tailed:
            memo[p] = memo[c] + end[p[len(c) :]]
        added = missing | cores
        return [p for k, p in enumerate(added) if k >= room or len(p) > LONGEST_PIECE]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, str, list[str]]] = []
        whole: list[int] = []
        for k, text in enumerate(texts):
            if not text:
                continue
            if single_spaced(text) and not any(n in text for n in self.names):
                pieces = text.replace("\n", " \n").split(" ")
                cut.append((k, pieces.pop(0), pieces))
            else:
                whole.append(k)
        missing: set[str] = set()
        for _, _, pieces in cut:
            missing.update(filterfalse(self.later.__contains__, pieces))
        forget = self._learn(missing)
        get = self.later.__getitem__
        for (k, _, pieces), head in zip(cut, self._library([h for _, h, _ in cut]), strict=True):
            out[k] = head + b"".join(map(get, pieces))
        for p in forget:
            del self.later[p]
        for k, ids in zip(whole, self._library([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out


def encoder(path: str, bound: int = MEMO_PIECES, special_tokens: bool = True) -> PieceEncoder:
    import os

    from stratal.llm.common import process_cache

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task is Spark's to give
    return process_cache(f"encoder_{bound}_{special_tokens}_{abs(hash(path))}", lambda: PieceEncoder(path, bound, special_tokens))
