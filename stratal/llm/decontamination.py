"""Benchmark decontamination by greedy string tiling.

Words are lower-cased and stripped of surrounding punctuation. The seeds are the windows of `min_match` words of the
benchmark items, by their running Karp-Rabin hash: a table. A bitmap of the seeds, of bounded size, tells which
documents may hold one. An item is indexed by its rarer seeds only: those without which the rest covers too little of it.
The documents' windows are joined with this index, which gives pairs; those that share enough tokens for the coverage
are tiled: the longest match of unmarked words is marked,
what is left of those that overlap it stays in the race, and so on until no match of `min_match` unmarked words is
left. The marked share of the item is the coverage, wherever in the document and in whatever order its parts stand.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratal.llm.common import WordHashes, by_bytes, fits_broadcast, mix64, process_cache, remove, split_join, texts_of, written

MIN_MATCH = 5
MIN_COVERAGE = 0.5
MAX_BITS = 26  # of the bitmap: 8 MB at most
PROBES = 4  # bits of a seed in it
MATCHES = 200_000  # seed matches of a pair that are held at once; beyond, matches are found row by row
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
EDGES = bytes(c for c in range(33, 128) if not chr(c).isalnum())


class CoreHashes(WordHashes):
    """Hash of a word without its edges; 0 for one that is nothing else."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        core = word.strip(EDGES)
        value = xxhash.xxh3_64_intdigest(core) or 1 if core else 0
        if len(self) < self.BOUND and len(word) <= 64:
            self[word] = value
        return value


def normal_words(text: str, memo: dict) -> np.ndarray:
    words = text.lower().encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(memo.__getitem__, words), dtype=_U, count=len(words))
    return h[h != 0]


def karp_rabin(h: np.ndarray, width: int) -> np.ndarray:
    """The polynomial hash modulo 2**64 of every window of `width` words, spread over all bits."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    out = h[:n].copy()
    for j in range(1, width):
        out *= _U(_BASE)
        out += h[j : j + n]
    return mix64(out + _U(width))


def greedy_tiles(matches: list[tuple[int, int, int]], min_match: int) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (length, item position, text position): longest first, then the earliest in the item and the text."""
    queue = [(-n, i, t) for n, i, t in matches]
    heapq.heapify(queue)
    item_marked: set[int] = set()
    text_marked: set[int] = set()
    tiles = []
    while queue:
        n, i, t = heapq.heappop(queue)
        n = -n
        free = [k for k in range(n) if i + k not in item_marked and t + k not in text_marked]
        if len(free) == n:
            tiles.append((n, i, t))
            item_marked.update(range(i, i + n))
            text_marked.update(range(t, t + n))
            continue
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= min_match:
                    heapq.heappush(queue, (-(k - start), i + free[start], t + free[start]))
                start = k
    return tiles


def longest_match(item: np.ndarray, text: np.ndarray, item_free: np.ndarray, text_free: np.ndarray) -> tuple[int, int, int]:
    """The longest common run of unmarked words, the earliest in the item and the text; memory of a few texts."""
    best, before = (0, 0, 0), np.zeros(len(text) + 1, dtype=np.int32)
    for i in range(len(item)):
        now = np.zeros(len(text) + 1, dtype=np.int32)
        if item_free[i]:
            now[1:] = np.where(text_free & (text == item[i]), before[:-1] + 1, 0)
            end = int(now.argmax())
            n = int(now[end])
            if n > best[0]:
                best = (n, i - n + 1, end - n)
        before = now
    return best


def tiles_of(item: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (length, item position, text position) of the words of an item and a text.

    Few seed matches are held and merged along diagonals; where repeated words give more than MATCHES of them, each
    next tile is searched row by row, in memory linear in the text. Both ways give the same tiles.
    """
    width = min(min_match, len(item))
    if not width or len(text) < width:
        return []
    seeds, own = karp_rabin(item, width), karp_rabin(text, width)
    order = np.argsort(seeds, kind="stable")
    low, high = np.searchsorted(seeds[order], own, "left"), np.searchsorted(seeds[order], own, "right")
    n = high - low
    total = int(n.sum())
    if total > MATCHES:
        item_free, text_free, tiles = np.ones(len(item), dtype=bool), np.ones(len(text), dtype=bool), []
        while True:
            size, i, t = longest_match(item, text, item_free, text_free)
            if size < width:
                return tiles
            tiles.append((size, i, t))
            item_free[i : i + size] = False
            text_free[t : t + size] = False
    place = np.repeat(np.arange(len(own)), n)
    at = order[np.repeat(low, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)]
    rank = np.lexsort((at, place - at))
    place, at = place[rank], at[rank]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(place - at) != 0) | (np.diff(at) != 1)])) if total else np.empty(0, np.int64)
    runs = np.diff(np.append(starts, total))
    return greedy_tiles([(int(r) + width - 1, int(at[s]), int(place[s])) for s, r in zip(starts, runs, strict=True)], width)


def shared_words(item: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> int:
    """How many words of the item lie in windows that the text has too: no tiling covers more."""
    width = min(min_match, len(item))
    at = np.flatnonzero(np.isin(karp_rabin(item, width), karp_rabin(text, width)))
    return covered_words(at, width, len(item))


def covered_words(starts: np.ndarray, width: int, size: int) -> int:
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def needed_seeds(seeds: list[tuple[int, int, int]], size: int, width: int, least: float) -> list[int]:
    """The seeds to index, of (documents, seed, place in the item): all but those, the most frequent first, whose windows
    cover fewer than `least` words together."""
    places: dict[int, list[int]] = {}
    often: dict[int, int] = {}
    for n, h, at in seeds:
        places.setdefault(h, []).append(at)
        often[h] = n
    covered, count, kept = bytearray(size), 0, []
    for h in sorted(places, key=lambda h: (-often[h], h)):
        new = {w for at in places[h] for w in range(at, at + width) if not covered[w]}
        if count + len(new) < least:
            count += len(new)
            for w in new:
                covered[w] = 1
        else:
            kept.append(h)
    return kept


def benchmark_items(benchmark: DataFrame, min_match: int) -> tuple[DataFrame, str]:
    """item (a number of the row), item_id, words, width and seeds of every item with words, written."""

    def run(batches):
        import pyarrow as pa

        memo = process_cache("core_hashes", CoreHashes)
        for batch in by_bytes(batches):
            words = [normal_words(t, memo) for t in batch.column(1).to_pylist()]
            width = [min(min_match, len(w)) for w in words]
            seeds = [karp_rabin(w, k) if k else w for w, k in zip(words, width, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(words), pa.array(width, pa.int32()), _lists(seeds)], names=["item_id", "words", "width", "seeds"])

    rows = texts_of(benchmark, key="item_id").mapInArrow(run, "item_id long, words array<long>, width int, seeds array<long>")
    return written(rows.where("width > 0").withColumn("item", F.monotonically_increasing_id()), "items")


def _lists(arrays: list[np.ndarray]):
    import pyarrow as pa

    bounds = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.empty(0, dtype=_U), *arrays]).view(np.int64)))


def probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th of the places of a hash in the bitmap."""
    return (h * _U((_BASE * (2 * k + 1)) % 2**64)) >> _U(64 - bits)


class Finder:
    """The windows of a text that may be seeds, by the bitmap."""

    def __init__(self, widths: list[int], bits: int, places: np.ndarray, words: np.ndarray):
        self.widths, self.bits, self.places, self.words = widths, bits, places, words

    def bitmap(self) -> np.ndarray:
        out = np.zeros(1 << (self.bits - 6), dtype=_U)
        out[self.places] = self.words.view(_U)
        return out

    def hits(self, words: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
        """The different hashes of windows that the bitmap knows."""
        found = [np.empty(0, dtype=_U)]
        for width in self.widths:
            h = karp_rabin(words, width)
            for k in range(PROBES):
                bit = probe(h, k, self.bits)
                h = h[(bitmap[bit >> _U(6)] >> (bit & _U(63))) & _U(1) == 1]
            found.append(h)
        return np.unique(np.concatenate(found))


def finder_of(items: DataFrame, seeds: DataFrame) -> Finder:
    """64 bits a seed, 2**MAX_BITS at most: what the driver gathers and sends is bounded; a fuller bitmap only lets more windows through to the join."""
    different = seeds.select("h")
    bits = min(MAX_BITS, max(10, (64 * different.count()).bit_length()))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            h = batch.column(0).to_numpy().view(_U)
            bit = np.concatenate([probe(h, k, bits) for k in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((bit >> _U(6)).astype(np.int64)), pa.array((_U(1) << (bit & _U(63))).view(np.int64))], names=["place", "w"])

    rows = different.mapInArrow(place, "place long, w long").groupBy("place").agg(F.expr("bit_or(w)").alias("w")).toArrow()
    return Finder(widths, bits, rows.column("place").to_numpy(), rows.column("w").to_numpy())


SCHEMA = "doc_id long, item_id long, item_words int, covered_words int, coverage double, tiles array<struct<length:int,item_start:int,text_start:int>>"


class Search:
    """The search for the items of a benchmark in a table; `columns` of it travel with the documents that may hold one."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, min_match: int, min_coverage: float, columns: list[str]):
        self.docs, self.min_match, self.min_coverage = docs, min_match, min_coverage
        self.items, items_path = benchmark_items(benchmark, min_match)
        self.seeds, seeds_path = written(self.items.select(F.explode("seeds").alias("h")).distinct(), "seeds")
        self.paths = [items_path, seeds_path]
        self.finder = finder_of(self.items, self.seeds)
        self.suspects, path = written(self._suspects(columns), "suspects")
        self.paths.append(path)

    def _suspects(self, columns: list[str]) -> DataFrame:
        """The columns of the documents that may hold a seed, their words and hits, and a number of the row."""
        docs, finder = self.docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns))), self.finder
        rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[1:])

        def run(batches):
            import pyarrow as pa

            memo, bitmap = process_cache("core_hashes", CoreHashes), finder.bitmap()
            for batch in by_bytes(batches, column=0, limit=4_000_000):
                words = [normal_words(t, memo) for t in batch.column(0).to_pylist()]
                hits = [finder.hits(w, bitmap) for w in words]
                some = [k for k, h in enumerate(hits) if len(h)]
                if some:
                    kept = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([*kept.columns[1:], _lists([words[k] for k in some]), _lists([hits[k] for k in some])], names=[*kept.schema.names[1:], "words", "hits"])

        found = docs.mapInArrow(run, f"{rest}, words array<long>, hits array<long>")
        return found.withColumn("row", F.monotonically_increasing_id())

    def clean(self) -> DataFrame:
        """The rows without any hit, all columns, without a shuffle."""
        column, finder = self.docs.columns.index("text"), self.finder

        def run(batches):
            import pyarrow as pa

            memo, bitmap = process_cache("core_hashes", CoreHashes), finder.bitmap()
            for batch in by_bytes(batches, column=column, limit=4_000_000):
                yield batch.filter(pa.array([not len(finder.hits(normal_words(t or "", memo), bitmap)) for t in batch.column(column).to_pylist()], pa.bool_()))

        return self.docs.mapInArrow(run, self.docs.schema)

    def indexed(self, counts: DataFrame) -> DataFrame:
        """h, item: the seeds of each item without which no document can cover it.

        An item's most frequent seeds (counts: h, _n by documents) are left out as long as all of their windows together
        cover less of it than the coverage: a document that shares nothing else is no result. So an opening that many
        items and documents have in common pairs none of them.
        """
        places = self.items.select("item", F.size("words").alias("size"), "width", F.posexplode("seeds").alias("at", "h"))
        total = self.items.agg(F.sum(F.size("seeds"))).first()[0] or 0
        known = split_join(places, counts, ["h"], total)  # what no document has needs no place in an index
        rows = known.groupBy("item", "size", "width").agg(F.collect_list(F.struct("_n", "h", "at")).alias("seeds"))
        coverage = self.min_coverage

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                out = []
                for item, size, width, seeds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out += [{"item": item, "h": h} for h in needed_seeds([(x["_n"], x["h"], x["at"]) for x in seeds], size, width, coverage * size)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("item", pa.int64()), ("h", pa.int64())]))

        return rows.mapInArrow(run, "item long, h long")

    def pairs(self) -> DataFrame:
        """row, item of every document and item that share a seed which the item is indexed by.

        A seed that stands in very many documents is dealt over tasks.
        """
        hits = self.suspects.select("row", F.explode("hits").alias("h"))
        total = self.suspects.agg(F.sum(F.size("hits")).alias("n")).first()["n"] or 0
        real = hits.join(self.seeds, "h", "left_semi")  # the bitmap lets others through
        counts, path = written(real.groupBy("h").agg(F.count(F.lit(1)).alias("_n")), "seed-counts")
        index, path2 = written(self.indexed(counts), "index")
        self.paths += [path, path2]
        return split_join(hits, index, ["h"], total, counts=counts).select("row", "item").distinct()

    def tiled(self, doc_id: str) -> DataFrame:
        """row and the columns of SCHEMA (the id from that column of the suspects) of the pairs that reach the coverage."""
        pairs, path = written(self.pairs(), "pairs")
        self.paths.append(path)
        total = pairs.count()
        with_item = split_join(pairs, self.items.select("item", "item_id", F.col("words").alias("item_words")), ["item"], total)
        suspects = self.suspects
        if fits_broadcast(total, 8):  # the words of the others stay where they are
            suspects = suspects.join(F.broadcast(pairs.select("row").distinct()), "row", "left_semi")
        both = with_item.join(suspects.select("row", F.expr(doc_id).cast("long").alias("doc_id"), "words"), "row").select("row", "doc_id", "item_id", "item_words", "words")
        least, coverage = self.min_match, self.min_coverage

        def run(batches):
            import pyarrow as pa

            kind = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("covered_words", pa.int32()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("length", pa.int32()), ("item_start", pa.int32()), ("text_start", pa.int32())])))])
            for batch in batches:
                rows = []
                for k in range(batch.num_rows):
                    item, text = (batch.column(c)[k].values.to_numpy() for c in (3, 4))
                    if shared_words(item.view(_U), text.view(_U), least) < coverage * len(item):
                        continue
                    tiles = tiles_of(item.view(_U), text.view(_U), least)
                    covered = sum(t[0] for t in tiles)
                    if covered >= coverage * len(item):
                        rows.append({"row": batch.column(0)[k].as_py(), "doc_id": batch.column(1)[k].as_py(), "item_id": batch.column(2)[k].as_py(), "item_words": len(item), "covered_words": covered, "coverage": covered / len(item), "tiles": [dict(zip(("length", "item_start", "text_start"), t, strict=True)) for t in tiles]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

        return both.mapInArrow(run, f"row long, {SCHEMA}")


def tile(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each document and item whose coverage reaches min_coverage, with the tiles.

    An item shorter than min_match words must stand in the document as a whole; one without words and null texts on
    either side match nothing. Null ids stay null; repeated rows on either side give repeated results; repeated words
    cost time, not memory; texts are read whole; an empty table on either side gives none; other columns are not read.
    """
    search = Search(docs, benchmark, min_match, min_coverage, ["doc_id"])
    out, _ = written(search.tiled("c0").drop("row"), "tiles")
    remove(docs.sparkSession, *search.paths)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose text covers no item by min_coverage.

    Rows without a text stay; repeated rows meet one fate each. Documents without a seed are passed on as they are
    read; only those with one are written and judged.
    """
    columns = docs.columns
    search = Search(docs, benchmark, min_match, min_coverage, columns)
    flagged, _ = written(search.tiled("NULL").select("row").distinct(), "flagged")
    judged = search.suspects.join(flagged, "row", "left_anti").select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)))
    return search.clean().unionByName(judged)
