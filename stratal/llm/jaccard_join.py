"""N-gram Jaccard join by the universe-partition pigeonhole, exact, and its connected components.

Two sets of sizes l and s link when 100 |r n s| >= 85 |r u s|, so they differ in at most H = 15 (l + s) / 185
shingles. For a band of sizes the universe of shingle hashes is cut into m ranges, the segments. Differences fall
into segments, so among any H + 1 segments one holds equal subsets, and among any (H + 1) / 2 segments one holds
subsets that differ in one shingle at most. Each band takes the cheaper of the two: equal subsets, or
equal-up-to-one-deletion (a subset and all its one-deletion neighbours are indexed).

A document skips segments with too few shingles to tell documents apart and goes on until it has indexed as many
good ones as the pigeonhole needs; both documents walk the segments in the same order, so where the first of the two
stops, the bound holds for the other as well. A document that runs out of segments indexes all of them.

Documents that index the same subset are candidates. Each group names one hub, and every member is paired with it.
Pairs that the sizes and parity sketches (which differ in no more bits than the sets in shingles) leave possible are
verified on the whole sets. Groups that still hold several components afterwards get the pairs across components,
under the same bounds and verification, as a grid of cells of bounded size.

The nodes are classes of equal sets, by their key, so documents without an id link like any other. A subset, hub or
class may own a third of all rows: every join on one deals its rows over tasks (common.split_join).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratal.llm.common import Scratch, fits_broadcast, by_bytes, hash_words, mix64, shingle_hashes, slice_size, split_join, word_hashes, written
from stratal.llm.components import components

WIDTH = 4
PERCENT = 85
GROWTH = 1.6  # of band edges
SHARED = 0.01  # assumed chance that another document of the band holds a given shingle, for the costs
BYTES_A_SHINGLE = 6  # about, to estimate how many sets there are of a size
SKETCH_WORDS = 16
CELL_ROWS = 1000  # a side, of the cells in which the rest of a group is compared
_U = np.uint64


class Bands:
    """Size bands and what each allots: segments, and how many good ones a document has to index."""

    def __init__(self, counts: dict[int, int], percent: int = PERCENT):
        """counts: documents by power of two of the set size, for the costs."""
        self.percent, self.total = percent, 100 + percent
        self.edges, self.deletion, self.segments = [1], [], []
        while self.edges[-1] < 2**40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * max(GROWTH, 101 / percent))))
        for low, high in zip(self.edges, self.edges[1:], strict=False):
            h = self.differences(high - 1, (high - 1) * 100 // percent)
            size, n = (low + high) / 2, counts.get(int(low).bit_length() - 1, 0)
            pairs = -(-(h + 1) // 2)
            equal = (h + 1) * (1 + n * SHARED ** (size / (h + 1)))
            deletion = size + pairs * (1 + n * SHARED ** max(1.0, size / pairs - 1))
            self.deletion.append(h <= 3 or deletion < equal)
            need = pairs if self.deletion[-1] else h + 1
            self.segments.append(need if h <= 3 else need + 1 + need // 8)
        self.edges = np.array(self.edges, dtype=np.int64)
        self.deletion, self.segments = np.array(self.deletion), np.array(self.segments, dtype=np.int64)

    def differences(self, a, b):
        return (100 - self.percent) * (a + b) // self.total

    def entries(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, band, good segments it must index) of every role; none where only equal sets can link."""
        band = np.searchsorted(self.edges, sizes, side="right") - 1
        own = self.differences(sizes, sizes * 100 // self.percent)
        below = np.maximum(band - 1, 0)
        top = self.edges[band] - 1  # the largest size of the band below
        larger = self.differences(sizes, np.minimum(sizes, top))
        reaches = (band > 0) & (100 * top >= self.percent * sizes)
        doc = np.concatenate([np.flatnonzero((sizes > 0) & (own > 0)), np.flatnonzero(reaches & (larger > 0))])
        n_own = int(((sizes > 0) & (own > 0)).sum())
        which = np.concatenate([band[doc[:n_own]], below[doc[n_own:]]])
        h = np.concatenate([own[doc[:n_own]], larger[doc[n_own:]]])
        return doc, which, np.where(self.deletion[which], -(-(h + 1) // 2), h + 1)


def sets_of(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; A-Z lower-cased, words between ASCII white space."""
    memo = word_hashes()
    return [np.unique(shingle_hashes(hash_words(t.encode("utf-8", "surrogatepass").lower().split(), memo), width)) for t in texts]


def class_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each set, as signed integers."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate([np.empty(0, dtype=_U), *sets])
    keys = []
    for salt in (_U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)):
        sums = np.zeros(len(sets), dtype=_U)
        if len(flat):
            some = np.flatnonzero(n)
            sums[some] = np.add.reduceat(mix64(flat ^ salt), (np.cumsum(n) - n)[some])
        keys.append(mix64(sums + n.astype(_U) * salt).view(np.int64))
    return keys[0], keys[1]


def parity_sketches(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Signed integers of each set: the parity of its shingles in each of their bits, the bins; two bins a shingle at least.

    A shingle in which two sets differ flips one bin, so the sketches differ in no more bins than the sets in shingles.
    The number of words is a power of two, and the halves of a sketch, combined by exclusive or, are the next smaller one.
    """
    out = []
    for s in sets:
        bins = 64 * max(SKETCH_WORDS, 1 << max(0, (len(s) - 1) // 32).bit_length())
        odd = np.bincount((mix64(s ^ _U(0xA0761D6478BD642F)) % _U(bins)).astype(np.int64), minlength=bins) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    return out


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of every indexed subset and neighbour."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    doc, band, need = bands.entries(sizes)
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m, length = bands.segments[band], sizes[doc]
    flat = np.concatenate([sets[d] for d in doc.tolist()])
    entry = np.repeat(np.arange(len(doc)), length)
    base = np.cumsum(m) - m
    segment = base[entry] + (((flat >> _U(32)) * m[entry].astype(_U)) >> _U(32)).astype(np.int64)
    total = int(m.sum())
    size = np.bincount(segment, minlength=total)
    spread = mix64(flat ^ _U(0x2545F4914F6CDD1D))
    sums = np.zeros(total, dtype=_U)
    held = np.flatnonzero(size)
    sums[held] = np.add.reduceat(spread, (np.cumsum(size) - size)[held])
    owner = np.repeat(np.arange(len(doc)), m)
    number = np.arange(total) - base[owner]
    home = mix64((band[owner].astype(_U) << _U(40)) + number.astype(_U))
    deletes = bands.deletion[band][owner]
    least = np.where(deletes, 3, 2)
    good = size >= least
    rank = np.cumsum(good)
    before = np.concatenate([[0], rank])[base]
    rank -= before[owner]  # good segments up to and with this one
    n_good = np.add.reduceat(good.astype(np.int64), base)
    short = (n_good < need)[owner]
    reached = (rank - good) < need[owner]
    take = short | (reached & (size >= least - deletes))
    chosen = np.flatnonzero(take)
    out_doc, out_sig = [owner[chosen]], [mix64(sums[chosen] + home[chosen])]
    neighbours = np.flatnonzero((take & deletes)[segment])
    if len(neighbours):
        s = segment[neighbours]
        out_doc.append(owner[s])
        out_sig.append(mix64(sums[s] - spread[neighbours] + home[s]))
    return doc[np.concatenate(out_doc)], np.concatenate(out_sig).view(np.int64)


def _indexed(docs: DataFrame, bands: Bands, width: int) -> DataFrame:
    """row, doc_id, n, class keys and signatures of every document; copies within a slice carry no signatures again."""

    def run(batches):
        import pyarrow as pa

        for batch in by_bytes(batches, column=2, limit=1_500_000):
            sets = sets_of(batch.column(2).to_pylist(), width)
            a, b = class_keys(sets)
            _, first = np.unique(a, return_index=True)
            which, sig = signatures([sets[k] for k in first.tolist()], bands)
            order = np.argsort(first[which], kind="stable")
            bounds = np.searchsorted(first[which][order], np.arange(len(sets) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), pa.ListArray.from_arrays(bounds, pa.array(sig[order]))], names=["row", "doc_id", "n", "c1", "c2", "sigs"])

    return docs.mapInArrow(run, "row long, doc_id long, n long, c1 long, c2 long, sigs array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in by_bytes(batches, limit=1_500_000):
            sets = sets_of(batch.column(1).to_pylist(), width)
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, dtype=_U), *sets]).view(np.int64)
            fine = parity_sketches(sets)
            small = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(flat)), pa.array(fine, small), pa.array([folded(x, SKETCH_WORDS) for x in fine], small)], names=["node", "n", "shingles", "fine", "sketch"])

    return docs.mapInArrow(run, "node long, n long, shingles array<long>, fine array<long>, sketch array<long>")


def _possible(words: list[str], percent: int):
    """What a link needs by the sizes n_a and n_b, the short sketches and the full ones, the larger of two folded."""
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    within = lambda apart: apart * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    short = sum((F.bit_count(F.col(w + "_a").bitwiseXOR(F.col(w + "_b"))) for w in words), F.lit(0))
    length = F.least(F.size("fine_a"), F.size("fine_b"))
    xor = lambda x, y: x.bitwiseXOR(y)
    same = lambda x: F.when(F.size(x) > length, F.zip_with(F.slice(x, F.lit(1), length), F.slice(x, length + 1, length), xor)).otherwise(F.col(x))
    full = F.aggregate(F.zip_with(same("fine_a"), same("fine_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return sizes & within(short) & within(full)


def _compared(pairs: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """a, b, i, u: the sizes of intersection and union of pairs of nodes, on the whole sets; a node with very many pairs is dealt over tasks."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    both = split_join(split_join(pairs, left, ["a"], total), right, ["b"], total, counts=pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_n")))
    shared = F.size(F.array_intersect("s", "t")).cast("long")
    return both.select("a", "b", "s", "t", shared.alias("i")).select("a", "b", "i", (F.size("s") + F.size("t") - F.col("i")).alias("u"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """a, b and whether they link."""
    return _compared(pairs, sets, total).select("a", "b", (100 * F.col("i") >= percent * F.col("u")).alias("linked"))


def _with_rows(docs: DataFrame) -> DataFrame:
    """row (a hash of id and text: rows that agree in both are one), doc_id, text (null as empty); no other column is read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(_row(), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _row() -> F.Column:
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row")


def _members(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """node, hub of every class of a group of classes that index the same subset."""
    index = classes.select(F.col("c1").alias("node"), F.explode("sigs").alias("sig"))
    shared = index.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("_n")).where("low <> high").select("sig", "_n")
    shared = scratch(shared, "shared")
    total = classes.agg(F.sum(F.size("sigs")).alias("n")).first()["n"] or 0
    if fits_broadcast(shared.count(), 8):
        grouped = index.join(F.broadcast(shared.select("sig")), "sig")
    else:
        grouped = split_join(index, shared.select("sig"), ["sig"], total, counts=shared)
    grouped = scratch(grouped.distinct(), "grouped")
    # a node that shares most of its subsets stands in the middle of its copies: the best hub of every group it is in
    score = grouped.groupBy("node").agg(F.count(F.lit(1)).alias("score"))
    hubs = grouped.join(score, "node").groupBy("sig").agg(F.max(F.struct("score", "node"))["node"].alias("hub"))
    return scratch(split_join(grouped, hubs, ["sig"], grouped.count()).select("node", "hub").distinct(), "members")


def _across(members: DataFrame, sized: DataFrame, linked: DataFrame, words: list[str], percent: int, scratch: Scratch) -> DataFrame:
    """a, b: possible pairs of different components that meet in a group, at least one of them outside the hub's component."""
    part = sized.select("node").join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    placed = scratch(members.join(part, "node"), "placed")
    total = placed.count()
    # those that are in the hub's component already need no look at each other, only at the rest
    main = placed.where("node = hub").select("hub", F.col("component").alias("main"))
    placed = scratch(split_join(placed, main, ["hub"], total).withColumn("apart", F.col("component") != F.col("main")), "apart")
    size = max(CELL_ROWS, slice_size(total))
    cells = lambda n: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    hubs = placed.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("apart").cast("long")).alias("s")).where("s > 0").select("hub", cells(F.col("s")).alias("rows"), cells(F.col("m")).alias("columns"))
    placed = split_join(placed, hubs, ["hub"], total)
    deal = lambda n: F.expr(f"CAST(pmod(xxhash64(node), {n}) AS INT)")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = placed.where("apart").withColumn("i", deal("rows")).withColumn("j", each("columns"))
    others = placed.withColumn("j", deal("columns")).withColumn("i", each("rows"))
    side = lambda df, end, *more: df.join(sized, "node").select("hub", "i", "j", *more, F.col("component").alias("component" + end), *(F.col(c).alias(c + end) for c in ("node", "n", "fine", *words)))
    unseen = (F.col("component_a") != F.col("component_b")) & (~F.col("apart") | (F.col("node_a") < F.col("node_b")))
    left, right = side(strays, "_a"), side(others, "_b", "apart")
    met = left.join(right, ["hub", "i", "j"]).where(unseen & _possible(words, percent))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _candidates(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (row, doc_id, n, c1, c2) of all documents, the representative (c1, c2, rep, row) of each class with words, the groups
    (node, hub) of classes that index the same subset, and the sets of their nodes."""
    if not 50 < percent < 100:
        raise ValueError("the similarity has to be between 51 and 99 percent: linked sizes may not differ by a factor of two")
    docs = _with_rows(docs)
    power = F.floor(F.log2(F.octet_length("text") / BYTES_A_SHINGLE)).cast("int")
    counts = {r["p"]: r["n"] for r in docs.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect() if r["p"] is not None}
    bands = Bands(counts, percent)
    classes = scratch(_indexed(docs, bands, width), "classes")
    members = _members(classes, scratch)

    rows = classes.drop("sigs")
    # the text of a class is that of its smallest id; of those without any, of its smallest row
    reps = scratch(rows.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("row")), "reps")
    wanted = reps.join(members.select("node").distinct(), F.col("c1") == F.col("node"), "left_semi").groupBy(F.col("c1").alias("node")).agg(F.min("row").alias("row"))
    wanted = scratch(wanted, "wanted")
    n_wanted, n_rows = wanted.count(), classes.count()
    by_row = rows.groupBy("row").agg(F.count(F.lit(1)).alias("_n"))
    texts = docs.join(F.broadcast(wanted), "row") if fits_broadcast(n_wanted, 16) else split_join(docs, wanted, ["row"], n_rows, counts=by_row)
    repeated = by_row.where("_n > 1").join(wanted, "row", "left_semi").select("row")
    sets = scratch(_sets(texts.select("node", "text"), width), "sets")
    if repeated.limit(1).count():
        sets = scratch(sets.dropDuplicates(["node"]), "sets")
    return rows, reps, members, sets


def _sized(sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """The sets without their shingles, the short sketch as columns, and the names of those."""
    words = [f"k{k}" for k in range(SKETCH_WORDS)]
    return scratch(sets.select("node", "n", "fine", *(F.col("sketch")[k].alias(w) for k, w in enumerate(words))), "sized"), words


def _classes(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, n, c1, c2) of all documents, and of every class (c1, c2) its component (a number) and the smallest doc_id in it."""
    rows, reps, members, sets = _candidates(docs, width, percent, scratch)
    sized, words = _sized(sets, scratch)
    side = lambda end: sized.select(*(F.col(c).alias(c + end) for c in ("node", "n", "fine", *words)))
    star = members.where("node <> hub").select(F.col("node").alias("node_a"), F.col("hub").alias("node_b"))
    star = split_join(star.join(side("_a"), "node_a"), side("_b"), ["node_b"], star.count(), counts=star.groupBy("node_b").agg(F.count(F.lit(1)).alias("_n")))
    star = scratch(star.where(_possible(words, percent)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "star")
    scores = scratch(_verified(star, sets, percent, star.count()), "scores")
    links = scores.where("linked").select("a", "b")
    linked, path = components(links)
    scratch.paths.append(path)

    known = scores.select("a", "b").unionByName(scores.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cross = scratch(_across(members, sized, linked, words, percent, scratch).join(known, ["a", "b"], "left_anti"), "cross")
    more = scratch(_verified(cross, sets, percent, cross.count()).where("linked").select("a", "b"), "more")
    if more.limit(1).count():
        linked, path = components(links.unionByName(more))
        scratch.paths.append(path)

    named = reps.join(linked.withColumnRenamed("node", "c1"), "c1", "left").select("c1", "c2", "rep", "component")
    joined = named.where("component IS NOT NULL")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    joined = split_join(joined, least, ["component"], joined.count()).select("c1", "c2", "component", "component_id")
    alone = named.where("component IS NULL").select("c1", "c2", F.col("c1").alias("component"), F.col("rep").alias("component_id"))
    return rows, scratch(joined.unionByName(alone), "named")


def _placed(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, Scratch]:
    """row, doc_id, n, component (null without words) and component_id of every document, written."""
    keep, scratch = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows, named = _classes(docs, width, percent, scratch)
    full = split_join(rows.where("n > 0"), named, ["c1", "c2"], rows.count()).select("row", "doc_id", "n", "component", "component_id")
    none = rows.where("n = 0").select("row", "doc_id", "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    out = keep(full.unionByName(none), "placed")
    scratch.drop()
    return out, keep


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document.

    Copies (equal sets, by a 128-bit key) are one node; nodes, groups and components stay distributed, and only tables of
    counted size are broadcast. Texts without words are linked with nothing, not even each other. Rows that repeat an
    id are documents of their own; a row without an id links like any other and gets the smallest id of its
    component, null if there is none. Whole texts count, however long; an empty table gives no rows; other columns are
    not read. Verification compares 64-bit hashes of shingles. What is written on the way is deleted at the end.
    """
    placed, _ = _placed(docs, width, percent)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _within(members: DataFrame, sized: DataFrame, words: list[str], percent: int, scratch: Scratch) -> DataFrame:
    """a, b (a < b): all possible pairs that meet in a group, each group a grid of cells of bounded size."""
    total = members.count()
    size = max(CELL_ROWS, slice_size(total))
    sides = members.groupBy("hub").agg(F.count(F.lit(1)).alias("m")).select("hub", F.greatest(F.lit(1), F.ceil(F.col("m") / size)).cast("int").alias("cells"))
    placed = scratch(split_join(members, sides, ["hub"], total).withColumn("cell", F.expr("CAST(pmod(xxhash64(node), cells) AS INT)")), "cells")
    each = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    side = lambda df, end: df.join(sized, "node").select("hub", "i", "j", *(F.col(c).alias(c + end) for c in ("node", "n", "fine", *words)))
    left = side(placed.select("hub", "node", F.col("cell").alias("i"), each.alias("j")), "_a")
    right = side(placed.select("hub", "node", F.col("cell").alias("j"), each.alias("i")), "_b")
    met = left.join(right, ["hub", "i", "j"]).where((F.col("node_a") < F.col("node_b")) & _possible(words, percent))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The join itself: every link between different sets, and which documents hold them. Both are written tables.

    pairs: class_a < class_b, n_shared, n_union (long) of each two classes that link, once. membership: doc_id, n_shingles,
    class_id of each document, class_id null without words; documents of one class are copies and link as well. Unlike
    jaccard_join, which needs a spanning set of links, all pairs that share an indexed subset and pass the sizes and
    sketches are verified, so a group of near copies costs about the square of its different sets, as its links do.
    Nulls, repeats, long texts, empty tables and other columns as in jaccard_join.
    """
    keep, scratch = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows, _, members, sets = _candidates(docs, width, percent, scratch)
    sized, words = _sized(sets, scratch)
    within = scratch(_within(members, sized, words, percent, scratch), "within")
    found = _compared(within, sets, within.count()).where(100 * F.col("i") >= percent * F.col("u"))
    pairs = keep(found.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.col("i").alias("n_shared"), F.col("u").alias("n_union")), "links")
    membership = keep(rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c1")).alias("class_id")), "membership")
    scratch.drop()
    return pairs, membership


def link_counts(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id, n_links of each document: how many other documents it links with, copies included.

    A row that repeats an id is a document of its own; one without words has no links. Counted by class, never by pairs of copies.
    """
    pairs, membership = links(docs, width, percent)
    sizes = membership.where("class_id IS NOT NULL").groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.select(F.col("class_a").alias("of"), F.col("class_b").alias("class_id")).unionByName(pairs.select(F.col("class_b").alias("of"), F.col("class_a").alias("class_id")))
    near = split_join(both, sizes, ["class_id"], 2 * pairs.count()).groupBy(F.col("of").alias("class_id")).agg(F.sum("copies").alias("near"))
    counts = sizes.join(near, "class_id", "left").select("class_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    total = membership.count()
    linked = split_join(membership.where("class_id IS NOT NULL"), counts, ["class_id"], total).select("doc_id", "n_shingles", "class_id", "n_links")
    none = membership.where("class_id IS NULL").select("doc_id", "n_shingles", "class_id", F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(none)


def one_of_each_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns whatever their names, one of each group: that of the smallest id, of those that repeat
    it that of the smallest hash of the text, and without any id that of the smallest hash.

    Rows that agree in id and text are one. Texts without words (null, empty, white space) stay, once for each id.
    """
    placed, keep = _placed(docs, width, percent)
    grouped = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("row").alias("row"))
    first = placed.where("component IS NOT NULL AND doc_id IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "row"))["row"].alias("first"))
    grouped = grouped.join(first, "component", "left").select(F.coalesce("first", "row").alias("row"))
    chosen = keep(grouped.unionByName(placed.where("component IS NULL").select("row")).distinct(), "chosen")
    copies = placed.groupBy("row").agg(F.count(F.lit(1)).alias("_n"))
    total = placed.count()
    rows = docs.withColumn("_row", _row())
    kept = split_join(rows, chosen.withColumnRenamed("row", "_row"), ["_row"], total, "left_semi", counts=copies.withColumnRenamed("row", "_row"))
    if copies.where("_n > 1").limit(1).count():
        kept = kept.dropDuplicates(["_row"])
    return kept.drop("_row")
