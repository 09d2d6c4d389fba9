"""Closed frequent itemsets of baskets with their rules, by minimal generators and their closures.

An itemset is a minimal generator if every proper subset has a larger support. Every subset of one is one too, so they
are found level by level: two generators of a basket that share all but their last item make a candidate, which goes on
if all its subsets are generators and its support is less than each of theirs. Every closed itemset is the closure of a
minimal generator: the intersection of the baskets that hold it. Supports of other sets follow: a set's support is the
least one of the generators within it.

What bounds the work: an item in fewer than a 2000th of the baskets is left out before baskets are gathered, so at most
2000 x (mean basket) items are left, whatever the input; no array and no basket is longer, however many lines a sale
has. Equal baskets become one row with a weight. Nothing is broadcast here and no list goes to the driver but the keys
that split_join deals out; hot items and pairs are counted with a combine before the shuffle and joined in slices.

Lines that repeat an item of a sale count once; lines without sale or item, or that are returned, not at all; a null
flag is not `returned`; other columns are not read. Ties need no order, as results are sets. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratal.llm.common import Scratch, split_join

MIN_BASKETS = 8
SHARE = 2_000  # a support of at least one in so many baskets
RULE_PERCENT = 10
SETS = "items array<long>, support long"


def baskets_of(lines: DataFrame) -> DataFrame:
    """sale_id, item_id of the lines that count."""
    kept = lines.where(F.coalesce(F.col("flag") != "returned", F.lit(True)) & F.col("sale_id").isNotNull() & F.col("item_id").isNotNull())
    return kept.select(F.col("sale_id").cast("long").alias("sale_id"), F.col("item_id").cast("long").alias("item_id"))


def merged_baskets(rows: DataFrame, least: int) -> DataFrame:
    """bid, items (ascending), w: the sets of often enough found items that baskets hold, and how many baskets hold just it."""
    often = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("item_id", "_n")
    total = rows.count()
    own = split_join(rows, often.select("item_id"), ["item_id"], total, counts=often)
    sets = own.groupBy("sale_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return sets.groupBy("items").agg(F.count(F.lit(1)).alias("w")).select(F.monotonically_increasing_id().alias("bid"), "items", "w")


def grown(held: DataFrame) -> DataFrame:
    """bid, w, head, item: two generators of a basket that share `prefix`, as the first one and the other's last item."""
    first = held.select("bid", "w", "prefix", "lasts", F.posexplode("lasts").alias("_p", "_a"))
    return first.select("bid", "w", F.concat("prefix", F.array("_a")).alias("head"), F.explode(F.expr("slice(lasts, _p + 2, size(lasts))")).alias("item"))


def candidates(generators: DataFrame, level: int) -> DataFrame:
    """head, item, lower: sets of `level` items all whose subsets of one less are generators; lower is their least support."""
    parts = generators.select("support", F.expr(f"slice(items, 1, {level - 2})").alias("prefix"), F.element_at("items", -1).alias("last"))
    pairs = parts.select("prefix", F.col("last").alias("a")).join(parts.select("prefix", F.col("last").alias("item")), "prefix").where("a < item")
    whole = pairs.select(F.concat("prefix", F.array("a")).alias("head"), "item").withColumn("whole", F.concat("head", F.array("item")))
    subset = whole.select("head", "item", F.explode(F.transform(F.sequence(F.lit(0), F.lit(level - 1)), lambda k: F.filter("whole", lambda _, i: i != k))).alias("items"))
    return subset.join(generators, "items").groupBy("head", "item").agg(F.min("support").alias("lower"), F.count(F.lit(1)).alias("_m")).where(F.col("_m") == level).drop("_m")


def minimal_generators(baskets: DataFrame, total: int, least: int, keep: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, support) of every frequent minimal generator but the empty one; (bid, w, items) of the baskets that hold
    one; (item, support) of every frequent item. total: all baskets.
    """
    single = baskets.select("w", F.explode("items").alias("item")).groupBy("item").agg(F.sum("w").alias("support"), F.count(F.lit(1)).alias("_n")).where(F.col("support") >= least)
    single = keep(single, "items")
    level, found, occurrences = 1, [], []
    generators = single.where(F.col("support") < total).select(F.array("item").alias("items"), "support", "_n")
    held = baskets.select("bid", "w", F.array().cast("array<long>").alias("prefix"), F.col("items").alias("lasts"))
    rows = baskets.select(F.sum(F.size("items"))).first()[0] or 0
    while True:
        found.append(generators.select("items", "support"))
        at = held.select("bid", "w", "prefix", F.explode("lasts").alias("_last")).select("bid", "w", F.concat("prefix", F.array("_last")).alias("items"))
        occurrences.append(split_join(at, generators.select("items"), ["items"], rows, counts=generators.select("items", "_n")))
        level += 1
        wider = grown(held)
        if level == 2:
            counted = wider.groupBy("head", "item").agg(F.sum("w").alias("support"), F.count(F.lit(1)).alias("_n")).where(F.col("support") >= least)
            one = single.select("item", F.col("support").alias("_s"))
            bounds = counted.withColumn("_h", F.element_at("head", 1)).join(one.select(F.col("item").alias("_h"), F.col("_s").alias("_s1")), "_h").join(one, "item")
            counted = bounds.withColumn("lower", F.least("_s", "_s1"))
        else:
            possible = keep(candidates(generators.select("items", "support"), level), f"candidates-{level}")
            met = wider.join(possible, ["head", "item"])
            counted = met.groupBy("head", "item").agg(F.sum("w").alias("support"), F.count(F.lit(1)).alias("_n"), F.first("lower").alias("lower")).where(F.col("support") >= least)
        generators = keep(counted.where("support < lower").select("head", "item", "support", "_n"), f"generators-{level}")
        rows = generators.select(F.sum("_n")).first()[0]
        if not rows:
            break
        held = split_join(wider, generators.select("head", "item"), ["head", "item"], rows, counts=generators.select("head", "item", "_n"))
        held = held.groupBy("bid", "w", F.col("head").alias("prefix")).agg(F.array_sort(F.collect_list("item")).alias("lasts"))
        held = keep(held, f"held-{level}")
        generators = generators.select(F.concat("head", F.array("item")).alias("items"), "support", "_n")
    union = lambda tables: tables[0] if len(tables) == 1 else tables[0].unionByName(union(tables[1:]))
    return union(found), union(occurrences), single.select("item", "support")


def closures(generators: DataFrame, occurrences: DataFrame, baskets: DataFrame, keep: Scratch) -> DataFrame:
    """(items, support) of the closed itemsets: each generator with what all baskets that hold it have in common.

    The intersection starts from the smallest of these baskets, an item of which stays if the baskets that hold both
    weigh as much as the generator's support; so a long basket is never spread out for its generators.
    """
    sized = baskets.select("bid", F.size("items").alias("_size"))
    smallest = occurrences.join(sized, "bid").groupBy("items").agg(F.min(F.struct("_size", "bid")).alias("_least")).select("items", "_least.bid")
    seeds = smallest.join(baskets.select("bid", F.col("items").alias("_held")), "bid").select("items", F.array_except("_held", "items").alias("_more"))
    seeds = keep(seeds.join(generators, "items"), "seeds")
    plain = seeds.where(F.size("_more") == 0).select("items", "support")
    open_ones = seeds.where(F.size("_more") > 0)
    counts = open_ones.select("items", F.col("support").alias("_n"))
    rows = open_ones.select(F.sum("support")).first()[0] or 0
    met = split_join(occurrences, open_ones.select("items", "_more"), ["items"], rows, counts=counts)
    common = met.join(baskets.select("bid", F.col("items").alias("_held")), "bid").select("items", "w", F.explode(F.array_intersect("_more", "_held")).alias("_j"))
    stays = common.groupBy("items", "_j").agg(F.sum("w").alias("_w")).join(open_ones.select("items", "support"), "items").where("_w = support")
    added = open_ones.join(stays.groupBy("items").agg(F.collect_list("_j").alias("_closed")), "items", "left")
    whole = added.select(F.array_sort(F.concat("items", F.coalesce("_closed", F.array().cast("array<long>")))).alias("items"), "support")
    return plain.unionByName(whole).groupBy("items").agg(F.max("support").alias("support"))


def rules(closed: DataFrame, generators: DataFrame, single: DataFrame, total: int, percent: int = RULE_PERCENT) -> DataFrame:
    """items, support, rules: of each closed itemset the structs (c, a, s) of the items c that the rest implies.

    a, the support of the rest, is the least of the generators in it. Each generator meets the closed sets by that of
    its items which the fewest of them hold.
    """
    parts = closed.where(F.size("items") > 1).select("items", "support", F.explode("items").alias("item"))
    spread = parts.groupBy("item").agg(F.count(F.lit(1)).alias("_n"))
    n_parts = parts.count()
    spelt = generators.select(F.col("items").alias("_g"), F.col("support").alias("_a"), F.explode("items").alias("item")).join(spread, "item")
    keyed = spelt.groupBy("_g", "_a").agg(F.min(F.struct("_n", "item")).alias("_k"), F.count(F.lit(1)).alias("_m")).where(F.col("_m") == F.size("_g"))
    within = split_join(parts, keyed.select(F.col("_k.item").alias("item"), "_g", "_a"), ["item"], n_parts, counts=spread).where(F.size(F.array_except("_g", "items")) == 0)
    rest = within.select("items", "support", F.explode(F.array_except("items", "_g")).alias("item"), "_a")
    rest = rest.unionByName(parts.withColumn("_a", F.lit(total).cast("long"))).groupBy("items", "support", "item").agg(F.min("_a").alias("_a"))
    rest = split_join(rest, single.select("item", F.col("support").alias("_s")), ["item"], n_parts, counts=spread)
    good = rest.where((100 * F.col("support") >= percent * F.col("_a")) & (F.col("support") * F.lit(total).cast("long") > F.col("_a") * F.col("_s")))
    made = good.groupBy("items").agg(F.array_sort(F.collect_list(F.struct(F.col("item").alias("c"), F.col("_a").alias("a"), F.col("_s").alias("s")))).alias("rules"))
    return closed.join(made, "items", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<struct<c:bigint,a:bigint,s:bigint>>")))


def closed_itemsets(lines: DataFrame, min_baskets: int = MIN_BASKETS, share: int = SHARE, percent: int = RULE_PERCENT) -> DataFrame:
    """items (ascending array), support, rules (array of c, a, s) of every closed frequent itemset of sale_lines."""
    keep = Scratch(lines.sparkSession)
    rows = baskets_of(lines)
    total = rows.select("sale_id").distinct().count()
    least = max(min_baskets, -(-total // share))
    baskets = keep(merged_baskets(rows, least), "baskets")
    generators, occurrences, single = minimal_generators(baskets, total, least, keep)
    generators = keep(generators, "generators")
    closed = closures(generators, occurrences, baskets, keep)
    everywhere = single.where(F.col("support") == total).agg(F.array_sort(F.collect_list("item")).alias("items"), F.max("support").alias("support")).where(F.size("items") > 0)
    closed = keep(closed.unionByName(everywhere).groupBy("items").agg(F.max("support").alias("support")), "closed")
    return rules(closed, generators, single, total, percent)


def digest(found: DataFrame) -> DataFrame:
    """items (joined by commas), n_items, support, n_rules, best_item, rules_sha256 of rows of closed_itemsets."""
    spelt = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r.c, r.a, r.s)), ";")
    best = F.array_min(F.transform("rules", lambda r: F.struct(r.a.alias("a"), r.c.alias("c"))))
    return found.select(
        F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), F.size("items").cast("long").alias("n_items"), "support",
        F.size("rules").cast("long").alias("n_rules"), best.c.alias("best_item"), F.sha2(spelt, 256).alias("rules_sha256"),
    )


SQL = """
WITH RECURSIVE b AS (
  SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE flag IS DISTINCT FROM 'returned' AND sale_id IS NOT NULL AND item_id IS NOT NULL
), t AS (SELECT count(DISTINCT sale_id) AS total FROM b),
single AS (SELECT item_id, count(*) AS s FROM b GROUP BY item_id HAVING count(*) >= 8 AND count(*) * 2000 >= (SELECT total FROM t)),
fb AS (SELECT b.sale_id, b.item_id FROM b JOIN single USING (item_id)),
occ AS (
  SELECT [item_id] AS items, item_id AS last, sale_id FROM fb
  UNION ALL
  SELECT items, last, sale_id FROM (
    SELECT list_append(o.items, y.item_id) AS items, y.item_id AS last, o.sale_id, count(*) OVER (PARTITION BY o.items, y.item_id) AS n
    FROM occ o JOIN fb y ON y.sale_id = o.sale_id AND y.item_id > o.last
  ) WHERE n >= 8 AND n * 2000 >= (SELECT total FROM t)
), sets AS (SELECT items, count(*) AS support FROM occ GROUP BY items),
part AS (SELECT items, support, unnest(items) AS c FROM sets WHERE len(items) > 1),
rest AS (SELECT p.items, p.support, p.c, r.items AS sub, r.support AS a FROM part p JOIN sets r ON r.items = list_filter(p.items, lambda i: i <> p.c)),
closed AS (SELECT items, support FROM sets WHERE items NOT IN (SELECT sub FROM rest WHERE a = support)),
rule AS (
  SELECT r.items, r.c, r.a, s.s FROM rest r JOIN single s ON s.item_id = r.c
  WHERE 100 * r.support >= 10 * r.a AND r.support * (SELECT total FROM t) > r.a * s.s
), made AS (
  SELECT items, count(*) AS n_rules, arg_min(c, (a, c)) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS spelt FROM rule GROUP BY items
)
SELECT array_to_string(closed.items, ',') AS items, CAST(len(closed.items) AS BIGINT) AS n_items, support,
       coalesce(n_rules, 0) AS n_rules, best_item, sha256(coalesce(spelt, '')) AS rules_sha256
FROM closed LEFT JOIN made ON made.items = closed.items
"""
