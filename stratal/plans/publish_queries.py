"""Queries on publishing, generic engine checks, and streams run to their end."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from stratal.catalogue import register
from stratal.functions.text import breadcrumb
from stratal.operators import checks as K
from stratal.operators import publish as P
from stratal.operators import publishing as W
from stratal.operators import selection as S
from stratal.sources import files
from stratal.sources.observations import table
from stratal.sources.shared import shared_root
from stratal.streaming.lists import run_lists


def _tree(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    desired = r.select(F.concat(F.lit("report:"), "r_name").alias("key"), F.sha2("r_name", 256).alias("content_hash")).unionByName(n.select(F.concat(F.lit("subreport:"), "n_name").alias("key"), F.sha2("n_name", 256).alias("content_hash")))
    recorded = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("subreport:"), "n_name").alias("key"), F.sha2(F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).otherwise("old"), 256).alias("content_hash"))
    old = n.where("n_nationkey < 3").select(F.concat(F.lit("report:gone"), "n_nationkey").alias("key"), F.lit("x").alias("content_hash"))
    return desired, recorded.unionByName(old)


@register("tree_diff", """
SELECT 'report:' || r_name AS key, 'create' AS action FROM region UNION ALL SELECT 'subreport:' || n_name, CASE WHEN n_nationkey % 2 = 1 THEN 'create' WHEN n_nationkey % 4 = 0 THEN 'skip' ELSE 'update' END FROM nation UNION ALL SELECT 'report:gone' || n_nationkey, 'delete' FROM nation WHERE n_nationkey < 3""")
def _(spark, sf):
    return S.desired_diff(*_tree(spark, sf))


@register("stale_nodes", "SELECT 'report:gone' || n_nationkey AS key, 1 AS deletion_order FROM nation WHERE n_nationkey < 3")
def _(spark, sf):
    desired, recorded = _tree(spark, sf)
    return S.stale(recorded, desired).select("key", "deletion_order")


@register("nav_index", "SELECT n_regionkey AS parent, string_agg('- [' || n_name || '](https://w/t' || n_nationkey || ')', chr(10) ORDER BY n_name DESC) AS index FROM nation GROUP BY 1")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("parent"), "n_name", F.concat(F.lit("t"), "n_nationkey").alias("token"))
    return P.navigation(n.unionAll(n), "parent", "n_name", "token", "https://w/")


@register("status_block", """
SELECT user_id, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) FILTER (event_type = 'error') AS n_failed,
'ok: ' || count(*) FILTER (event_type <> 'error') || '; failed: ' || count(*) FILTER (event_type = 'error') || CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN ' (' || string_agg('s' || event_id, ', ' ORDER BY 's' || event_id) FILTER (event_type = 'error') || ')' ELSE '' END AS block FROM events GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.concat(F.lit("s"), "event_id").alias("source"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))
    return P.status_block(e, "user_id")


@register("brief_assembly", "SELECT source || '-' || doc_id // 512 AS day, string_agg(CASE WHEN doc_id % 2 = 0 THEN '- [d' || doc_id || '](/r/' || doc_id || ')' ELSE '- d' || doc_id END, chr(10) ORDER BY doc_id) AS brief FROM documents GROUP BY 1")
def _(spark, sf):
    """A brief lists the reports of a day: 512 at most here."""
    d = table(spark, sf, "documents").select(F.concat_ws("-", "source", F.floor(F.col("doc_id") / 512)).alias("day"), "doc_id", F.concat(F.lit("d"), "doc_id").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/r/"), "doc_id")).alias("link"))
    return P.brief(d, "day", "doc_id", "title", "link")


@register("breadcrumbs", "SELECT n_nationkey, '[' || r_name || '](/r/' || r_regionkey || ') / [' || n_name || '](/n/' || n_nationkey || ')' AS crumb FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select("n_nationkey", F.array("r_name", "n_name").alias("t"), F.array(F.concat(F.lit("/r/"), "r_regionkey"), F.concat(F.lit("/n/"), "n_nationkey")).alias("u"))
    return n.select("n_nationkey", breadcrumb("t", "u").alias("crumb"))


@register("referenced_blobs", "SELECT DISTINCT sha256(text) AS ref FROM documents WHERE doc_id % 2 = 0 UNION SELECT DISTINCT sha256(lang) FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.array(F.sha2("lang", 256)).alias("refs"), F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).alias("full"))
    return P.referenced_blobs(d, "refs", "full")


@register("wiki_links_closed", "SELECT 'dead link' AS problem, 'n' || n_nationkey AS id FROM nation WHERE n_nationkey % 6 = 5 UNION ALL SELECT 'unreachable', 'n' || n_nationkey FROM nation WHERE n_nationkey % 5 = 4 AND n_nationkey % 6 <> 5")
def _(spark, sf):
    n = table(spark, sf, "nation")
    page = F.concat(F.lit("n"), "n_nationkey")
    pages = n.where("n_nationkey % 6 <> 5").select(page.alias("page"), F.lit(False).alias("root"))
    links = n.where("n_nationkey % 5 <> 4 OR n_nationkey % 6 = 5").select(F.lit("root").alias("source"), page.alias("target"))
    return K.links_closed(links, pages)


@register("sitemap_rows", """
WITH p AS (SELECT url, CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-01-10' + INTERVAL (page_id % 9) DAY WHEN page_id % 3 = 1 THEN TIMESTAMP '2023-06-01' END AS t, page_id // 64 AS map_id, contains(url, '/en/') AS wanted FROM pages),
m AS (SELECT map_id, url, t AS updated_at, row_number() OVER (PARTITION BY map_id ORDER BY t DESC NULLS LAST, url)::INT AS rank FROM p WHERE wanted AND (t IS NULL OR t >= TIMESTAMP '2024-01-13') QUALIFY rank <= 30)
SELECT * FROM m UNION ALL SELECT map_id, NULL, NULL, NULL FROM p GROUP BY map_id HAVING NOT bool_or(wanted)""")
def _(spark, sf):
    """Sitemaps made of 64 pages each, then read again; the newest 30 of a map are the feature."""
    p = table(spark, sf, "pages").withColumn("map_id", F.floor(F.col("page_id") / 64))
    day = F.when(F.col("page_id") % 3 == 0, F.date_format(F.expr("TIMESTAMP_NTZ'2024-01-10'") + F.make_dt_interval(days=(F.col("page_id") % 9).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("page_id") % 3 == 1, "2023-06-01T00:00:00Z")
    entry = F.concat_ws("", F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), F.when(day.isNotNull(), F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>"))), F.lit("</url>"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>"))
    maps = p.groupBy("map_id").agg(xml.alias("xml"))
    out = files.sitemap_rows(maps, "map_id", "xml", F.expr("TIMESTAMP'2024-01-20'"), ["/en/"], 30)
    return out.select("map_id", "url", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "rank")


@register("feed_rows", "SELECT conv_id, count(*) AS n, min('post ' || turn) AS first_title FROM conversations WHERE turn % 4 <> 3 GROUP BY 1")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    link = F.when(F.col("turn") % 4 != 3, F.concat(F.lit("<link>http://f/"), "turn", F.lit("</link>")))
    item = F.concat_ws("", F.lit("<item><title>post \n "), "turn", F.lit("</title>"), link, F.lit("<pubDate>x</pubDate></item>"))
    feeds = c.groupBy("conv_id").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml"))
    return files.feed_rows(feeds, "conv_id", "xml").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("first_title"))


@register("cli_envelope", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id END AS n FROM events")
def _(spark, sf):
    """All events; the output of odd ones has no envelope."""
    last = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"ok":true,"n":'), "event_id", F.lit("}\n"))).otherwise("no envelope\n")
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit('log line\n{"note":1}\n'), last).alias("out"))
    return files.envelope(e, "event_id", "out").select("event_id", F.get_json_object("envelope", "$.n").cast("long").alias("n"))


@register("pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def _(spark, sf):
    x = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ'1998-09-02'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count(F.lit(1)).alias("n"))


@register("top_customers", """
SELECT c_custkey, r_name, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL ORDER BY spent DESC, c_custkey LIMIT 20""")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    x = o.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select("c_custkey", "r_name", F.round("s", 2).alias("spent")).orderBy(F.desc("spent"), "c_custkey").limit(20)


@register("cross_regions", "SELECT r.r_name AS a, n.n_name AS b FROM region r CROSS JOIN nation n")
def _(spark, sf):
    return table(spark, sf, "region").select(F.col("r_name").alias("a")).crossJoin(table(spark, sf, "nation").select(F.col("n_name").alias("b")))


@register("stream_ledger_available_now")
def _(spark, sf):
    """The first-write ledger fed by a stream that runs to its end; equal to the batch query put_items_revisions."""
    from stratal.streaming.ledger import run_events

    return run_events(spark, sf)


@register("stream_cooldown")
def _(spark, sf):
    """Events with a cooldown, state by user, in a stream that runs to its end; equal to growth_cooldown."""
    from stratal.streaming.cooldown import run_events

    return run_events(spark, sf)


@register("story_rows", """
SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10' - INTERVAL 24 HOUR THEN 'bootstrap_snapshot' ELSE 'live_increment' END AS kind, CASE WHEN event_id % 7 = 0 THEN 'tombstone' ELSE 'full' END AS status
FROM events WHERE event_type = 'view' AND event_id % 10 <> 0 AND ts < TIMESTAMP '2024-01-10'""")
def _(spark, sf):
    """Stories with a stored blob; on the first poll those older than a day are snapshots, deleted or dead ones tombstones."""
    from stratal.operators.classify import story_status

    now = F.expr("TIMESTAMP_NTZ'2024-01-10'")
    e = table(spark, sf, "events").withColumn("blob", F.when(F.col("event_id") % 10 != 0, F.sha2("props", 256)))
    rows = e.where((F.col("event_type") == "view") & F.col("blob").isNotNull() & (F.col("ts") < now))
    return rows.select("event_id", F.when(F.col("ts") < now - F.expr("INTERVAL 24 HOURS"), "bootstrap_snapshot").otherwise("live_increment").alias("kind"), story_status(F.col("event_id") % 7 == 0, F.lit(None).cast("boolean")).alias("status"))


@register("row_validity", "SELECT event_id FROM events WHERE event_id % 4 IN (0, 3)")
def _(spark, sf):
    """Rows with a non-empty identity; nulls and empty strings are both missing."""
    name = F.when(F.col("event_id") % 4 == 1, "").when(F.col("event_id") % 4 != 2, F.concat(F.lit("o/r"), "event_id"))
    return table(spark, sf, "events").withColumn("name", name).where("name IS NOT NULL AND name <> ''").select("event_id")


@register("report_kinds", "SELECT doc_id, ['main_report_v1', 'legacy_v3', 'legacy_v2'][1 + doc_id % 3] AS kind FROM documents")
def _(spark, sf):
    from stratal.operators.classify import report_kind

    path = F.concat(F.lit("r/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, "/main_report.md").when(F.col("doc_id") % 3 == 1, "/report.md").otherwise(".md"))
    return table(spark, sf, "documents").select("doc_id", report_kind(path).alias("kind"))


@register("canonical_json", """SELECT event_id, '{"a":' || CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'null' END || ',"b":"' || event_type || '","c":[1,2]}' AS json FROM events""")
def _(spark, sf):
    """Compact JSON with sorted keys; nulls are kept."""
    s = F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("a"), F.col("event_type").alias("b"), F.array(F.lit(1), F.lit(2)).alias("c"))
    return table(spark, sf, "events").select("event_id", F.to_json(s, {"ignoreNullFields": "false"}).alias("json"))


@register("subreport_files", "SELECT 's' || n_nationkey AS path, CASE WHEN n_nationkey % 5 = 0 THEN 'missing' ELSE 'extra' END AS problem FROM nation WHERE (n_nationkey % 5 = 0) <> (n_nationkey % 7 = 0)")
def _(spark, sf):
    """Declared against found files of a package: every fifth was not written, every seventh was not declared."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("path"), "n_nationkey")
    return K.files_equal(n.where("n_nationkey % 7 <> 0").select("path"), n.where("n_nationkey % 5 <> 0").select("path"))


@register("hash_manifest", "SELECT doc_id, doc_id % 9 = 0 AS changed FROM documents")
def _(spark, sf):
    """Files against the hashes of their manifest."""
    d = table(spark, sf, "documents")
    manifest = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("want"))
    return d.join(manifest, "doc_id").select("doc_id", (F.sha2("text", 256) != F.col("want")).alias("changed"))


@register("run_lookup", "SELECT o_orderkey AS run_id, '/runs/' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def _(spark, sf):
    """Paths of queued runs that stay under the root."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "/runs/").otherwise("/elsewhere/"), "o_orderkey").alias("path"))
    wanted = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("run_id"))
    return o.join(wanted, "run_id", "left_semi").where(F.col("path").startswith("/runs/"))


@register("reconciled_status", """
SELECT o_orderkey AS run_id, CASE WHEN n = 0 THEN 'failed' WHEN n < o_orderkey % 8 THEN 'partial' ELSE 'success' END AS status
FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def _(spark, sf):
    """Phase status from the artefacts that are there against those that were planned."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id")).join(n, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return o.select("run_id", F.when(F.col("n") == 0, "failed").when(F.col("n") < F.col("run_id") % 8, "partial").otherwise("success").alias("status"))


@register("readiness", "SELECT source, bool_and(n_chars > 100) FILTER (lang = 'en') AS ready FROM documents GROUP BY 1")
def _(spark, sf):
    """Whether every required check (here: those of one language) holds."""
    return table(spark, sf, "documents").groupBy("source").agg(F.every(F.when(F.col("lang") == "en", F.col("n_chars") > 100)).alias("ready"))


@register("time_fields", "SELECT event_id, make_timestamp(year(ts), month(ts), day(ts), hour(ts), minute(ts), 0.0) AS t FROM events")
def _(spark, sf):
    """A timestamp from its calendar fields."""
    t = F.expr("make_timestamp_ntz(year(ts), month(ts), day(ts), hour(ts), minute(ts), 0)")
    return table(spark, sf, "events").select("event_id", t.alias("t"))


@register("surface_attention", "SELECT user_id, list_sort(list_distinct(list(event_type))) AS surfaces, count(*) AS n, max(value) AS score FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("surfaces"), F.count(F.lit(1)).alias("n"), F.max("value").alias("score"))


_TREE = """
SELECT 'root' AS key, CAST(NULL AS VARCHAR) AS parent, 'World' AS content UNION ALL SELECT 'r' || r_regionkey, 'root', r_name FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0"""


@register("published_tree", f"SELECT key, sha256(content) AS content_hash FROM ({_TREE})")
def _(spark, sf):
    """Regions, nations and suppliers published as a tree; an earlier run wrote other suppliers and other names, which are replaced
    and deleted. The rows are what the target holds when it is read back."""
    root = shared_root(spark, "published")
    spark.dataSource.register(W.node_source("published_tree_nodes", partial(W.FolderTarget, root, 4)))
    r, n, s = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    top = spark.range(1).select(F.lit("root").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit("World").alias("content"))
    inner = top.unionByName(r.select(key("r", "r_regionkey").alias("key"), F.lit("root").alias("parent"), F.col("r_name").alias("content")))
    inner = inner.unionByName(n.select(key("n", "n_nationkey").alias("key"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("content")))
    leaf = s.select(key("s", "s_suppkey").alias("key"), key("n", "s_nationkey").alias("parent"), F.col("s_name").alias("content"), "s_suppkey")
    earlier = leaf.where("s_suppkey % 2 = 0").withColumn("content", F.concat("content", F.when(F.col("s_suppkey") % 4 == 0, " (old)").otherwise("")))
    for tree in (inner.unionByName(earlier.drop("s_suppkey")), inner.unionByName(leaf.where("s_suppkey % 3 <> 0").drop("s_suppkey"))):
        W.publish_tree(spark, "published_tree_nodes", tree.withColumn("content_hash", F.sha2("content", 256)))
    return spark.read.format("published_tree_nodes").load()


@register("stream_lists", "SELECT DISTINCT conv_id % 4 AS list, conv_id * 1000 + turn AS post_id, text FROM conversations")
def _(spark, sf):
    """Posts of four lists from a stream with a cursor by list, stopped and started again between batches; each post once."""
    return run_lists(spark, sf)
