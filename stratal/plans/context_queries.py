"""Queries on the context of a repository, projections for bounded readers, and checks of older layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratal.catalogue import register
from stratal.functions import text as X
from stratal.operators import checks as K
from stratal.operators import classify as C
from stratal.operators import events as E
from stratal.operators import projection as P
from stratal.operators import publish as R
from stratal.operators import selection as S
from stratal.sources.observations import table


@register("repository_context", """
SELECT e.event_id AS probe_id, l.value AS latest, a.value AS baseline_6h, b.value AS baseline_24h, c.value AS baseline_7d, g.at AS growth_event_at,
array_to_string(list_sort(list_filter([CASE WHEN e.event_type <> 'error' THEN 'ev:' || e.event_id END, CASE WHEN n.event_type <> 'error' THEN 'ev:' || n.event_id END], lambda x: x IS NOT NULL)), ',') AS existing
FROM events e ASOF LEFT JOIN events l ON e.user_id = l.user_id AND e.ts > l.ts
ASOF LEFT JOIN events a ON e.user_id = a.user_id AND e.ts - INTERVAL 6 HOUR >= a.ts
ASOF LEFT JOIN events b ON e.user_id = b.user_id AND e.ts - INTERVAL 24 HOUR >= b.ts
ASOF LEFT JOIN events c ON e.user_id = c.user_id AND e.ts - INTERVAL 168 HOUR >= c.ts
LEFT JOIN events n ON n.event_id = e.event_id + 1
LEFT JOIN (SELECT user_id, max(ts) AS at FROM events WHERE event_type = 'purchase' GROUP BY 1) g ON g.user_id = e.user_id""")
def _(spark, sf):
    """Every event is a snapshot of its user and a probe that asks for its own item and the next one's."""
    e = table(spark, sf, "events")
    item = lambda n: F.concat(F.lit("ev:"), n)
    key = F.concat(F.lit("growth:"), "user_id")
    probes = e.select(F.col("event_id").alias("probe_id"), F.col("user_id").alias("repo_id"), F.col("ts").alias("observed_at"), F.array(item(F.col("event_id")), item(F.col("event_id") + 1)).alias("event_item_ids"), key.alias("growth_event_key"))
    snapshots = e.select(F.col("user_id").alias("repo_id"), F.col("ts").alias("observed_at"), F.col("event_id").alias("snapshot_id"), F.col("value").alias("stars"), F.col("props").alias("metadata"))
    items = e.where("event_type <> 'error'").select(item(F.col("event_id")).alias("item_id"))
    markers = e.where("event_type = 'purchase'").select(key.alias("event_key"), F.col("ts").alias("observed_at"))
    out = E.repository_context(probes, snapshots, items, markers)
    return out.select("probe_id", F.col("latest.stars").alias("latest"), *(F.col(f"baseline_{h}.stars").alias(f"baseline_{h}") for h in E.HORIZONS), "growth_event_at", F.array_join("existing_item_ids", ",").alias("existing"))


@register("snapshot_history", "SELECT user_id AS repo_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, ts AS observed_at, event_id AS snapshot_id, CAST(props->>'k' AS BIGINT) AS k, 'snapshots/' || event_id AS file_ref FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("repo_id"), F.col("ts").alias("observed_at"), F.col("event_id").alias("snapshot_id"), F.col("props").alias("metadata"), F.concat(F.lit("snapshots/"), "event_id").alias("file_ref"))
    out = E.snapshot_history(e)
    return out.select("repo_id", "position", "observed_at", "snapshot_id", F.get_json_object("metadata", "$.k").cast("long").alias("k"), "file_ref")


@register("compact_families", """
SELECT doc_id, family, CASE WHEN doc_id % 2 = 0 THEN 'https://h/' || doc_id ELSE 'https://u/' || doc_id END AS url,
CASE family WHEN 'post' THEN left(coalesce(text, ''), 1200) WHEN 'article' THEN left(coalesce(nullif(text, ''), 'p' || doc_id), 1800) END AS text,
CASE family WHEN 'post' THEN left(coalesce(text, ''), 800) END AS quoted_text,
CASE family WHEN 'post' THEN CASE WHEN doc_id % 3 = 0 THEN 'e' || doc_id ELSE 'l' || doc_id END END AS links,
CASE family WHEN 'repository' THEN left(coalesce(text, ''), 800) END AS description, CASE family WHEN 'repository' THEN doc_id END AS stars,
CASE family WHEN 'repository' THEN left(coalesce(text, ''), 1200) END AS readme_preview,
CASE family WHEN 'paper' THEN CASE WHEN doc_id % 4 = 0 THEN 's' || doc_id ELSE left(coalesce(nullif(text, ''), 's' || doc_id), 2000) END END AS abstract,
CASE family WHEN 'paper' THEN left(coalesce(text, ''), 1000) END AS hf_summary,
CASE family WHEN 'article' THEN left(coalesce(text, ''), 1200) END AS summary, CASE WHEN family IN ('paper', 'article') THEN lang END AS title
FROM (SELECT *, ['post', 'repository', 'paper', 'article', 'paper'][1 + doc_id % 5] AS family FROM documents)""")
def _(spark, sf):
    """All documents as payloads of five sources; '' and what is missing fall through to the next member of a chain."""
    d, n = table(spark, sf, "documents"), F.col("doc_id")
    named = lambda c: F.concat(F.lit(c), "doc_id")
    payload = F.struct(
        F.when(n % 2 == 0, "").otherwise(named("https://u/")).alias("url"), named("https://h/").alias("hn_url"), F.col("text"), named("p").alias("text_preview"), F.col("text").alias("quoted_text"),
        F.when(n % 3 == 0, F.array(named("e"))).otherwise(F.expr("CAST(array() AS array<string>)")).alias("expanded_links"), F.array(named("l")).alias("links"),
        F.col("text").alias("description"), F.struct(n.alias("stars")).alias("snapshot"), F.col("text").alias("readme_preview"), F.when(n % 4 != 0, F.col("text")).otherwise("").alias("abstract"),
        named("s").alias("summary"), F.col("text").alias("hf_ai_summary"), F.lit("").alias("feed_summary"), F.col("lang").alias("title"),
    )
    source = F.element_at(F.array(*map(F.lit, ["x_list", "github", "arxiv", "article:web", "huggingface"])), (1 + n % 5).cast("int"))
    out = P.compact(d.select(n.alias("item_id"), source.alias("source"), F.lit("new").alias("change"), F.lit(None).cast("timestamp_ntz").alias("occurred_at"), F.to_json(payload).alias("payload")))
    return out.select(F.col("item_id").alias("doc_id"), "family", "url", "text", "quoted_text", F.array_join("links", ",").alias("links"), "description", "stars", "readme_preview", "abstract", "hf_summary", "summary", "title")


@register("run_summary", """
SELECT user_id AS run_id, user_id % 2 AS exit_code, arg_max('t' || event_id, event_id) FILTER (event_type = 'view') AS thread_id, sum(event_id % 10)::BIGINT AS usage, count(*) AS event_count,
[NULL, 'quota', 'network', 'process_error'][1 + user_id % 4] AS error_class, [NULL, 'Usage limit hit', 'Connection reset', 'broken'][1 + user_id % 4] AS error FROM events GROUP BY user_id""")
def _(spark, sf):
    e = table(spark, sf, "events")
    error = F.element_at(F.array(F.lit(None), *map(F.lit, ["Usage limit hit", "Connection reset", "broken"])), (1 + F.col("user_id") % 4).cast("int"))
    runs = e.select(F.col("user_id").alias("run_id")).distinct().select("run_id", (F.col("run_id") % 2).alias("exit_code"), F.col("run_id").alias("user_id")).withColumn("error", error).drop("user_id")
    events = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", F.concat(F.lit("t"), "event_id")).alias("thread_id"), (F.col("event_id") % 10).alias("tokens"))
    return P.run_summary(runs, events)


@register("legacy_validate", """
WITH l AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'investigate' WHEN quality = 1 THEN 'supporting' ELSE 'archive' END AS d, toxic, doc_id // 512 AS package FROM labels),
p AS (SELECT package, count(*) FILTER (d = 'investigate' AND doc_id % 12 <> 0) AS n FROM l GROUP BY 1)
SELECT 'missing annotation' AS problem, CAST(doc_id AS VARCHAR) AS id FROM l WHERE doc_id % 50 = 0
UNION ALL SELECT 'missing investigated unit', CAST(doc_id AS VARCHAR) FROM l WHERE d = 'investigate' AND doc_id % 12 = 0 AND doc_id % 50 <> 0
UNION ALL SELECT 'extra investigated unit', CAST(doc_id AS VARCHAR) FROM l WHERE d = 'investigate' AND doc_id % 12 <> 0 AND doc_id % 50 = 0
UNION ALL SELECT 'extra supporting unit', CAST(doc_id AS VARCHAR) FROM l WHERE toxic = 1 AND (d <> 'supporting' OR doc_id % 50 = 0)
UNION ALL SELECT 'too many packages', CAST(count(*) AS VARCHAR) FROM p HAVING count(*) > 15
UNION ALL SELECT 'nothing to investigate', CAST(package AS VARCHAR) FROM p WHERE n = 0""")
def _(spark, sf):
    """Units of which one in fifty has no annotation, packages of 512 ids that leave out one in twelve and support all toxic ones."""
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "investigate").when(F.col("quality") == 1, "supporting").otherwise("archive")
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("unit_id"), kind.alias("disposition"), "toxic")
    listed = lambda when: F.collect_list(F.when(when, F.col("unit_id")))
    packages = lab.groupBy(F.floor(F.col("unit_id") / 512).alias("package_id")).agg(listed((F.col("disposition") == "investigate") & (F.col("unit_id") % 12 != 0)).alias("investigate_unit_ids"), listed(F.col("toxic") == 1).alias("supporting_unit_ids"))
    return K.legacy_valid(lab.select("unit_id"), lab.where("unit_id % 50 <> 0").select("unit_id", "disposition"), packages)


@register("recent_history", """
WITH r AS (SELECT doc_id // 40 AS p, doc_id % 2 AS name, doc_id, CASE WHEN doc_id % 3 = 0 THEN '# Title ' || doc_id || chr(10) || coalesce(text, '') ELSE 'none ' || doc_id END AS content
  FROM documents WHERE TIMESTAMP '2024-03-01' - INTERVAL 1 HOUR * (doc_id % 1000) >= TIMESTAMP '2024-03-01' - INTERVAL 30 DAY AND doc_id // 40 % 7 <> 3),
l AS (SELECT p, arg_max(content, (name, -(doc_id % 1000))) AS content FROM r GROUP BY p)
SELECT 'd' || p % 7 || '-attempt-1-p' || p || '.md' AS target,
'- [' || CASE WHEN starts_with(content, '# Title ') THEN trim(substr(content, 3, strpos(content, chr(10)) - 3)) ELSE 'p' || p END || '](history/d' || p % 7 || '-attempt-1-p' || p || '.md)' AS line FROM l""")
def _(spark, sf):
    """Packages of forty documents as reports of seven runs, the fourth of which is the current one."""
    d, p = table(spark, sf, "documents"), F.floor(F.col("doc_id") / 40)
    now = F.expr("TIMESTAMP_NTZ'2024-03-01'")
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Title "), "doc_id", F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.concat(F.lit("none "), "doc_id"))
    reports = d.select(F.concat(F.lit("d"), p % 7).alias("date"), F.lit("attempt-1").alias("attempt"), F.concat(F.lit("p"), p).alias("package"), F.concat(F.lit("r"), F.col("doc_id") % 2).alias("name"), (now - F.make_dt_interval(hours=(F.col("doc_id") % 1000).cast("int"))).alias("modified_at"), content.alias("content"))
    return R.recent_history(reports, now, "d3/attempt-1").select("target", "line")


@register("candidate_overflow", "SELECT user_id, count(*) AS n_found, count(*) - 5 AS n_dropped FROM events GROUP BY 1 HAVING count(*) > 5")
def _(spark, sf):
    return S.overflow(table(spark, sf, "events"), "user_id", 5)


@register("paper_kinds", "SELECT event_id, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-15' THEN 'late_arrival' ELSE 'live_increment' END AS kind FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", C.paper_kind(F.to_date("ts"), F.expr("DATE'2024-01-15'")).alias("kind"))


@register("unknown_links", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'none' || doc_id ELSE lang || ',none' || doc_id END AS unknown FROM documents")
def _(spark, sf):
    """Each document links the known slug en, its language, and a slug of its own twice."""
    own = F.concat(F.lit("report://none"), "doc_id")
    content = F.concat(F.lit("see report://en, report://"), "lang", F.lit(". and "), own, F.lit(" subreport://en "), own)
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.unknown_links(content, F.array(F.lit("en"))), ",").alias("unknown"))


@register("html_descriptions", "SELECT page_id, left(url || ' & more', 1000) AS description FROM pages")
def _(spark, sf):
    """The description that is put before each page's own, with a character reference."""
    page = F.concat(F.lit('<head><meta name="description" content="'), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit(' &amp; more"></head>'), F.coalesce("html", F.lit("")))
    return table(spark, sf, "pages").select("page_id", X.html_description(page).alias("description"))
