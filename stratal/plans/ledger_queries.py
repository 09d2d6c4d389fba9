"""Queries on the ledger, its state and its events over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratal.catalogue import register
from stratal.functions import text as X
from stratal.operators import events as E
from stratal.operators import ledger as L
from stratal.operators import selection as S
from stratal.sources import observations as O
from stratal.sources.observations import table

GROUP_SQL = "CASE WHEN source IN ('x_list','x_for_you') THEN source WHEN source IN ('github','github_trending') THEN 'github' WHEN source IN ('arxiv','huggingface') THEN 'papers' WHEN source = 'hackernews' THEN 'hackernews' ELSE 'articles' END"
OBS_SQL = "SELECT 'ev:' || event_id AS item_id, event_type AS source, 'user:' || user_id AS entity_key, sha256(event_type) AS content_hash, ts AS ready_at, CASE WHEN event_id % 17 = 0 THEN 'bootstrap_snapshot' ELSE 'live_increment' END AS observation_kind, event_id AS seq, value, user_id FROM events"


@register("daily_seal", f"""
WITH obs AS (
  SELECT 'ev:' || event_id AS item_id, event_type AS source, CASE WHEN event_id % 17 = 0 THEN 'bootstrap_snapshot' ELSE 'live_increment' END AS kind, ts AS ready_at FROM events
  UNION ALL SELECT 'doc:' || min(doc_id), arg_min('article:' || source, doc_id), 'live_increment', TIMESTAMP '2024-01-10' FROM documents GROUP BY sha256(text)
  UNION ALL SELECT 'page:' || page_id, 'article:web', 'live_increment', TIMESTAMP '2024-01-10' FROM pages
  UNION ALL SELECT 'x_list:' || conv_id || ':' || turn, 'x_list', 'live_increment', TIMESTAMP '2024-01-10' FROM conversations)
SELECT {GROUP_SQL} AS source_group, count(*) AS n_items, count(DISTINCT source) AS n_sources, min(item_id) AS first_item
FROM obs WHERE kind <> 'bootstrap_snapshot' AND ready_at < TIMESTAMP '2024-01-15' GROUP BY 1""")
def daily_seal(spark, sf):
    """Envelope, first-write dedup, pending cutoff, counts by source group."""
    ready = F.expr("TIMESTAMP_NTZ'2024-01-10'")
    docs = O.documents(spark, sf)
    docs = docs.groupBy("content_hash").agg(F.min_by(F.struct("item_id", "source", "observation_kind"), "seq").alias("r")).select("r.*")
    late = [d.select("item_id", "source", "observation_kind", ready.alias("ready_at")) for d in (docs, O.pages(spark, sf), O.posts(spark, sf))]
    items = O.events(spark, sf).select("item_id", "source", "observation_kind", "ready_at")
    for d in late:
        items = items.unionByName(d)
    due = O.grouped(L.pending(items, F.expr("TIMESTAMP_NTZ'2024-01-15'")))
    return due.groupBy("source_group").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("source").alias("n_sources"), F.min("item_id").alias("first_item"))


@register("put_items_first_write", "SELECT 'user:' || user_id AS item_id, arg_min(event_type, event_id) AS source, min(event_id) AS seq FROM events GROUP BY user_id")
def _(spark, sf):
    e = O.events(spark, sf).select(F.col("entity_key").alias("item_id"), "source", "seq")
    return L.first_write(e)


_PUT = """
WITH a AS (SELECT 'user:' || user_id AS item_id, sha256(event_type) AS h, event_id AS seq FROM events),
base AS (SELECT item_id, arg_min(h, seq) AS h, min(seq) AS seq FROM a GROUP BY item_id),
rev AS (SELECT a.item_id || ':rev:' || a.h[:12] AS item_id, min(a.seq) AS seq FROM a JOIN base b ON a.item_id = b.item_id WHERE a.h <> b.h GROUP BY 1)
SELECT item_id, 'live_increment' AS observation_kind, seq FROM base UNION ALL SELECT item_id, 'content_revision', seq FROM rev"""


def _arrivals(spark, sf):
    return O.events(spark, sf).select(F.col("entity_key").alias("item_id"), "content_hash", F.lit("live_increment").alias("observation_kind"), "seq")


@register("put_items_revisions", _PUT)
def _(spark, sf):
    return L.put_items(_arrivals(spark, sf)).select("item_id", "observation_kind", "seq")


@register("overlap_replay_idempotent", _PUT)
def _(spark, sf):
    """The second half of the arrivals replays the end of the first half; the union equals one pass."""
    a = _arrivals(spark, sf)
    middle = a.agg(F.max("seq")).first()[0] // 2
    first = L.put_items(a.where(F.col("seq") <= middle))
    return first.unionByName(L.put_items(a.where(F.col("seq") > middle - 300), first)).select("item_id", "observation_kind", "seq")


@register("pending_items_cutoff", f"SELECT item_id, ready_at FROM ({OBS_SQL}) WHERE observation_kind <> 'bootstrap_snapshot' AND ready_at < TIMESTAMP '2024-01-12'")
def _(spark, sf):
    return L.pending(O.events(spark, sf), F.expr("TIMESTAMP_NTZ'2024-01-12'")).select("item_id", "ready_at")


@register("pending_excl_delivered", f"SELECT item_id FROM ({OBS_SQL}) o WHERE observation_kind <> 'bootstrap_snapshot' AND ready_at < TIMESTAMP '2024-01-20' AND NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND 'ev:' || l_orderkey = o.item_id) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND 'ev:' || o_orderkey = o.item_id)")
def _(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    done = lines.join(orders.where("o_orderstatus = 'F'"), lines["l_orderkey"] == orders["o_orderkey"], "left_semi").select(F.concat(F.lit("ev:"), "l_orderkey").alias("item_id")).distinct()
    sealed = orders.where("o_orderstatus = 'P'").select(F.concat(F.lit("ev:"), "o_orderkey").alias("item_id"))
    return L.pending(O.events(spark, sf), F.expr("TIMESTAMP_NTZ'2024-01-20'"), done, sealed).select("item_id")


@register("seal_violations", """
SELECT DISTINCT 'ord:' || l_orderkey AS item_id, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'delivered' ELSE 'sealed' END AS problem
FROM (SELECT l_orderkey + CASE WHEN l_orderkey % 50 = 0 THEN 100000000 ELSE 0 END AS l_orderkey FROM lineitem) l
LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR o_orderstatus IN ('F', 'P')""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("ord:"), "o_orderkey").alias("item_id"), "o_orderstatus")
    key = F.col("l_orderkey") + F.when(F.col("l_orderkey") % 50 == 0, 100000000).otherwise(0)
    wanted = table(spark, sf, "lineitem").select(F.lit("run").alias("run_id"), F.concat(F.lit("ord:"), key).alias("item_id")).distinct()
    seals = o.where("o_orderstatus = 'P'").select("item_id", F.lit("other").alias("run_id"))
    return L.seal_violations(wanted, o, o.where("o_orderstatus = 'F'"), seals)


@register("ledger_repair_semi", """
SELECT l_orderkey || '-' || l_linenumber AS item_id FROM lineitem l WHERE l_returnflag <> 'N'
AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderstatus IN ('F', 'O'))""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"), F.col("l_orderkey").alias("run_id"), "l_returnflag")
    items = lines.select("item_id", F.when(F.col("l_returnflag") != "N", F.col("run_id")).alias("sealed_run_id"), F.lit(None).cast("long").alias("delivered_run_id"))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "queued").otherwise("sealed").alias("handoff_state"))
    return L.repair(items, lines.select("item_id", "run_id"), runs).select("item_id")


@register("mark_queued_in", "SELECT l_orderkey || '-' || l_linenumber AS item_id, l_orderkey AS run_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def _(spark, sf):
    seals = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"), F.col("l_orderkey").alias("run_id"))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("sealed").alias("handoff_state"))
    return L.delivered_by(seals, runs)


@register("sealed_unqueued_runs", "SELECT o_orderkey AS run_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P' ORDER BY created_at, run_id")
def _(spark, sf):
    """All of them, oldest first."""
    return table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at")).orderBy("created_at", "run_id")


@register("cursor_last_write", "SELECT event_type AS source, arg_max(event_id, ts) AS value FROM events GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("value"), F.col("ts").alias("seq"))
    return L.last_write(e, "source", "value")


_DAILY = "SELECT event_type AS source, CAST(ts AS DATE) AS seq, sum(CASE WHEN value > 95 THEN 1 ELSE 0 END)::BIGINT AS fetched_count FROM events GROUP BY ALL"


def _daily(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("seq")).agg(F.count_if(F.col("value") > 95).alias("fetched_count"))


@register("baseline_nonzero", f"SELECT source, arg_max(fetched_count, seq) AS baseline FROM ({_DAILY}) WHERE fetched_count > 0 GROUP BY source")
def _(spark, sf):
    return L.baselines(_daily(spark, sf))


@register("suspect_empty", f"""
WITH d AS ({_DAILY}), c AS (SELECT source, seq, CASE WHEN day(seq) % 3 = 0 THEN 0 ELSE fetched_count END AS fetched_count FROM d WHERE seq >= DATE '2024-01-20'),
b AS (SELECT source, arg_max(fetched_count, seq) AS baseline FROM d WHERE fetched_count > 0 AND seq < DATE '2024-01-20' GROUP BY source)
SELECT c.source, c.seq, CASE WHEN c.fetched_count = 0 AND coalesce(baseline, 0) > 0 AND day(c.seq) % 2 = 0 THEN 'failed' ELSE 'success' END AS status FROM c LEFT JOIN b USING (source)""")
def _(spark, sf):
    d = _daily(spark, sf)
    known = L.baselines(d.where("seq < DATE'2024-01-20'"))
    now = d.where("seq >= DATE'2024-01-20'").select("source", "seq", F.when(F.day("seq") % 3 == 0, 0).otherwise(F.col("fetched_count")).alias("fetched_count"), F.lit(False).alias("allow_empty"), F.when(F.day("seq") % 2 == 1, "holiday").alias("quiet_reason"), F.lit("success").alias("status"))
    return L.suspect_empty(now, known).select("source", "seq", "status")


@register("expire_split", "SELECT event_type, ts + INTERVAL 7 DAY < TIMESTAMP '2024-01-20' AS expired, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 7 DAYS"))
    gone, kept = L.split_expired(e, F.expr("TIMESTAMP_NTZ'2024-01-20'"))
    both = gone.withColumn("expired", F.lit(True)).unionByName(kept.withColumn("expired", F.lit(False)))
    return both.groupBy("event_type", "expired").agg(F.count(F.lit(1)).alias("n"))


@register("reclassify_bootstrap", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'bootstrap_snapshot' ELSE 'live_increment' END AS observation_kind, doc_id % 3 = 0 AS changed FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("article:"), "source").alias("source"), F.when(F.col("doc_id") % 3 == 0, F.expr("TIMESTAMP_NTZ'2024-01-01'")).otherwise(F.expr("TIMESTAMP_NTZ'2024-02-01'")).alias("handoff_at"), F.lit("live_increment").alias("observation_kind"))
    return L.reclassify_bootstrap(d, F.expr("TIMESTAMP_NTZ'2024-01-15'")).select("doc_id", "observation_kind", "changed")


@register("daily_gate", """
SELECT o_orderkey AS run_id FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT CAST(min(o_orderdate) AS DATE) FROM orders)
AND (o_orderstatus IN ('P', 'F') OR o_orderkey % 2 = 0)""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    day = o.agg(F.to_date(F.min("o_orderdate"))).first()[0]
    now = F.lit(day).cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "P", "sealed").otherwise("open").alias("handoff_state"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("running").alias("status"), (now - F.make_dt_interval(mins=F.when(F.col("o_orderkey") % 2 == 0, 5).otherwise(40))).alias("updated_at"))
    return L.daily_gate(runs, F.lit(day), now).select("run_id")


@register("watch_upsert", "SELECT user_id AS repo_id, min(CASE WHEN event_type = 'view' THEN ts END) AS first_seen_at, max(ts) AS last_checked_at, arg_max('r' || event_id, ts) AS full_name FROM events GROUP BY user_id HAVING min(CASE WHEN event_type = 'view' THEN ts END) IS NOT NULL")
def _(spark, sf):
    return L.watch_state(_sightings(spark, sf))


def _sightings(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("repo_id"), F.when(F.col("event_type") == "view", "early").otherwise("other").alias("lane"), F.col("ts").alias("observed_at"), F.concat(F.lit("r"), "event_id").alias("full_name"))


@register("watchlist_topk", """
WITH w AS (SELECT user_id AS repo_id, min(CASE WHEN event_type = 'view' THEN ts END) AS first_seen_at, max(ts) AS last_checked_at FROM events GROUP BY user_id)
SELECT repo_id, last_checked_at FROM w WHERE first_seen_at >= TIMESTAMP '2024-01-01 06:00:00' ORDER BY last_checked_at, repo_id LIMIT 20""")
def _(spark, sf):
    return L.watchlist(L.watch_state(_sightings(spark, sf)), F.expr("TIMESTAMP_NTZ'2024-01-01 06:00:00'"), 20).select("repo_id", "last_checked_at")


@register("marker_newest", "SELECT event_type || ':' || user_id AS event_key, arg_max(event_id, ts) AS event_id, max(ts) AS observed_at FROM events GROUP BY 1")
def _(spark, sf):
    return L.latest_marker(table(spark, sf, "events").select(F.concat_ws(":", "event_type", "user_id").alias("event_key"), "event_id", F.col("ts").alias("observed_at")))


@register("record_run_upsert", "SELECT user_id AS run_id, arg_min(CAST(ts AS DATE), event_id) AS date, arg_min(event_id % 7, event_id) AS attempt, arg_min('p' || event_id, event_id) AS path, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def _(spark, sf):
    return L.record_run(table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.to_date("ts").alias("date"), (F.col("event_id") % 7).alias("attempt"), F.concat(F.lit("p"), "event_id").alias("path"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")))


@register("next_attempt", "SELECT CAST(ts AS DATE) AS date, max(event_id % 40) + 1 AS next_attempt, lpad(CAST(max(event_id % 40) + 1 AS VARCHAR), 4, '0') AS name FROM events GROUP BY 1")
def _(spark, sf):
    return L.next_attempt(table(spark, sf, "events").select(F.to_date("ts").alias("date"), (F.col("event_id") % 40).alias("attempt")))


@register("latest_per_key", "SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY user_id")
def _(spark, sf):
    return L.latest_per_key(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), "user_id", "ts", "event_id")


def _asof(horizon):
    interval = {"6h": "6 HOUR", "24h": "24 HOUR", "7d": "168 HOUR"}[horizon]

    @register(f"asof_delta_{horizon}", f"SELECT e.event_id, round(e.value - b.value, 6) AS delta FROM events e ASOF LEFT JOIN events b ON e.user_id = b.user_id AND e.ts - INTERVAL {interval} >= b.ts")
    def _(spark, sf):
        out = E.as_of_deltas(table(spark, sf, "events").select("event_id", "ts", "user_id", "value"), "user_id", "ts", "event_id", "value", {horizon: E.HORIZONS[horizon]})
        return out.select("event_id", F.round(f"delta_{horizon}", 6).alias("delta"))


for _h in E.HORIZONS:
    _asof(_h)


@register("latest_prior", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events")
def _(spark, sf):
    return E.latest_prior(table(spark, sf, "events"), "user_id", "ts", "event_id", "value").select("event_id", "prior")


@register("threshold_crossing_once", """
WITH p AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, threshold, arg_min(event_id, ts) AS event_id, min(ts) AS ts FROM p, (SELECT unnest([20.0, 50.0, 95.0]::DOUBLE[]) AS threshold) WHERE prev < threshold AND value >= threshold GROUP BY ALL""")
def _(spark, sf):
    out = E.crossings(table(spark, sf, "events"), "user_id", "ts", "event_id", "value", [20.0, 50.0, 95.0])
    return out.select("user_id", "threshold", "event_id", "ts")


@register("lane_entry_first", "SELECT user_id, event_type, arg_min(event_id, ts) AS event_id, min(ts) AS ts FROM events GROUP BY ALL")
def _(spark, sf):
    return E.first_per_lane(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id")


@register("attr_change", """
WITH p AS (SELECT *, lag(o_orderstatus) OVER w AS b1, lag(o_orderpriority) OVER w AS b2, lag(o_orderkey) OVER w AS b0 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, (o_orderstatus <> b1)::INT + (o_orderpriority <> b2)::INT AS n_changed, CASE WHEN o_orderstatus <> b1 THEN b1 END AS status_before, CASE WHEN o_orderstatus <> b1 THEN o_orderstatus END AS status_after
FROM p WHERE b0 IS NOT NULL AND (o_orderstatus <> b1 OR o_orderpriority <> b2)""")
def _(spark, sf):
    out = E.changes(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    status = F.try_element_at("changed", F.lit("o_orderstatus"))
    return out.select("o_orderkey", F.size("changed").alias("n_changed"), status["before"].alias("status_before"), status["after"].alias("status_after"))


@register("release_change", "SELECT o_orderkey, prev AS was, o_orderpriority AS now FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL AND prev <> o_orderpriority")
def _(spark, sf):
    out = E.changes(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey", ["o_orderpriority"])
    return out.select("o_orderkey", F.element_at("changed", "o_orderpriority")["before"].alias("was"), F.col("o_orderpriority").alias("now"))


@register("growth_cooldown", """
WITH RECURSIVE c AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value > 50),
w(user_id, n, ts, event_id) AS (
  SELECT user_id, n, ts, event_id FROM c WHERE n = 1
  UNION ALL
  SELECT x.user_id, x.n, x.ts, x.event_id FROM (
    SELECT c.user_id, c.n, c.ts, c.event_id, row_number() OVER (PARTITION BY c.user_id ORDER BY c.n) AS r
    FROM w JOIN c ON c.user_id = w.user_id AND c.n > w.n AND c.ts >= w.ts + INTERVAL 24 HOUR) x WHERE r = 1)
SELECT user_id, event_id, ts FROM w""")
def _(spark, sf):
    c = table(spark, sf, "events").where("value > 50").select("user_id", "event_id", "ts")
    return E.with_cooldown(c, "user_id", "ts", "event_id", 24 * E.HOUR)


@register("growth_horizons", """
WITH d AS (SELECT e.event_id, e.value, e.value - a.value AS d6, e.value - b.value AS d24, lag(e.value) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS prior
  FROM events e ASOF LEFT JOIN events a ON e.user_id = a.user_id AND e.ts - INTERVAL 6 HOUR >= a.ts ASOF LEFT JOIN events b ON e.user_id = b.user_id AND e.ts - INTERVAL 24 HOUR >= b.ts)
SELECT event_id, CASE WHEN d6 >= 25 THEN '6h,' ELSE '' END || CASE WHEN d24 >= 40 THEN '24h,' ELSE '' END AS horizons FROM d WHERE (d6 >= 25 OR d24 >= 40) AND value > prior""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    d = E.latest_prior(E.as_of_deltas(e, "user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id", "value")
    out = E.growth_candidates(d, "value", "prior", {"6h": 25, "24h": 40})
    return out.select("event_id", F.concat(F.array_join("horizons", ","), F.lit(",")).alias("horizons"))


@register("failure_cooldown", """
WITH f AS (SELECT event_id, user_id, ts, (value < 40)::INT AS failed FROM events),
g AS (SELECT *, sum(1 - failed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f)
SELECT event_id, sum(failed) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS failures, sum(failed) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) >= 2 AS cooling FROM g""")
def _(spark, sf):
    return E.failure_cooldown(table(spark, sf, "events"), "user_id", "ts", "event_id", F.col("value") < 40).select("event_id", "failures", "cooling")


ONE_SERIES = 2_000  # rows of a chunk: all events as one series lie in as many chunks as tasks should share it


@register("asof_one_series", """
WITH b AS (SELECT ts, arg_max(value, event_id) AS value FROM events GROUP BY ts)
SELECT e.event_id, round(e.value - h.value, 6) AS delta_6h, round(e.value - d.value, 6) AS delta_24h FROM events e
ASOF LEFT JOIN b h ON e.ts - INTERVAL 6 HOUR >= h.ts ASOF LEFT JOIN b d ON e.ts - INTERVAL 24 HOUR >= d.ts""")
def _(spark, sf):
    """As-of deltas with all events as one hot entity."""
    e = table(spark, sf, "events").select("event_id", "ts", "value", F.lit("all").alias("entity"))
    out = E.as_of_deltas(e, "entity", "ts", "event_id", "value", {h: E.HORIZONS[h] for h in ("6h", "24h")}, ONE_SERIES)
    return out.select("event_id", *(F.round(f"delta_{h}", 6).alias(f"delta_{h}") for h in ("6h", "24h")))


@register("prior_one_series", """
WITH b AS (SELECT ts, arg_max(value, event_id) AS value FROM events GROUP BY ts)
SELECT e.event_id, b.value AS prior FROM events e ASOF LEFT JOIN b ON e.ts > b.ts""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "value", F.lit(0).alias("entity"))
    return E.latest_prior(e, "entity", "ts", "event_id", "value", ONE_SERIES).select("event_id", "prior")


@register("changes_one_series", "SELECT event_id, was, event_type AS now FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY ts, event_id) AS was FROM events) WHERE was <> event_type")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "event_type", F.lit(0).alias("entity"))
    out = E.changes(e, "entity", "ts", "event_id", ["event_type"], ONE_SERIES)
    return out.select("event_id", F.element_at("changed", "event_type")["before"].alias("was"), F.col("event_type").alias("now"))


@register("failures_one_series", """
WITH g AS (SELECT event_id, ts, (value < 70)::INT AS failed, sum(1 - (value < 70)::INT) OVER (ORDER BY ts, event_id) AS island FROM events)
SELECT event_id, sum(failed) OVER (PARTITION BY island ORDER BY ts, event_id)::BIGINT AS failures, sum(failed) OVER (PARTITION BY island ORDER BY ts, event_id) >= 2 AS cooling FROM g""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "value", F.lit(0).alias("entity"))
    return E.failure_cooldown(e, "entity", "ts", "event_id", F.col("value") < 70, chunk_rows=ONE_SERIES).select("event_id", "failures", "cooling")


@register("cooldown_one_series", """
WITH RECURSIVE c AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT c.event_id, c.ts, c.n, d.n AS following FROM c ASOF LEFT JOIN (SELECT ts, min(n) AS n FROM c GROUP BY ts) d ON c.ts + INTERVAL 6 HOUR <= d.ts),
w(n, event_id, ts, following) AS (SELECT n, event_id, ts, following FROM s WHERE n = 1 UNION ALL SELECT s.n, s.event_id, s.ts, s.following FROM w JOIN s ON s.n = w.following)
SELECT event_id, ts FROM w""")
def _(spark, sf):
    """All events as one hot entity: an event is accepted six hours after the last accepted one."""
    e = table(spark, sf, "events").select("event_id", "ts", F.lit(0).alias("entity"))
    return E.with_cooldown(e, "entity", "ts", "event_id", 6 * E.HOUR, ONE_SERIES).select("event_id", "ts")


@register("observed_rank", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events QUALIFY rank <= 5")
def _(spark, sf):
    return S.capped_in_order(table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id", 5).select("event_id", F.col("rank").cast("long").alias("rank"))


@register("newest_n_pinned", """
SELECT event_id, pinned OR row_number() OVER (PARTITION BY user_id ORDER BY pinned DESC, ts DESC, event_id) <= 3 AS kept FROM (SELECT *, event_type = 'purchase' AS pinned FROM events)""")
def _(spark, sf):
    return S.keep_newest(table(spark, sf, "events"), "user_id", "ts", "event_id", F.col("event_type") == "purchase", 3).select("event_id", "kept")


@register("nulls_last_topn", "SELECT event_id, t FROM (SELECT event_id, CASE WHEN event_id % 1000 = 0 THEN ts END AS t FROM events) ORDER BY t DESC NULLS LAST, event_id LIMIT 200")
def _(spark, sf):
    """The newest 200 of all events (the feature), most of them without a time."""
    return S.top_newest(table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 1000 == 0, F.col("ts")).alias("t")), "t", "event_id", 200)


@register("bootstrap_newest_index", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events ORDER BY ts DESC, event_id LIMIT 5000")
def _(spark, sf):
    e = table(spark, sf, "events").orderBy(F.desc("ts"), "event_id").limit(5000)
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("bounded_scan", "SELECT event_type, p + 1 AS first, least(m, p + 20000) AS last, greatest(m - least(m, p + 20000), 0) AS backlog FROM (SELECT event_type, min(event_id) AS p, max(event_id) * 9 AS m FROM events GROUP BY 1)")
def _(spark, sf):
    from stratal.functions.times import bounded_scan

    e = table(spark, sf, "events").groupBy("event_type").agg(F.min("event_id").alias("p"), (F.max("event_id") * 9).alias("m"))
    return e.select("event_type", bounded_scan("p", "m", 20000).alias("s")).select("event_type", "s.*")


@register("contiguous_cursor", """
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) FILTER (value > 99.5) = 0 AS ok FROM events GROUP BY ALL),
g AS (SELECT event_type, min(day) FILTER (NOT ok) AS bad, min(day) AS low, max(day) AS high FROM d GROUP BY 1)
SELECT event_type, CASE WHEN bad IS NULL THEN high WHEN bad > low THEN CAST(bad - 1 AS DATE) END AS cursor FROM g""")
def _(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg((F.count_if(F.col("value") > 99.5) == 0).alias("ok"))
    return S.contiguous_cursor(d, "event_type", "day", "ok")


@register("late_arrival_kind", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'content_revision' WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN 'bootstrap_snapshot' WHEN doc_id % 4 = 1 THEN 'late_arrival' ELSE 'live_increment' END AS kind,
CASE WHEN doc_id % 5 = 0 THEN 'updated' WHEN doc_id % 5 = 1 THEN 'observed' ELSE 'occurred' END AS time_basis,
CASE WHEN doc_id % 6 = 0 THEN 'extraction_failed' WHEN doc_id % 6 = 1 THEN 'preview' ELSE 'full' END AS content_status FROM documents""")
def _(spark, sf):
    """Kind, time basis and content status of an article from its previous hash, age, first poll and texts."""
    from stratal.operators.classify import article_kind, article_status, time_basis

    d = table(spark, sf, "documents")
    now = F.expr("TIMESTAMP_NTZ'2024-02-01'")
    occurred = F.when(F.col("doc_id") % 4 == 1, F.expr("TIMESTAMP_NTZ'2024-01-01'")).otherwise(now)
    return d.select(
        "doc_id",
        article_kind(F.when(F.col("doc_id") % 4 == 0, "h"), occurred, now, F.expr("INTERVAL 7 DAYS"), F.col("doc_id") % 3 == 0).alias("kind"),
        time_basis(F.col("doc_id") % 5 == 0, F.col("doc_id") % 5 != 1).alias("time_basis"),
        article_status(F.when(F.col("doc_id") % 6 > 1, F.col("text")), F.when(F.col("doc_id") % 6 == 1, "t")).alias("content_status"),
    )


@register("topic_score_argmax", f"""
WITH s AS (SELECT source, doc_id, {' + '.join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in ["the", "and", "ation"])} AS score FROM documents)
SELECT source, arg_max(doc_id, (score, doc_id)) AS doc_id FROM s GROUP BY source""")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("score", X.topic_score("text", ["the", "and", "ation"]))
    return S.argmax(d, "source", "doc_id", "score", "doc_id")
