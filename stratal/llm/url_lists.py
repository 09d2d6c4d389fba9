"""Temporal list join: dated list entries as validity intervals, every capture judged by the entries active when it was fetched.

DataFrame functions only. An entry names a host (and all hosts below it) or a path prefix of a host, the list it is
on (block or allow), a date and whether it is added or removed on that date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]*)"  # an IPv6 address stands in brackets
RESULTS = ("host", "n_active", "verdict", "kept")
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def validity_intervals(entries: DataFrame) -> DataFrame:
    """list, kind, pattern, valid_from, valid_to (exclusive, null: still valid) from list, kind, pattern, action, day.

    Entries of one pattern and day count once and a removal wins over an addition on the same day, so a pattern has
    at most one row a day before the window looks for its next event. Rows with a null in any of the five are left out.
    """
    whole = entries.select("list", "kind", "pattern", "action", F.col("day").cast("date").alias("day")).dropna()
    daily = whole.where(F.col("action").isin("add", "remove")).groupBy("list", "kind", F.lower("pattern").alias("pattern"), "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(Window.partitionBy("list", "kind", "pattern").orderBy("day"))
    return daily.select("list", "kind", "pattern", "action", F.col("day").alias("valid_from"), following.alias("valid_to")).where("action = 'add'").drop("action")


def capture_keys(captures: DataFrame, depth: int) -> DataFrame:
    """kind and pattern of everything an entry could say about a capture: its host and those above, prefixes up to depth segments."""
    host = F.rtrim(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("."))
    labels = F.split("host", "\\.")
    segments = F.filter(F.split(F.lower(F.regexp_extract("url", PATH, 1)), "/"), lambda x: x != "")
    parts = captures.withColumn("host", host).select("url", "day", "host", labels.alias("labels"), F.slice(segments, 1, max(depth, 1)).alias("segments"))
    hosts = F.transform("labels", lambda _, i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice("labels", i + 1, F.size("labels") - i), ".").alias("pattern")))
    prefixes = F.transform("segments", lambda _, i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", "host", F.array_join(F.slice("segments", F.lit(1), i + 1), "/")).alias("pattern")))
    return parts.where("host <> ''").select("url", "day", F.explode(F.concat(hosts, prefixes)).alias("key")).select("url", "day", "key.kind", "key.pattern")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row of captures (url, day, any other columns) with host, n_active, verdict ('allow', 'block' or 'none') and kept.

    The most specific active entry (the longest pattern) decides; allow wins over block on equal ones. Distinct
    (url, day) pairs are judged, so copies of a capture are joined once. Intervals are cut by month and joined on
    (kind, pattern, month): a hot pattern is an equi-join that Spark may split, and a capture meets the few intervals
    of its month only. A null or relative url has no host, a null day no active entry: verdict none, kept. Repeated
    rows stay repeated, an empty table of captures gives no rows, an empty one of entries verdict none everywhere; urls
    are read whole. A column of captures that is named like one of the four results comes back as capture_<name>.
    """
    clashing = {c: f"capture_{c}" for c in captures.columns if c.lower() in RESULTS}
    captures = captures.withColumnsRenamed(clashing).withColumn("day", F.col("day").cast("date"))
    intervals = validity_intervals(entries)
    depth = intervals.where("kind = 'prefix'").agg(F.max(F.size(F.split("pattern", "/"))).alias("d")).first()["d"]
    last = captures.agg(F.max("day").alias("d")).first()["d"]
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last)), F.lit(last))
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))
    monthly = intervals.where(F.col("valid_from") <= end).select("list", "kind", "pattern", "valid_from", "valid_to", F.explode(months).alias("month"))
    pairs = captures.select("url", "day").where("url IS NOT NULL AND day IS NOT NULL").distinct()
    keys = capture_keys(pairs, (depth or 1) - 1).withColumn("month", F.trunc("day", "month"))
    active = keys.join(monthly, ["kind", "pattern", "month"]).where("valid_from <= day AND (valid_to IS NULL OR day < valid_to)")
    best = F.max(F.struct(F.length("pattern").alias("specific"), F.col("kind").alias("k"), (F.col("list") == "allow").alias("allowed")))
    verdicts = active.groupBy("url", "day").agg(F.count(F.lit(1)).alias("n_active"), best.alias("best")).select("url", "day", "n_active", F.when(F.col("best.allowed"), "allow").otherwise("block").alias("verdict"))
    out = captures.join(verdicts, ["url", "day"], "left")
    verdict = F.coalesce("verdict", F.lit("none"))
    return out.withColumns({"host": F.coalesce(F.rtrim(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(".")), F.lit("")), "n_active": F.coalesce("n_active", F.lit(0)), "verdict": verdict, "kept": verdict != "block"})


def demonstration_entries(pages: DataFrame) -> DataFrame:
    """Dated entries made by rule from the hosts of pages: there is no list table among the inputs."""
    hosts = pages.select(F.lower(F.regexp_extract("url", HOST, 1)).alias("host")).where("host <> ''").distinct()
    first = F.expr("DATE'2024-01-01'") + (F.col("h") % 200).cast("int")
    row = lambda name, kind, pattern, action, day, when: F.when(when, F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day.alias("day")))
    host = F.col("host")
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long"))
    parent = F.substring_index("host", ".", -2)
    rows = F.array(
        row("block", "host", host, "add", first, F.col("h") % 3 == 0),
        row("block", "host", host, "remove", first + (30 + F.col("h") % 90).cast("int"), F.col("h") % 6 == 0),
        row("block", "host", host, "add", first + (140 + F.col("h") % 40).cast("int"), F.col("h") % 30 == 0),
        row("block", "host", parent, "add", F.expr("DATE'2024-02-01'"), F.col("h") % 2 == 0),
        row("block", "host", parent, "remove", F.expr("DATE'2024-03-15'"), F.col("h") % 2 == 0),
        row("allow", "prefix", F.concat("host", F.lit("/en")), "add", first + F.lit(15), F.col("h") % 4 == 0),
        row("allow", "host", host, "add", F.expr("DATE'2024-02-10'"), F.col("h") % 7 == 0),
        row("block", "prefix", F.concat("host", F.lit("/de")), "add", first, F.col("h") % 5 == 0),
    )
    return hosts.select(F.explode(rows).alias("e")).where("e IS NOT NULL").select("e.*")


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, url, day: a fetch day by rule, as pages carry none."""
    return pages.select("page_id", "url", (F.expr("DATE'2024-01-01'") + (F.col("page_id") % 365).cast("int")).alias("day"))


SQL = r"""
WITH hosts AS (
  SELECT *, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS h FROM (
    SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host FROM pages) WHERE host <> ''),
dated AS (SELECT *, DATE '2024-01-01' + CAST(h % 200 AS INT) AS first, array_to_string(split(host, '.')[-2:], '.') AS parent FROM hosts),
entries AS (
  SELECT 'block' AS list, 'host' AS kind, host AS pattern, 'add' AS action, first AS day FROM dated WHERE h % 3 = 0
  UNION ALL SELECT 'block', 'host', host, 'remove', first + CAST(30 + h % 90 AS INT) FROM dated WHERE h % 6 = 0
  UNION ALL SELECT 'block', 'host', host, 'add', first + CAST(140 + h % 40 AS INT) FROM dated WHERE h % 30 = 0
  UNION ALL SELECT 'block', 'host', parent, 'add', DATE '2024-02-01' FROM dated WHERE h % 2 = 0
  UNION ALL SELECT 'block', 'host', parent, 'remove', DATE '2024-03-15' FROM dated WHERE h % 2 = 0
  UNION ALL SELECT 'allow', 'prefix', host || '/en', 'add', first + 15 FROM dated WHERE h % 4 = 0
  UNION ALL SELECT 'allow', 'host', host, 'add', DATE '2024-02-10' FROM dated WHERE h % 7 = 0
  UNION ALL SELECT 'block', 'prefix', host || '/de', 'add', first FROM dated WHERE h % 5 = 0),
daily AS (SELECT list, kind, lower(pattern) AS pattern, day, max(action) AS action FROM entries GROUP BY ALL),
intervals AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS valid_to FROM daily) WHERE action = 'add'),
captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INT) AS day,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.') AS host,
    list_filter(split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '') AS segments FROM pages),
keys AS (
  SELECT page_id, day, 'host' AS kind, unnest(list_transform(range(1, len(split(host, '.')) + 1), lambda i: array_to_string(split(host, '.')[i:], '.'))) AS pattern FROM captures WHERE host <> ''
  UNION ALL SELECT page_id, day, 'prefix', host || '/' || segments[1] FROM captures WHERE host <> '' AND len(segments) > 0),
matched AS (
  SELECT k.page_id, count(*) AS n_active, max({'s': length(k.pattern), 'k': k.kind, 'a': i.list = 'allow'}) AS best
  FROM keys k JOIN intervals i ON k.kind = i.kind AND k.pattern = i.pattern AND i.day <= k.day AND (i.valid_to IS NULL OR k.day < i.valid_to) GROUP BY k.page_id)
SELECT c.page_id, c.url, c.day, c.host, coalesce(m.n_active, 0) AS n_active,
  CASE WHEN m.page_id IS NULL THEN 'none' WHEN m.best.a THEN 'allow' ELSE 'block' END AS verdict, NOT coalesce(m.page_id IS NOT NULL AND NOT m.best.a, FALSE) AS kept
FROM captures c LEFT JOIN matched m USING (page_id)
"""
