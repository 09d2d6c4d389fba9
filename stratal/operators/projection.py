"""Projections of observations for readers with a bounded context: one select, whatever the family of the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratal.functions.text import error_class, truthy

PAYLOAD = (
    "url string, hn_url string, author string, text string, text_preview string, quoted_text string, references array<string>, expanded_links array<string>, links array<string>,"
    " full_name string, description string, snapshot struct<stars:long>, star_deltas map<string,long>, topics array<string>, event string, latest_release string, readme_preview string,"
    " arxiv_id string, title string, abstract string, summary string, hf_ai_summary string, categories array<string>, upvotes long, feed_summary string, score long, comments long, surfaces array<string>"
)
# The longest texts of each family, in code points.
CAPS = {"post": 1200, "quoted": 800, "description": 800, "readme": 1200, "abstract": 2000, "short": 1000, "article": 1800, "feed": 1200}


def family(source: Column) -> Column:
    return F.when(source.isin("x_list", "x_for_you"), "post").when(source == "github", "repository").when(source.isin("arxiv", "huggingface"), "paper").otherwise("article")


def compact(items: DataFrame) -> DataFrame:
    """item_id, source, change, occurred_at, family, url and the members that the family of the source has; all others are null.

    items: item_id, source, change, occurred_at, payload (JSON text; null or broken: no members). Of a chain the first
    member that is there and not empty counts; texts without any are empty, lists too.
    """
    p = items.select("item_id", "source", "change", "occurred_at", family(F.col("source")).alias("family"), F.from_json("payload", PAYLOAD).alias("p"))
    m = lambda name: F.col(f"p.{name}")
    text = lambda cap, *names: F.left(F.coalesce(truthy(*(m(n) for n in names)), F.lit("")), F.lit(CAPS[cap]))
    listed = lambda *names: F.coalesce(*(F.when(F.size(m(n)) > 0, m(n)) for n in names), F.expr("CAST(array() AS array<string>)"))
    of = {
        "post": {"author": m("author"), "text": text("post", "text"), "quoted_text": text("quoted", "quoted_text"), "references": listed("references"), "links": listed("expanded_links", "links")},
        "repository": {"full_name": m("full_name"), "description": text("description", "description"), "stars": m("snapshot.stars"), "star_deltas": m("star_deltas"), "topics": listed("topics"), "event": m("event"), "release": m("latest_release"), "readme_preview": text("readme", "readme_preview")},
        "paper": {"arxiv_id": m("arxiv_id"), "title": m("title"), "abstract": text("abstract", "abstract", "summary"), "hf_summary": text("short", "hf_ai_summary"), "categories": listed("categories"), "upvotes": m("upvotes")},
        "article": {"title": m("title"), "text": text("article", "text", "text_preview"), "summary": text("feed", "feed_summary", "description"), "score": m("score"), "comments": m("comments"), "surfaces": listed("surfaces")},
    }
    members: dict[str, Column] = {}
    for kind, named in of.items():
        for name, value in named.items():
            case = members.get(name, F)
            members[name] = case.when(F.col("family") == kind, value)
    return p.select("item_id", "source", "change", "occurred_at", "family", truthy(m("url"), m("hn_url")).alias("url"), *(c.alias(n) for n, c in members.items()))


def run_summary(runs: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, exit_code, thread_id, usage, event_count, error_class, error of runs (run_id, exit_code, error).

    events (run_id, seq, thread_id, tokens): the last thread that was named, the sum of tokens, and how many there
    were; a run without events has none of them. A run without an error has no class of error.
    """
    named = F.max_by("thread_id", F.when(F.col("thread_id").isNotNull(), F.col("seq")))
    seen = events.groupBy("run_id").agg(named.alias("thread_id"), F.sum("tokens").alias("usage"), F.count(F.lit(1)).alias("event_count"))
    kind = F.when(F.coalesce(F.trim("error"), F.lit("")) != "", error_class(F.col("error")))
    return runs.join(seen, "run_id", "left").select("run_id", "exit_code", "thread_id", "usage", F.coalesce("event_count", F.lit(0).cast("long")).alias("event_count"), kind.alias("error_class"), "error")
