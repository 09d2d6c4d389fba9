"""Kinds, statuses and changes of observations as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def article_kind(previous_hash: Column, occurred: Column, now: Column, bootstrap_age: Column, first_poll: Column) -> Column:
    """A revision if there was content before; an old row is a snapshot on the first poll and late afterwards."""
    old = occurred < now - bootstrap_age
    return F.when(previous_hash.isNotNull(), "content_revision").when(old & first_poll, "bootstrap_snapshot").when(old, "late_arrival").otherwise("live_increment")


def paper_kind(requested: Column, today: Column) -> Column:
    """A paper of a day before today's was listed late."""
    return F.when(requested < today, "late_arrival").otherwise("live_increment")


def time_basis(updated: Column, has_time: Column) -> Column:
    return F.when(updated, "updated").when(has_time, "occurred").otherwise("observed")


def article_status(clean_text: Column, preview: Column) -> Column:
    return F.when(F.coalesce(clean_text, F.lit("")) != "", "full").when(F.coalesce(preview, F.lit("")) != "", "preview").otherwise("extraction_failed")


def story_status(deleted: Column, dead: Column) -> Column:
    return F.when(F.coalesce(deleted, F.lit(False)) | F.coalesce(dead, F.lit(False)), "tombstone").otherwise("full")


def paper_item_id(paper: Column, version: Column, explicit: Column, announce: Column, at: Column) -> Column:
    """Version ids, stamped ids for replacements and withdrawals without a version, dated ids for cross-lists."""
    return (
        F.when(announce.isin("replace", "withdraw") & ~explicit, F.concat(F.lit("arxiv:"), paper, F.lit(":"), announce, F.lit(":"), F.date_format(at, "yyyyMMdd'T'HHmmss")))
        .when(announce.isin("cross", "cross-list"), F.concat(F.lit("arxiv:"), paper, F.lit(":cross:"), F.date_format(at, "yyyyMMdd")))
        .otherwise(F.concat(F.lit("arxiv:"), paper, F.lit(":v"), version))
    )


def paper_change(version: Column, announce: Column) -> Column:
    return F.when(announce == "withdraw", "withdrawn").when((announce == "replace") | (version > 1), "version").when(announce.isin("cross", "cross-list"), "cross_listed").otherwise("announced")


def disposition(kind: Column) -> Column:
    return F.when(kind == "investigate", "r").when(kind == "supporting", "w").otherwise("n")


def report_kind(path: Column) -> Column:
    """Layout by the report's name; an unknown one is an error."""
    return F.when(path.endswith("/main_report.md"), "main_report_v1").when(path.endswith("/report.md"), "legacy_v3").when(path.rlike(r"\.md$"), "legacy_v2").otherwise(F.raise_error(F.concat(F.lit("unknown report layout: "), path)))
