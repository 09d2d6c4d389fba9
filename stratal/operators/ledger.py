"""The append-only ledger: observations, seals, deliveries, cursors and baselines as logs with latest-by-key views.

Nothing is updated in place. A log row carries its arrival number `seq`; the state of a key is what its rows say
together. Every operator here is one shuffle on the key (or a join with the current state) and idempotent: applied
twice it gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratal.sources.shared import written

HASH_DIGITS = 12
TERMINAL = ["queued", "local_complete", "published"]


def first_write(arrivals: DataFrame, key: str = "item_id", seq: str = "seq") -> DataFrame:
    """The first row of each key: insert-or-ignore of a batch, by minima that combine before the shuffle."""
    row = F.struct(F.col(seq).alias("__seq"), *[F.col(c) for c in arrivals.columns])
    first = arrivals.groupBy(F.col(key).alias("__key")).agg(F.min_by(row, F.col(seq)).alias("r"))
    return first.select(*[F.col("r").getField(c).alias(c) for c in arrivals.columns])


def put_items(arrivals: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows to append: the first of each new item, and a revision for each other content of an item.

    A later row whose non-null hash differs from a non-null hash of the item's first row is a revision
    `id:rev:<12 digits>` of kind content_revision, once for each 12 digits; always measured against the first row, so
    going back to it adds nothing. arrivals and existing: item_id, content_hash, observation_kind, seq and others.
    """
    base = first_write(arrivals)
    if existing is not None:
        known = existing.where(~F.col("item_id").contains(":rev:")).select("item_id", F.col("content_hash").alias("__base"), F.lit(True).alias("__known"))
        base_hash = base.select("item_id", F.col("content_hash").alias("__own")).join(known, "item_id", "left").select("item_id", F.when(F.col("__known"), F.col("__base")).otherwise(F.col("__own")).alias("base_hash"), F.coalesce("__known", F.lit(False)).alias("__known"))
        fresh = base.join(known.select("item_id"), "item_id", "left_anti")
    else:
        base_hash = base.select("item_id", F.col("content_hash").alias("base_hash"))
        fresh = base
    changed = arrivals.join(base_hash.select("item_id", "base_hash"), "item_id").where("content_hash IS NOT NULL AND base_hash IS NOT NULL AND content_hash <> base_hash").drop("base_hash")
    revisions = changed.withColumns({"item_id": F.concat("item_id", F.lit(":rev:"), F.left("content_hash", F.lit(HASH_DIGITS))), "observation_kind": F.lit("content_revision")})
    revisions = first_write(revisions.select(arrivals.columns))
    if existing is not None:
        revisions = revisions.join(existing.select("item_id"), "item_id", "left_anti")
    return fresh.select(arrivals.columns).unionByName(revisions)


def pending(items: DataFrame, cutoff, delivered: DataFrame | None = None, sealed: DataFrame | None = None) -> DataFrame:
    """Undelivered, unsealed rows that were ready before the cutoff and are no bootstrap snapshots; no lower bound."""
    out = items.where((F.col("observation_kind") != "bootstrap_snapshot") & (F.col("ready_at") < cutoff))
    for log in (delivered, sealed):
        if log is not None:
            out = out.join(log.select("item_id"), "item_id", "left_anti")
    return out


def seal_violations(wanted: DataFrame, items: DataFrame, deliveries: DataFrame, seals: DataFrame) -> DataFrame:
    """item_id, problem of what keeps a run (run_id, item_id) from being sealed; empty means the whole run may be."""
    known = items.select("item_id", F.lit(True).alias("known"))
    done = deliveries.select("item_id", F.lit(True).alias("done")).distinct()
    held = seals.select("item_id", F.col("run_id").alias("holder"))
    joined = wanted.join(known, "item_id", "left").join(done, "item_id", "left").join(held, "item_id", "left")
    problem = F.when(F.col("known").isNull(), "unknown").when(F.col("done"), "delivered").when(F.col("holder") != F.col("run_id"), "sealed")
    return joined.select("item_id", problem.alias("problem")).where("problem IS NOT NULL").distinct()


def seal(wanted: DataFrame, items: DataFrame, deliveries: DataFrame, seals: DataFrame) -> DataFrame:
    """The seal rows to append; raises without appending anything if the run can't have all of its items.

    Rows that are known, not delivered and not sealed are the ones to append, found once and kept in the shared folder. Only
    where some rows are not among them is it asked whether the run has these already or may not have them.
    """
    new = wanted.select("run_id", "item_id").join(items.select("item_id"), "item_id", "left_semi")
    for log in (deliveries, seals):
        new = new.join(log.select("item_id"), "item_id", "left_anti")
    new = written(new, "seal")
    if new.count() < wanted.count():
        # ordered, as a bare limit looks for its rows in one partition, then in four, and so on
        bad = seal_violations(wanted, items, deliveries, seals).orderBy("item_id", "problem").limit(5).collect()
        if bad:
            kind = KeyError if any(r["problem"] == "unknown" for r in bad) else RuntimeError
            raise kind(f"the run can't be sealed: {[tuple(r) for r in bad]}")
    return new


def delivered_by(seals: DataFrame, runs: DataFrame) -> DataFrame:
    """Deliveries that follow from seals of runs in a terminal state: item_id, run_id."""
    return seals.join(runs.where(F.col("handoff_state").isin(TERMINAL)).select("run_id"), "run_id", "left_semi").select("item_id", "run_id")


def repair(items: DataFrame, run_items: DataFrame, runs: DataFrame) -> DataFrame:
    """Sealed, undelivered items whose run is complete and lists them."""
    complete = run_items.join(runs.where(F.col("handoff_state").isin(TERMINAL)).select("run_id"), "run_id", "left_semi")
    return items.where("delivered_run_id IS NULL AND sealed_run_id IS NOT NULL").join(complete, (items["sealed_run_id"] == complete["run_id"]) & (items["item_id"] == complete["item_id"]), "left_semi")


def next_state(state: str, event: str) -> tuple[str, bool]:
    """(state after the event, whether anything changes); raises for an event that the state doesn't allow."""
    target = {"queue": "queued", "complete_locally": "local_complete", "publish": "published"}[event]
    if state == target:
        return state, False
    if state != "sealed":
        raise RuntimeError(f"{event} is not allowed in state {state}")
    return target, True


def last_write(log: DataFrame, key: str, value: str, seq: str = "seq") -> DataFrame:
    """The latest value of each key."""
    return log.groupBy(key).agg(F.max_by(value, seq).alias(value))


def baselines(counts: DataFrame) -> DataFrame:
    """source, baseline: the last count that is not zero (source, fetched_count, seq)."""
    return counts.where("fetched_count > 0").groupBy("source").agg(F.max_by("fetched_count", "seq").alias("baseline"))


def suspect_empty(current: DataFrame, known: DataFrame) -> DataFrame:
    """Adds the status of sources that fetched nothing although they have a baseline and no reason to be quiet."""
    joined = current.join(known, "source", "left")
    suspect = (F.col("fetched_count") == 0) & (F.coalesce("baseline", F.lit(0)) > 0) & ~F.col("allow_empty") & F.col("quiet_reason").isNull()
    return joined.withColumn("status", F.when(suspect, "failed").otherwise(F.col("status")))


def reclassify_bootstrap(items: DataFrame, before) -> DataFrame:
    """Undelivered article rows that happened before their first sighting's horizon become bootstrap snapshots."""
    old = F.col("source").startswith("article:") & (F.col("handoff_at") < before) & (F.col("observation_kind") == "live_increment")
    return items.withColumns({"changed": old, "observation_kind": F.when(old, "bootstrap_snapshot").otherwise(F.col("observation_kind"))})


def split_expired(items: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(rows past their expiry, rows to keep)."""
    expired = F.coalesce(F.col("expires_at") < now, F.lit(False))
    return items.where(expired), items.where(~expired)


def watch_state(sightings: DataFrame) -> DataFrame:
    """repo_id, first_seen_at, last_checked_at, full_name: first sighting in the early lane, latest check and name."""
    return sightings.groupBy("repo_id").agg(F.min(F.when(F.col("lane") == "early", F.col("observed_at"))).alias("first_seen_at"), F.max("observed_at").alias("last_checked_at"), F.max_by("full_name", F.struct("observed_at", "full_name")).alias("full_name")).where("first_seen_at IS NOT NULL")


def watchlist(state: DataFrame, since, limit: int) -> DataFrame:
    """The `limit` least recently checked of those first seen since then; none for a limit of 0 or less."""
    return state.where(F.col("first_seen_at") >= since).orderBy("last_checked_at", "repo_id").limit(max(0, limit))


def latest_marker(markers: DataFrame) -> DataFrame:
    """event_key, event_id, observed_at: the newest marker of each key."""
    return markers.groupBy("event_key").agg(F.max(F.struct("observed_at", "event_id")).alias("m")).select("event_key", "m.event_id", "m.observed_at")


def daily_gate(runs: DataFrame, day, now, stale_minutes: int = 18) -> DataFrame:
    """Runs that make a daily run of that day superfluous: handed off or done, or running and fresh."""
    fresh = (F.col("status") == "running") & (F.col("updated_at") >= now - F.expr(f"INTERVAL {stale_minutes} MINUTES"))
    return runs.where((F.col("date") == day) & (F.col("handoff_state").isin(["sealed", *TERMINAL]) | F.col("status").isin("success", "partial", "quiet") | fresh))


def record_run(log: DataFrame) -> DataFrame:
    """run_id with its first date, attempt and path and its last status (run_id, date, attempt, path, status, seq)."""
    first = {c: F.min_by(c, "seq").alias(c) for c in ("date", "attempt", "path")}
    return log.groupBy("run_id").agg(*first.values(), F.max_by("status", "seq").alias("status"))


def next_attempt(attempts: DataFrame) -> DataFrame:
    """date, next number, and its name of four digits at least."""
    n = F.coalesce(F.max("attempt"), F.lit(0)) + 1
    return attempts.groupBy("date").agg(n.alias("next_attempt")).withColumn("name", F.lpad(F.col("next_attempt").cast("string"), 4, "0"))


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last by `order`; aggregated before the shuffle."""
    rest = [c for c in df.columns if c != key]
    row = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(row.alias("r")).select(key, *[F.col("r").getField(c).alias(c) for c in rest])


def nth_write_window(key: str, seq: str):
    return Window.partitionBy(key).orderBy(seq)
