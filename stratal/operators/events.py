"""Time series of snapshots: as-of deltas, crossings, changes, and events with a cooldown.

One window specification (entity, time, id) serves all of them, so Spark shuffles and sorts a series once. An entity with
more than chunk_rows snapshots is scanned in chunks (see series), so that no series has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratal.functions.times import micros
from stratal.operators import series as S
from stratal.operators.greedy import CHUNK_ROWS as WALK_ROWS
from stratal.operators.greedy import Cooldown, labelled
from stratal.operators.series import CHUNK_ROWS

HOUR = 3_600_000_000
HORIZONS = {"6h": 6 * HOUR, "24h": 24 * HOUR, "7d": 168 * HOUR}
GROWTH = {"6h": 25, "24h": 75, "7d": 250}
CROSSINGS = [500, 5000]


def series(entity: str):
    return Window.partitionBy(entity).orderBy("t")


def as_of_deltas(snapshots: DataFrame, entity: str, ts: str, tie: str, value: str, horizons: dict[str, int] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds delta_<h>: the value minus that of the last snapshot at or before ts minus the horizon; null without one.

    Of several snapshots at one instant the one with the highest tie counts as the last. RANGE frames over microseconds
    read the sorted series once, whatever the number of horizons.
    """
    rows, hot = S.parted(snapshots.withColumn("t", micros(ts)), entity, chunk_rows)
    horizons = horizons or HORIZONS
    held = F.struct("t", F.col(tie).alias("i"), F.col(value).alias("v"))
    bases = {f"base_{h}": F.max(held).over(series(entity).rangeBetween(Window.unboundedPreceding, -length)) for h, length in horizons.items()}
    out = rows.withColumns(bases)
    if hot is not None:
        out = out.unionByName(S.as_of(hot, entity, "t", held, {f"base_{h}": length for h, length in horizons.items()}, chunk_rows))
    return out.withColumns({f"delta_{h}": F.col(value) - F.col(f"base_{h}.v") for h in horizons}).drop("t", *bases)


def latest_prior(snapshots: DataFrame, entity: str, ts: str, tie: str, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds prior: the value of the last snapshot strictly before."""
    rows, hot = S.parted(snapshots.withColumn("t", micros(ts)), entity, chunk_rows)
    held = F.struct("t", F.col(tie).alias("i"), F.col(value).alias("v"))
    out = rows.withColumn("prior", F.max(held).over(series(entity).rangeBetween(Window.unboundedPreceding, -1)))
    if hot is not None:
        out = out.unionByName(S.as_of(hot, entity, "t", held, {"prior": 1}, chunk_rows))
    return out.withColumn("prior", F.col("prior.v")).drop("t")


def _with_before(snapshots: DataFrame, entity: str, ts: str, tie: str, fields: list[str], chunk_rows: int) -> DataFrame:
    """Adds __before: the fields of the snapshot before, null for the first one."""
    rows, hot = S.parted(snapshots, entity, chunk_rows)
    value = F.struct(F.col(ts).alias("__t"), F.col(tie).alias("__i"), *fields)
    out = rows.withColumn("__before", F.lag(value).over(Window.partitionBy(entity).orderBy(ts, tie)))
    return out if hot is None else out.unionByName(S.lagged(hot, entity, [ts, tie], value, "__before", chunk_rows))


def crossings(snapshots: DataFrame, entity: str, ts: str, tie: str, value: str, thresholds: list, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """entity, threshold, ts, tie of the first snapshot at which the value passes from below to it; never the first one."""
    rows = snapshots.select(entity, ts, tie, F.col(value).alias("v"))
    stepped = _with_before(rows, entity, ts, tie, ["v"], chunk_rows).select(entity, ts, tie, "v", F.col("__before.v").alias("p"))
    hits = stepped.select(entity, ts, tie, "v", "p", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).where("p < threshold AND v >= threshold")
    return hits.groupBy(entity, "threshold").agg(F.min(F.struct(ts, tie)).alias("m")).select(entity, "threshold", f"m.{ts}", f"m.{tie}")


def first_per_lane(sightings: DataFrame, entity: str, lane: str, ts: str, tie: str) -> DataFrame:
    """When each entity first entered each lane."""
    return sightings.groupBy(entity, lane).agg(F.min(F.struct(ts, tie)).alias("m")).select(entity, lane, f"m.{ts}", f"m.{tie}")


def changes(snapshots: DataFrame, entity: str, ts: str, tie: str, fields: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Snapshots at which one of the fields differs from the one before, with {field: {before, after}}."""
    pairs = [F.when(~F.col(f"__before.{f}").eqNullSafe(F.col(f)), F.struct(F.lit(f).alias("key"), F.struct(F.col(f"__before.{f}").cast("string").alias("before"), F.col(f).cast("string").alias("after")).alias("value"))) for f in fields]
    changed = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull()))
    rows = _with_before(snapshots, entity, ts, tie, fields, chunk_rows)
    return rows.where("__before IS NOT NULL").withColumn("changed", changed).drop("__before").where(F.size("changed") > 0)


def with_cooldown(candidates: DataFrame, entity: str, ts: str, tie: str, cooldown_micros: int, chunk_rows: int = WALK_ROWS) -> DataFrame:
    """The candidates that are accepted when, in order, each must be a cooldown after the last accepted one.

    One without a time is never accepted. An entity with any number of candidates is walked in chunks by as many tasks
    (see greedy).
    """
    timed = candidates.withColumn("__t", micros(ts)).where("__t IS NOT NULL")
    return labelled(timed, entity, ["__t", tie], "__t", Cooldown(cooldown_micros), chunk_rows).where("__label").select(*candidates.columns)


def growth_candidates(deltas: DataFrame, value: str, prior: str, thresholds: dict[str, int] | None = None) -> DataFrame:
    """Rows with a horizon whose delta reaches its threshold and a value above the one before; adds the horizons."""
    least = thresholds or GROWTH
    hit = F.filter(F.array(*[F.when(F.col(f"delta_{h}") >= n, F.lit(h)) for h, n in least.items()]), lambda x: x.isNotNull())
    return deltas.withColumn("horizons", hit).where((F.size("horizons") > 0) & (F.col(value) > F.col(prior)))


def failure_cooldown(attempts: DataFrame, entity: str, ts: str, tie: str, failed: Column, after: int = 2, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds the number of consecutive failures up to each attempt and whether it starts a cooldown (gaps and islands)."""
    rows, hot = S.parted(attempts.withColumn("__failed", failed.cast("int")), entity, chunk_rows)
    w = Window.partitionBy(entity).orderBy(ts, tie)
    out = rows.withColumn("__island", F.sum(1 - F.col("__failed")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum("__failed").over(Window.partitionBy(entity, "__island").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("failures", streak).drop("__island")
    if hot is not None:
        out = out.unionByName(S.streaks(hot, entity, [ts, tie], "__failed", "failures", chunk_rows))
    return out.withColumn("cooling", F.col("failures") >= after).drop("__failed")


def repository_context(probes: DataFrame, snapshots: DataFrame, items: DataFrame, markers: DataFrame) -> DataFrame:
    """What committed history says of each probe: probe_id, latest, baseline_6h, _24h, _7d, existing_item_ids, growth_event_at.

    probes: probe_id (unique), repo_id, observed_at, event_item_ids, growth_event_key; snapshots: repo_id, observed_at,
    snapshot_id, stars, metadata; items: item_id; markers: event_key, observed_at (the newest counts). latest is the
    snapshot strictly before the probe, a baseline the last one at or before the probe minus its horizon, of several at one
    instant that of the largest id; null where there is none. Probes and snapshots are sorted together once, and
    every horizon is a RANGE frame over that order.
    """
    held = F.struct("t", "snapshot_id", "observed_at", "stars", "metadata")
    s = snapshots.withColumn("t", micros("observed_at")).select("repo_id", "t", held.alias("held"))
    p = probes.select("repo_id", micros("observed_at").alias("t"), "probe_id", "growth_event_key", F.lit(True).alias("is_probe"))
    w, latest = series("repo_id"), F.max("held")
    frames = {"latest": latest.over(w.rangeBetween(Window.unboundedPreceding, -1))}
    frames |= {f"baseline_{h}": latest.over(w.rangeBetween(Window.unboundedPreceding, -length)) for h, length in HORIZONS.items()}
    seen = s.unionByName(p, allowMissingColumns=True).withColumns(frames).where("is_probe")
    shown = [F.when(F.col("latest").isNotNull(), F.struct("latest.observed_at", "latest.stars", "latest.metadata")).alias("latest")]
    shown += [F.when(F.col(f"baseline_{h}").isNotNull(), F.struct(f"baseline_{h}.observed_at", f"baseline_{h}.stars")).alias(f"baseline_{h}") for h in HORIZONS]
    asked = probes.select("probe_id", F.explode("event_item_ids").alias("item_id")).join(items.select("item_id"), "item_id", "left_semi")
    known = asked.groupBy("probe_id").agg(F.array_sort(F.collect_set("item_id")).alias("existing_item_ids"))
    marked = markers.groupBy(F.col("event_key").alias("growth_event_key")).agg(F.max("observed_at").alias("growth_event_at"))
    out = seen.select("probe_id", "growth_event_key", *shown).join(known, "probe_id", "left").join(marked, "growth_event_key", "left")
    ids = F.coalesce("existing_item_ids", F.expr("CAST(array() AS array<string>)")).alias("existing_item_ids")
    return out.select("probe_id", "latest", *(f"baseline_{h}" for h in HORIZONS), ids, "growth_event_at")


def snapshot_history(snapshots: DataFrame, repo_id=None) -> DataFrame:
    """Snapshots (repo_id, observed_at, snapshot_id, metadata, file_ref) with their position in their repository's history,
    in order; of one repository if it is named, which then filters the scan."""
    own = snapshots if repo_id is None else snapshots.where(F.col("repo_id") == repo_id)
    position = F.row_number().over(Window.partitionBy("repo_id").orderBy("observed_at", "snapshot_id"))
    return own.select("repo_id", position.cast("long").alias("position"), "observed_at", "snapshot_id", "metadata", "file_ref").orderBy("repo_id", "position")
