"""The work queue, the reuse of checkpoints, and the checks before anything is imported or published."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegralType, MapType, StructType

from stratal.functions.times import lenient_timestamp
from stratal.operators.checks import exact_cover

MAX_IMPORT_BYTES = 2 * 1024 * 1024
REPORT_ID = r"\A[a-z0-9][a-z0-9_-]{0,63}\z"


def requeue(jobs: DataFrame, now, visible: DataFrame | None = None) -> DataFrame:
    """jobs (job_id, retry_at text) with what becomes of each: 'due', 'wait', or 'quarantine' where the time can't be
    read, is missing, or a due job of that id is visible already."""
    at = lenient_timestamp("retry_at")
    out = jobs.withColumn("at", at)
    if visible is None:
        out = out.withColumn("there", F.lit(False))
    else:
        out = out.join(visible.select("job_id").distinct().withColumn("there", F.lit(True)), "job_id", "left")
    action = F.when(F.col("at").isNull(), "quarantine").when(F.col("at") > now, "wait").when(F.coalesce("there", F.lit(False)), "quarantine").otherwise("due")
    return out.withColumn("action", action).drop("at", "there")


def publish_due(retry_at, now) -> Column:
    """Publishing retries when its time has come, and also when the time can't be read."""
    at = lenient_timestamp(retry_at)
    return at.isNull() | (at <= now)


def reusable(batches: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """batches (phase, batch, input_hash) with whether their output may be used again.

    checkpoints: phase, batch, input_hash. A phase is one generation: if any of its checkpoints has another input than
    the batch of that number, or there is a checkpoint of a batch that is planned no more, none of them is used.
    """
    known = checkpoints.select("phase", "batch", F.col("input_hash").alias("had"), F.lit(True).alias("there"))
    both = batches.withColumn("planned", F.lit(True)).join(known, ["phase", "batch"], "full")
    stale = F.coalesce("there", F.lit(False)) & (F.col("planned").isNull() | ~F.col("input_hash").eqNullSafe(F.col("had")))
    abandoned = both.groupBy("phase").agg(F.max(stale).alias("abandoned"))
    out = both.where("planned").join(abandoned, "phase")
    return out.select("phase", "batch", "input_hash", (F.coalesce("there", F.lit(False)) & ~F.col("abandoned")).alias("reused"))


def generations(phases: DataFrame, batches: DataFrame) -> DataFrame:
    """phase, cause, reusable: why a phase's generation of checkpoints is given up, null if it isn't, and how many of its first
    batches may be used again.

    phases: phase, input_hash, had_hash (of the generation that is stored, null without one), session (whether its session is
    there). batches: phase, batch (from 1), committed (a checkpoint with its session and input), whole, partial (what its
    output holds). The causes, in this order: the input of the whole generation changed; checkpoints without their
    session; and a rewind, that is a batch without a whole output although it is committed and has no part of it, or
    although a later batch is committed. Two aggregates by phase and no sort, so a phase of any number of batches is
    combined before it is shuffled.
    """
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    last = batches.where(t("committed")).groupBy("phase").agg(F.max("batch").alias("last"))
    seen = batches.join(last, "phase", "left").withColumn("later", F.coalesce(F.col("last") > F.col("batch"), F.lit(False)))
    cached = t("committed") & t("whole")
    rewind = F.when(t("committed"), ~t("whole") & (~t("partial") | F.col("later"))).otherwise(F.col("later"))
    found = seen.groupBy("phase").agg(F.max(rewind).alias("rewind"), F.min(F.when(~cached, F.col("batch"))).alias("open"), F.count(F.lit(1)).alias("n"), F.count_if(t("committed") | t("whole") | t("partial")).alias("stored"))
    both = phases.join(found, "phase", "left")
    changed = t("session") & F.col("had_hash").isNotNull() & ~F.col("had_hash").eqNullSafe(F.col("input_hash"))
    cause = F.when(changed, "generation_input_changed").when(~t("session") & (F.coalesce("stored", F.lit(0)) > 0), "missing_session_checkpoint").when(t("rewind"), "checkpoint_rewind_required")
    prefix = F.coalesce(F.col("open") - 1, F.col("n"), F.lit(0))
    return both.select("phase", cause.alias("cause"), F.when(cause.isNull(), prefix).otherwise(0).cast("long").alias("reusable"))


def select_sources(items: DataFrame, names: list[str], known: list[str], source: str = "source") -> DataFrame:
    """The rows of the named sources; a name that is not known is an error, no names mean all."""
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    return items.where(F.col(source).isin(names)) if names else items


def import_valid(files: DataFrame, max_bytes: int = MAX_IMPORT_BYTES) -> DataFrame:
    """problem, path of files (path, n_bytes, is_link) that may not be imported: links, absolute or climbing paths, too large or of unknown size."""
    path = F.coalesce("path", F.lit(""))
    outside = (path == "") | path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)") | F.contains(path, F.lit("\\"))
    problem = F.when(F.coalesce("is_link", F.lit(True)), "link").when(outside, "outside").when(F.col("n_bytes").isNull() | (F.col("n_bytes") > max_bytes), "too large")
    return files.select(problem.alias("problem"), "path").where("problem IS NOT NULL")


def subreports_valid(declared: DataFrame, found: DataFrame, allowed: DataFrame) -> DataFrame:
    """problem, id of subreports (package_id, slug, path, unit_ids): bad or repeated slugs, a path that is not subreports/<slug>.md,
    units that the package does not have, and files (package_id, path) that differ from the declared ones."""
    slug = F.coalesce("slug", F.lit(""))
    bad = declared.where(~slug.rlike(REPORT_ID)).select(F.lit("bad slug").alias("problem"), F.concat_ws("/", "package_id", slug).alias("id"))
    elsewhere = declared.where(~F.col("path").eqNullSafe(F.concat(F.lit("subreports/"), slug, F.lit(".md")))).select(F.lit("bad path").alias("problem"), F.concat_ws("/", "package_id", slug).alias("id"))
    twice = declared.groupBy("package_id", "slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated").alias("problem"), F.concat_ws("/", "package_id", "slug").alias("id"))
    units = declared.select("package_id", F.explode("unit_ids").alias("unit_id")).join(allowed.select("package_id", "unit_id"), ["package_id", "unit_id"], "left_anti")
    unknown = units.select(F.lit("unknown unit").alias("problem"), F.concat_ws("/", "package_id", "unit_id").alias("id")).distinct()
    whole = lambda df: df.select(F.concat_ws("/", "package_id", "path").alias("id"))
    files = exact_cover(whole(declared), whole(found), "id").select(F.concat("problem", F.lit(" file")).alias("problem"), "id")
    return bad.unionByName(elsewhere).unionByName(twice).unionByName(unknown).unionByName(files)


def manifest_valid(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """problem, path of a manifest (path, sha256, n_rows) against the files (path, content, n_rows): not there, not named, changed, other count."""
    held = files.select("path", F.sha2("content", 256).alias("found"), F.col("n_rows").alias("rows_found"), F.lit(True).alias("there"))
    both = manifest.withColumn("named", F.lit(True)).join(held, "path", "full")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("named").isNull(), "not named").when(~F.col("sha256").eqNullSafe(F.col("found")), "changed").when(~F.col("n_rows").eqNullSafe(F.col("rows_found")), "row count")
    return both.select(problem.alias("problem"), "path").where("problem IS NOT NULL")


def layout_valid(packages: DataFrame, files: DataFrame) -> DataFrame:
    """problem, id: a published package (package_id, published) needs its main report, one that is not published may hold neither report nor subreports."""
    seen = files.groupBy("package_id").agg(F.max(F.col("path") == "main_report.md").alias("main"), F.max(F.col("path").startswith("subreports/")).alias("sub"))
    both = packages.join(seen, "package_id", "left").withColumns({"main": F.coalesce("main", F.lit(False)), "sub": F.coalesce("sub", F.lit(False))})
    published = F.coalesce("published", F.lit(False))
    problem = F.when(published & ~F.col("main"), "no main report").when(~published & (F.col("main") | F.col("sub")), "report of an unpublished package")
    return both.select(problem.alias("problem"), F.col("package_id").alias("id")).where("problem IS NOT NULL")


def preflight(reports: DataFrame, brief_links: DataFrame, packages: DataFrame) -> DataFrame:
    """problem, id before anything is published: reports (report_id, path, content) with an unsafe id, an empty text or no
    package, links of the brief (target) to no report, and reports that the brief does not link."""
    named = F.coalesce("report_id", F.lit(""))
    unsafe = reports.where(~named.rlike(REPORT_ID)).select(F.lit("unsafe id").alias("problem"), named.alias("id"))
    blank = reports.where(F.trim(F.coalesce("content", F.lit(""))) == "").select(F.lit("blank").alias("problem"), named.alias("id"))
    unknown = reports.join(packages.select(F.col("package_id").alias("report_id")), "report_id", "left_anti").select(F.lit("no package").alias("problem"), named.alias("id"))
    dead = brief_links.join(reports, brief_links["target"] == reports["report_id"], "left_anti").select(F.lit("dead link").alias("problem"), F.col("target").alias("id")).distinct()
    unlinked = reports.join(brief_links, reports["report_id"] == brief_links["target"], "left_anti").select(F.lit("not linked").alias("problem"), named.alias("id"))
    return unsafe.unionByName(blank).unionByName(unknown).unionByName(dead).unionByName(unlinked)


def json_schema(kind: DataType, enums: dict[str, list] | None = None, max_items: dict[str, int] | None = None, path: str = "") -> dict:
    """JSON schema of a Spark type: every field required, none besides, enumerations and longest lists by dotted path."""
    enums, max_items = enums or {}, max_items or {}
    if isinstance(kind, StructType):
        inner = {f.name: json_schema(f.dataType, enums, max_items, f"{path}.{f.name}" if path else f.name) for f in kind.fields}
        return {"type": "object", "additionalProperties": False, "required": [f.name for f in kind.fields], "properties": inner}
    if isinstance(kind, ArrayType):
        out: dict = {"type": "array", "items": json_schema(kind.elementType, enums, max_items, path)}
        return out | ({"maxItems": max_items[path]} if path in max_items else {})
    if isinstance(kind, MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType, enums, max_items, path)}
    name = "boolean" if isinstance(kind, BooleanType) else "integer" if isinstance(kind, IntegralType) else "number" if isinstance(kind, FractionalType) else "string"
    return {"type": name} | ({"enum": enums[path]} if path in enums else {})


def schema_text(spark: SparkSession, ddl: str, **more) -> str:
    return json.dumps(json_schema(spark.createDataFrame([], ddl).schema, **more), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def poll_commit(polls: DataFrame, ledger: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New items and markers of polls, a poll all or nothing.

    polls: poll_id, item_id (null for a broken row), entity, at. A poll with a broken row is left out as a whole; of the
    others each item that the ledger (item_id) lacks is new once, by its earliest poll, and each entity's marker
    (entity, at) moves forward only.
    """
    broken = polls.where("item_id IS NULL OR entity IS NULL OR at IS NULL").select("poll_id").distinct()
    whole = polls.join(broken, "poll_id", "left_anti")
    new = whole.join(ledger.select("item_id"), "item_id", "left_anti").groupBy("item_id").agg(F.min_by(F.struct("poll_id", "entity", "at"), F.struct("at", "poll_id")).alias("r")).select("item_id", "r.*")
    moved = whole.select("entity", "at").unionByName(markers.select("entity", "at")).groupBy("entity").agg(F.max("at").alias("at"))
    return new, moved
