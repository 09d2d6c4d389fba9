"""Constraint checks that return their violations; an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PACKAGES = 15
MAX_CONSOLIDATED = 18
MAX_MAP_BYTES = 64 * 1024


def exact_cover(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, problem ('missing', 'extra' or 'duplicate') where actual does not hold each expected key exactly once."""
    sides = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("a")).distinct().unionByName(actual.select(key, F.lit(0).alias("e"), F.lit(1).alias("a")))
    counts = sides.groupBy(key).agg(F.max("e").alias("e"), F.sum("a").alias("a"))
    problem = F.when(F.col("a") == 0, "missing").when(F.col("e") == 0, "extra").when(F.col("a") > 1, "duplicate")
    return counts.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def require_empty(violations: DataFrame, what: str) -> None:
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def packages_valid(packages: DataFrame, units: DataFrame, catalog: DataFrame) -> DataFrame:
    """problem, id of packages (package_id, unit_ids): more than 15, repeated ids, units not covered exactly once, catalog disagreeing."""
    members = packages.select("package_id", F.explode("unit_ids").alias("unit_id"))
    many = packages.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_PACKAGES).select(F.lit("too many packages").alias("problem"), F.col("n").cast("string").alias("id"))
    repeated = duplicates(packages, "package_id").select(F.lit("duplicate package").alias("problem"), F.col("package_id").alias("id"))
    cover = exact_cover(units.select("unit_id"), members, "unit_id").select(F.concat("problem", F.lit(" unit")).alias("problem"), F.col("unit_id").alias("id"))
    told = members.join(catalog.select("unit_id", F.col("package_id").alias("told")), "unit_id").where(~F.col("package_id").eqNullSafe(F.col("told"))).select(F.lit("catalog disagrees").alias("problem"), F.col("unit_id").alias("id"))
    return many.unionByName(repeated).unionByName(cover).unionByName(told)


def legacy_valid(units: DataFrame, annotations: DataFrame, packages: DataFrame) -> DataFrame:
    """problem, id of annotated units (unit_id, disposition) and packages (package_id, investigate_unit_ids, supporting_unit_ids):
    more than 15 packages, one that investigates nothing, repeated packages, units not annotated exactly once, investigated
    units not in exactly one package, and supporting units that are attached twice or were not annotated so. Null lists are empty."""
    many = packages.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_PACKAGES).select(F.lit("too many packages").alias("problem"), F.col("n").cast("string").alias("id"))
    bare = packages.where(F.coalesce(F.size("investigate_unit_ids"), F.lit(0)) <= 0).select(F.lit("nothing to investigate").alias("problem"), F.col("package_id").cast("string").alias("id"))
    repeated = duplicates(packages, "package_id").select(F.lit("duplicate package").alias("problem"), F.col("package_id").cast("string").alias("id"))
    told = lambda found, what: found.select(F.concat("problem", F.lit(f" {what}")).alias("problem"), F.col("unit_id").cast("string").alias("id"))
    of = lambda kind: annotations.where(F.col("disposition") == kind).select("unit_id")
    listed = lambda c: packages.select(F.explode(c).alias("unit_id"))
    annotated = told(exact_cover(units.select("unit_id"), annotations, "unit_id"), "annotation")
    assigned = told(exact_cover(of("investigate"), listed("investigate_unit_ids"), "unit_id"), "investigated unit")
    attached = told(exact_cover(of("supporting"), listed("supporting_unit_ids"), "unit_id").where("problem <> 'missing'"), "supporting unit")
    return many.unionByName(bare).unionByName(repeated).unionByName(annotated).unionByName(assigned).unionByName(attached)


def subset_output(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of a partial output whose unit is allowed; others are dropped."""
    return rows.join(allowed.select("unit_id"), "unit_id", "left_semi")


def working_map_valid(maps: DataFrame, max_bytes: int | None = MAX_MAP_BYTES) -> DataFrame:
    """map_id, problem of texts (map_id, content, group_ids) that are blank or null, over 64 KiB, or silent about a group.

    A null list of groups and a null group are groups that the text is silent about. max_bytes None: a text may be of any length.
    """
    silent = ~F.coalesce(F.forall("group_ids", lambda g: F.coalesce(F.contains(F.col("content"), g), F.lit(False))), F.lit(False))
    large = F.lit(False) if max_bytes is None else F.octet_length("content") > max_bytes
    problem = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "blank").when(large, "too large").when(silent, "group missing")
    return maps.select("map_id", problem.alias("problem")).where("problem IS NOT NULL")


def routing_valid(assignments: DataFrame, bundles: DataFrame, index: DataFrame) -> DataFrame:
    """problem, id of a routing: items covered exactly once, one or two topics for 'r' and none otherwise, and bundles
    that list exactly the items that name them. Null topics are none, a null topic is one that no bundle lists, and an
    item without a disposition must have none.
    """
    cover = exact_cover(index.select(F.col("id")), assignments, "id").select("problem", "id")
    n, r = F.greatest(F.size("t"), F.lit(0)), F.col("d").eqNullSafe("r")
    topics = assignments.where((r & ~F.coalesce(n, F.lit(0)).between(1, 2)) | (~r & (F.coalesce(n, F.lit(0)) > 0))).select(F.lit("topics").alias("problem"), "id")
    named = assignments.where("d = 'r'").select("id", F.explode("t").alias("bundle_id"))
    listed = bundles.select(F.explode("item_ids").alias("id"), "bundle_id")
    apart = named.exceptAll(listed).select(F.lit("not listed").alias("problem"), "id").unionByName(listed.exceptAll(named).select(F.lit("not named").alias("problem"), "id"))
    return cover.unionByName(topics).unionByName(apart)


def consolidation_valid(groups: DataFrame, bundles: DataFrame) -> DataFrame:
    """problem, id of groups (bundle_id, local_ids[]): none or more than 18, repeated or empty ones, local ids not covered exactly once."""
    n = groups.agg(F.count(F.lit(1)).alias("n")).where(~F.col("n").between(1, MAX_CONSOLIDATED)).select(F.lit("group count").alias("problem"), F.col("n").cast("string").alias("id"))
    repeated = duplicates(groups, "bundle_id").select(F.lit("duplicate group").alias("problem"), F.col("bundle_id").cast("string").alias("id"))
    empty = groups.where(F.coalesce(F.size("local_ids"), F.lit(0)) <= 0).select(F.lit("empty group").alias("problem"), F.col("bundle_id").cast("string").alias("id"))
    members = groups.select(F.explode("local_ids").alias("local_id"))
    cover = exact_cover(bundles.select("local_id"), members, "local_id").select(F.concat("problem", F.lit(" bundle")).alias("problem"), F.col("local_id").cast("string").alias("id"))
    return n.unionByName(repeated).unionByName(empty).unionByName(cover)


def calibration_valid(rows: DataFrame, index: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """problem, id: suggestions (id, suggestion) must be for items routed 'w', unique and neither blank nor null; with items, the index
    (id, d) must cover them exactly once."""
    joined = rows.join(index.select("id", "d"), "id", "left")
    wrong = joined.where("d IS NULL OR d <> 'w'").select(F.lit("not watched").alias("problem"), "id")
    blank = rows.where(F.trim(F.coalesce("suggestion", F.lit(""))) == "").select(F.lit("blank").alias("problem"), "id")
    twice = duplicates(rows, "id").select(F.lit("duplicate").alias("problem"), "id")
    found = wrong.unionByName(blank).unionByName(twice)
    if items is None:
        return found
    cover = exact_cover(items.select("id"), index, "id").select(F.concat("problem", F.lit(" item")).alias("problem"), "id")
    return found.unionByName(cover)


def evidence_valid(evidence: DataFrame, reviewed: DataFrame) -> DataFrame:
    """problem, id of claims (claim, evidence[], related_unit_ids[]): no or null evidence, or units that were not reviewed (a null one never was)."""
    bare = evidence.where(F.size(F.coalesce("evidence", F.expr("array()"))) <= 0).select(F.lit("no evidence").alias("problem"), F.col("claim").alias("id"))
    related = evidence.select("claim", F.explode("related_unit_ids").alias("unit_id")).join(reviewed.select("unit_id"), "unit_id", "left_anti")
    return bare.unionByName(related.select(F.lit("unknown unit").alias("problem"), F.col("claim").alias("id")))


def files_equal(declared: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """key, problem where the declared and the found files differ."""
    return exact_cover(declared, found, key)


def links_closed(links: DataFrame, pages: DataFrame) -> DataFrame:
    """problem, id: links (source, target) to no page, and pages that no link reaches (the root excepted)."""
    lost = links.join(pages, links["target"] == pages["page"], "left_anti").select(F.lit("dead link").alias("problem"), F.col("target").alias("id"))
    orphan = pages.where("NOT root").join(links, pages["page"] == links["target"], "left_anti").select(F.lit("unreachable").alias("problem"), F.col("page").alias("id"))
    return lost.unionByName(orphan)


def markers_known(markers: DataFrame, items: DataFrame) -> DataFrame:
    """Markers that point at no item of the same commit."""
    return markers.join(items.select(F.col("item_id").alias("event_id")), "event_id", "left_anti")


def single_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value (nulls don't count)."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")
