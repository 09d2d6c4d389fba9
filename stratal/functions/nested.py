"""Arrays, maps and structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def without_nulls(m) -> Column:
    return F.map_filter(_c(m), lambda k, v: v.isNotNull())


def changed_fields(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """field -> {before, after} of the fields that differ (nulls are values)."""
    rows = [F.when(~before[k].eqNullSafe(after[k]), F.struct(F.lit(k).alias("key"), F.struct(before[k].cast("string").alias("before"), after[k].cast("string").alias("after")).alias("value"))) for k in before]
    return F.map_from_entries(F.filter(F.array(*rows), lambda x: x.isNotNull()))


def triggered(values: dict[str, Column], least: dict[str, int]) -> Column:
    """The horizons whose value reaches its threshold."""
    rows = [F.when(values[k] >= least[k], F.struct(F.lit(k).alias("key"), values[k].alias("value"))) for k in values]
    return F.map_from_entries(F.filter(F.array(*rows), lambda x: x.isNotNull()))


def expanded_links(urls) -> Column:
    """Distinct targets of link structs, in order: the expanded one, its other spelling, or the short one."""
    return F.array_distinct(F.filter(F.transform(_c(urls), lambda u: F.coalesce(F.nullif(u["expanded_url"], F.lit("")), F.nullif(u["expandedUrl"], F.lit("")), F.nullif(u["url"], F.lit("")))), lambda x: x.isNotNull()))


def references(quoted, reposted, reply_to) -> Column:
    """The posts that a post refers to: (type, id, text), those without an id left out."""
    one = lambda kind, x: F.struct(F.lit(kind).alias("type"), x["id"].cast("string").alias("id"), x["text"].alias("text"))
    rows = F.array(one("quoted", _c(quoted)), one("reposted", _c(reposted)), F.struct(F.lit("replied_to").alias("type"), _c(reply_to).cast("string").alias("id"), F.lit(None).cast("string").alias("text")))
    return F.filter(rows, lambda r: F.coalesce(r["id"], F.lit("")) != "")


def text_candidates(title, text, description, quoted, refs) -> Column:
    """The non-empty texts of an item, nested references included."""
    own = F.array(*[_c(x) for x in (title, text, description, quoted)])
    nested = F.coalesce(F.transform(_c(refs), lambda r: r["text"]), F.expr("CAST(array() AS array<string>)"))
    return F.filter(F.concat(own, nested), lambda x: F.coalesce(x, F.lit("")) != "")


def last_entries(a, keep: int) -> Column:
    a = _c(a)
    return F.slice(a, F.greatest(F.size(a) - keep + 1, F.lit(1)), F.lit(keep))


def subset(a, b) -> Column:
    return F.size(F.array_except(_c(a), _c(b))) == 0


def has_duplicates(a) -> Column:
    return F.size(_c(a)) != F.size(F.array_distinct(_c(a)))
