"""Line-delimited JSON, blobs, feeds and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RSS = "channel struct<item:array<struct<title:string,link:string,guid:string,author:string,description:string,pubDate:string>>>"
ATOM = "entry array<struct<id:string,title:string,link:array<struct<_href:string,_rel:string>>,author:array<struct<name:string>>,summary:string,content:string,published:string,updated:string>>"
SITEMAP = "url array<struct<loc:string,lastmod:string>>, sitemap array<struct<loc:string>>"


def parse_jsonl(files: DataFrame, content: str, schema: str, keep: list[str]) -> DataFrame:
    """A row for each JSON record of a text column; only line feeds end a record, lines that are no JSON object are skipped."""
    lines = files.select(*keep, F.explode(F.split(content, "\n")).alias("__line")).where(F.ltrim("__line").startswith("{"))
    parsed = lines.select(*keep, F.from_json("__line", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r")).where("r IS NOT NULL AND r.__bad IS NULL")
    return parsed.select(*keep, "r.*").drop("__bad")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Typed scan of JSONL files; strict ones fail on a bad record. A missing path is an empty table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def blobs(spark: SparkSession, root: str) -> DataFrame:
    """ref, content of stored blobs; a blob whose bytes do not match its name is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", "([0-9a-f]{64}[^/]*)$", 1)
    return files.where(F.sha2("content", 256) == F.left(name, F.lit(64))).select(F.concat(F.lit("sha256:"), name).alias("ref"), "content")


def first_found(refs: DataFrame, roots: list[DataFrame]) -> DataFrame:
    """ref, content from the first root that has it; null where none does."""
    every = None
    for k, root in enumerate(roots):
        own = root.select("ref", F.struct(F.lit(k).alias("root"), "content").alias("hit"))
        every = own if every is None else every.unionByName(own)
    best = every.groupBy("ref").agg(F.min_by("hit", F.col("hit.root")).alias("hit"))
    return refs.join(best, "ref", "left").select("ref", F.col("hit.content").alias("content"))


def feed_rows(feeds: DataFrame, feed_id: str, xml: str, max_entries: int = 100) -> DataFrame:
    """feed_id, at, url, guid, title, author, summary, published of the first entries of RSS and Atom documents that have a link."""
    from stratal.functions.text import truthy

    rss = lambda i: F.struct(i["link"].alias("url"), F.coalesce(i["guid"], i["link"]).alias("guid"), i["title"].alias("title"), i["author"].alias("author"), i["description"].alias("summary"), i["pubDate"].alias("published"))

    def atom(e):
        link = F.try_element_at(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(1))["_href"]
        author = F.try_element_at(e["author"], F.lit(1))["name"]
        return F.struct(link.alias("url"), truthy(e["id"], link).alias("guid"), e["title"].alias("title"), author.alias("author"), truthy(e["content"], e["summary"]).alias("summary"), truthy(e["published"], e["updated"]).alias("published"))

    parsed = feeds.select(feed_id, F.from_xml(F.col(xml), f"{RSS}, {ATOM}").alias("f"))
    items = parsed.select(feed_id, F.slice(F.coalesce(F.transform("f.channel.item", rss), F.transform("f.entry", atom)), 1, max_entries).alias("items"))
    rows = items.select(feed_id, F.posexplode("items").alias("at", "i"))
    title = F.trim(F.regexp_replace(F.coalesce("i.title", F.lit("")), r"(?U)\s+", " "))
    return rows.select(feed_id, "at", "i.url", "i.guid", title.alias("title"), "i.author", "i.summary", "i.published").where("COALESCE(url, '') <> ''")


def sitemap_rows(maps: DataFrame, map_id: str, xml: str, now, needles: list[str] | None = None, max_entries: int = 100, days: int = 7, children: DataFrame | None = None, max_children: int = 20) -> DataFrame:
    """map_id, url, updated_at, rank: addresses that match, not older than `days` (undated ones stay), newest first.

    A sitemap index has the addresses of its first `max_children` maps, which are looked up in children (url, xml; one row
    a url), ranked together. A sitemap whose addresses match nothing at all and an index with a map that children lacks are
    errors of that map: they give a row with a null url. An index whose maps match nothing gives no row.
    """
    from stratal.functions.text import contains_any
    from stratal.functions.times import lenient_timestamp

    is_index = F.col(xml).rlike(r"(?s)\A\W*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<sitemapindex\b")
    parsed = maps.select(map_id, F.coalesce(is_index, F.lit(False)).alias("is_index"), F.from_xml(F.col(xml), SITEMAP).alias("m"))
    entries = parsed.select(map_id, "m.url")
    named = F.filter(F.transform("m.sitemap", lambda s: F.trim(s["loc"])), lambda u: u != "")
    listed = parsed.where("is_index").select(map_id, F.explode(F.slice(named, 1, max_children)).alias("__child"))
    missing = listed
    if children is not None:
        known = children.select(F.col("url").alias("__child"), F.col("xml").alias("__xml"))
        entries = entries.unionByName(listed.join(known, "__child").select(map_id, F.from_xml("__xml", SITEMAP)["url"].alias("url")))
        missing = listed.join(known, "__child", "left_anti")
    urls = entries.select(map_id, F.explode_outer("url").alias("u")).select(map_id, F.trim("u.loc").alias("url"), lenient_timestamp("u.lastmod").alias("updated_at"))
    matching = urls.where(F.col("url").isNotNull() & contains_any("url", needles or []))
    fresh = matching.where(F.col("updated_at").isNull() | (F.col("updated_at") >= now - F.expr(f"INTERVAL {days} DAYS")))
    rank = F.row_number().over(Window.partitionBy(map_id).orderBy(F.col("updated_at").desc_nulls_last(), "url"))
    top = fresh.withColumn("rank", rank).where(F.col("rank") <= max_entries)
    nothing = parsed.where("NOT is_index").select(map_id).join(matching.select(map_id).distinct(), map_id, "left_anti")
    return top.unionByName(nothing.unionByName(missing.select(map_id).distinct()), allowMissingColumns=True)


def envelope(text: DataFrame, key: str, content: str) -> DataFrame:
    """key, envelope: the first line that is a JSON object with a member `ok`."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.startswith("{") & F.try_variant_get(F.try_parse_json(x), "$.ok", "boolean").isNotNull())
    return text.select(key, F.try_element_at(lines, F.lit(1)).alias("envelope"))
