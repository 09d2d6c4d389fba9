"""Queries that run over all rows, and operators on the cases that given tables lack."""

from pyspark.sql import functions as F

from stratal import catalogue, plans
from stratal.operators import checks as K
from stratal.operators import publish as P
from stratal.sources import files

SF = "/root/testdata/sf0.1"
plans.load()


def test_artifact_hash_sees_every_document(spark):
    d = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.concat(F.lit("text "), "id").alias("text"))
    digest = lambda df: {r["source"]: r["digest"] for r in P.ordered_digest(df, "source", "doc_id", "text", 4096).collect()}
    late = d.withColumn("text", F.when(F.col("doc_id") == 9_999, "changed").otherwise(F.col("text")))
    before, after = digest(d.repartition(7)), digest(late)
    assert before["s0"] == after["s0"] and before["s1"] != after["s1"] and digest(d) == before
    assert digest(d.where("doc_id <> 5000"))["s0"] != before["s0"]
    assert catalogue.queries()["artifact_hash"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").select("source").distinct().count()


def test_no_event_or_customer_is_filtered_away(spark):
    """Every user of sf0.1 has its row, counts add up to all events, and each outcome occurs."""
    q = lambda name: catalogue.queries()[name](spark, SF)
    e = spark.read.parquet(f"{SF}/events.parquet")
    n, users = e.count(), e.select("user_id").distinct().count()
    block = q("status_block").select(F.sum(F.col("n_ok") + F.col("n_failed")).alias("n"), F.count(F.lit(1)).alias("users")).first()
    assert (block["n"], block["users"]) == (n, users)
    assert q("cli_envelope").count() == n and q("cli_envelope").where("n IS NULL").count() == n // 2
    assert q("set_predicates").select("user_id").distinct().count() == users and q("set_predicates").select("within").distinct().count() == q("set_predicates").select("repeated").distinct().count() == 2
    assert {r["status"] for r in q("surface_status").collect()} == {"success", "partial", "failed"} and q("surface_status").count() == users
    assert {r["status"] for r in q("severity_max").collect()} == {"success", "quiet", "partial", "failed"} and q("severity_max").count() == users
    assert 0 < q("thread_identity").count() < users
    top = q("nulls_last_topn").collect()
    assert len(top) == 200 and sum(r["t"] is not None for r in top) == e.where("event_id % 1000 = 0").count()
    nations = lambda name, column: {r[0] for r in spark.read.parquet(f"{SF}/{name}.parquet").select(column).distinct().collect()}
    assert {r["n"] for r in q("set_intersect").collect()} == nations("customer", "c_nationkey") & nations("supplier", "s_nationkey")
    assert {r["n"] for r in q("set_except").collect()} == {k for k in nations("nation", "n_nationkey") if k and k % 3 == 0}


def test_every_page_link_and_document_has_a_row(spark):
    q = lambda name: catalogue.queries()[name](spark, SF)
    pages, documents = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("pages", "documents"))
    n = pages.count()
    assert [q(name).count() for name in ("html_title", "html_text", "safe_ids", "long_keys")] == [n] * 4 and q("md_title").count() == documents.count()
    assert q("safe_ids").where("slug RLIKE '-[0-9a-f]{6}$' AND length(slug) = 48").count() > 0
    hrefs = pages.select(F.explode(F.regexp_extract_all("html", F.lit('(?is)<a[^>]*href="([^"]*)"'), 1))).count()
    assert q("absolute_links").count() == hrefs + 8 * n


def test_entities_titles_and_links_that_were_filtered_away(spark, tmp_path):
    html = '<title>a &lt;b&gt;&nbsp;c &amp;lt;</title><p>x&nbsp;y &amp;amp; z</p><a href="//c.example/z">k</a>'
    spark.createDataFrame([(1, "http://h.example/a/b?x=1#t", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    texts = [(0, "body"), (1, "no title\n# Real \nrest"), (2, "a # b"), (3, "x\n# second"), (4, "#none\n#  \nx")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = lambda name: catalogue.queries()[name](spark, str(tmp_path))
    assert q("html_title").first()["title"] == "a <b> c &lt;" and q("html_text").first()["text"] == "a <b> c &lt; x y &amp; z k"
    assert {r["href"]: r["target"] for r in q("absolute_links").collect()} == {
        "//c.example/z": "http://c.example/z", "//cdn.example/x": "http://cdn.example/x", "/root": "http://h.example/root", "beside.html": "http://h.example/a/beside.html", "#part": "http://h.example/a/b?x=1#part",
        "?q=1": "http://h.example/a/b?q=1", "": "http://h.example/a/b?x=1", "mailto:a@b.example": "mailto:a@b.example", "https://other.example/y": "https://other.example/y",
    }
    assert {r["doc_id"]: r["title"] for r in q("md_title").collect()} == {0: "body", 1: "Real", 2: None, 3: "x", 4: None}


def test_atom_feeds_give_rows(spark):
    atom = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><link href="http://x/"/><entry><id>i1</id><title type="html"> a \n b</title><link rel="self" href="http://x/self"/><link href="http://x/1"/><author><name>N</name></author><summary>s</summary><updated>2026-01-02</updated></entry><entry><title>no link</title></entry><entry><title>c</title><link rel="alternate" href="http://x/3"/><summary>s</summary><content type="html">whole</content><published>2026-01-01</published><updated>2026-01-02</updated></entry></feed>'
    rss = "<rss><channel><item><title>r</title><link>http://y/1</link></item></channel></rss>"
    rows = files.feed_rows(spark.createDataFrame([(1, atom), (2, rss)], "id long, xml string"), "id", "xml").orderBy("id", "at").collect()
    assert [tuple(r) for r in rows] == [
        (1, 0, "http://x/1", "i1", "a b", "N", "s", "2026-01-02"),
        (1, 2, "http://x/3", "http://x/3", "c", None, "whole", "2026-01-01"),
        (2, 0, "http://y/1", "http://y/1", "r", None, None, None),
    ]


def test_a_sitemap_index_has_the_addresses_of_its_maps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = lambda *names: f'<?xml version="1.0"?>\n<sitemapindex {ns}>' + "".join(f"<sitemap><loc> {n}</loc></sitemap>" for n in names) + "</sitemapindex>"
    urls = lambda *pairs: f"<urlset {ns}>" + "".join(f"<url><loc>{u}</loc><lastmod>{t}</lastmod></url>" for u, t in pairs) + "</urlset>"
    maps = spark.createDataFrame([(1, index("a", "b")), (2, urls(("http://x/own", "2026-01-30"))), (3, index("a", "lost")), (4, index("other")), (5, index("a", "b", "c"))], "id long, xml string")
    children = spark.createDataFrame([("a", urls(("http://x/1", "2026-01-27"), ("http://x/2", "2026-01-30"), ("http://x/old", "2025-01-01"))), ("b", urls(("http://x/3", "2026-01-29"))), ("c", urls(("http://x/4", "2026-01-31"))), ("other", urls(("http://z/", "2026-01-30")))], "url string, xml string")
    rows = lambda n, **more: sorted((r["id"], r["rank"] or 0, r["url"]) for r in files.sitemap_rows(maps, "id", "xml", F.expr("TIMESTAMP'2026-01-31 00:00:00'"), ["//x/"], n, **more).collect())
    assert rows(2, children=children, max_children=2) == [(1, 1, "http://x/2"), (1, 2, "http://x/3"), (2, 1, "http://x/own"), (3, 0, None), (3, 1, "http://x/2"), (3, 2, "http://x/1"), (5, 1, "http://x/2"), (5, 2, "http://x/3")]
    assert (5, 1, "http://x/4") in rows(2, children=children)
    assert rows(2) == [(1, 0, None), (2, 1, "http://x/own"), (3, 0, None), (4, 0, None), (5, 0, None)]


def test_consolidation_and_calibration_cover(spark):
    groups = lambda rows: spark.createDataFrame(rows, "bundle_id string, local_ids array<string>")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "local_id string")
    found = lambda df: sorted((r["problem"], str(r["id"])) for r in df.collect())
    assert found(K.consolidation_valid(groups([("g", ["a", "b"]), ("h", ["c"])]), known)) == []
    assert found(K.consolidation_valid(groups([("g", ["a", "b"]), ("g", ["b", "x"]), ("h", []), ("k", None)]), known)) == [("duplicate bundle", "b"), ("duplicate group", "g"), ("empty group", "h"), ("empty group", "k"), ("extra bundle", "x"), ("missing bundle", "c")]
    assert ("group count", "0") in found(K.consolidation_valid(groups([]), known))
    assert ("group count", "19") in found(K.consolidation_valid(groups([(f"g{k}", ["a"]) for k in range(19)]), known))
    routed = spark.createDataFrame([(1, "w"), (2, "r"), (2, "r"), (4, "w")], "id long, d string")
    rows = spark.createDataFrame([(1, "promote")], "id long, suggestion string")
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert found(K.calibration_valid(rows, routed, items)) == [("duplicate item", "2"), ("extra item", "4"), ("missing item", "3")]
