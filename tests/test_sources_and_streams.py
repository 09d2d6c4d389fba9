import json

from pyspark.sql import functions as F

from stratal.operators import ledger as L
from stratal.sources import files
from stratal.sources.observations import OBSERVATION, with_defaults
from stratal.streaming import cooldown
from stratal.streaming import ledger as stream

SF = "/root/testdata/sf0.001"


def test_jsonl_keeps_line_separators_inside_strings(spark, tmp_path):
    rows = [{"id": k, "s": "a b c"} for k in range(3)]
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    got = files.read_jsonl(spark, f"file://{tmp_path}/*.jsonl", "id long, s string").collect()
    assert sorted((r["id"], r["s"]) for r in got) == [(r["id"], r["s"]) for r in rows]
    assert files.read_jsonl(spark, f"file://{tmp_path}/none/*.jsonl", "id long").count() == 0


def test_jsonl_text_skips_what_is_no_object(spark):
    df = spark.createDataFrame([(1, '{"a":1}\nnoise\n{"a":\n\n{"a":3}')], "k long, c string")
    assert [r["a"] for r in files.parse_jsonl(df, "c", "a long", ["k"]).collect()] == [1, 3]


def test_blobs_and_roots(spark, tmp_path):
    import hashlib

    digest = hashlib.sha256(b"hello").hexdigest()
    (tmp_path / "blobs" / digest[:2]).mkdir(parents=True)
    (tmp_path / "blobs" / digest[:2] / f"{digest}.txt").write_bytes(b"hello")
    (tmp_path / "blobs" / digest[:2] / ("0" * 64 + ".txt")).write_bytes(b"forged")
    found = files.blobs(spark, f"file://{tmp_path}/blobs")
    assert [(r["ref"], bytes(r["content"])) for r in found.collect()] == [(f"sha256:{digest}.txt", b"hello")]
    refs = spark.createDataFrame([(f"sha256:{digest}.txt",), ("sha256:none",)], "ref string")
    assert {r["ref"]: r["content"] and bytes(r["content"]) for r in files.first_found(refs, [found.limit(0), found]).collect()} == {f"sha256:{digest}.txt": b"hello", "sha256:none": None}


def test_feed_and_sitemap(spark):
    rss = "<rss><channel><title>f</title><item><title> a \n b</title><link>http://x/1</link></item><item><title>no link</title></item></channel></rss>"
    rows = files.feed_rows(spark.createDataFrame([(1, rss)], "id long, xml string"), "id", "xml").collect()
    assert [(r["url"], r["title"], r["guid"]) for r in rows] == [("http://x/1", "a b", "http://x/1")]
    site = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>http://x/old</loc><lastmod>2026-01-01</lastmod></url><url><loc>http://x/mid</loc><lastmod>2026-01-28</lastmod></url><url><loc>http://x/new</loc><lastmod>2026-01-30T10:00:00Z</lastmod></url><url><loc>http://x/undated</loc></url><url><loc>http://y/other</loc></url></urlset>'
    maps = spark.createDataFrame([(1, site), (2, site.replace("//x/", "//z/"))], "id long, xml string")
    got = files.sitemap_rows(maps, "id", "xml", F.expr("TIMESTAMP'2026-01-31 00:00:00'"), ["//x/"], 2).collect()
    assert [(r["id"], r["url"]) for r in sorted(got, key=lambda r: (r["id"], r["rank"] or 0))] == [(1, "http://x/new"), (1, "http://x/mid"), (2, None)]


def test_envelope(spark):
    df = spark.createDataFrame([(1, 'x\n{"a":1}\n {"ok":true}\n{"ok":false,"n":2}'), (2, "none")], "k long, c string")
    assert {r["k"]: r["envelope"] for r in files.envelope(df, "k", "c").collect()} == {1: '{"ok":false,"n":2}', 2: None}


def test_defaults_of_older_rows(spark):
    old = spark.createDataFrame([("a", 5, None)], "item_id string, first_observed_at int, observation_kind string")
    r = with_defaults(old).first()
    assert (r["ready_at"], r["observation_kind"]) == (5, "live_increment") and "payload" in OBSERVATION.fieldNames()


def test_streams_equal_batches(spark):
    from stratal import catalogue, plans

    plans.load()
    for run, name in ((stream.run_events, "put_items_revisions"), (cooldown.run_events, "growth_cooldown")):
        got, want = run(spark, SF), catalogue.queries()[name](spark, SF)
        columns = sorted(want.columns)
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_a_replayed_batch_counts_once(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    append = stream.appender(root)
    batch = spark.createDataFrame([("a", "h" * 64, "live_increment", 1), ("b", None, "live_increment", 2)], stream.ARRIVAL)
    append(batch, 0)
    append(batch, 0)
    append(batch, 1)
    assert stream.state(spark, root).count() == 2 and L.put_items(batch, stream.state(spark, root).drop("batch")).count() == 0


def test_id_scan_batch_and_stream(spark, tmp_path):
    from stratal.sources.id_scan import id_source

    spark.dataSource.register(id_source("numbered", "id long, title string", lambda: 950, lambda a, b: [(k, f"t{k}") for k in range(a, b + 1) if k % 10]))
    read = spark.read.format("numbered").option("previous", 100).option("limit", 500).option("per_task", 60).load()
    assert sorted(r["id"] for r in read.collect()) == [k for k in range(101, 601) if k % 10]
    assert spark.read.format("numbered").option("previous", 950).load().count() == 0
    query = spark.readStream.format("numbered").option("previous", 100).option("limit", 300).load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [k for k in range(101, 951) if k % 10]


def test_the_keyed_ledger_equals_the_batch_over_several_runs(spark, tmp_path):
    rows = [[("a", "1" * 64, "live_increment", 1), ("a", "2" * 64, "live_increment", 2), ("b", None, "live_increment", 3), ("c", "5" * 64, "bootstrap_snapshot", 4)], [("a", "1" * 64, "live_increment", 5), ("a", "2" * 64, "live_increment", 6), ("a", "3" * 64, "live_increment", 7), ("b", "4" * 64, "live_increment", 8), (None, "6" * 64, "live_increment", 9)], [("c", "7" * 64, "live_increment", 10), ("d", "8" * 64, "live_increment", 11)]]
    source, root = f"{tmp_path}/in", f"file://{tmp_path}/ledger"
    for k, part in enumerate(rows):  # three runs, the state of each taken up by the next
        spark.createDataFrame(part, stream.ARRIVAL).coalesce(1).write.mode("append").parquet(source)
        stream.start(spark.readStream.schema(stream.ARRIVAL).parquet(source), root).awaitTermination()
    got = spark.read.schema(stream.ARRIVAL).parquet(f"{root}/items").collect()
    want = L.put_items(spark.createDataFrame([r for part in rows for r in part], stream.ARRIVAL)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 8


def test_the_state_of_a_stream_is_a_table(spark, tmp_path):
    from stratal.streaming import processors as P

    source, root = f"{tmp_path}/in", f"file://{tmp_path}/ledger"
    for part in ([("a", "1" * 64, "live_increment", 1), ("a", "2" * 64, "live_increment", 2), ("b", None, "live_increment", 3)], [("a", "3" * 64, "live_increment", 4), ("a", "2" * 64, "live_increment", 5)]):
        spark.createDataFrame(part, stream.ARRIVAL).coalesce(1).write.mode("append").parquet(source)
        stream.start(spark.readStream.schema(stream.ARRIVAL).parquet(source), root).awaitTermination()
    base = {r["item_id"]: r["value"]["content_hash"] for r in P.state_of(spark, f"{root}/checkpoint", "base").collect()}
    seen = P.state_of(spark, f"{root}/checkpoint", "seen")
    assert base == {"a": "1" * 64, "b": None}
    assert sorted((r["item_id"], r["user_map_key"]["digits"], r["user_map_value"]["seq"]) for r in seen.collect()) == [("a", "2" * L.HASH_DIGITS, 2), ("a", "3" * L.HASH_DIGITS, 4)]


def test_idle_state_is_dropped_by_its_timer(spark, tmp_path):
    import time

    from stratal.streaming import processors as P

    source, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    found = lambda: sorted(r["event_id"] for r in spark.read.schema(P.ACCEPTED).parquet(out).collect())

    def land(rows, wait=0.0):
        spark.createDataFrame(rows, P.ACCEPTED).coalesce(1).write.mode("append").parquet(source)
        end = time.time() + 40
        while time.time() < end and rows and rows[-1][1] not in (found() if (tmp_path / "out").exists() else []):
            time.sleep(0.5)
        time.sleep(wait)

    land([], 0)
    with P.rocks(spark):
        events = spark.readStream.schema(P.ACCEPTED).parquet(source)
        query = P.accepted(events, 100, idle_ms=3_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").trigger(processingTime="1 second").start()
    try:
        land([(1, 1, 0)], wait=8)  # longer than it may be idle: batches without data run the timer
        land([(1, 5, 50)])  # within the cooldown of the first, but nothing is known of that any more
        assert found() == [1, 5]
    finally:
        query.stop()
