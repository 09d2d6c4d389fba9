"""Paged upstreams, settings, projections, the context of a repository, locks and history."""

import os
import time

import pytest
from pyspark.sql import functions as F

from stratal.operators import checks as K
from stratal.operators import events as E
from stratal.operators import projection as P
from stratal.operators import publish as R
from stratal.sources import paging, settings
from stratal.sources.shared import single_owner


def upstream():
    def fetch(key, number, cursor):
        """Five rows a request, two a page; the third day fails on its second page."""
        if key == "d3" and number == 1:
            raise OSError("gone")
        rows = [(f"{key}:{k}", k) for k in range(2 * number, min(5, 2 * number + 2))]
        return paging.Page(rows, cursor=f"c{number}" if number < 2 else "", total=5)

    return fetch


@pytest.mark.parametrize("rule", ["short", "total", "cursor"])
def test_pages_are_walked_to_their_end(spark, tmp_path, rule):
    spark.dataSource.register(paging.page_source(f"paged_{rule}", "id string, n long", 2, upstream()))
    read = spark.read.format(f"paged_{rule}").option("requests", "d1,d2,d3,d4").option("rule", rule).option("page_size", 2).load()
    read.write.parquet(f"{tmp_path}/landed")
    landed = spark.read.parquet(f"{tmp_path}/landed")
    assert {r["request"]: (r["n_rows"], r["outcome"]) for r in paging.outcomes(landed).collect()} == {"d1": (5, "complete"), "d2": (5, "complete"), "d3": (2, "OSError: gone"), "d4": (5, "complete")}
    assert sorted(r["id"] for r in paging.kept(landed).collect()) == [f"{d}:{k}" for d in ("d1", "d2") for k in range(5)]
    assert paging.kept(landed, contiguous=False).count() == 15
    assert paging.cursor(landed).first()["cursor"] == "d2" and paging.cursor(landed.where("request >= 'd3'")).first()["cursor"] is None


def test_a_page_limit_is_an_error_of_the_request(spark):
    spark.dataSource.register(paging.page_source("capped", "id string, n long", 2, upstream()))
    read = spark.read.format("capped").option("requests", "d1").option("rule", "total").option("page_size", 2).option("max_pages", 2).load()
    assert paging.outcomes(read).first()["outcome"] == "page limit of 2 reached" and paging.kept(read).count() == 0
    assert spark.read.format("capped").load().count() == 0 and paging.cursor(spark.read.format("capped").load()).first()["cursor"] is None
    with pytest.raises(ValueError):
        paging.Walk("never", 1, 1)


def test_a_surface_is_sampled_until_it_has_nothing_new():
    drawn = []

    def rounds(name, *given):
        for r in given:
            drawn.append(name)
            yield r

    first = rounds("a", [("1", "x"), (None, "?")], [("1", "x")], [("1", "x")], [("9", "never asked for")])
    second = rounds("b", [("1", "x"), ("2", "y")], [("3", "z"), ("4", "w")], [("5", "v")])
    assert list(paging.sampled([first, second], 3, 2)) == [(1, "1", "x"), (2, "2", "y"), (3, "3", "z")]
    assert drawn == ["a", "a", "a", "b", "b"]
    assert list(paging.sampled([], 3, 2)) == []


def test_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "runtime.example.toml").write_text('root = "r"\nagents = 4\n')
    path = settings.first_existing("runtime", tmp_path)
    monkeypatch.delenv(settings.ROOT_VARIABLE, raising=False)
    assert path.name == "runtime.example.toml" and settings.runtime(path) == settings.Runtime(root="r", agents=4)
    (tmp_path / "runtime.toml").write_text('root = "s"\n')
    monkeypatch.setenv(settings.ROOT_VARIABLE, "elsewhere")
    assert settings.runtime(settings.first_existing("runtime", tmp_path)).root == "elsewhere"
    for wrong in ("agents = 0", 'agents = "3"', "other = 1", "idle_seconds = true"):
        (tmp_path / "bad.toml").write_text(wrong)
        with pytest.raises((ValueError, TypeError)):
            settings.runtime(tmp_path / "bad.toml")
    (tmp_path / "sources.toml").write_text('[papers]\nenabled = false\nmax_pages = 4\n[[articles]]\nid = "a"\nhosts = ["x", "y"]\n[[articles]]\nid = "b"\n')
    found = settings.as_table(spark, settings.sources(tmp_path / "sources.toml")).collect()
    assert [(r["name"], r["enabled"], r["options"].get("hosts")) for r in found] == [("papers", False, None), ("articles:a", True, '["x", "y"]'), ("articles:b", True, None)]
    (tmp_path / "sources.toml").write_text('[[articles]]\nid = "a"\n[[articles]]\nid = "a"\n')
    with pytest.raises(ValueError):
        settings.sources(tmp_path / "sources.toml")


def test_projection_of_broken_and_missing_payloads(spark):
    rows = [(1, "x_list", None), (2, "github", "{"), (3, "arxiv", '{"abstract":"","summary":"s","url":"","hn_url":"h"}'), (4, "web", '{"text":"' + "é" * 3000 + '","event":{"a":1}}'), (5, "github", '{"event":{"a":1},"star_deltas":{"6h":3},"snapshot":{"stars":7}}')]
    df = spark.createDataFrame([(i, s, "new", None, p) for i, s, p in rows], "item_id long, source string, change string, occurred_at timestamp_ntz, payload string")
    got = {r["item_id"]: r for r in P.compact(df).collect()}
    assert (got[1]["text"], got[1]["links"], got[1]["title"]) == ("", [], None) and got[2]["description"] == ""
    assert (got[3]["abstract"], got[3]["url"]) == ("s", "h") and got[4]["text"] == "é" * 1800 and got[4]["event"] is None
    assert (got[5]["event"], got[5]["star_deltas"], got[5]["stars"]) == ('{"a":1}', {"6h": 3}, 7)


def test_summary_of_a_run_without_events(spark):
    runs = spark.createDataFrame([(1, 0, None), (2, 1, "token expired")], "run_id long, exit_code int, error string")
    events = spark.createDataFrame([(2, 1, "t1", 5), (2, 2, None, None), (3, 1, "t9", 9)], "run_id long, seq long, thread_id string, tokens long")
    got = {r["run_id"]: tuple(r)[1:] for r in P.run_summary(runs, events).collect()}
    assert got == {1: (0, None, None, 0, None, None), 2: (1, "t1", 5, 2, "authentication", "token expired")}


def test_context_without_history_and_at_ties(spark):
    ts = lambda c: F.col(c).cast("timestamp_ntz").alias("observed_at")
    snaps = spark.createDataFrame([("r", "2024-01-01 00:00:00", 1, 10, "{}"), ("r", "2024-01-01 00:00:00", 2, 11, "{}"), ("r", "2024-01-02 00:00:00", 3, 20, "{}")], "repo_id string, at string, snapshot_id long, stars long, metadata string").select("repo_id", ts("at"), "snapshot_id", "stars", "metadata")
    probes = spark.createDataFrame([(1, "r", "2024-01-02 00:00:00", ["a", "b", "a"], "g"), (2, "new", "2024-01-02 00:00:00", None, None)], "probe_id long, repo_id string, at string, event_item_ids array<string>, growth_event_key string").select("probe_id", "repo_id", ts("at"), "event_item_ids", "growth_event_key")
    items = spark.createDataFrame([("a",), ("c",)], "item_id string")
    markers = spark.createDataFrame([("g", "2024-01-01 01:00:00"), ("g", "2024-01-01 02:00:00")], "event_key string, at string").select("event_key", ts("at"))
    got = {r["probe_id"]: r for r in E.repository_context(probes, snaps, items, markers).collect()}
    assert got[1]["latest"]["stars"] == 11 and got[1]["baseline_24h"]["stars"] == 11 and got[1]["baseline_7d"] is None
    assert got[1]["existing_item_ids"] == ["a"] and got[1]["growth_event_at"].hour == 2
    assert (got[2]["latest"], got[2]["existing_item_ids"], got[2]["growth_event_at"]) == (None, [], None)
    one = E.snapshot_history(snaps.withColumn("file_ref", F.lit("f")), "r").collect()
    assert [(r["position"], r["snapshot_id"]) for r in one] == [(1, 1), (2, 2), (3, 3)]


def test_legacy_layout(spark):
    units = spark.createDataFrame([("a",), ("b",), ("c",)], "unit_id string")
    told = spark.createDataFrame([("a", "investigate"), ("b", "supporting"), ("c", "archive")], "unit_id string, disposition string")
    ddl = "package_id string, investigate_unit_ids array<string>, supporting_unit_ids array<string>"
    assert K.legacy_valid(units, told, spark.createDataFrame([("p", ["a"], ["b"])], ddl)).count() == 0
    assert K.legacy_valid(units, told, spark.createDataFrame([("p", ["a"], None)], ddl)).count() == 0  # a supporting unit need not be attached
    bad = spark.createDataFrame([("p", ["a"], ["b", "c"]), ("p", None, ["b"])], ddl)
    assert {tuple(r) for r in K.legacy_valid(units, told, bad).collect()} == {("duplicate package", "p"), ("nothing to investigate", "p"), ("duplicate supporting unit", "b"), ("extra supporting unit", "c")}


def test_one_owner_at_a_time(spark, tmp_path):
    path = f"file://{tmp_path}/lock"
    with single_owner(spark, path):
        with pytest.raises(RuntimeError), single_owner(spark, path):
            pass
        past = time.time() - 7200
        os.utime(tmp_path / "lock", (past, past))
        with single_owner(spark, path, stale_minutes=60):
            pass
    assert not (tmp_path / "lock").exists()


def test_publishing_reads_back(spark):
    class Forgetful(R.MemorySink):
        def apply(self, action, key, content_hash):
            if key != "b":
                super().apply(action, key, content_hash)

    desired = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, content_hash string")
    with pytest.raises(RuntimeError, match="'b', 'create'"):
        R.publish(desired, Forgetful())


def test_history_is_copied_with_its_list(spark, tmp_path):
    rows = [("d1", "a1", "p", "report.md", 5, "x\n# One\ny"), ("d1", "a1", "p", "dossier.md", 5, "# Other"), ("d1", "a1", "q", "report.md", 45, "# Old"), ("d2", "a1", "p", "report.md", 1, "# Now"), ("d1", "a2", "s", "report.md", None, "# Unknown age")]
    now = F.expr("TIMESTAMP_NTZ'2024-03-01'")
    df = spark.createDataFrame(rows, "date string, attempt string, package string, name string, age int, content string").withColumn("modified_at", now - F.make_dt_interval(days=F.col("age")))
    out = R.recent_history(df, now, "d2/a1")
    R.copy_history(out, f"file://{tmp_path}/h")
    assert (tmp_path / "h/history/target=d1-a1-p.md").is_dir()
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/h/history_index").collect()] == ["# Prior research reports", "", "- [One](history/d1-a1-p.md)"]
