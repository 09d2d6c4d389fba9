"""Writers, queue and checks on the cases that the given tables lack."""

import json

import pytest
from pyspark.sql import functions as F

from stratal.functions import text as X
from stratal.operators import checks as K
from stratal.operators import handoff as H
from stratal.sources import sinks
from stratal.sources.shared import exists


def found(df):
    return sorted((r[0], str(r[1])) for r in df.collect())


def test_canonical_json_sorts_every_level(spark):
    texts = ['{"b":1,"a":{"z":null,"y":[{"d":2,"c":"é\\n"}]}}', '[3, 1]', "no json", None, '{"k":""}']
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(sinks.canonical_json("x").alias("j")).collect()
    want = [json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if t and t != "no json" else None for t in texts]
    assert [r["j"] for r in rows] == want


def test_groups_are_written_with_an_index(spark, tmp_path):
    rows = [("a", 1, "x y"), ("a", 2, None), (None, 3, 'q"'), ("b/c", 4, "")]
    sinks.write_groups(spark.createDataFrame(rows, "g string, n long, t string").repartition(3), "g", f"{tmp_path}/o")
    lines = {(r["group"], r["value"]) for r in sinks.read_groups(spark, f"{tmp_path}/o").collect()}
    assert lines == {(g or "none", json.dumps({"g": g, "n": n, "t": t}, separators=(",", ":"), ensure_ascii=False)) for g, n, t in rows}
    index = {r["group"]: (r["n"], r["n_bytes"]) for r in spark.read.json(f"{tmp_path}/o/index").collect()}
    assert {g: n for g, (n, _) in index.items()} == {"a": 2, "none": 1, "b/c": 1}
    assert index["b/c"][1] == len('{"g":"b/c","n":4,"t":""}') + 1
    sinks.write_groups(spark.createDataFrame([], "g string, n long"), "g", f"{tmp_path}/empty")
    assert sinks.read_groups(spark, f"{tmp_path}/empty").count() == 0


def test_blobs_are_stored_once_and_erased(spark, tmp_path):
    d = spark.createDataFrame([("x",), ("x",), ("y",), (None,), ("",)], "c string")
    sinks.append_blobs(d, "c", f"{tmp_path}/b")
    sinks.append_blobs(d, "c", f"{tmp_path}/b")
    held = lambda: sorted(r["content"] for r in sinks.blobs_in(spark, f"{tmp_path}/b").collect())
    assert held() == ["", "x", "y"]
    gone = spark.createDataFrame([("x",), ("not there",)], "c string").select(F.sha2("c", 256).alias("digest"))
    sinks.erase(spark, f"{tmp_path}/b", gone)
    spark.catalog.clearCache()
    assert held() == ["", "y"]


def test_a_hand_off_is_whole_and_once(spark, tmp_path):
    d = spark.range(5)
    assert sinks.hand_off(d, f"{tmp_path}/job") and not sinks.hand_off(d, f"{tmp_path}/job")
    assert spark.read.parquet(f"{tmp_path}/job").count() == 5 and exists(spark, f"{tmp_path}/job/_SUCCESS")
    assert len(list(tmp_path.glob("job*"))) == 1


def test_schema_of_a_type(spark):
    made = json.loads(H.schema_text(spark, "id string, kind string, n long, parts array<struct<x:double,ok:boolean>>, by map<string,int>", enums={"kind": ["a", "b"]}, max_items={"parts": 15}))
    assert made["required"] == ["id", "kind", "n", "parts", "by"] and made["additionalProperties"] is False
    assert made["properties"]["kind"] == {"type": "string", "enum": ["a", "b"]} and made["properties"]["parts"]["maxItems"] == 15
    assert made["properties"]["parts"]["items"]["properties"] == {"x": {"type": "number"}, "ok": {"type": "boolean"}} and made["properties"]["by"]["additionalProperties"] == {"type": "integer"}


def test_sources_are_selected_by_name(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "source string, n int")
    assert [r["n"] for r in H.select_sources(d, ["b"], ["a", "b"]).collect()] == [2] and H.select_sources(d, [], ["a", "b"]).count() == 3
    with pytest.raises(ValueError):
        H.select_sources(d, ["c"], ["a", "b"])


def test_nulls_are_violations(spark):
    maps = spark.createDataFrame([(1, None, ["a"]), (2, "a", [None]), (3, "a", None), (4, "a b", ["a", "b"]), (5, "a", [])], "map_id int, content string, group_ids array<string>")
    assert sorted(tuple(r) for r in K.working_map_valid(maps).collect()) == [(1, "blank"), (2, "group missing"), (3, "group missing")]
    claims = spark.createDataFrame([(1, None, None), (2, [], []), (3, [5], [None]), (4, [5], [5])], "claim int, evidence array<int>, related_unit_ids array<int>")
    assert found(K.evidence_valid(claims, spark.createDataFrame([(5,)], "unit_id int"))) == [("no evidence", "1"), ("no evidence", "2"), ("unknown unit", "3")]
    index = spark.createDataFrame([(1, "w"), (2, None)], "id int, d string")
    rows = spark.createDataFrame([(1, None), (2, "x"), (None, "y")], "id int, suggestion string")
    assert found(K.calibration_valid(rows, index)) == [("blank", "1"), ("not watched", "2"), ("not watched", "None")]
    routed = spark.createDataFrame([(1, "r", None), (2, None, ["b"]), (3, "r", ["b"]), (4, "n", None)], "id int, d string, t array<string>")
    bundles = spark.createDataFrame([("b", [3])], "bundle_id string, item_ids array<int>")
    assert found(K.routing_valid(routed, bundles, routed.select("id"))) == [("topics", "1"), ("topics", "2")]


def test_queue_and_imports(spark):
    jobs = spark.createDataFrame([("a", "2024-01-01T00:00:00Z"), ("b", None), ("c", "x"), ("d", "2030-01-01"), ("e", "0")], "job_id string, retry_at string")
    got = {r["job_id"]: r["action"] for r in H.requeue(jobs, F.expr("TIMESTAMP'2024-06-01'"), spark.createDataFrame([("e",), ("e",)], "job_id string")).collect()}
    assert got == {"a": "due", "b": "quarantine", "c": "quarantine", "d": "wait", "e": "quarantine"}
    files = [("a/b.md", 1, False), ("a/..b", 1, False), ("../x", 1, False), ("a/..", 1, False), ("/x", 1, False), ("", 1, False), (None, 1, False), ("a\\b", 1, False), ("l", 1, True), ("big", 3 * 1024 * 1024, False), ("n", None, False), ("m", 1, None)]
    bad = found(H.import_valid(spark.createDataFrame(files, "path string, n_bytes long, is_link boolean")))
    assert bad == sorted([("outside", "../x"), ("outside", "a/.."), ("outside", "/x"), ("outside", ""), ("outside", "None"), ("outside", "a\\b"), ("link", "l"), ("link", "m"), ("too large", "big"), ("too large", "n")])


def test_references_and_links_of_any_spelling(spark):
    html = "&#233;&#xE9;&eacute;&amp;lt;&copy;&nosuch;&#0;&#xD800;&#128512; & &lt"
    row = spark.createDataFrame([(html, """<a class=x href='/one'>1</a><A HREF=/two>2</A><a data-href="/no" href = "/three">3</a><a name=q>4</a><area href="/no">""")], "t string, h string").select(X.unescaped(F.col("t")).alias("t"), X.html_hrefs("h").alias("h")).first()
    assert row["t"] == "ééé&lt;©&nosuch;&#0;&#xD800;😀 & &lt" and row["h"] == ["/one", "/two", "/three"]
