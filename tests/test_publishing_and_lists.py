"""Publishing from the executors, and the stream of lists: repeats, failures, restarts."""

import json
import sys

import pytest
from pyspark import cloudpickle

from stratal.operators import publishing as W
from stratal.sources.list_stream import list_source
from stratal.streaming import lists as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test


def tree(spark, *rows):
    return spark.createDataFrame([(k, p, f"h{c}", c) for k, p, c in rows], "key string, parent string, content_hash string, content string")


def source(spark, tmp_path, name, kind=W.FolderTarget):
    root = f"file://{tmp_path}/t"
    spark.dataSource.register(W.node_source(name, lambda: kind(root)))
    return W.FolderTarget(root)


def nodes(target):
    return {k: h for p in target.parts() for k, h in target.listed(p)}


def test_a_tree_is_published_by_levels_and_once(spark, tmp_path):
    target = source(spark, tmp_path, "tree_once")
    rows = [("root", None, "a"), *((f"n{k}", "root", "b") for k in range(20)), *((f"m{k}", f"n{k % 20}", "c") for k in range(60))]
    first = W.publish_tree(spark, "tree_once", tree(spark, *rows).repartition(5))
    assert nodes(target) == {k: f"h{c}" for k, _, c in rows} and sum(r["put"] for r in target.receipts(first)) == 81
    again = W.publish_tree(spark, "tree_once", tree(spark, *rows))
    assert target.receipts(again) == []  # nothing to do, nothing written
    third = W.publish_tree(spark, "tree_once", tree(spark, ("root", None, "a"), ("n1", "root", "new"), ("x", "n1", "d")))
    assert nodes(target) == {"root": "ha", "n1": "hnew", "x": "hd"} and sum(r["put"] for r in target.receipts(third)) == 2 and sum(r.get("deleted", 0) for r in target.receipts(third)) == 79


def test_a_repeated_task_writes_once(tmp_path):
    target = W.FolderTarget(f"file://{tmp_path}/t")
    writer = W.node_source("tree_task", lambda: W.FolderTarget(f"file://{tmp_path}/t"))({"run": "r1"}).writer(None, False)
    rows = [{"key": k, "parent": None, "content_hash": "h", "content": "c", "action": "create"} for k in "abc"]
    first, second = writer.write(iter(rows)), writer.write(iter(rows))
    assert (first.put, second.put, second.repeated) == (3, 0, 3)
    assert all(target._read(target._name(k))["writes"] == 1 for k in "abc")
    writer.commit([second, None])
    writer.abort([first, None])
    assert sorted(json.dumps(r, sort_keys=True) for r in target.receipts("r1")) == ['{"deleted": 0, "put": 0, "repeated": 3}', '{"given up": true, "tasks": 1}']


class Forgetful(W.FolderTarget):
    def put(self, key, *rest):
        return True if key == "b" else super().put(key, *rest)


def test_the_target_is_read_back(spark, tmp_path):
    source(spark, tmp_path, "tree_forgets", Forgetful)
    with pytest.raises(RuntimeError, match="'b', 'create'"):
        W.publish_tree(spark, "tree_forgets", tree(spark, ("a", None, "1"), ("b", "a", "2")))


class Breaks(W.FolderTarget):
    def put(self, key, *rest):
        if key == "m7":
            raise OSError("unreachable")
        return super().put(key, *rest)


def test_a_run_that_broke_off_is_gone_on_with(spark, tmp_path):
    rows = [("root", None, "a"), *((f"m{k}", "root", "c") for k in range(30))]
    target = source(spark, tmp_path, "tree_breaks", Breaks)
    with pytest.raises(Exception, match="unreachable"):
        W.publish_tree(spark, "tree_breaks", tree(spark, *rows), run="broken")
    assert {"given up"} <= {k for r in target.receipts("broken") for k in r} and "m7" not in nodes(target)
    source(spark, tmp_path, "tree_mended")
    W.publish_tree(spark, "tree_mended", tree(spark, *rows))
    assert nodes(target) == {k: f"h{c}" for k, _, c in rows}


def test_nodes_without_a_way_to_the_top_are_refused(spark):
    for rows in ([("a", None, "1"), ("b", "gone", "2")], [("a", "b", "1"), ("b", "a", "2")]):
        with pytest.raises(ValueError):
            W.levels(tree(spark, *rows))


def upstream(root, **held):
    for name, cursors in held.items():
        folder = root / "groups" / f"group={name}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{len(list(folder.iterdir()))}.txt").write_text("".join(json.dumps({"cursor": c, "post_id": p, "text": f"{name}-{p}"}) + "\n" for c, p in cursors))


def test_stop_restart_overlap_and_a_failing_list(spark, tmp_path):
    root, down = tmp_path / "up", tmp_path / "down"
    lists, newest, fetch = S.landed(f"file://{root}")

    def asked(name):
        if name == "2" and down.exists():
            raise OSError("rate limited")
        return newest(name)

    spark.dataSource.register(list_source("lists_restart", S.POSTS, lists, asked, fetch))
    out = f"file://{tmp_path}/out"
    posts = lambda: sorted((r["list"], r["post_id"]) for r in spark.read.schema(S.POSTS).parquet(f"{out}/posts").collect())

    def offsets():  # what Spark has planned last
        log = tmp_path / "out/checkpoint/offsets"
        return json.loads((log / str(max(int(f.name) for f in log.iterdir() if f.name.isdigit()))).read_text().splitlines()[-1])

    upstream(root, **{"1": [(k, k) for k in range(1, 8)], "2": [(k, 100 + k) for k in range(1, 6)]})
    S.advance(spark, "lists_restart", out, limit=3)
    assert posts() == [(1, k) for k in range(1, 8)] + [(2, 100 + k) for k in range(1, 6)] and offsets() == {"1": 7, "2": 5}
    down.touch()
    upstream(root, **{"1": [(7, 50), (9, 9)], "2": [(6, 106)], "3": [(4, 300)]})  # 50 came late, at a cursor that was read
    S.advance(spark, "lists_restart", out, overlap=2)
    assert (1, 50) in posts() and (2, 106) not in posts() and offsets() == {"1": 9, "2": 5, "3": 4}
    down.unlink()
    S.advance(spark, "lists_restart", out, overlap=2)
    assert posts() == sorted([(1, k) for k in range(1, 8)] + [(1, 50), (1, 9), (3, 300)] + [(2, 100 + k) for k in range(1, 7)]) and offsets() == {"1": 9, "2": 6, "3": 4}
    S.advance(spark, "lists_restart", out, overlap=5)  # nothing new: equal rows
    assert len(posts()) == 16
