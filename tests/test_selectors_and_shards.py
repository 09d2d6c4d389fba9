"""Selectors against a matcher that looks at whole paths; shard files read back."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stratal.functions import selectors as S
from stratal.operators import units as U
from stratal.sources import shards as D

RNG = random.Random(9)


def tree(depth=0):
    tag = RNG.choice(["div", "p", "ul", "li", "a", "span"])
    attrs = {}
    if RNG.random() < 0.5:
        attrs["class"] = " ".join(RNG.sample(["x", "y", "z-1"], RNG.randrange(1, 3)))
    if RNG.random() < 0.3:
        attrs["id"] = RNG.choice(["one", "two"])
    if RNG.random() < 0.4:
        attrs["href"] = RNG.choice(["/a/b", "http://h/x.html", "#top", ""])
    return tag, attrs, [tree(depth + 1) for _ in range(RNG.randrange(0, 4))] if depth < 5 else []


def rendered(node):
    tag, attrs, inner = node
    return f"<{tag}" + "".join(f' {k}="{v}"' for k, v in attrs.items()) + ">" + "".join(map(rendered, inner)) + f"</{tag}>"


def fits(compound, node):
    tag, attrs, _ = node
    want_tag, tests = compound
    if want_tag not in ("*", tag):
        return False
    for kind, name, value in tests:
        has = attrs.get(name)
        if has is None or not {"has": lambda: True, "=": lambda: has == value, "^=": lambda: has.startswith(value), "$=": lambda: has.endswith(value), "*=": lambda: value in has, "~=": lambda: value in has.split()}[kind]():
            return False
    return True


def path_matches(selector, path):
    """Whether a selector [(combinator, compound), ...] matches the last node of a path, from right to left."""
    (comb, compound), rest = selector[-1], selector[:-1]
    if not fits(compound, path[-1]):
        return False
    if not rest:
        return True
    if comb == ">":
        return len(path) > 1 and path_matches(rest, path[:-1])
    return any(path_matches(rest, path[:k]) for k in range(1, len(path)))


SELECTORS = {
    "a": [[("", ("a", []))]],
    "div a[href]": [[("", ("div", [])), (" ", ("a", [("has", "href", "")]))]],
    "ul > li.x > a": [[("", ("ul", [])), (">", ("li", [("~=", "class", "x")])), (">", ("a", []))]],
    "#one .y": [[("", ("*", [("=", "id", "one")])), (" ", ("*", [("~=", "class", "y")]))]],
    "div > p span.z-1, a[href^='/'], *#two": [[("", ("div", [])), (">", ("p", [])), (" ", ("span", [("~=", "class", "z-1")]))], [("", ("a", [("^=", "href", "/")]))], [("", ("*", [("=", "id", "two")]))]],
    "span span > * a[href$=\".html\"]": [[("", ("span", [])), (" ", ("span", [])), (">", ("*", [])), (" ", ("a", [("$=", "href", ".html")]))]],
    "p [href*=h].x": [[("", ("p", [])), (" ", ("*", [("*=", "href", "h"), ("~=", "class", "x")]))]],
}


@pytest.mark.parametrize("selector", SELECTORS)
def test_selectors_match_what_paths_match(selector):
    compounds = S.compiled(selector)
    hits = 0
    for _ in range(400):
        root, want = tree(), []

        def visit(node, above, want=want):
            path = [*above, node]
            if any(path_matches(s, path) for s in SELECTORS[selector]):
                want.append((node[0], node[1].get("href")))
            for inner in node[2]:
                visit(inner, path)

        visit(root, [])
        got = [(e["tag"], e["href"]) for e in S.elements(rendered(root), compounds)]
        assert got == want
        hits += len(want)
    assert hits


def test_lines_of_a_body_are_kept(spark):
    html = "<body class=b><script>var x='<p>no</p>'</script><h1> One\n title</h1><p>first<br>second &amp; <b>third</b></p><style>p{}</style><noscript>no</noscript><p>last<p>open</body>"
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>only</b></p>"), (5, "<div><p class='b'>in<div>deep</div></div>out")], "k long, html string")
    got = {r["k"]: r["t"] for r in df.select("k", S.body_lines("html", ".b, body").alias("t")).collect()}
    assert got == {1: "One title\nfirst\nsecond &\nthird\nlast\nopen", 2: None, 3: None, 4: None, 5: "in\ndeep"}
    links = df.select(F.explode(S.select("html", "p, br")).alias("e")).select("e.tag", "e.text").collect()
    assert [tuple(r) for r in links][:2] == [("p", "first\nsecond &\nthird"), ("br", "")]


@pytest.mark.parametrize("bad", ["", "  ", "a >", "> a", "a,,b", "a[", "a..b", ".xdiv p&", "a b:hover", "[x=]"])
def test_what_is_no_selector_is_refused(bad):
    with pytest.raises(ValueError):
        S.compiled(bad)


def test_catalog_files_hold_the_rows_in_bounds(spark, tmp_path):
    rows = spark.createDataFrame([("s1", k, "x" * (k % 700)) for k in range(900)] + [("s2", k, "é" * 300_000 if k == 1 else "y") for k in range(3)], "scope string, k long, t string")
    D.catalog_files(rows.repartition(5), "scope", "k", f"{tmp_path}/c", 160, 64 * 1024)
    assert D.problems(spark, f"{tmp_path}/c", 160, 64 * 1024).count() == 0
    manifest = {(r["scope"], r["batch"]): r for r in spark.read.parquet(f"{tmp_path}/c/manifest").collect()}
    for (scope, batch), r in manifest.items():
        (file,) = [f for f in os.listdir(f"{tmp_path}/c/shards/scope={scope}/batch={batch}") if f.startswith("part")]
        raw = open(f"{tmp_path}/c/shards/scope={scope}/batch={batch}/{file}", "rb").read()
        assert len(raw) == r["n_bytes"] and raw.count(b"\n") == r["n_rows"] <= 160 and (r["n_bytes"] <= 64 * 1024 or r["n_rows"] == 1)
    lines = D.files(spark, f"{tmp_path}/c").where("scope = 's1'").orderBy("batch").collect()
    ks = [int(line.split('"k":')[1].split(",")[0]) for r in lines for line in r["content"].splitlines()]
    assert ks == list(range(900))


def test_broken_shards_are_found(spark, tmp_path):
    rows = spark.createDataFrame([("s", b, k, f"line {k}") for b in range(5) for k in range(4)], "scope string, batch int, at long, line string")
    D.write_batches(rows, f"{tmp_path}/c")
    folder = lambda b: f"{tmp_path}/c/shards/scope=s/batch={b}"
    part = lambda b: next(f"{folder(b)}/{f}" for f in os.listdir(folder(b)) if f.startswith("part"))
    for b in (0, 1, 2):
        for f in os.listdir(folder(b)):
            if f.endswith(".crc"):
                os.remove(f"{folder(b)}/{f}")
    with open(part(0), "a") as f:
        f.write("more\n")
    with open(f"{folder(1)}/part-other.txt", "w") as f:
        f.write("again\n")
    os.remove(part(2))
    got = {(r["problem"], r["batch"]) for r in D.problems(spark, f"{tmp_path}/c").collect()}
    assert got == {("changed", 0), ("several files", 1), ("missing", 2)}
    assert {r["problem"] for r in D.problems(spark, f"{tmp_path}/c", max_rows=3).collect()} == {"changed", "several files", "missing", "too large"}
    D.write_batches(rows.where("batch <> 3"), f"{tmp_path}/gap")
    assert [tuple(r) for r in D.problems(spark, f"{tmp_path}/gap").collect()] == [("gap", "s", 4)]
    with pytest.raises(ValueError):
        D.write_batches(rows.withColumn("scope", F.lit("a/b")), f"{tmp_path}/bad")


def test_workspaces_nest_items_and_split_large_units(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "PART_ITEMS", 40)
    items = spark.createDataFrame([("u1", f"i{k:04d}", k) for k in range(100)] + [("u2", "i", 1)], "unit_id string, item_id string, n long")
    units = spark.createDataFrame([("u1", "one"), ("u2", "two"), ("u3", "empty")], "unit_id string, title string")
    packages = spark.createDataFrame([("p", "u1"), ("p", "u2"), ("q", "u3"), ("q", "u1")], "package_id string, unit_id string")
    docs = {(r["package_id"], r["unit_id"], r["part"]): r["document"] for r in D.unit_documents(packages, units, items).collect()}
    assert set(docs) == {("p", "u1", 0), ("p", "u1", 1), ("p", "u1", 2), ("q", "u1", 0), ("q", "u1", 1), ("q", "u1", 2), ("p", "u2", 0), ("q", "u3", 0)}
    assert docs["p", "u2", 0] == '{"items":[{"item_id":"i","n":1}],"part":0,"title":"two","unit_id":"u2"}' and docs["q", "u3", 0].startswith('{"items":null')
    D.write_workspaces(packages, units, items, f"{tmp_path}/w")
    assert all(D.problems(spark, f"{tmp_path}/w/{x}").count() == 0 for x in ("units", "todo"))
    assert {(r["scope"], r["content"]) for r in D.files(spark, f"{tmp_path}/w/todo").collect()} == {("p", "- [ ] u1\n- [ ] u2\n"), ("q", "- [ ] u1\n- [ ] u3\n")}
    assert U.MAX_UNITS == 160
