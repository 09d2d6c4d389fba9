import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from stratal.functions import nested as N
from stratal.functions import text as X
from stratal.functions import times as T


def one(spark, column, **values):
    """The value of an expression over a row of these values."""
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://A.com/x/?page=2&ref=x#top", "http://a.com/x?page=2"),
        ("http://a.com", "http://a.com/"),
        ("http://a.com//", "http://a.com"),
        ("http://a.com/x?b=%20c+d&e=", "http://a.com/x?b=+c+d&e="),
        ("http://a.com/p;v=1?x", "http://a.com/p?x="),
        ("https://u:P@A.com:8080/Q/?UTM_X=1&a=1&a=2", "https://u:p@a.com:8080/Q?a=1&a=2"),
        ("http://a.com/?q=a%2Ab~c*&&gclid=1", "http://a.com/?q=a%2Ab~c%2A"),
        ("http://a.com/?q=%zz", "http://a.com/?q=%25zz"),
        ("no scheme", None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, X.canonical_url("u"), u=url) == want


@pytest.mark.parametrize(
    ("href", "want"),
    [("/x", "https://a.org/x"), ("y?z", "https://a.org/d/y?z"), ("//b.org/q", "https://b.org/q"), ("http://c/", "http://c/"), ("#f", "https://a.org/d/p?k=1#f"), ("?n", "https://a.org/d/p?n"), ("", "https://a.org/d/p?k=1")],
)
def test_absolute_url(spark, href, want):
    assert one(spark, X.absolute_url("h", "b"), h=href, b="https://a.org/d/p?k=1#old") == want


def test_links_rewritten_longest_first(spark):
    urls = F.create_map(*map(F.lit, ["agent", "https://w/$1", "agent-tools", "https://w/tools"]))
    got = one(spark, X.rewrite_links("c", F.map_keys(urls), urls), c="report://agent-tools report://agent, subreport://agent report://agentx")
    assert got == "https://w/tools https://w/$1, subreport://agent report://agentx"


def test_titles(spark):
    assert one(spark, X.markdown_title("c"), c="a\n# T x \n# U") == "T x" and one(spark, X.markdown_title("c"), c="#no") is None
    assert one(spark, X.replace_title("c", F.lit("N"))  , c="a\n# T\n# U") == "a\n# N\n# U"
    assert one(spark, X.replace_title("c", F.lit("N")), c="body") == "# N\n\nbody"


def test_small_text_functions(spark):
    assert one(spark, X.collapse("c"), c=" a   b\n\tc ") == "a b c"
    assert one(spark, X.post_id("c"), c="/user/status/123?x=1") == "123" and one(spark, X.post_id("c"), c="/home") is None
    assert one(spark, X.host("c"), c="HTTP://u:p@WWW.A.com:80/x") == "www.a.com"
    assert one(spark, X.arxiv_id("c"), c="https://arxiv.org/abs/2608.12345v2") == "2608.12345" and one(spark, X.arxiv_version("c"), c="https://arxiv.org/abs/2608.12345v2") == 2
    assert one(spark, X.topic_score("c"), c="Robotics and a humanoid ROBOT") == 4  # a robotics is a robot as well
    assert one(spark, X.error_class("c"), c="Selected model is at capacity; quota") == "capacity" and one(spark, X.error_class("c"), c="boom") == "process_error"
    assert one(spark, X.truthy(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert one(spark, X.unit_id("c"), c="k") == "u_" + hashlib.sha256(b"k").hexdigest()[:20]
    assert one(spark, X.html_text("c"), c="<p>a&amp;b</p><script>x<y</script><!-- c --> d") == "a&b d"


@pytest.mark.parametrize(("raw", "want"), [("2026-08-30T00:00:00Z", dt.datetime(2026, 8, 30)), ("0", dt.datetime(1970, 1, 1)), ("1.5", dt.datetime(1970, 1, 1, 0, 0, 1, 500000)), ("not-a-date", None), ("", None), (None, None), ("Sat Aug 30 00:00:00 +0000 2026", dt.datetime(2026, 8, 30))])
def test_lenient_times(spark, raw, want):
    assert one(spark, T.provider_timestamp(F.col("r").cast("string")).cast("timestamp_ntz"), r=raw) == want


def test_date_windows(spark):
    d = lambda day: dt.date(2026, 8, day)
    assert one(spark, T.dates_to_fetch("p", "t", 2), p=d(28), t=d(31)) == [d(29), d(30)]
    assert one(spark, T.dates_to_backfill("p", "t", 3), p=d(27), t=d(31)) == [d(28), d(29), d(30)]
    assert one(spark, T.dates_to_fetch(F.lit(None).cast("date"), "t", 2), t=d(31)) == [d(31)] and one(spark, T.dates_to_backfill(F.lit(None).cast("date"), "t", 2), t=d(31)) == []


@pytest.mark.parametrize(("previous", "upstream", "want"), [(100, 45100, (101, 20100, 25000)), (20100, 45100, (20101, 40100, 5000)), (40100, 45100, (40101, 45100, 0)), (50, 50, (51, 50, 0))])
def test_bounded_scan(spark, previous, upstream, want):
    assert tuple(one(spark, T.bounded_scan("p", "u", 20000), p=previous, u=upstream)) == want


def test_nested(spark):
    changed = one(spark, N.changed_fields({"x": F.lit(1), "y": F.lit(2)}, {"x": F.lit(1), "y": F.lit(3)}))
    assert {k: tuple(v) for k, v in changed.items()} == {"y": ("2", "3")}
    assert one(spark, N.triggered({"6h": F.lit(30), "24h": F.lit(None).cast("int")}, {"6h": 25, "24h": 75})) == {"6h": 30}
    assert one(spark, N.last_entries(F.array(*map(F.lit, range(30))), 20)) == list(range(10, 30)) and one(spark, N.last_entries(F.array(F.lit(1)), 20)) == [1]
