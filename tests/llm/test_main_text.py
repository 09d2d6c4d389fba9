import random
import time

import numpy as np
import pytest

from stratal.llm import boosting
from stratal.llm import main_text as M
from stratal.llm import main_text_training as T
from stratal.llm.dom import parse


@pytest.fixture(scope="module")
def model():
    return M.train()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></li></ul></nav><!-- note --><div class="ad">Buy now, cheap things.</div>
<div id="cookie-notice"><p>We use cookies here.</p><button>OK</button></div>
<article><h1>A &amp; B &eacute;</h1><p><b>First  paragraph
 of the story &lt;here&gt;, with words.<br><p>Second one has <a href="/x">a link</a> inside it, and more.</p><p>End.</p></article>
<section class="comments"><h2>Comments</h2><div class="comment"><b>Joe</b><p>I like this very much indeed.</p></div></section>
<aside class="sidebar"><h3>More</h3><p>Something else to read today.</p></aside>
<form class="newsletter"><label>Subscribe</label><input></form><footer>&copy; me &middot; All rights.</footer></body></html>"""
STORY = "<h1>The heading</h1><p>This is the text, of the story. It goes on.</p><p>And on, with more words.</p>"
WANT = "The heading\nThis is the text, of the story. It goes on.\nAnd on, with more words."


def test_main_text_of_a_page(model):
    assert M.extract([PAGE], model) == ["A & B é\nFirst paragraph of the story <here>, with words.\nSecond one has a link inside it, and more.\nEnd."]


@pytest.mark.parametrize("page", [
    f'<body class="page-with-sidebar social"><nav><a href=/>Home</a></nav><article>{STORY}</article><footer>&copy; x</footer>',
    f'<main class="search-results-page"><article>{STORY}</article></main>',
    f'<html class="comments modal"><body id="footer-fixed"><div class="cookie-theme"><main>{STORY}</main></div>',
    "<article><header><h1>The heading</h1></header><p>This is the text, of the story. It goes on.</p><p>And on, with more words.</p></article>",
    f"<div><a href=/a>Home</a> | <a href=/b>News</a> | <a href=/c>About</a></div><div>{STORY}</div><div>&copy; 2024 Example Inc.</div>",
    f"<article>{STORY.replace('of the story', '<svg><g><path/></g><text>ICON</text></svg>of the <math><mi>M</mi></math>story')}<video><div>no video</div></video><select><option>one</select></article>",
    f"<article>{STORY.replace('It goes', '<script>x</script>It <img src=x alt=y>goes')}</article><object><p>none</p></object>",
    f"<article data-x=\"<p>not a tag</p>\" title='a>b'>{STORY}</article>",
])
def test_ordinary_markup(model, page):
    assert M.extract([page], model) == [WANT]


def family(name, rng):
    """Pages of layouts that no training page has; the text wanted of each."""
    word = lambda: "".join(rng.choice("kvzw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    words = lambda n: " ".join(word() for _ in range(n))
    prose = lambda: ". ".join(words(rng.randint(6, 15)).capitalize() + ", " + words(4) for _ in range(rng.randint(2, 5))) + "."
    links = "".join(f"<li><a href='/{word()}'>{words(2)}</a>" for _ in range(6))
    title, parts = words(5), [prose() for _ in range(rng.randint(2, 7))]
    p = "".join(f"<p>{x}" for x in parts)
    page = {
        "roles": f"<div role=banner><a href=/>{words(2)}</a></div><div role=navigation><ul>{links}</ul></div><div role=main><h1>{title}</h1>{p}</div><div role=complementary><p>{words(6)}</div><div role=contentinfo>{words(5)}</div>",
        "wiki": f"<div id=mw-head><ul>{links}</ul></div><div id=content class=mw-body><h1 id=firstHeading>{title}</h1><div id=bodyContent><div id=toc class=toc><ul>{links}</ul></div>{p}</div></div><div id=mw-panel class=portal><ul>{links}</ul></div><div id=footer><ul><li>{words(4)}</ul></div>",
        "news": f"<section class=topnav><ul>{links}</ul></section><section class=story-body><h1>{title}</h1><ul class=share-tools><li><a href=/f>{word()}</a></ul>{p}</section><section class=related-links><h3>{words(2)}</h3><ul>{links}</ul></section><section class=adslot>{words(9)}</section>",
        "docs": f"<my-header><a href=/>{words(1)}</a></my-header><div class=flex><div class=sidenav><ul>{links}</ul></div><div class=prose><h1>{title}</h1>{p}</div></div><my-footer class=footer>{words(6)}</my-footer>",
        "frames": f"<center><table><tbody><tr><td><font size=1>{'<br>'.join(f'<a href=/{word()}>{words(1)}</a>' for _ in range(5))}</font></td><td><h1>{title}</h1>{p}</td></tr></tbody></table></center>",
    }[name]
    return f"<html><body>{page}</body></html>", "\n".join([title, *parts])


@pytest.mark.parametrize("name", ["roles", "wiki", "news", "docs", "frames"])
def test_layouts_that_no_training_page_has(model, name):
    rng = random.Random(name)
    made = [family(name, rng) for _ in range(40)]
    got = M.extract([p for p, _ in made], model)
    assert np.mean([g == w for g, (_, w) in zip(got, made, strict=True)]) >= 0.9


def test_unseen_templates(model):
    made = T.Templates(4242)
    right = 0
    for _ in range(100):
        tree, y = T.labelled(made.page())
        right += M.decode(tree, boosting.logits(model, M.features(tree))) == [t for k, t in enumerate(tree.texts) if tree.tags[k] == "#text" and y[k]]
    assert right >= 90


@pytest.mark.parametrize("page", ["<article>" + "<p>Some words, here.</p>" * 100_000 + "</article>", '<a b="' * 100_000, "<p>x</p><a b='" * 20_000, "<div>" * 50_000 + "x", "<svg>" * 50_000, "</section>" * 50_000 + "<center>" * 50_000 + "<p>x" * 30_000, "<!--" * 50_000, "<" * 100_000, "<p>" + "word, " * 300_000])
def test_long_and_broken_pages_take_linear_time(model, page):
    began = time.process_time()
    M.extract([page], model)
    assert time.process_time() - began < 8


def test_rows_of_any_kind(spark, model):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, PAGE), (2, "v", None), (3, "w", ""), (4, "x", "<p>"), (5, "y", "no markup"), (6, "z", "<article>" + "<p>Some words, here.</p>" * 2_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "9 AS n_chars")
    got = M.main_text(pages.repartition(3)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["text"].startswith("A & B") for r in got) == 3 and [r["text"] for r in got if r["page_id"] in (2, 3, 4)] == [""] * 3
    assert M.main_text(pages.limit(0)).count() == 0


def test_decoding_is_closed_towards_the_root_and_optimal():
    tree = parse("<div><p>a</p><p>b</p></div><section><p>c</p></section>")
    assert tree.tags == ["div", "p", "#text", "p", "#text", "section", "p", "#text"]
    odds = np.array([-1.0, 1, 1, -5, 2, -9, 1, 2])
    assert M.decode(tree, odds) == ["a"]  # c is not worth its section, b not its paragraph


def test_decoding_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        tree = parse("".join(rng.choice(["<div>", "</div>", "<p>t", "x<br>", "<section>", "</section>"]) for _ in range(9)))
        n = len(tree)
        odds = np.array([rng.uniform(-2, 2) for _ in range(n)])
        best, texts = 0.0, []
        for mask in range(1 << n):
            own = [k for k in range(n) if mask >> k & 1]
            if all(tree.parents[k] < 0 or mask >> tree.parents[k] & 1 for k in own) and odds[own].sum() > best:
                best, texts = odds[own].sum(), [tree.texts[k] for k in own if tree.tags[k] == "#text"]
        assert M.decode(tree, odds) == texts


def test_sums_and_places_equal_a_plain_count():
    tree = parse("<ul><li>one <a href=x>two</a></li><li>three<ul><li>four</ul></li></ul><p>five</p>")
    x = M.features(tree)
    at = len(M.TAGS) + M.N_KINDS
    for k in range(len(tree)):
        below = [j for j in range(len(tree)) if any(a == k for a in _line(tree, j))]
        mates = [j for j in range(len(tree)) if tree.parents[j] == tree.parents[k]]
        assert np.isclose(np.expm1(x[k, at + 10]), sum(len(tree.texts[j]) for j in below), rtol=1e-4)
        assert x[k, at + 17] == mates.index(k) and x[k, at + 18] == len(mates)
        assert x[k, at + 33] == sum(tree.tags[j] == tree.tags[k] for j in mates)


def _line(tree, k):
    while k >= 0:
        yield k
        k = tree.parents[k]


def test_one_tree_takes_the_best_split():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (200, 3))
    y = (x[:, 1] > 0.4).astype(float)
    one = boosting.fit(x, y, trees=1, depth=1, rate=1.0, bins=32)
    g = y.mean() - y  # gradients of the logistic loss at the base rate
    h = np.full(200, y.mean() * (1 - y.mean()))
    gains = {}
    for j in range(3):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])):
            left = x[:, j] <= cut
            gains[j, cut] = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
    j, cut = max(gains, key=gains.get)
    assert (one["features"][0][0], one["thresholds"][0][0]) == (j, cut)
    left = x[:, j] <= cut
    assert np.allclose(one["leaves"][0], [-g[left].sum() / (h[left].sum() + 1), -g[~left].sum() / (h[~left].sum() + 1)], atol=1e-3)
