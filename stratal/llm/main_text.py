"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A node is a block-level element or a run of inline text. The trees give the odds that a node holds main text. A node
is chosen only with its parent, so the decoder takes the subtree closed upwards with the largest sum of log-odds:
best(v) = max(0, odds(v) + sum of best(children)). The text runs that are chosen, in page order, are the main text.
What stands above a node counts by its share of the page, so a wrapper named after a part of it condemns nothing.
The trees learn from pages of several families of layouts that main_text_training makes by rule.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from stratal.llm import boosting
from stratal.llm.common import by_bytes
from stratal.llm.dom import Tree, parse

TRAINING_PAGES = 900
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "body", "#text", "dialog", "button"]
GOOD = frozenset("content article post entry body main story text hentry prose page".split())
# Words of class, id and role that name a part of a page, by kind.
KINDS = {
    "menu": "nav navbar navigation menu menus submenu subnav sidenav topnav breadcrumb breadcrumbs crumbs pagination pager toc toolbar topbar dropdown tabs sitemap skip",
    "head": "header masthead branding logo top tagline",
    "foot": "footer foot copyright colophon legal disclaimer contentinfo bottom imprint",
    "side": "sidebar side aside widget widgets complementary related recommended recommendations rail secondary teaser teasers trending popular more",
    "advert": "ad ads advert adverts advertisement advertising promo promos promotion promoted sponsor sponsored sponsors banner commercial adslot",
    "notice": "cookie cookies consent notice notices alert alerts gdpr popup modal overlay warning message toast announcement",
    "comment": "comment comments commentlist reply replies respond discussion disqus responses trackbacks feedback",
    "social": "share sharing social follow tags tagcloud tag likes",
    "form": "form newsletter subscribe subscription subscriptions signup login signin register search searchbox contact input",
    "meta": "meta byline author date dateline timestamp published info hidden print",
}
KIND_OF = {w: k for k, words in enumerate(KINDS.values()) for w in words.split()}
BOILERPLATE = frozenset("nav aside form dialog button menu".split())
N_KINDS = len(KINDS)
_TAG_AT = {t: k for k, t in enumerate(TAGS)}
COPYRIGHT = ("©", "(c)", "copyright", "all rights reserved")


def features(tree: Tree) -> np.ndarray:
    """One row a node: tag, attribute tokens, ancestors, subtree density, place, siblings; linear in the nodes."""
    n = len(tree)
    parents = np.array(tree.parents, dtype=np.int64)
    chars, linked, runs = tree.sums()
    is_text = np.array([t == "#text" for t in tree.tags])
    total = max(1.0, float(chars[is_text].sum()))
    share = chars / total
    # down the tree: what stands above a node
    article, boiler, foot, in_header, lists, hidden, depth = ([0] * n for _ in range(7))
    good, worst, own_kind, sentences, spaces, rights, place = [0] * n, [1.5] * n, np.zeros((n, N_KINDS), dtype=np.float32), [0] * n, [0] * n, [0] * n, [0] * n
    counts: list[dict] = [{} for _ in range(n + 1)]
    children = [0] * (n + 1)
    shares = share.tolist()
    for k, (tag, p) in enumerate(zip(tree.tags, tree.parents, strict=True)):
        up = p >= 0
        inside = article[p] if up else 0
        article[k] = inside + (tag in ("article", "main"))
        boiler[k] = (boiler[p] if up else 0) + (tag in BOILERPLATE)
        foot[k] = (foot[p] if up else 0) + (tag == "footer")
        in_header[k] = (in_header[p] if up else 0) or (0 if tag != "header" else 1 if inside else 2)
        lists[k] = (lists[p] if up else 0) + (tag in ("ul", "ol", "table"))
        hidden[k] = (hidden[p] if up else 0) + tree.hidden[k]
        depth[k] = depth[p] + 1 if up else 0
        good[k] = good[p] if up else 0
        worst[k] = worst[p] if up else 1.5
        if tree.tokens[k]:
            kinds = {KIND_OF[t] for t in tree.tokens[k] if t in KIND_OF}
            good[k] += len(GOOD & tree.tokens[k])
            for j in kinds:
                own_kind[k, j] = 1
            if kinds:
                worst[k] = min(worst[k], shares[k])
        if tag == "#text":
            text = tree.texts[k]
            sentences[k] = text.count(". ") + text.count(", ") + text.endswith((".", "!", "?", "…", "。"))
            spaces[k] = text.count(" ")
            low = text.lower()
            rights[k] = not article[k] and any(c in low for c in COPYRIGHT)  # within an article such a line is part of it
        place[k] = children[p]
        children[p] += 1
        own = counts[p]
        own[tag] = own.get(tag, 0) + 1
    up = np.where(parents >= 0, parents, n)
    pad = lambda values, outside: np.append(np.asarray(values, dtype=np.float64), outside)
    # prose: characters of runs that are not links and have marks of sentences
    text_prose = np.where(is_text & (linked < 0.5 * np.maximum(chars, 1)) & (np.array(sentences) >= 2), chars, 0.0).tolist()
    text_rights = [float(r) for r in rights]
    for k in range(n - 1, 0, -1):
        p = tree.parents[k]
        if p >= 0:
            text_prose[p] += text_prose[k]
            text_rights[p] += text_rights[k]
    prose = np.array(text_prose)
    prose_total = max(1.0, float(prose[is_text].sum()))
    before = np.concatenate([[0.0], np.cumsum(np.where(is_text, chars, 0.0))[:-1]]) / total
    h1 = np.array([t == "h1" for t in tree.tags])
    seen_h1 = np.cumsum(h1) - h1
    tag_at = np.array([_TAG_AT.get(t, -1) for t in tree.tags], dtype=np.int64)
    density = linked / np.maximum(1, chars)
    # siblings: nodes of one parent, in order
    order = np.lexsort((place, up))
    same = up[order][1:] == up[order][:-1]
    left, right = np.full(n, n, dtype=np.int64), np.full(n, n, dtype=np.int64)
    left[order[1:][same]] = order[:-1][same]
    right[order[:-1][same]] = order[1:][same]
    log_chars, tags_out = pad(np.log1p(chars), -1), pad(tag_at, -2)
    siblings = np.array(children, dtype=np.float64)[parents]
    alike = np.array([counts[p][t] for t, p in zip(tree.tags, tree.parents, strict=True)], dtype=np.float64)
    onehot = np.zeros((n, len(TAGS)), dtype=np.float32)
    known = np.flatnonzero(tag_at >= 0)
    onehot[known, tag_at[known]] = 1
    worst_up = pad(worst, 1.5)[up]
    columns = [
        good, article, boiler, foot, in_header, lists, hidden, depth, worst, worst_up, np.log1p(chars), density, runs, np.log1p(chars / np.maximum(1, runs)), share, before,
        np.array(children[:n]), place, siblings, siblings - np.array(place), log_chars[left], log_chars[right], pad(density, -1)[left], pad(density, -1)[right], pad(share, 1)[up], chars / np.maximum(1, pad(chars, total)[up]), pad(density, 0)[up],
        pad(tag_at, -1)[up], tags_out[left], tags_out[right], sentences, spaces, np.array(text_rights) / np.maximum(1, runs), alike, prose / prose_total, pad(prose, prose_total)[up] / prose_total, prose / np.maximum(1, chars), seen_h1, int(h1.any()) + np.zeros(n),
    ]
    return np.concatenate([onehot, own_kind, np.stack([np.asarray(c, dtype=np.float32) for c in columns], axis=1)], axis=1)


def decode(tree: Tree, odds: np.ndarray) -> list[str]:
    """Texts of the best choice of nodes that is closed towards the root."""
    best = odds.astype(np.float64).tolist()
    for k in range(len(tree) - 1, -1, -1):
        gain = best[k] = max(0.0, best[k])
        if gain and tree.parents[k] >= 0:
            best[tree.parents[k]] += gain
    out, chosen = [], [False] * len(tree)
    for k, p in enumerate(tree.parents):
        chosen[k] = best[k] > 0 and (p < 0 or chosen[p])
        if chosen[k] and tree.tags[k] == "#text":
            out.append(tree.texts[k])
    return out


def extract(pages: list[str], model: dict) -> list[str]:
    trees = [parse(p) for p in pages]
    filled = [t for t in trees if len(t)]
    if not filled:
        return [""] * len(pages)
    odds = boosting.logits(model, np.concatenate([features(t) for t in filled]))
    ends = iter(np.split(odds, np.cumsum([len(t) for t in filled])[:-1]))
    return ["\n".join(decode(t, next(ends))) if len(t) else "" for t in trees]


@lru_cache(maxsize=2)
def train(pages: int = TRAINING_PAGES, seed: int = 11) -> dict:
    from stratal.llm.main_text_training import Templates, labelled

    made = Templates(seed)
    data = [labelled(made.page()) for _ in range(pages)]
    return boosting.fit(np.concatenate([features(t) for t, _ in data]), np.concatenate([y for _, y in data]))


def main_text(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page, no shuffle; whole pages, a slice at a time.

    Null and empty html and pages without main text give an empty text; null ids and urls and repeated rows stay, an
    empty table gives none, other columns are not read. Time and memory are linear in the page, whatever its markup.
    """
    model = model or train()

    def run(batches):
        import pyarrow as pa

        for batch in by_bytes(batches, column=2, limit=2_000_000):
            texts = extract(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "CAST(url AS STRING) AS url", "COALESCE(CAST(html AS STRING), '') AS html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
