"""A tolerant HTML reader: block-level elements and runs of inline text as a tree of nodes, in time linear in the page."""

from __future__ import annotations

import html
import re

import numpy as np

# Quoted values without "<" cover nearly all tags; a match never runs past the next "<", so many of them stay linear.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^<\"]*+\"|'[^<']*+')?+|[\"'])*+)>")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)")
VALUE = re.compile(r"[^>\"']*+")
LOOSE = re.compile(r"[^<>]*+>?")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-label|aria-hidden|itemprop|href)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|\d+")
LAYOUT = re.compile(r"(?:^|[-_])(?:with|has|no|without|show|hide)[-_].*", re.I)
WHITE = re.compile(r"\s+")
# Fixed values of the HTML standard.
VOID = frozenset("area base basefont bgsound br col command embed frame hr img input keygen link meta param source track wbr".split())
OPAQUE = frozenset("template object svg math canvas select datalist audio video map applet frameset".split())
RAW = frozenset("script style textarea title iframe xmp noscript noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("html body button caption legend optgroup option summary tbody td tfoot th thead tr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("html body table td th ul ol dl div article section aside nav main form header footer blockquote figure details fieldset dialog menu button".split())
PHRASING = frozenset("p h1 h2 h3 h4 h5 h6 pre button summary legend caption dt figcaption".split())


class Tree:
    """Nodes in page order as parallel lists; parent -1 is the page. '#text' is a run of text between block boundaries."""

    def __init__(self):
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.tokens: list[frozenset] = []
        self.hidden: list[bool] = []

    def add(self, tag: str, parent: int, text: str = "", linked: int = 0, tokens: frozenset = frozenset(), hidden: bool = False) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.texts.append(text)
        self.linked.append(linked)
        self.tokens.append(tokens)
        self.hidden.append(hidden)
        return len(self.tags) - 1

    def __len__(self) -> int:
        return len(self.tags)

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters, characters within links and text runs of each subtree."""
        chars = [len(t) for t in self.texts]
        linked, runs = [*self.linked], [int(t == "#text") for t in self.tags]
        for k in range(len(self.tags) - 1, 0, -1):
            p = self.parents[k]
            if p >= 0:
                chars[p] += chars[k]
                linked[p] += linked[k]
                runs[p] += runs[k]
        return np.array(chars, dtype=np.float64), np.array(linked, dtype=np.float64), np.array(runs, dtype=np.float64)


def attribute_tokens(raw: str) -> tuple[frozenset, bool]:
    """Lower-case words of class, id, role and aria-label; whether the element is hidden.

    What follows with, has, no or without in a class name says how the page is laid out, not what the element is.
    """
    tokens, hidden = set(), False
    for name, a, b, c in ATTRIBUTE.findall(raw):
        value, name = a or b or c, name.lower()
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name != "href":
            for part in value.split():
                tokens.update(w.lower() for w in WORD.findall(LAYOUT.sub("", part)))
    return frozenset(tokens), hidden


class Reader:
    """One pass over a page."""

    def __init__(self, page: str):
        self.page, self.tree = page, Tree()
        self.here = -1  # the innermost open node
        self.pieces: list[str] = []
        self.in_links = 0  # characters of the pieces that stand in a link
        self.link = None  # the node in which a link was opened
        self.strict = False  # from here on quotes don't protect "<": one of them is never closed
        self.last_close: dict[str, int] = {}
        self.open: dict[str, int] = {}  # open nodes by name: a search for one that is not there is never begun

    def read(self) -> Tree:
        page, n, position = self.page, len(self.page), 0
        while position < n:
            at = page.find("<", position)
            if at < 0:
                self.text(page[position:])
                break
            if at > position:
                self.text(page[position:at])
            position = self.markup(at)
        self.flush()
        return self.tree

    def text(self, raw: str) -> None:
        self.pieces.append(raw)
        if self.link is not None:
            self.in_links += len(raw)

    def flush(self) -> None:
        """Ends a run of text."""
        if self.pieces:
            text = "".join(self.pieces)
            if "&" in text:
                text = html.unescape(text)
            text = WHITE.sub(" ", text).strip()
            if text:
                self.tree.add("#text", self.here, text, min(self.in_links, len(text)))
            self.pieces.clear()
        self.in_links = 0

    def markup(self, at: int) -> int:
        """Reads what starts with "<" at that place; returns where it ends."""
        page = self.page
        m = TAG.match(page, at)
        if m:
            end, name, attributes, stop = m[1], m[2], m[3], m.end()
        else:
            follows = page[at + 1 : at + 2]
            if follows in ("!", "?") or (follows == "/" and not page[at + 2 : at + 3].isalpha()):
                return self.comment(at)
            m = NAME.match(page, at)
            if not m:
                self.text("<")
                return at + 1
            end, name = m[1], m[2]
            attributes, stop = self.attributes(m.end())
        name = name.lower()
        if end:
            self.end(name)
            return stop
        return self.start(name, attributes, stop)

    def comment(self, at: int) -> int:
        page = self.page
        if page.startswith("<!--", at):
            if page.startswith(("<!-->", "<!--->"), at):
                return page.index(">", at) + 1
            stop = page.find("-->", at + 4)
            return stop + 3 if stop >= 0 else len(page)
        stop = page.find(">", at)
        return stop + 1 if stop >= 0 else len(page)

    def attributes(self, position: int) -> tuple[str, int]:
        """What stands up to the end of a tag whose quoted values hold "<"; each character is looked at once."""
        page, start = self.page, position
        while not self.strict:
            position = VALUE.match(page, position).end()
            if position >= len(page):
                break
            mark = page[position]
            if mark == ">":
                return page[start:position], position + 1
            opens = page[start:position].rstrip()[-1:] == "=" if position - start < 200 else page[position - 200 : position].rstrip()[-1:] == "="
            if not opens:
                position += 1
                continue
            position = page.find(mark, position + 1) + 1
            if not position:
                break
        self.strict = True  # a quote that is never closed: the tag ends before the next "<"
        m = LOOSE.match(page, start)
        return m[0].rstrip(">"), m.end()

    def start(self, name: str, attributes: str, stop: int) -> int:
        if name in RAW:
            return self.after(name, stop, raw=True)
        if name in OPAQUE:
            return stop if attributes.endswith("/") and name in ("svg", "math") else self.after(name, stop, raw=False)
        if name in ("br", "hr"):
            self.flush()
        if name in VOID or name == "head":
            return stop
        custom = "-" in name and not self.pieces and not (self.here >= 0 and self.tree.tags[self.here] in PHRASING)
        if name not in BLOCK and not custom:
            if name == "a":
                self.link = self.here if "href" in attributes.lower() else None
            return stop
        if name in ("html", "body") and name in self.tree.tags[:2]:
            return stop
        self.flush()
        if name in CLOSED_BY:
            self.implied(CLOSED_BY[name])
        elif name in ENDS_PARAGRAPH:
            self.implied({"p"})
        tokens, hidden = attribute_tokens(attributes) if attributes else (frozenset(), False)
        if custom:
            tokens |= frozenset(WORD.findall(name))
        self.here = self.tree.add(name, self.here, tokens=tokens, hidden=hidden)
        self.open[name] = self.open.get(name, 0) + 1
        return stop

    def after(self, name: str, position: int, raw: bool) -> int:
        """The place behind an element whose content is never read; the start tag alone if it is never closed (raw: the rest)."""
        page = self.page
        if name not in self.last_close:
            self.last_close[name] = max((m.start() for m in re.finditer(rf"</{name}(?=[\s/>])", page, re.I)), default=-1)
        if self.last_close[name] < position:
            return len(page) if raw else position
        depth, last = 1, position
        for m in re.compile(rf"<(/?){name}(?=[\s/>])[^<>]*+>?", re.I).finditer(page, position):
            if m[1]:
                depth, last = depth - 1, m.end()
                if raw or not depth:
                    return m.end()
            elif not m[0].endswith("/>"):
                depth += 1
        return last

    def end(self, name: str) -> None:
        if name == "br":
            self.flush()
        elif name == "a":
            self.link = None
        elif name in BLOCK or "-" in name:
            if name not in ("html", "body", "head"):
                self.close(name)

    def leave(self, node: int) -> None:
        """Closes that open node and all within it."""
        self.flush()
        at = self.here
        while True:
            self.open[self.tree.tags[at]] -= 1
            if at == self.link:
                self.link = None
            if at == node:
                break
            at = self.tree.parents[at]
        self.here = self.tree.parents[node]

    def close(self, name: str) -> None:
        """Leaves the nearest open element of that name, if one is open; an end tag of a cell or item stays within its table or list."""
        if not self.open.get(name):
            return
        tags, parents, at = self.tree.tags, self.tree.parents, self.here
        inner = SCOPE if name in PHRASING or name in CLOSED_BY else ()
        while at >= 0 and tags[at] != name:
            if tags[at] in inner:
                return
            at = parents[at]
        if at >= 0:
            self.leave(at)

    def implied(self, names: set[str]) -> None:
        """Closes the open elements of those names, one within the other, that this block ends, without leaving its container."""
        if not any(self.open.get(n) for n in names):
            return
        tags, parents, at, found = self.tree.tags, self.tree.parents, self.here, -1
        while at >= 0:
            if tags[at] in names:
                found = at
            elif found >= 0 or tags[at] in SCOPE or "-" in tags[at]:
                break
            at = parents[at]
        if found >= 0:
            self.leave(found)


def parse(page: str) -> Tree:
    return Reader(page).read()
