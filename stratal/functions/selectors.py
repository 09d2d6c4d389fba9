"""Elements of HTML by CSS selectors: a selector becomes an automaton that runs over the tags of a page as they come.

Selectors: lists of tag, *, .class, #id and [attribute], [a=v], [a^=v], [a$=v], [a*=v], [a~=v], joined by spaces (somewhere
below) or > (directly below). The state of an open element is two sets of bits, the compounds that it matches and those
that it or an ancestor matches, so a page takes one pass and memory for its open elements and texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of HTML: elements without an end, and elements whose text is none of the page
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template"}

ELEMENTS = "array<struct<tag:string,href:string,text:string>>"
PART = re.compile(r"(?P<comb>\s*>\s*|\s+)|(?P<comma>\s*,\s*)|(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]")
TESTS: dict[str, Callable[[str, str], bool]] = {
    "=": lambda has, want: has == want,
    "^=": lambda has, want: bool(want) and has.startswith(want),
    "$=": lambda has, want: bool(want) and has.endswith(want),
    "*=": lambda has, want: bool(want) and want in has,
    "~=": lambda has, want: want in has.split(),
}


class Compound:
    """The tests on one element, and how it hangs below the compound before it ('' for the first of a selector)."""

    def __init__(self, comb: str):
        self.comb, self.tag, self.tests, self.last = comb, "*", [], False

    def matches(self, tag: str, attrs: dict[str, str]) -> bool:
        return self.tag in ("*", tag) and all(name in attrs and test(attrs[name], want) for name, test, want in self.tests)


def compiled(selector: str) -> list[Compound]:
    """The compounds of a list of selectors, one after the other; ValueError for what is no such selector."""
    out, at, selector = [Compound("")], 0, selector.strip()
    empty = True
    while at < len(selector):
        m = PART.match(selector, at)
        if not m:
            raise ValueError(f"not a selector: {selector!r} at {at}")
        if m["comb"] or m["comma"]:
            if empty:
                raise ValueError(f"nothing to match: {selector!r} at {at}")
            out[-1].last = bool(m["comma"])
            out.append(Compound("" if m["comma"] else m["comb"].strip() or " "))
            empty = True
        else:
            if m["tag"]:
                if not empty:
                    raise ValueError(f"a tag comes first: {selector!r} at {at}")
                out[-1].tag = m["tag"].lower()
            elif m["cls"]:
                out[-1].tests.append(("class", TESTS["~="], m["cls"]))
            elif m["id"]:
                out[-1].tests.append(("id", TESTS["="], m["id"]))
            else:
                want = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), "")
                out[-1].tests.append((m["attr"].lower(), TESTS[m["op"]] if m["op"] else lambda has, want: True, want))
            empty = False
        at = m.end()
    if empty:
        raise ValueError(f"nothing to match: {selector!r}")
    out[-1].last = True
    return out


class Selecting(HTMLParser):
    """Runs over one page; `found` has (tag, href, lines of text) of the matching elements in the order of their starts."""

    def __init__(self, compounds: list[Compound]):
        super().__init__(convert_charrefs=True)
        self.compounds = compounds
        self.last = sum(1 << i for i, c in enumerate(compounds) if c.last)
        self.open: list[tuple[str, int, int, int | None]] = []  # tag, matched, matched here or above, place in found
        self.silent, self.texts, self.found, self.begun = 0, [], [], {}

    def handle_starttag(self, tag, attrs):
        held = {k: v or "" for k, v in reversed(attrs)}  # of repeated attributes the first counts
        _, above, anywhere, _ = self.open[-1] if self.open else ("", 0, 0, None)
        here = 0
        for i, c in enumerate(self.compounds):
            before = 1 if not c.comb else (above if c.comb == ">" else anywhere) >> (i - 1) & 1
            if before and c.matches(tag, held):
                here |= 1 << i
        place = None
        if here & self.last:
            place = len(self.found)
            self.found.append([tag, held.get("href"), len(self.texts), None])
        if tag in VOID:
            if place is not None:
                self.found[place][3] = len(self.texts)
            return
        self.silent += tag in SILENT
        self.open.append((tag, here, here | anywhere, place))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag):
        if any(o[0] == tag for o in self.open):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, _, _, place = self.open.pop()
        self.silent -= tag in SILENT
        if place is not None:
            self.found[place][3] = len(self.texts)
        return tag

    def handle_data(self, data):
        if not self.silent:
            line = " ".join(data.split())
            if line:
                self.texts.append(line)

    def result(self) -> list[dict]:
        self.close()
        while self.open:
            self._close()
        return [{"tag": tag, "href": href, "text": "\n".join(self.texts[start:end])} for tag, href, start, end in self.found]


def elements(html: str | None, compounds: list[Compound]) -> list[dict]:
    page = Selecting(compounds)
    page.feed(html or "")
    return page.result()


def select(html, selector: str) -> Column:
    """tag, href (as written, null without one) and text of the elements that a selector matches, in page order.

    The text is one line for each run of text between tags, white space collapsed, without scripts and styles. A null
    page has no elements; unclosed elements end with those around them; an end without a start is none.
    """
    compiled(selector)  # errors belong to the driver

    @F.pandas_udf(ELEMENTS)
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compounds = compiled(selector)
        for batch in pages:
            yield pd.Series([elements(h, compounds) for h in batch])

    return run(html if isinstance(html, Column) else F.col(html))


def body_lines(html, selector: str = "body") -> Column:
    """The lines of the first element that matches, null if none does."""
    return F.try_element_at(select(html, selector), F.lit(1))["text"]
