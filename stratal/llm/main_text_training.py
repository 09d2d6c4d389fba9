"""Labelled pages for the main-text trees, by rule: six families of layouts with the same parts of a page.

A text that is main text begins with a mark, which is taken out again before the trees see the page.
"""

from __future__ import annotations

import random

import numpy as np

from stratal.llm.dom import Tree, parse

MARK = chr(0xE000)
WRAPPERS = ["page-with-sidebar", "has-sidebar social", "layout sidebar-right", "search-results-page", "comments-open", "modal-ready header-fixed", "no-ads cookie-ok", "single post-template", "home page", "left-nav-layout", "site", "promo-theme", "form-page"]


class Templates:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self):
        return "".join(self.r.choice("bcdfglmnprst") + self.r.choice("aeiouéüñ") for _ in range(self.r.randint(1, 4)))

    def words(self, low, high):
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, low, high):
        return " ".join(self.words(3, 14).capitalize() + self.r.choice([".", ".", ".", "!", ",", "***", " |"]) for _ in range(self.r.randint(low, high)))

    def named(self, *names, chance=1.0):
        """A class or an id of one of these names, or nothing."""
        name = self.r.choice(names)
        return f' {self.r.choice(["class", "class", "id"])}="{name}"' if name and self.r.random() < chance else ""

    def links(self, n):
        return [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(n)]

    def list_of(self, parts):
        return "<ul>" + "".join(f"<li>{x}</li>" for x in parts) + "</ul>"

    # parts that are not main text; bare: without any attribute or telling tag

    def menu(self, bare=False):
        links = self.links(self.r.randint(2, 9))
        inner = self.list_of(links) if self.r.random() < 0.7 else self.r.choice([" | ", " ", " &middot; "]).join(links)
        if bare:
            return f"<div>{inner}</div>"
        tag, name = self.r.choice([("nav", ""), ("nav", "main-nav"), ("div", "menu"), ("div", "nav"), ("header", "site-header"), ("div", "breadcrumbs"), ("ul", "menu"), ("div", "navbar navbar-top"), ("div", "masthead")])
        return f"<{tag}{self.named(name)}>{inner}</{tag}>"

    def noise(self):
        r, s = self.r, self.sentences
        return r.choice([
            lambda: f'<div{self.named("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner")}>{s(1, 4)}</div>',
            lambda: f'<aside{self.named("sidebar", "", "related", "widget")}>{r.choice(["", "<h3>" + self.words(1, 4) + "</h3>"])}{"".join("<p>" + s(1, 3) + "</p>" for _ in range(r.randint(1, 4)))}</aside>',
            lambda: f'<div{self.named("sidebar", "side-bar", "related-posts", "recommended", "widget")}><h3>{self.words(1, 4)}</h3>{self.list_of(self.links(r.randint(2, 6)))}</div>',
            lambda: f'<div{self.named("cookie-notice", "cookie-banner", "consent", "notice", "site-notice", "alert", "popup", "modal")}><p>{s(1, 4)}</p><button>{self.word()}</button></div>',
            lambda: f'<form{self.named("", "newsletter", "search", "login-form", "subscribe")}><label>{self.words(1, 5)}</label><input name="q"><p>{s(1, 2)}</p><button>{self.word()}</button></form>',
            lambda: f'<div{self.named("share", "social", "tags", "byline", "meta", "pagination")}>{self.words(1, 4)} {" ".join(self.links(r.randint(1, 4)))}</div>',
        ])()

    def comments(self):
        r = self.r
        one = lambda: f'<{(t := r.choice(["div", "li", "article"]))} class="{r.choice(["comment", "comment-body", "reply"])}"><b>{self.word()}</b><p>{self.sentences(1, 5)}</p></{t}>'
        tag = r.choice(["section", "div", "ol"])
        return f'<{tag}{self.named("comments", "comment-list", "reader-comments", "replies comments", "respond")}><h2>{self.words(1, 3)}</h2>{"".join(one() for _ in range(r.randint(1, 6)))}</{tag}>'

    def footer(self, bare=False):
        r = self.r
        text = r.choice(["&copy; ", "&copy; 2019 ", "Copyright ", "© "]) + f"{self.word()}.example &middot; {self.sentences(1, 3)}"
        inner = r.choice([text, f"<p>{text}</p>", f"<p>{text}</p>{self.list_of(self.links(3))}", f"{text} {' '.join(self.links(2))}"])
        if bare:
            return f"<div>{inner}</div>"
        return r.choice([f"<footer>{inner}</footer>", f'<div class="footer">{inner}</div>', f'<div id="site-footer" class="copyright">{inner}</div>', f'<div id="colophon">{inner}</div>'])

    # main text

    def title(self):
        return f"<{(t := self.r.choice(['h1', 'h1', 'h1', 'h2']))}>{MARK}{self.words(1, 12)}</{t}>"

    def blocks(self, noise=0.06):
        r, parts = self.r, []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 15])):
            text = self.sentences(1, r.choice([1, 2, 6, 12])) if r.random() < 0.85 else self.words(1, 3)
            if r.random() < 0.15:
                text = text.upper()
            if r.random() < 0.15:
                text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(1, 6)}.'
            if r.random() < 0.05:
                text = f"<i>{text}</i>, copyright {self.words(3, 9)}."
            parts.append(r.choice([f"<p>{MARK}{text}</p>"] * 6 + [f"<p><b>{MARK}{text}<br>", f"<p>{MARK}{text}", f"<blockquote>{MARK}{text}</blockquote>", f"<ul><li>{MARK}{text}</li><li>{MARK}{self.words(2, 12)}</li></ul>", f"<h2>{MARK}{self.words(1, 6)}</h2><p>{MARK}{text}</p>", f"<pre>{MARK}{text}</pre>", f"<table><tr><td>{MARK}{self.words(1, 4)}</td><td>{MARK}{self.words(1, 4)}</td></tr></table>", f"<figure><img src=x><figcaption>{MARK}{self.words(3, 9)}</figcaption></figure><p>{MARK}{text}</p>"]))
            if r.random() < 0.08:
                parts.append(f"<p>{MARK}{r.choice(['All rights reserved.', 'Copyright ' + self.words(1, 4) + '.', '&copy; ' + self.words(1, 5), self.words(2, 6) + ', all rights reserved.'])}</p>")
            if r.random() < noise:
                parts.append(self.noise())
        return "".join(parts)

    def byline(self):
        return f'<div{self.named("byline", "meta", "post-meta", "author date")}>{self.words(1, 4)} <time>{self.r.randint(1, 28)} {self.word()} 2020</time></div>'

    # families of pages

    def classic(self):
        r = self.r
        top = [self.menu() for _ in range(r.choice([0, 1, 1, 2]))] + [self.noise() for _ in range(r.choice([0, 1, 1, 2]))]
        if r.random() < 0.3:
            top.append(f'<header{self.named("", "site-header", "page-header")}><h1>{self.words(1, 4)}</h1><p>{self.sentences(1, 1)}</p></header>')
        r.shuffle(top)
        end = [self.noise() for _ in range(r.choice([0, 0, 1, 2]))] + ([self.comments()] if r.random() < 0.3 else [])
        r.shuffle(end)
        open_, close = r.choice([("<article>", "</article>")] * 5 + [("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="article-body">', "</div>"), ('<div class="post-content entry">', "</div>"), ("<main><article>", "</article></main>"), ("<div>", "</div>"), ('<section class="story">', "</section>"), ('<div id="main"><div class="text">', "</div></div>")])
        body = open_ + (self.title() if r.random() < 0.85 else "") + self.blocks() + (self.comments() if r.random() < 0.15 else "") + close
        return "".join(top) + body + "".join(end) + (self.footer() if r.random() < 0.9 else "")

    def semantic(self):
        r = self.r
        head = f"<header>{self.title()}{self.byline() if r.random() < 0.5 else ''}</header>" if r.random() < 0.7 else self.title()
        body = f"<article{self.named('', 'post', 'hentry')}>{head}{self.blocks()}{f'<footer>{self.words(2, 5)} {self.links(1)[0]}</footer>' if r.random() < 0.3 else ''}</article>"
        aside = self.noise() if r.random() < 0.6 else ""
        main = f"<main{self.wrapper()}>{body}{aside if r.random() < 0.5 else ''}{self.comments() if r.random() < 0.3 else ''}</main>"
        return f"<header>{r.choice(['', '<h1>' + self.words(1, 3) + '</h1>'])}{self.menu()}</header>{main}{aside if r.random() < 0.5 else ''}{self.footer()}"

    def grid(self):
        r = self.r
        body = f'<div class="col-md-8{r.choice(["", " content", " content-with-sidebar", " blog-main"])}">{self.title()}{self.byline() if r.random() < 0.4 else ""}{self.blocks()}{self.comments() if r.random() < 0.3 else ""}</div>'
        side = f'<div class="col-md-4{r.choice([" sidebar", " side", "", " widgets"])}">{"".join(self.noise() for _ in range(r.randint(1, 3)))}</div>'
        columns = [body, side] if r.random() < 0.7 else [side, body]
        return f'<div class="navbar navbar-default"><div class="container">{self.menu()}</div></div><div class="container"><div class="row">{"".join(columns)}</div></div><div class="container">{self.footer()}</div>'

    def plain(self):
        r = self.r
        parts = [self.menu(bare=True)] if r.random() < 0.85 else []
        if r.random() < 0.3:
            body = f"<div>{self.title()}" + "".join(f"<div>{MARK}{self.sentences(1, 6)}</div>" for _ in range(r.randint(1, 8))) + "</div>"
        elif r.random() < 0.3:
            body = f"<div>{self.title()}</div><div>" + "<br><br>".join(MARK + self.sentences(2, 8) for _ in range(r.randint(1, 6))) + "</div>"
        else:
            body = f"<div>{self.title()}{self.blocks(noise=0)}</div>"
        parts += [body] + ([self.footer(bare=True)] if r.random() < 0.85 else [])
        if r.random() < 0.3:
            parts.append(f"<div>{' '.join(self.links(4))}</div>")
        return "".join(parts)

    def tables(self):
        r = self.r
        menu = "<br>".join(self.links(r.randint(3, 9)))
        body = f'<td{r.choice(["", " width=600", " valign=top"])}>{self.title()}{self.blocks(noise=0)}</td>'
        top = f"<tr><td colspan=2>{' | '.join(self.links(4))}</td></tr>" if r.random() < 0.5 else ""
        foot = f"<tr><td colspan=2>&copy; {self.words(1, 4)}</td></tr>" if r.random() < 0.7 else ""
        return f"<table>{top}<tr><td>{menu}</td>{body}</tr>{foot}</table>"

    def blog(self):
        r = self.r
        post = f'<div class="post hentry"><h2 class="entry-title">{MARK}{self.words(2, 9)}</h2>{self.byline()}<div class="entry-content">{self.blocks()}</div>{self.noise() if r.random() < 0.4 else ""}</div>'
        side = f'<div id="secondary" class="widget-area">{"".join(self.noise() for _ in range(r.randint(1, 4)))}</div>'
        head = f'<div id="masthead"><h1><a href="/">{self.words(1, 3)}</a></h1><p>{self.words(2, 6)}</p>{self.menu()}</div>'
        return f'<div id="wrapper"{self.wrapper()}>{head}<div id="primary">{post}{self.comments() if r.random() < 0.5 else ""}</div>{side}{self.footer()}</div>'

    def wrapper(self):
        return f' class="{self.r.choice(WRAPPERS)}"' if self.r.random() < 0.4 else ""

    def page(self) -> str:
        r = self.r
        body = r.choice([self.classic, self.classic, self.semantic, self.grid, self.plain, self.tables, self.blog])()
        if r.random() < 0.3:
            body = f"<div{self.wrapper()}>{body}</div>"
        return f"<!DOCTYPE html><html{self.wrapper() if r.random() < 0.2 else ''}><head><title>{self.words(1, 8)}</title></head><body{self.wrapper()}>{body}</body></html>"


def labelled(page: str) -> tuple[Tree, np.ndarray]:
    """Nodes of a template page without its marks, and whether each holds main text."""
    marked, tree = parse(page), parse(page.replace(MARK, ""))
    y = np.zeros(len(tree))
    for k, text in enumerate(marked.texts):
        if MARK in text:
            while k >= 0:
                y[k] = 1
                k = marked.parents[k]
    if marked.tags != tree.tags:
        raise AssertionError("the marks changed the tree")
    return tree, y
