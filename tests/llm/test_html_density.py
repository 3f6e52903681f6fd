"""Main text against a plain recursive form of the density rule, and pages that once lost text or took long."""

import math
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.html_extract import main_text

WORDS = st.sampled_from(["word", "two words", "a longer run of some words here", "x", "and a sentence that goes on for quite a while, with commas."])
TREES = st.recursive(WORDS, lambda inner: st.tuples(st.sampled_from(["div", "section", "span", "b", "a", "article"]), st.lists(inner, max_size=4)), max_leaves=25)
BLOCKS = ("div", "section", "article", "body")


def shown(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>{''.join(map(shown, tree[1]))}</{tree[0]}>"


class Plain:
    """The rule as it is stated: every number is computed anew for every node."""

    def __init__(self, tree):
        self.body = tree

    def below(self, n):
        return [x for x in n[1] if not isinstance(x, str)]

    def own(self, n):
        return sum(len(" ".join(x.split())) for x in texts(n))

    def chars(self, n):
        return self.own(n) + sum(self.chars(x) for x in self.below(n))

    def tags(self, n):
        return sum(1 + self.tags(x) for x in self.below(n))

    def link_chars(self, n):
        return self.chars(n) if n[0] == "a" else sum(self.link_chars(x) for x in self.below(n))

    def link_tags(self, n):
        return sum((x[0] == "a") + self.link_tags(x) for x in self.below(n))

    def density(self, c, t, lc, lt):
        if c == 0:
            return 0.0
        spread = c / max(lc, 1) * max(t, 1) / max(lt, 1)
        if spread <= 1:
            return 0.0
        scale = math.log(c * lc / max(c - lc, 1) + c * self.link_chars(self.body) / max(self.chars(self.body), 1) + math.e)
        return c / max(t, 1) * math.log(spread) / scale

    def of(self, n):
        return self.density(self.chars(n), self.tags(n), self.link_chars(n), self.link_tags(n))

    def total(self, n):
        own = self.own(n)
        return sum(map(self.of, self.below(n))) + (self.density(own, 1, own if n[0] == "a" else 0, 0) if own else 0.0)

    def nodes(self, n):
        return [n, *(y for x in self.below(n) for y in self.nodes(x))]

    def best(self, n):
        most = max(map(self.total, self.nodes(n)))
        return next(x for x in self.nodes(n) if self.total(x) >= most - 1e-12)

    def way(self, n, to):
        """The nodes from n down to a node in it, compared by identity."""
        if n is to:
            return [n]
        for x in self.below(n):
            if found := self.way(x, to):
                return [n, *found]
        return []

    def content(self):
        way = self.way(self.body, self.best(self.body))
        while len(way) > 2 and not any(x[0] in BLOCKS for x in self.below(way[-1])):
            way = way[:-1]
        least = min(map(self.of, way))
        return self.parts(self.body, way, least)

    def parts(self, n, way, least):
        on_way = any(n is x for x in way)
        if n is way[-1] or not on_way and self.best(n) is n:
            return [n]
        out = []
        for x in self.below(n):
            wanted = any(x is y for y in way) if on_way else self.best(x) is self.best(n)
            if wanted or self.of(x) >= least and self.chars(x):
                out += self.parts(x, way, least)
        return out


def texts(n):
    """Strings of a node as a page holds them: neighbours are one string."""
    out = [""]
    for x in n[1]:
        if isinstance(x, str):
            out[-1] += x
        else:
            out.append("")
    return out


def lines(n, inside=False):
    """Text with a border mark around blocks; blocks outside an article that are all links are menus."""
    p = Plain(n)
    inside = inside or n[0] == "article"
    if not inside and n[0] in BLOCKS and p.link_tags(n) >= 2 and p.link_chars(n) >= 0.9 * p.chars(n):
        return ""
    border = "\0" if n[0] in BLOCKS else ""
    return border + "".join(x if isinstance(x, str) else lines(x, inside) for x in n[1]) + border


def expected(tree):
    p = Plain(tree)
    found = []
    for n in p.content():
        inside = any(x[0] == "article" for x in p.way(tree, n))
        found += lines(n, inside).split("\0")
    return "\n".join(x for x in (" ".join(y.split()) for y in found) if x)


@settings(max_examples=300, deadline=None)
@given(st.lists(TREES, max_size=5))
def test_density_rule(children):
    tree = ("body", children)
    assert main_text(shown(tree)) == expected(copied(tree))


def copied(tree):
    """The tree with every node an object of its own, so that equal nodes differ in identity."""
    return tree if isinstance(tree, str) else [tree[0], [copied(x) for x in tree[1]]]


PROSE = "".join(f"<p>Paragraph {i} of the article, with words enough to be read as prose.</p>" for i in range(5))
TEXT = "\n".join(f"Paragraph {i} of the article, with words enough to be read as prose." for i in range(5))


@pytest.mark.parametrize("page", ['<div class="content has-sidebar">%s</div>', '<div class="overflow-hidden">%s</div>', '<div class="layout no-comments">%s</div>', '<article><div class="discussion">%s</div></article>', '<article>%s<div class="related-links"><a href=1>One more</a></div><div class=share>Share</div></article>', '<div id="sidebar-right">one two</div><div>%s</div>', '<article>%s<section class="post-comments"><p>I think so too.</p></section></article>', '<body>%s<div class="cookie-notice">We use cookies.</div></body>'])
def test_names_do_not_take_the_article(page):
    assert main_text(page % PROSE) == TEXT


@pytest.mark.parametrize("name", ["discussion", "market-share", "related", "right", "panel side-effects"])
def test_parts_of_an_article_stay(name):
    assert main_text(f"<article>{PROSE}<section id='{name}'>{PROSE}</section></article>") == f"{TEXT}\n{TEXT}"
    assert main_text(f"<article>{PROSE}<p class='market-share'>Up by a tenth.</p></article>") == f"{TEXT}\nUp by a tenth."


def test_lists_of_references_and_text_behind_the_body_stay():
    refs = "<ul><li><a href=1>First reference</a><li><a href=2>Second reference</a></ul>"
    assert main_text(f"<article>{PROSE}{refs}</article>") == TEXT + "\nFirst reference\nSecond reference"
    assert main_text(f"<nav>{refs}</nav><div>{refs}</div><div>{PROSE}</div>") == TEXT
    assert main_text(f"<html><body>{PROSE}</body></html><p>And more of it, behind the end of the body.</p>") == TEXT + "\nAnd more of it, behind the end of the body."


LONG = ["<a x" * 32_000 + '"', "<i>" * 16_000 + "<p></p>" * 16_000, "<b><div>" + "<i>" * 16_000 + "</b>" * 16_000, "<ul>" + "<li><div>" * 12_000, '<a x="' * 20_000, "<!--" * 30_000, "<p " + "a = " * 30_000 + ">", "<script" * 20_000]


@pytest.mark.parametrize("page", LONG, ids=range(len(LONG)))
def test_time_is_linear(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 4
