"""Pages as trees: plain ones are read without a parser, and are the trees that the parser gives."""

import random

import pytest

from tidemark.sources import articles


def shape(x):
    return x if isinstance(x, str) else (x.tag, x.attributes, x.classes, [shape(c) for c in x.children])


def walked(x):
    for c in x.children:
        if not isinstance(c, str):
            yield c
            yield from walked(c)


PARTS = ["<p>", "</p>", "<div class=\"a b\">", "</div>", "<br>", "<img src=\"x.png\">", "text", " 文本 > ", "<a href=\"u\"\n class=\"c\" class=\"a\">", "</a>", "\n", "<span>", "</span>", "</none>", "<h1 id=\"\">", "</br>"]
OTHER = ["<br/>", "&amp;", "<P>", "<a href=u>", "<!-- c -->", "<script>x<p></script>", "<", "<a x='1'>", "</a b>", "<title>&lt;</title>", "<p a=\"&lt;\">", "<style>", "<textarea><p>", "<a"]


@pytest.mark.parametrize("seed", range(200))
def test_plain_pages_are_the_parsers_trees(seed):
    rng = random.Random(seed)
    html = "".join(rng.choices(PARTS + OTHER if seed % 2 else PARTS, k=rng.randrange(25)))
    tree, parsed = articles.page(html), articles._parsed_page(html)
    together = lambda s: repr(shape(s))
    assert together(tree) == together(parsed)
    for x in (tree, *walked(tree)):
        assert list(x.all()) == list(walked(x))


def test_a_plain_feed_needs_no_parser(monkeypatch):
    monkeypatch.setattr(articles, "HTMLParser", None)
    monkeypatch.setattr(articles._Builder, "__init__", lambda _: pytest.fail("parsed"))
    html = '<div class="m_feed_item" id="item-1"><div class="m_feed_detail m_qa_detail"><div class="m_feed_txt">:甲(600001)问</div><div class="m_feed_from"><span>刚刚</span></div></div></div>'
    (item,) = articles.feed_items(html)
    assert (item["item"], item["question"], item["asked"], item["reply"]) == ("1", ":甲(600001)问", "刚刚", None)
