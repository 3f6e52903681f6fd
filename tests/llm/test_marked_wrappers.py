"""Main text of pages whose wrappers have names that mark what is not the article."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.html_extract import main_text

ARTICLE = "<article><h1>Title here</h1><p>First long paragraph of the article.</p><p>Second one, long enough too.</p></article>"
TEXT = "Title here\nFirst long paragraph of the article.\nSecond one, long enough too."


@pytest.mark.parametrize("wrapper", ["class='page has-sidebar'", "id='content-with-comments'", "class='right-side'", "class='no-ads'", "class='hasSidebar'", "class='social'", "class='notice'"])
def test_a_wrapper_of_the_article_stays(wrapper):
    assert main_text(f"<body><div {wrapper}>{ARTICLE}</div></body>") == TEXT
    assert main_text(f"<body><nav><a href=1>Home</a></nav><div {wrapper}><div>{ARTICLE}</div><div class='share'>Share this</div></div></body>") == TEXT


def test_a_wrapper_of_most_of_the_text_stays():
    page = "<body><div class='page side'><div><p>First long paragraph of a page without article.</p><p>Second one, long enough too.</p></div></div><p>Imprint</p></body>"
    assert "First long paragraph of a page without article." in main_text(page)


@pytest.mark.parametrize("rest", ["<div class='sidebar'><p>Something beside it.</p></div>", "<section id='comments'><article class='c'><p>" + "A reader says very much here. " * 20 + "</p></article></section>", "<div class='related'><article><a href=1>Another page</a></article></div>", "<div class='ad'>Buy</div>", "<div class='ad'>" + "Buy more of it. " * 40 + "</div>"])
def test_marked_elements_beside_the_article_go(rest):
    assert main_text(f"<body>{ARTICLE}{rest}</body>") == TEXT


def test_longer_comments_beside_a_page_without_article_go():
    page = "<body><div id='post'><p>A paragraph of the post.</p><p>And another paragraph.</p></div><div id='comments'><p>" + "A reader says very much here. " * 20 + "</p></div></body>"
    assert main_text(page) == "A paragraph of the post.\nAnd another paragraph."


LONG = [f"Paragraph {i} of an article that a page builder has put in a block of its own, with words enough to be prose, like this." for i in range(4)]
NAMES = ["widget", "elementor-widget elementor-widget-text-editor", "promo-text", "banner", "popup-content", "newsletter", "sidebar", "nav-item", "notice"]


@pytest.mark.parametrize("name", [*NAMES, "comment"])
@pytest.mark.parametrize("page", ["<body><h1>Title</h1>%s</body>", "<body><main><h1>Title</h1>%s</main></body>", "<body><article><h1>Title</h1><p>A lead that has no mark.</p>%s</article></body>"])
def test_an_article_in_marked_blocks_stays(name, page):
    if name == "comment" and "lead" in page:
        return  # there the lead is the article
    blocks = "".join(f'<div class="{name}"><p>{x}</p></div>' for x in LONG)
    lead = ["A lead that has no mark."] if "lead" in page else []
    assert main_text(page % blocks) == "\n".join(["Title", *lead, *LONG])


@pytest.mark.parametrize("name", NAMES)
def test_smaller_sets_of_other_names_go(name):
    blocks = "".join(f'<div class="{name}"><p>{x}</p></div>' for x in LONG)
    rest = "<div class='advert'><p>Buy this thing now, it is cheap.</p></div><div class='comments'><p>" + "I have read it all. " * 60 + "</p></div><div class='cookie-consent'>We use cookies.</div>"
    assert main_text(f"<body><h1>Title</h1>{blocks}{rest}</body>") == "\n".join(["Title", *LONG])
    assert main_text(f"<body><main><h1>Title</h1>{blocks}{rest}</main></body>") == "\n".join(["Title", *LONG])


def test_a_part_whose_name_says_more_stays_and_one_that_is_only_marked_goes():
    parts = "<p class='widget-text'>A paragraph with an odd name.</p><div class='promo-lead'><p>Another one.</p></div><div class='ad'><p>Buy this.</p></div><div class='newsletter-signup'><p>Subscribe to us.</p></div><div class='notice'><p>Members only.</p></div>"
    assert main_text(f"<article><p>{LONG[0]}</p>{parts}<p>{LONG[1]}</p></article>") == f"{LONG[0]}\nA paragraph with an odd name.\nAnother one.\n{LONG[1]}"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([*NAMES, "text", "column", ""]), min_size=1, max_size=6), st.sampled_from(["%s", "<main>%s</main>", "<article>%s</article>"]), st.sampled_from(NAMES))
def test_the_largest_set_of_blocks_is_never_lost(around, page, name):
    """Whatever the names around: if all blocks have one name, the article is there."""
    blocks = "".join(f'<section class="{name}"><p>{x}</p></section>' for x in LONG)
    for outer in around:
        blocks = f'<div class="{outer}">{blocks}</div>'
    assert main_text("<body>" + page % blocks + "</body>") == "\n".join(LONG)
