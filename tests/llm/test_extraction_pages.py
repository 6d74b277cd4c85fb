"""Pages whose class words, forms or markup say little of where the main text is."""

import pytest

from webmine.llm import extraction

LINE = "Some long text, with marks. And more of it, again and again; really."
BODY = "<h1>Title</h1>" + f"<p>{LINE}</p>" * 4
WANT = ["Title", *[LINE] * 4]


@pytest.mark.parametrize("page", [
    f'<body><div class="post overflow-hidden">{BODY}</div></body>',
    f'<body><div class="has-sidebar"><nav>a b</nav><div>{BODY}</div></div></body>',
    f'<main><div class="with-sidebar">{BODY}</div></main>',
    f'<form id="aspnetForm"><div class="menu"><a href="/">Home</a></div><div>{BODY}</div></form>',
    f'<div class="sidebar"><div>{BODY}</div></div>',
    f'<div id="search"><article>{BODY}</article><form>Send</form></div><div class="footer">About us, and more. All of it is here.</div>',
    f"<![foo[bar]]><article>{BODY}</article>", f"<article>{BODY}</article><![ %x; [bar]]>", f"<article>{BODY}</article><![if", f"<!x[<article>{BODY}</article>",
])
def test_main_text_is_found(page):
    assert extraction.content_blocks(page) == WANT


def test_ids_and_modifiers_inside_an_article_are_no_reason():
    page = f'<article>{BODY}<section id="related-work"><p>{LINE}</p></section><section id="search-algorithms"><p>{LINE}</p></section><p class="md:hidden">Small.</p></article>'
    assert extraction.content_blocks(page) == [*WANT, LINE, LINE, "Small."]


@pytest.mark.parametrize("words", ["comments", "comment-list", "left-sidebar", "site-footer", "cookie-banner", "share", "ad-slot"])
def test_what_stands_beside_the_text_still_goes(words):
    assert extraction.content_blocks(f'<div>{BODY}</div><div class="{words}">{BODY * 20}</div>') == WANT
    assert extraction.content_blocks(f'<article>{BODY}<div class="{words}"><p>{LINE}</p></div></article>') == WANT
    assert extraction.content_blocks(f'<div>{BODY}</div><form><p>{LINE}</p></form>') == WANT


@pytest.mark.parametrize("page", ["<![", "<!", "<", "<a", "</", "<!--", "<![CDATA[", "<![ ]>", "<!DOCTYPE [<!ELEMENT", "&#x110000;", "<p " + "a=" * 5000, "<div>" * 3000])
def test_broken_markup_ends_no_job(page):
    extraction.content_blocks(page)
    assert LINE in extraction.content_blocks(f"<article>{BODY}</article>" + page)
