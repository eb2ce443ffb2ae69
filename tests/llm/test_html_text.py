"""Regions of text with and without marked elements."""

import re

import pyarrow.parquet as pq
import pytest

from keepsake.llm import html_text

LONG = "A long line of text that says what the page is about, at some length. " * 4
TEXT = f"<h1>Its title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
WANT = "\n\n".join(["Its title", LONG.strip(), "Short.", LONG.strip()])
MENU = "<nav>" + "<a href=x>menu entry</a> " * 30 + "</nav>"


def test_pages_without_their_marks():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    marked = re.compile(r"</?(article|main)>")
    assert sum(bool(marked.search(p or "")) for p in pages) > 100
    for page in pages:
        assert html_text.extract(marked.sub("", page or "")) == html_text.extract(page)


@pytest.mark.parametrize("page", [
    MENU + TEXT,
    f"{MENU}<div>{TEXT}</div><div><a href=x>One</a> <a href=y>two</a></div>",
    f"{MENU}<div><h1>Its title</h1></div><div><p>{LONG}<p>Short.<p>{LONG}</div>",
    f"{MENU}<main><h1>Its title</h1><article><p>{LONG}<p>Short.<p>{LONG}</article></main>",
    f"<article>{TEXT}</article><div>Log in</div>",
])
def test_short_lines_stay_with_their_region(page):
    assert html_text.extract(f"<html><body>{page}</body></html>") == WANT


def test_long_text_beside_a_marked_element_stays():
    assert html_text.extract(f"<article>{TEXT}</article><p>{LONG}</p>") == f"{WANT}\n\n{LONG.strip()}"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-comments", "sidebar"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_layout_wrappers(name, tag):
    page = f"{MENU}<div class='{name}'><{tag}>{TEXT}</{tag}><div class='share'>Share this</div></div>"
    assert html_text.extract(f"<html><body>{page}</body></html>") == WANT


def test_parts_of_an_article_stay_and_what_stands_beside_it_goes():
    page = f"""<article><div class="article-header"><h1>Its title</h1></div><section id="related-work">
    <p>{LONG}</p></section><p class="notice">Short.</p><p>{LONG}</p></article>"""
    assert html_text.extract(page) == WANT
    other = f"""<section id="comments"><article><p>{LONG * 9}</article></section><div class="sidebar">
    <p>{LONG * 9}<p>{LONG}</div><div class="ad-slot">{LONG}</div><aside><article>{LONG}</article></aside>"""
    assert html_text.extract(f"<article>{TEXT}</article>{other}") == WANT
    assert html_text.extract(f"<form>{TEXT}</form><div class='ad'>{LONG}</div>") == WANT


def test_odd_markup_never_stops_a_page():
    import random

    assert html_text.extract("<p>some text</p><![foo[x]]><p>more text</p>") == "some text\n\nmore text"
    bits = ["<", "<!", "<![", "<!--", "-->", "]]>", ">", "<p>", "</p>", "<a href='", "'", '"', "&", "&#x",
            "text", "<![CDATA[", "<?php", "<script>", "</script>", "</", "<svg/>", "<!DOCTYPE", "[", "<![if",
            "<![endif]>", "\x00", "</div>", "<table>"]
    some = random.Random(5)
    for _ in range(5000):
        html_text.extract("".join(some.choice(bits) for _ in range(some.randrange(14))))


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    start = time.process_time()
    for page in ("<p><b>some words here " * 60_000, "<div><aside>" * 50_000 + "text",
                 "<b>" * 50_000 + "</div>" * 50_000, "<p>word " * 200_000):
        html_text.extract(page)
    assert time.process_time() - start < 60


def test_notices_and_reader_comments_are_no_text():
    page = (
        "<main><article><h1>Title of it</h1><p>The text itself, long enough to be one.</p>"
        "<div class='notice'>Mind this notice of ours.</div><div class='legal-notice'>Terms.</div>"
        "<section id='related-work'><p>Kept as a part of the text.</p></section>"
        "<div class='related-posts'><p>Read this too.</p></div>"
        "<article class='comment'><p>I disagree, says a reader.</p></article>"
        "<ol class='comment-list'><li>Me too.</li></ol></article>"
        "<div id='post-comments'><p>Third reader.</p></div></main>"
    )
    assert html_text.extract(page).split("\n\n") == [
        "Title of it", "The text itself, long enough to be one.", "Kept as a part of the text."]
