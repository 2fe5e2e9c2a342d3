"""Main text of pages: against a plain reader on given pages, and regions of every size."""

import re
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from corvane.llm import html_text

TREE = html_text.train()
STORY = "".join(f"<p>The story goes on in paragraph {i} with a good many words in it, as stories do, until its end comes near.</p>" for i in range(5))
PLAIN = "\n\n".join(re.findall(r"<p>(.*?)</p>", STORY))
SAID = "<p>I think that this is a great article and I have much to say about it.</p>"


class PlainReader(HTMLParser):
    """Blocks of a well-formed page outside elements that hold no article by their tag, class or id."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text, self.blocks = [], "", []

    def flush(self):
        text = " ".join(self.text.split())
        if text and not any(out for _, out in self.open):
            self.blocks.append(text)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCK:
            self.flush()
        if tag not in html_text.VOID:
            names = re.findall("[a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower())
            unread = tag in html_text.SKIPPED or tag in html_text.RAW
            header = tag == "header" and not any(t in ("article", "main") for t, _ in self.open)
            self.open.append((tag, unread or header or tag in ("nav", "footer", "aside", "form") or any(n in html_text.OUTER_NAMES for n in names)))
        elif tag == "br":
            self.text += " "

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.flush()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(out for _, out in self.open):
            self.text += data


def test_given_pages_equal_a_plain_reader():
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    same = 0
    for (page,) in pages:
        r = PlainReader()
        r.feed(page or "")
        r.close()
        r.flush()
        same += html_text.main_text(page, TREE) == "\n\n".join(r.blocks)
    assert same == len(pages)


@pytest.mark.parametrize("n", [1, 10, 900])
@pytest.mark.parametrize("region", ["<div id=comments>{}</div>", "<section class='reader-comments'><article>{}</article></section>", "<aside>{}</aside>", "<div class=sidebar>{}</div>", "<footer>{}</footer>", "<form>{}</form>", "<nav>{}</nav>", "<div hidden>{}</div>"])
def test_a_region_stays_out_at_any_size(region, n):
    outside = region.format(SAID * n)
    assert html_text.main_text(f"<div class=story>{STORY}</div>{outside}", TREE) == PLAIN
    assert html_text.main_text(f"{outside}<article>{STORY}</article>", TREE) == PLAIN
    assert html_text.main_text(f"<article>{STORY}{outside}</article>", TREE) == PLAIN


@pytest.mark.parametrize("page", [
    "<form id=all><nav><a href=x>Home</a></nav><div>{}</div><div class=sidebar><p>Some words at the side</p></div><footer>(c) all rights</footer></form>", "<form><article>{}</article><aside>Hello there reader</aside></form>", "<div id=social-history>{}</div><footer>Contact</footer>",
    "<div class='modal-root'><form><main>{}</main><div class=comments><article>" + SAID * 50 + "</article></div></form></div>", "<a href=x>Skip to content</a><form>{}</form>",
])
def test_what_wraps_a_page_is_looked_into(page):
    assert html_text.main_text(page.format(STORY), TREE) == PLAIN


def test_pages_that_hold_nothing_but_what_stays_out():
    assert [html_text.main_text(p, TREE) for p in (f"<div id=comments>{SAID * 9}</div>", f"<footer>{SAID}</footer>", f"<nav>{SAID}</nav><aside>{SAID}</aside>", f"<div style='display: none'>{STORY}</div>")] == [""] * 4


#: Pages without telling names: only word counts and link densities tell the story from menus and lists of links.
NAMELESS = [
    f"<div><a href=1>Home</a> | <a href=2>News</a> | <a href=3>More</a></div><div>{STORY}</div>", f"<ul><li><a href=1>Home page</a></li><li><a href=2>All the news</a></li></ul><div>{STORY}</div><div><a href=1>Next</a></div>",
    f"<table><tr><td><a href=1>One</a><td><a href=2>Two</a><td>{STORY}</table><p><a href=4>To the top of the page</a> <a href=5>or print it</a></p>",
]


def test_words_and_links_decide_where_no_name_does():
    assert [html_text.main_text(p, TREE) for p in NAMELESS] == [PLAIN] * 3


def test_without_words_and_links_the_tree_fails():
    rows = [line.split() for line in html_text.LABELLED.strip().splitlines()]
    blind = html_text.grow(np.array([[0.0] * 6 + [float(v) for v in r[6:-1]] for r in rows]), np.array([float(r[-1]) for r in rows]))
    assert all(html_text.main_text(p, blind) != PLAIN for p in NAMELESS)


def test_short_notes_linked_paragraphs_and_copyright_lines():
    assert html_text.main_text("<p>Short note.</p>", TREE) == "Short note."
    linked = "<p><a href=x>A paragraph of an article that is one long link</a></p>"
    assert "one long link" in html_text.main_text(f"<article>{STORY}{linked}{STORY}</article>", TREE)
    assert html_text.main_text(f"<div>{STORY}</div><div>© 2024 Example Press</div><div>All rights reserved.</div>", TREE) == PLAIN
    assert "All rights reserved." in html_text.main_text(f"<article>{STORY}<p>All rights reserved.</p></article>", TREE)
