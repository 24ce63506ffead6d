"""Main text against pages whose article is known, and against a plain reader built on the standard HTML parser."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import numpy as np
import pytest

from fiscal_ledger.llm.html_text import main_text, op9_html_text
from tests.conftest import SF_DIR
from tests.llm import fixture

PROSE = "A sentence of the article, long enough to be read, with commas."

INLINE = {"a", "b", "i", "em", "strong", "span", "code", "small", "br", "u", "sub", "sup"}
LEFT_OUT = {"nav", "footer", "aside", "form", "script", "style", "title"}


class PlainReader(HTMLParser):
    """The article of a page that marks it as such: its blocks, without adverts; no scores, no repairs but for p."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.block = [], [], ""

    def end_block(self):
        words = self.block.replace("\xa0", " ").split()
        self.blocks += [" ".join(words)] if words else []
        self.block = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.block += " "
        if tag in INLINE or tag in ("meta", "img", "link"):
            return
        self.end_block()
        if self.open and self.open[-1][0] == "p":
            self.open.pop()
        self.open.append((tag, dict(attrs).get("class") == "ad" or tag in LEFT_OUT))

    def handle_endtag(self, tag):
        if tag in INLINE:
            return
        self.end_block()
        if any(name == tag for name, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(name == "article" for name, _ in self.open) and not any(out for _, out in self.open):
            self.block += data


def plainly_read(page: str) -> str:
    reader = PlainReader()
    reader.feed(page)
    reader.close()
    reader.end_block()
    return "\n".join(reader.blocks)


@pytest.mark.parametrize("seed", range(40))
def test_articles_that_are_known(seed):
    """Pages put together from blocks that belong to the article and ones that don't."""
    rng = np.random.default_rng(seed)
    words = "alpha beta gamma, delta epsilon, zeta eta theta. iota".split()

    def prose(least=12):
        return " ".join(rng.choice(words, rng.integers(least, 60)))

    body, expected = [], []
    for _ in range(rng.integers(3, 12)):
        text = prose()
        kind = rng.integers(7)
        if kind == 0:
            body.append(f"<h2 id='related'>{text}</h2>")
            expected.append(text)
        elif kind == 1:
            body.append(f"<section id='discussion'><div><p>{text}</p></div></section>")
            expected.append(text)
        elif kind == 2:
            body.append(f"<table class='market-share'><tr><td>{text}</td><td>5 &lt; 6</td></tr></table>")
            expected += [text, "5 < 6"]
        elif kind == 3:
            body.append(f"<div class='ad'><p>{text}</p></div>")
        elif kind == 4:
            body.append(f"<div class='related'><ul><li><a href='/x'>{text}</a></li></ul></div>")
        elif kind == 5:
            body.append(f"<section class='comments'><p>{text}</p></section>")
        else:
            body.append(f"<p>{text} <i>and</i>\n\t&amp;  so on</p>")
            expected.append(f"{text} and & so on")
    body.append(f"<p>{PROSE}</p>")
    expected.append(PROSE)
    page = f"<html><body><header><h1>Site</h1></header><nav><a href=/>x</a></nav><article>{''.join(body)}</article><footer>{prose()}</footer>"
    assert main_text(page) == "\n".join(expected)


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ("<section id='discussion'><p>Part, of the article.</p></section>", f"Part, of the article.\n{PROSE}"),
        ("<h2 id='related'>Related work</h2>", f"Related work\n{PROSE}"),
        ("<div class='article-header'><h1>The title</h1></div>", f"The title\n{PROSE}"),
        ("<table class='market-share'><tr><td>A<td>5 %</table>", f"A\n5 %\n{PROSE}"),
        ("<div class='social-history'>Short</div>", f"Short\n{PROSE}"),
        ("<div class='share'>Share this</div>", PROSE),
        ("<div class='post-footer'><a href=/t>tags</a></div>", PROSE),
        ("<div class='newsletter'><p>Sign up, now, please.</p></div>", PROSE),
        ("<div class='share' hidden><p>Hidden, with commas, and so on.</p></div>", PROSE),
    ],
)
def test_words_inside_an_article(inside, text):
    assert main_text(f"<body><article>{inside}<p>{PROSE}</p></article>") == text


def test_given_pages(spark):
    rows = op9_html_text(spark, SF_DIR).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for row in rows:
        assert (row.url, row.text) == (pages[row.page_id].url, plainly_read(pages[row.page_id].html or ""))
        assert row.n_chars == len(row.text)


def test_rows_of_the_fixture(spark, tmp_path):
    rows = op9_html_text(spark, fixture.write(spark, str(tmp_path))).collect()
    assert len(rows) == len(fixture.pages())
    texts = {p[0]: p[2] for p in fixture.pages()}
    assert all(row.text == "" for row in rows if not texts[row.page_id])


@pytest.mark.parametrize("unit", ["<div>", "<blockquote>", "<blockquote></p>", "<ul><li>", "<span class=ad>", "<li><div>", "<thead>"])
def test_deep_pages_take_linear_time(unit):
    def seconds(times):
        began = time.process_time()
        main_text(unit * times + PROSE + "<tbody>" + "</p></i>" * times)
        return time.process_time() - began

    seconds(100)
    # A time that grows with the square would be 64 times as long.
    assert min(seconds(32_000) for _ in range(2)) < 24 * max(min(seconds(4000) for _ in range(3)), 0.004)
