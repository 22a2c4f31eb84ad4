"""Main text of hand-made and generated pages."""

import html
import re

import pytest

from seasonwise.llm.html_text import extract, main_text
from seasonwise.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
LONG = "This is a long sentence, with commas, that tells something about the matter at hand."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>", ""),
    ("a < b &amp; c &nbsp; d", "a < b & c d"),
    (f"<p>{LONG}</p><p>two\n\t lines<br>here</p>", f"{LONG}\ntwo lines here"),
    (f"<body><article><h1>T</h1><p>{LONG}<p>Short.</article><footer>f</footer>", f"T\n{LONG}\nShort."),
    ("<article><h1>Only</h1></article><div>else</div>", "Only"),
    (f"<div class=content><p>{LONG}</p></div><div class='comment-list'><p>{LONG} {LONG}</p></div>",
     LONG),
    (f"<div id=a><p>{LONG}</p><aside><p>{LONG}</p></aside><form><p>{LONG}</p></form></div>", LONG),
    (f"<div><p>{LONG}</p></div><div role=navigation><p>{LONG}</p></div>", LONG),
    (f"<div><script>var t='</p>'; if (a<b) {{}}</script><p>{LONG}</p><!-- <p>x</p> --></div>", LONG),
    (f"<div><p>{LONG}</p><script>never closed <p>x", LONG),
    (f"<div><p>{LONG}</p><!-- never closed <p>x", LONG),
    (f"<main><header><h1>Title</h1></header><p>{LONG}</p><section class=share>Share</section></main>",
     f"Title\n{LONG}"),
    (f"<header>Site</header><p>{LONG}</p>", LONG),
    (f"<div><h2>Head</h2><div><p>{LONG}</p><p>{LONG}</p></div></div>", f"Head\n{LONG}\n{LONG}"),
    (f"<div><ul><li><a href=x>{LONG}</a></li></ul></div><div><p>{LONG}</p></div>", LONG),
    (f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>",
     f"{LONG}\none\ntwo\na\nb"),
    (f"<head><title>x</title><body><p>{LONG}", LONG),
    (f"<div class=heading-address><p>{LONG}</p></div>", LONG),
    (f"<div class='cookie-notice'>{LONG}</div><article><p>{LONG}</p></article>", LONG),
    (f"<p title='a > b'>{LONG}</p>", LONG), (f'<p title="never closed>{LONG}</p>', LONG),
    # Elements of other languages, closed by themselves, by a tag, or by the next block.
    (f"<article><p>{LONG}</p><svg width=1 /><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><svg><title>x</title><path d=M0 /><text>y</text></svg><p>Two</p>",
     f"{LONG}\nTwo"),
    (f"<article><p>{LONG}</p><svg><path d=M0><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><object data=x><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><canvas id=c></canvas><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG} <math><mi>a</mi><mo>+</mo><mi>b</mi></math> end</p></article>",
     f"{LONG} a+b end"),
    (f"<article><p>{LONG} <label>so called</label> end</p></article>", f"{LONG} so called end"),
    (f"<div><p>{LONG}</p></div><form><label>Name</label><input></form>", LONG),
    # Containers named after what they hold beside the article.
    (f"<div class='content has-sidebar'><p>{LONG}</p><div class=sidebar><p>{LONG}</p></div></div>",
     LONG),
    (f"<div id=post-with-comments><p>{LONG}</p><div class=comments><p>{LONG} {LONG}</p></div></div>",
     LONG),
    (f"<div class=page-header><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class=widget><p>{LONG}</p></div>", LONG),
    (f"<div class=widget><div class=social><p>{LONG}</p></div></div><div class=ad>x</div>", LONG),
    (f"<div class='no-js post'><p>{LONG}</p></div><div class=promo><p>{LONG} {LONG}</p></div>", LONG),
    # More than one article, and a title beside it.
    (f"<main><article><p>{LONG}</p></article><article><p>Two: {LONG}</p></article></main>",
     f"{LONG}\nTwo: {LONG}"),
    (f"<body><article><p>{LONG}</p></article><article><p>Two: {LONG}</p></article><p>© me</p>",
     f"{LONG}\nTwo: {LONG}"),
    (f"<main><h1>Title</h1><article><p>{LONG}</p></article><ul class=related><li>x</ul></main>",
     f"Title\n{LONG}"),
    (f"<body><article><p>{LONG}</p></article><article><p><a href=x>{LONG}</a></p></article>", LONG),
    ("<article><pre>a  b\n c</pre></article>", "a b c"),
])
def test_pages(page, text):
    assert main_text(page) == text


def test_long_and_deep_pages_take_linear_time():
    deep = "<div>" * 20_000 + f"<p>{LONG}</p>"
    assert main_text(deep) == LONG
    many = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert main_text(many) == "\n".join([LONG] * 20_000)
    assert main_text("<a \"" * 3_000 + LONG) is not None
    assert len(main_text("x" * 3_000_000)) == 3_000_000


def test_odd_rows(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x"), (1, "u", f"<p>{LONG}</p>", "x"), (None, None, None, ""),
            (2, "v", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, "v", "", 0)],
                         key=str)
    assert extract(pages.limit(0)).count() == 0


def test_whole_table(spark):
    """All blocks of the one article of each page, and nothing else."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op3_html_text"](spark, SF_DIR).collect()}
    assert len(got) == len(pages)
    for page in pages:
        article = re.search("<article>(.*)</article>", page.html, re.S)[1].replace("<br>", "\n")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split())
                  for b in re.split("</?(?:p|h1)>", article))
        assert got[page.page_id].text == "\n".join(b for b in blocks if b)
        assert got[page.page_id].n_chars == len(got[page.page_id].text)
