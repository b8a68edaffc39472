"""The page parser against texts written down by hand."""

import time

import pytest

from colloquy.llm import pages

PAGES = {
    '<article><p title="The hidden cost of war">Lead paragraph.</p><p>Second.</p></article>': "Lead paragraph.\n\nSecond.",
    '<article><div data-hidden="false">One</div><div data-style="display:none">Two</div><div hidden>Three</div><div style="color:red; display : none">Four</div></article>': "One\n\nTwo",
    '<article><p>Text.</p><div class="post-share">Share on X</div><div class="post-header">By me</div></article>': "Text.\n\nBy me",
    "<article><p>x<button>Buy</button> y</p></article>": "x y",
    "<article><p>Name <label for=a>Your name</label> end</p></article>": "Name end",
    "<article><p>a <span hidden>secret</span>b</p></article>": "a b",
    '<article><p>see <a class="share" href="x">Share</a>it <em class="notice">now</em> <code class="comment">// c</code></p></article>': "see it now // c",
    '<article class="related-work"><h2>Related work</h2><p>Others did.</p></article>': "Related work\n\nOthers did.",
    '<article><p>Essay.</p><section class="discussion"><p>We discuss.</p></section></article>': "Essay.\n\nWe discuss.",
    '<p>Body.</p><div class="related-posts"><p>More</p></div><div id="discussion">Reader: hi</div>': "Body.",
    "<p>a<button><div>inner</div>more</button>b</p>": "a\n\nb",
    "<p>kept <object>fallback": "kept fallback",
    "<p>one &amp; two&nbsp;&#8364;\n\t three<br>four</p><script>if (a < b) {}</script>": "one & two € three four",
}


@pytest.mark.parametrize("page", PAGES)
def test_texts_by_hand(page):
    assert "\n\n".join(text for text, kind in pages.blocks(page) if kind != 2) == PAGES[page]


@pytest.mark.parametrize("tag", ["<object>", "<head>", "<svg>", "<script>", "<p class=", "<!--"])
def test_unclosed_tags_take_linear_time(tag):
    began = time.perf_counter()
    pages.blocks(tag * 200_000)
    assert time.perf_counter() - began < 4  # some seconds of slack for a busy machine; quadratic would be minutes


def test_extract_by_hand(spark):
    rows = [(k, f"http://h{k}.org/a", page) for k, page in enumerate(PAGES)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: PAGES[page] for k, (_, _, page) in enumerate(rows)}
