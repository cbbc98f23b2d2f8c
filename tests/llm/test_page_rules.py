"""Rules of blocks: class names, nesting, clashing columns."""

from __future__ import annotations

import time

from sitescope.llm import pages


def kept(html):
    return [b.text for b in pages.blocks(html) if not b.chrome]


def test_names_that_also_say_main_text():
    html = ('<article><div class="article-header"><h1>Title</h1></div><p class="related-work">Earlier work.</p>'
            '<section class="discussion"><p>We discuss.</p></section><div class="share-buttons">Share</div><div class="ad">Buy</div></article>'
            '<div class="related">More</div><section id="comments"><p>First!</p></section>')
    assert kept(html) == ["Title", "Earlier work.", "We discuss."]


def test_deep_nesting_takes_no_longer_for_each_block():
    def took(n):
        t = time.process_time()
        assert len(pages.blocks("<div>x" * n)) == n
        return time.process_time() - t

    took(2000)
    assert took(32000) < 64 * max(took(2000), 0.01)


def test_end_tags_of_nothing():
    assert kept("<div>a</b></i></section>b</div>" * 3) == ["a", "b"] * 3


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a/b", "<p>x  y&amp;</p>", "old", 5)], "page_id long, url string, html string, text string, n_chars long")
    got = pages.extract(df).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [(1, "x y&", 4)]
