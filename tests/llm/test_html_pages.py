"""Odd pages: read in whole, in time that grows with their length, and no word of an article is lost to a class name."""

import time

import pytest

from vitalgrid.llm import html_tree as H


def test_class_names_inside_an_article():
    kept = ['<p class="related-work">a</p>', '<div class="story notice-of-award">b</div>', '<h1 class="title banner-text">c</h1>', '<section id="comment-on-policy">d</section>']
    gone = ['<div class="comments">x</div>', '<ul class="related-posts"><li>x</li></ul>', '<div id="comment-list">x</div>', '<p class="ad box">x</p>', '<span class="share-buttons">x</span>']
    assert H.main_text("<article>" + "".join(k + g for k, g in zip(kept + ["e"], gone)) + "</article>") == "a b c d e"
    assert H.main_text('<div class="site-nav">x</div><p>text</p><div class="cookie-hint">x</div>') == "text"


@pytest.mark.parametrize("unit", ["<a b='", '<a b="\'>', "<x>", "</y>", "</p>", "<p><h2>", "<li>", "<span class='ad'>", "<div>", "<", "<!--", "<td><p>"])
def test_odd_pages_take_linear_time(unit):
    def took(n):
        page = "<x>" * (n // 20) + unit * (n // len(unit)) + "<p>x</p></span>"
        start = time.perf_counter()
        H.main_text(page)
        return time.perf_counter() - start

    small, large = max(took(50_000), 0.01), took(400_000)
    assert large < 8 * small * 4 + 0.5  # four times the room that linear growth needs, against a busy machine


def test_quotes_that_nothing_closes():
    assert H.main_text("<p>it's <b class='x>bold</b></p> <p title=\"a>b\">more</p>") == "it's bold more"
    assert H.main_text("<p title=\"a>b\">more</p> it's") == "more it's"
    assert H.main_text("<p>open <b") == "open <b"
