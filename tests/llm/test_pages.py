"""Main text of pages: block sums against plain loops, and what tags and names may and may not do."""

from __future__ import annotations

import random

import numpy as np
import pytest

from vigil.llm import html_text

STORY = "<h1>Head</h1><p>" + "A long paragraph of the story. " * 5 + "</p>"
TOLD = "Head " + ("A long paragraph of the story. " * 5).strip()


def brute_lines_kept(rows):
    """Block sums by loops over (text, characters in links, whether in an article), as the method is written: one stream."""
    weight = [min(len(t) if main or not linked else (len(t) - linked if 5 * linked < 4 * len(t) else 0), html_text.LINE_CHARS) for t, linked, main in rows]
    n, size = len(rows), html_text.BLOCK_LINES
    blocks = {first: sum(weight[k] for k in range(first, first + size) if 0 <= k < n) for first in range(1 - size, n)}
    greatest, keep = max(blocks.values(), default=0), set()
    first = 1 - size
    while greatest and first < n:
        last = first
        while last < n and blocks[last] >= html_text.SURGE_SHARE * greatest:
            last += 1
        if last > first:
            own = [k for k in range(max(0, first), min(last + size - 1, n)) if weight[k]]
            keep |= set(range(own[0], own[-1] + 1)) if own else set()
        first = last + 1
    return [rows[k][0] for k in sorted(keep)]


@pytest.mark.parametrize("article", [False, True])
def test_block_sums_equal_plain_loops(article):
    rng = random.Random(3)
    for _ in range(300):
        page, rows = [], []
        for _ in range(rng.randrange(1, 40)):
            kind = rng.choice(["text", "short", "short", "tiny", "tiny", "tiny", "link"])
            if kind == "link" and not article and rows and rows[-1][1]:
                kind = "tiny"  # two links line by line are a menu
            text = {"text": "w" * rng.randrange(20, 400), "short": "s" * rng.randrange(1, 30), "tiny": "t", "link": "l" * 9}[kind]
            page.append(f"<div><a href='/'>{text}</a></div>" if kind == "link" else f"<p>{text}</p>")
            rows.append((text, len(text) * (kind == "link"), article))
        body = "".join(page)
        assert html_text.main_text(f"<body><article>{body}</article><p>outside</p></body>" if article else f"<body>{body}</body>") == " ".join(brute_lines_kept(rows))


def test_pages_table_equals_plain_loops_and_block_sums_choose(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]
    own = [html_text.main_text(p) for p in pages]
    for page, text in list(zip(pages, own, strict=True))[::5]:
        rows = [(x.text, x.linked, True) for x in html_text.lines_of(page) if x.main and x.level == html_text.PLAIN]
        assert text == " ".join(brute_lines_kept(rows))
    changed = lambda: sum(html_text.main_text(p) != t for p, t in zip(pages, own, strict=True))
    monkeypatch.setattr(html_text, "BLOCK_LINES", 1)
    assert changed() > 500  # short lines of an article hold by the lines around them only
    monkeypatch.setattr(html_text, "BLOCK_LINES", 5)
    assert changed() == 0
    monkeypatch.setattr(html_text, "SURGE_SHARE", 0.5)
    assert changed() > 200


def test_noise_around_a_story_goes():
    links = "".join(f"<li><a href='/{i}'>Other place {i}</a></li>" for i in range(4))
    pages = [
        f"<body><ul>{links}</ul><div>{STORY}</div><ul>{links}</ul></body>",
        f"<body><div>{STORY}<ul class='links'>{links}</ul><div class='cta-box'>Subscribe to us now</div><div class='opinions'><p>I liked it.</p></div></div></body>",
        f"<body><div class='ad'>Buy this thing now, it is good</div><article>{STORY}</article></body>",
        f"<body><article>{STORY}</article><p>Some words outside of the article.</p></body>",
    ]
    assert [html_text.main_text(p) for p in pages] == [TOLD] * 4


@pytest.mark.parametrize("inside", ["<p class='share'>Each share rose by two.</p>", "<section class='related'><p>Each share rose by two.</p></section>"])
def test_words_of_texts_are_no_noise_in_an_article_without_links(inside):
    assert html_text.main_text(f"<article>{STORY}{inside}</article>") == TOLD + " Each share rose by two."
    linked = inside.replace("Each share", "<a href='/x'>Each share</a>")
    assert html_text.main_text(f"<article>{STORY}{linked}</article>") == TOLD


@pytest.mark.parametrize("inside", ["<h2 class='related-work'>Related work</h2>", "<p class='notice-board-history'>Related work</p>", "<div id='share-price-table'>Related work</div>", "<p><a href='/x'>Related work</a></p>"])
def test_text_of_an_article_stays_under_any_name(inside):
    assert html_text.main_text(f"<article>{STORY}{inside}</article>") == TOLD + " Related work"
    assert html_text.main_text(f"<article class='promo'>{STORY}</article>") == TOLD


def test_a_page_under_a_name_that_only_begins_like_noise_stays():
    assert html_text.main_text(f"<body><div class='share-price-table'>{STORY}</div></body>") == TOLD


@pytest.mark.parametrize("comment", ["<article class='comment'>{}</article>", "<div class='comments'><article>{}</article></div>", "<article class='comment even depth-1'>{}</article>", "<ul class='comment-list'><li>{}</li></ul>", "<div id='disqus_thread'>{}</div>"])
def test_reader_comments_go(comment):
    noise = comment.format("<p>What a story, I read it twice, and so should you.</p>" * 4)
    assert html_text.main_text(f"<body><article>{STORY}</article>{noise}</body>") == TOLD
    assert html_text.main_text(f"<body><article>{STORY}{noise}</article></body>") == TOLD


def test_link_heavy_running_text_stays():
    middle = "<p><a href='/a'>A list of all that was said</a></p>"
    assert html_text.main_text(f"<body><div>{STORY}{middle}{STORY}</div></body>") == f"{TOLD} A list of all that was said {TOLD}"


def test_a_very_long_page_is_read_to_its_end(spark):
    story = "".join(f"<p>Paragraph {i} of a very long page, without end it seems.</p>" for i in range(30_000))
    rows = [(1, "u", f"<article>{story}</article>", "t", 1), (2, "u", None, None, None), (3, None, "", "x", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = {r.page_id: r for r in html_text.extract_main_text(pages).collect()}
    assert got[1].text.startswith("Paragraph 0 ") and got[1].text.endswith("Paragraph 29999 of a very long page, without end it seems.")
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "")


def test_sums_and_dives(monkeypatch):
    monkeypatch.setattr(html_text, "BLOCK_LINES", 3)
    w = np.array([0.0, 5, 0, 0, 0, 200, 1, 0, 0, 0, 0, 3])
    sums = html_text.block_sums(w)
    assert sums.tolist() == [0, 5, 5, 5, 0, 200, 201, 201, 1, 0, 0, 3, 3, 3]
    assert np.flatnonzero(html_text.surging(w, sums, 20)).tolist() == [5, 6]
    assert np.flatnonzero(html_text.surging(w, sums, 5)).tolist() == [1, 5, 6]
    assert np.flatnonzero(html_text.surging(w, sums, 1)).tolist() == [1, 5, 6, 11]
