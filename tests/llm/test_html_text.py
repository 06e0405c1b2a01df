"""Main text: windows by definition, the articles of the driver's pages, and layouts that names alone do not tell apart."""

import html
import os
import random
import re

import pyarrow.parquet as pq
import pytest

from tandem.llm import html_text as H

LONG = "a sentence of plain words that goes on for long enough to surge over the threshold of a window"


def live_by_definition(weights, window):
    n = len(weights)
    return [not any(sum(weights[a : a + window]) == 0 for a in range(max(0, i - window + 1), min(i, n - window) + 1)) for i in range(n)]


def test_runs_are_what_no_empty_window_covers():
    r = random.Random(3)
    for _ in range(500):
        window = r.randint(1, 5)
        weights = [r.choice([0, 0, 0, 5, 90]) for _ in range(r.randint(0, 25))]
        live = live_by_definition(weights, window)
        runs = H._runs(weights, window)
        assert [any(a <= i < b for a, b in runs) for i in range(len(weights))] == live
        assert all(not live[a - 1] for a, _ in runs if a) and all(b == len(live) or not live[b] for _, b in runs)


def brute_text(blocks, window, threshold):
    """Without an article: blocks are (text, characters of links), None a gap of a window."""
    lines = [x for b in [None, *blocks, None] for x in ([("", 0)] * window if b is None else [b])]
    weights = [len(t) - k for t, k in lines]
    live = live_by_definition(weights, window)
    runs, kept = [[]], []
    for i, alive in enumerate(live):
        if alive:
            runs[-1].append(i)
        elif runs[-1]:
            runs.append([])
    surging = [run for run in runs if any(sum(weights[j] for j in run if i <= j < i + window) > threshold for i in run)]
    for run in surging or [run for run in runs if any(weights[i] for i in run)]:
        kept += [lines[i][0] for i in run if lines[i][0]]
    return "\n".join(kept)


def test_pages_without_an_article_against_brute_force():
    r = random.Random(8)
    for _ in range(300):
        blocks, page = [], ""
        for i in range(r.randint(0, 14)):
            kind = r.choice(["p", "p", "long", "link", "menu"])
            text = f"b{i} " + (LONG if kind == "long" else "short")
            if kind == "menu":
                blocks.append(None)
                page += "<nav>menu</nav>"
            else:
                blocks.append((text, len(text) if kind == "link" else 0))
                page += f"<p><a href=x>{text}</a></p>" if kind == "link" else f"<p>{text}</p>"
        window, threshold = r.randint(1, 4), r.choice([20, 80, 200])
        old, H.WINDOW = H.WINDOW, window
        try:
            assert H.main_text(f"<body>{page}</body>", window, threshold) == brute_text(blocks, window, threshold)
        finally:
            H.WINDOW = old


def article_of(page):
    """The blocks of the one article of a generated page, cut where the generator leaves tags open."""
    body = re.search(r"<article[^>]*>(.*?)(?:</article>|<footer)", page.replace("\n", " "), re.S)[1]
    body = re.sub(r"(?is)<(script|style|nav|aside|form|header|footer)\b.*?</\1>", "\n", body)
    body = re.sub(r"(?i)</?(p|h[1-6]|div|ul|ol|li|blockquote|section|table|tr)\b[^>]*>", "\n", re.sub(r"<br\s*/?>", " ", body))
    lines = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]+>", "", body).split("\n"))
    return "\n".join(x for x in lines if x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_articles_of_the_pages(sf):
    pages = pq.read_table(f"{os.environ.get('TESTDATA', '/root/testdata')}/{sf}/pages.parquet").to_pylist()
    assert [H.main_text(p["html"]) for p in pages] == [article_of(p["html"]) for p in pages]


CASES = {
    "<article><p><a href=x>Only a link</a></p></article>": "Only a link",
    f"<article><p>{LONG}</p><ul><li><a href=x>One source</a></li><li>and text</li></ul></article>": f"{LONG}\nOne source\nand text",
    f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>": f"{LONG} x=2",
    f"<article><p>{LONG} at <span class='share-price'>12</span> or <span class='menu-item'>soup</span> now</p></article>": f"{LONG} at 12 or soup now",
    f"<article><p class='ad-hoc'>{LONG}</p><h2 id='related-work'>Related work</h2><h2 id='comments'>On comments</h2><section id='comments-on-the-bill'><p>Text</p></section></article>": f"{LONG}\nRelated work\nOn comments\nText",
    f"<article><header><h1>Head</h1><p class='standfirst'>Stands first</p><div class=meta>by X</div></header><p>{LONG}</p></article>": f"Head\nStands first\n{LONG}",
    "<nav>menu</nav><p>third short.</p><nav>menu</nav><p>fourth</p>": "third short.\nfourth",
    f"<article><p>{LONG}</p><span hidden>no</span><p style='display:none'>no</p><div class='cookie-notice'>no</div><div class='site-header'>no</div><p>end</p></article>": f"{LONG}\nend",
    f"<div class='has-sidebar'><p>{LONG}</p></div><div class='sidebar-left'>{LONG}</div><div id='ad_slot_3'>{LONG}</div><div class='relatedPosts'>{LONG}</div>": LONG,
    f"<article><p>{LONG}</p></article><div class='comments'><article class='comment'><p>{LONG}</p></article></div>": LONG,
}


@pytest.mark.parametrize("page", CASES)
def test_layouts(page):
    assert H.main_text(f"<html><body>{page}</body></html>") == CASES[page]


def test_the_window_decides_inside_an_article():
    page = f"<article><p>{LONG}</p>" + "".join(f"<p><a href={i}>Link {i}</a></p>" for i in range(3)) + "<p>end</p></article>"
    assert H.main_text(page) == f"{LONG}\nend"
    assert H.main_text(page, window=4) == f"{LONG}\nLink 0\nLink 1\nLink 2\nend"


def test_the_threshold_decides_among_texts():
    page = f"<article><p>{LONG}</p></article><article><p>A teaser</p></article>"
    assert H.main_text(page) == LONG and H.main_text(page, threshold=500) == f"{LONG}\nA teaser"


def test_very_long_and_unclosed_pages():
    many = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert H.main_text(many).count("\n") == 19_999
    assert H.main_text("<article>" + "<svg>x" * 20_000 + f"<p>{LONG}") .endswith(LONG)
