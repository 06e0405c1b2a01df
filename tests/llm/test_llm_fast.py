"""Single-row functions against brute force; no Spark."""

import random

import numpy as np
import pytest
import xxhash

from tandem.llm import decontaminate, html_text, quality_knn, simhash, token_count, toxicity

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p><p>no</p>";</script></head>
<body><header class="site"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy now</div>
<article><header><h1>Head &amp; tail</h1><span>by X</span></header><p>First   <b>para&eacute;</b>graph <a href="x">with link</a>.</p><p>Sh.<br>Two</p>
<aside>side</aside><form><input><p>form</p></form><ul><li>one</li><li>two &lt;3</li></ul><script>x()</script><p>Last&nbsp;one</p></article>
<section id="comments"><p>A reader says something rather long that is still no part of the article at all, even if it goes on and on.</p></section>
<div class="cookie-notice">We use cookies</div><footer>&copy; F</footer></body></html>"""


def test_main_text():
    want = "Head & tail\nFirst paraégraph with link.\nSh. Two\none\ntwo <3\nLast one"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE[: PAGE.index("<footer>")]) == want


def test_main_text_without_article():
    long = "word " * 30
    page = f"<body><div id='menu'><a>x</a></div><div><p>{long}</p><p>short</p><p>{long}</p></div><div><a href=1>{long}</a></div><div class='sidebar'>{long}</div></body>"
    assert html_text.main_text(page) == f"{long.strip()}\nshort\n{long.strip()}"


@pytest.mark.parametrize("page", [None, "", "<p", "<p class=\"x", "<p>", "<!--", "<script>", "<nav>menu</nav>", "<a href='>' title=\"", "<div class=ad>x"])
def test_main_text_odd(page):
    assert html_text.main_text(page) == ""


def test_main_text_wrappers():
    inner = "<article class='post comments-open'><p>Kept text</p></article>"
    for wrap in ("<form>%s</form>", "<div class='menu'>%s</div>", "<div class='content-with-sidebar'>%s</div>", "<header>%s</header>"):
        assert html_text.main_text("<body>" + wrap % inner + "<div class='related'><article class='comment-body'>x</article></div></body>") == "Kept text"
    assert html_text.main_text("<aside><article><p>teaser</p></article></aside>" + inner) == "Kept text"


def test_main_text_plain():
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("1 < 2") == "1 < 2"
    assert html_text.main_text("<p>tiny</p>") == "tiny"
    assert html_text.main_text("<article><p><b>Open<br><p>Next</article>") == "Open\nNext"
    many = "<article>" + "<p>ab</p>" * 20_000 + "</article>"
    assert html_text.main_text(many).count("\n") == 19_999


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split() if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprint():
    r = random.Random(3)
    for text in [None, "", " \n", "A", "a B", "ä Ö ß x", *(" ".join(r.choice(["a", "bb", "É", "x.", "\x85y"]) for _ in range(r.randint(1, 60))) for _ in range(60))]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint("One  two\tTHREE four") == simhash.fingerprint("one two three four")


def test_triples_meet_every_five():
    from itertools import combinations

    assert all(any(set(t) <= set(five) for t in simhash.TRIPLES) for five in combinations(range(8), 5))


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        k = next((k for k in range(len(word) - i, 0, -1) if word[i : i + k] in pieces), None)
        if k is None:
            return 1
        i, n = i + k, n + 1
    return n


def test_automaton():
    r = random.Random(5)
    for _ in range(200):
        pieces = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 8))}
        a = token_count.Automaton(sorted(pieces))
        for _ in range(30):
            w = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 12)))
            assert a.count(w) == greedy(w, pieces)


def test_count_text():
    a = token_count.Automaton([b" ", b"a", b" a", b"aa"])
    assert [token_count.count_text(t, a, {}) for t in (None, "", " \n", "a", "aaa a", "z", "\u00a0")] == [0, 0, 0, 1, 3, 1, 1]


def item(i):
    r = random.Random(i)
    return " ".join(r.choice(["the", "of", "and", *(f"w{r.randint(0, 4000)}" for _ in range(5))]) for _ in range(30))


ITEMS = [(i, item(i)) for i in range(40)]


def test_leaks_and_clean_texts():
    index = decontaminate.Index([*ITEMS, (90, None), (91, ""), (92, "yes no")])
    filler = " ".join(f"q{i}" for i in range(300))
    own = ITEMS[7][1].split()
    changed = own[:9] + ["changed"] + own[10:]
    assert set(index.matches(f"{filler} {ITEMS[7][1].upper()}, {filler}")) == {7}
    assert set(index.matches(f"{filler} {' '.join(changed)} {filler}")) == {7}
    assert index.matches(filler) == {} and index.matches(None) == {} and index.matches("") == {}
    assert index.matches(" ".join(own[:12])) == {}
    assert decontaminate.Index([]).matches(filler) == {}
    assert set(index.matches("well yes no more")) == {92}


def test_terms():
    cols, vals = quality_knn.terms("Aa### bb bb\nAa### bb bb")
    assert len(cols) == len(vals) and (vals >= 0).all() and quality_knn.terms(None)[0].size == 0


def test_terms_are_whole():
    """Marks differ beyond their fourth character, and capitals are a share of all characters."""
    cols = lambda t: set(quality_knn.terms(t)[0].tolist())
    assert cols("abc#######!") != cols("abc#######?") and cols("x AAAAAAAAAA") != cols("x AAAAaaaaaa")


def test_voter_is_exact_nearest_neighbours():
    """Against a sort of all similarities; neighbours as near as the last one vote too."""
    r = random.Random(1)
    texts = [" ".join(r.choice(["alpha", "beta", "GAMMA!!", "x***"] if i % 2 else ["one", "two", "three"]) for _ in range(20)) for i in range(60)]
    texts += [texts[0]] * 20 + [texts[1]] * 20
    y = np.array([i % 3 > 0 for i in range(len(texts))], float)
    v = quality_knn.Voter([quality_knn.terms(t) for t in texts], y, rank=8)
    probes = texts[:30] + ["alpha two GAMMA!!", "one x***", "zzz"]
    for t, s in zip(probes, v.score(probes)):
        cols, vals = quality_knn.terms(t)
        x = v._weigh(cols, vals) @ v.space[cols]
        near = np.round(v.vectors @ (x / np.linalg.norm(x)), quality_knn.DIGITS)
        last = sorted(near, reverse=True)[quality_knn.NEIGHBOURS - 1]
        votes = [(max(n, 0) ** quality_knn.SHARP, good) for n, good in zip(near, y) if n >= last]
        assert len(votes) >= quality_knn.NEIGHBOURS
        want = (sum(w * good for w, good in votes) + 0.01 * v.share) / (sum(w for w, _ in votes) + 0.01)
        assert abs(s - want) < 1e-9
    assert sum(n >= last for n in near) >= quality_knn.NEIGHBOURS
    assert np.allclose(v.score(probes), [v.score([t])[0] for t in probes], atol=1e-9)
    assert abs(v.score([None])[0] - v.share) < 1e-6 and quality_knn.Voter([], np.array([])).score(["x"])[0] == 0.5


def test_more_evidence_never_lowers_a_score():
    r = np.random.default_rng(3)
    a = r.normal(size=500)
    x = np.stack([a + r.normal(scale=0.1, size=500), a + r.normal(scale=0.1, size=500), -a], axis=1)
    mean, spread, w = toxicity.logistic(x, (a > 0).astype(float))
    assert (w[1:] >= 0).all() and w[3] == 0 and w[1:].max() > 1
