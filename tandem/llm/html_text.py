"""Main-text extraction by line-block distribution.

A page becomes a list of lines, one for each block element. A line weighs as many characters as it has outside
links (inside an article also those of a link beyond the first ``LINK``: longer ones are text, not a menu's). Weights are
summed over windows of ``WINDOW`` lines. A line lies in a dive if some window around it weighs nothing;
what is between dives is a run, and a run surges if a window in it weighs over ``THRESHOLD``. The runs that
surge are the text; where nothing surges, all runs that weigh anything are.

Structure only mutes and divides: what is marked as boilerplate (menus, headers, footers, sidebars, notices, adverts, forms,
comments) is left out, and on a page without an article leaves a gap of a window. If there is an ``article`` or
``main`` element, what is outside is left out, and the article is one text: if any of its
runs surges, all do, while a menu of ``WINDOW`` short links in a row is a dive within it.

Edge cases: null or empty html and pages without text give ``''``; an article of nothing but links is its links; markup cut off
anywhere is read as far as it goes; pages of any length are read whole; equal pages give equal texts, and equal
weights are treated alike; rows are never dropped; columns other than the id, the url and the html are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WINDOW = 3
THRESHOLD = 80
#: Characters of a menu's link at most.
LINK = 40

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>"
    r"|</?[a-zA-Z][^<]*+\Z",  # cut off at the page's end
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

RAW = frozenset("script style noscript template iframe svg textarea title object canvas audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot "
    "thead tr ul".split()
)
GAPS = frozenset("br td th".split())
BOILER = frozenset("nav header footer aside form menu dialog button fieldset head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Whole class names and ids of boilerplate, also with the qualifiers beside them, as in 'left-sidebar' or 'cookie-notice'.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments "
    "commentlist disqus reply replies respond related recommended share sharing social newsletter subscribe signup login "
    "modal popup overlay widget widgets pagination pager toolbar skip masthead topbar".split()
)
QUALIFIERS = frozenset(
    "site page main primary secondary top bottom left right global sticky fixed mobile desktop item items list links link bar box "
    "block container wrapper wrap area section inner outer content body text icons icon buttons button form post posts article articles "
    "entry stories reader user the to us this slot unit space zone holder frame placeholder row col column panel title heading label side rail".split()
)
#: What may stand beside 'header' for it to be the site's.
SITE = frozenset("site page main top global sticky fixed mobile nav navbar masthead".split())
#: Elements whose ids name a place to link to, and elements that stand in a line.
ANCHORED = HEADINGS | frozenset("p li dt dd blockquote figure figcaption td th tr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark math q s samp small span strike strong sub sup time tt u var".split())
#: What is text in an article's own header.
STANDING = HEADINGS | frozenset("p blockquote".split())
#: Classes of an article that is a reader's comment.
_COMMENT = re.compile(r"(?:comments?|repl(?:y|ies))(?:[-_](?:body|item|list|content|text|\d+))?", re.I)


def _named(token: str) -> bool:
    """Whether a class name or id says boilerplate as a whole; one other word in it, and it does not."""
    parts = [p.lower() for p in _PART.findall(token)]
    words = [p for p in parts if not p.isdigit()]
    if not words:
        return False
    if words[-1] == "header":
        return len(words) == 1 or set(words[:-1]) <= SITE
    return any(w in NAMES for w in words) and all(w in NAMES or w in QUALIFIERS for w in words)


def _is_boiler(name: str, attrs: str) -> bool:
    if name in BOILER:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    low = attrs.lower()
    if "class" not in low and "id" not in low and "role" not in low and "hidden" not in low and "display" not in low:
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", low):
        return True
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return True
        if name in INLINE or (key == "id" and name in ANCHORED) or key not in ("class", "id"):
            continue
        if any(_COMMENT.fullmatch(token) if name == "article" else _named(token) for token in value.split()):
            return True
    return False


def _tags(page: str) -> list[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes); comments and raw elements come as the name ''."""
    out, at = [], 0
    open_ended = set()  # raw elements of which no end follows
    while m := _TAG.search(page, at):
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing and not attrs.endswith("/"):
            end = None if name in open_ended else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if not end:
                open_ended.add(name)
            at = end.end() if end else len(page) if name in ("script", "style") else at
            name = ""
        out.append((m.start(), at, closing, name, attrs))
    return out


def _regions(tags: list[tuple[int, int, bool, str, str]]) -> list[int]:
    """For each opening tag the index of its closing tag; -1 where it has none."""
    ends, open_at = [-1] * len(tags), {}
    for i, (_, _, closing, name, attrs) in enumerate(tags):
        if not name or name in VOID or attrs.endswith("/"):
            continue
        if not closing:
            open_at.setdefault(name, []).append(i)
        elif open_at.get(name):
            ends[open_at[name].pop()] = i
    return ends


def _lines(page: str) -> list[tuple[str, int, int]]:
    """(text, characters inside links, article) of each block; article is 0 outside, else its number. ('', 0, 0) is a gap."""
    tags = _tags(page)
    ends = _regions(tags)
    # How many articles begin before each tag: an element that holds them all is no boilerplate, whatever its name.
    bodies = [0]
    for _, _, closing, name, attrs in tags:
        bodies.append(bodies[-1] + (not closing and name in ("article", "main") and not _is_boiler(name, attrs)))
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = anchors = 0
    muted_to = -1  # tag index up to which text is boilerplate
    loose = False  # inside boilerplate that never closes: it lasts to the next block
    standing_to = header_to = article_to = -1  # headings and paragraphs in the article's own header are kept
    article = count = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(_html.unescape("".join(parts)).split())
        if text:
            lines.append((text, min(len(text), linked), article))
        parts.clear()
        linked = 0

    def take(raw: str, i: int) -> None:
        nonlocal linked
        if raw and (i > muted_to or i <= standing_to) and not loose:
            parts.append(raw)
            if anchors:
                linked += len(" ".join(_html.unescape(raw).split()))

    at = 0
    for i, (start, end, closing, name, attrs) in enumerate(tags):
        take(page[at:start], i)
        at = end
        if not name:
            continue
        if name == "a":
            anchors = max(0, anchors + (-1 if closing else 1)) if not attrs.endswith("/") else anchors
        if name in GAPS:
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            loose = False
            anchors = 0
        if i >= article_to:
            article = 0
        if closing:
            continue
        if i >= muted_to:
            holds_all = bodies[-1] and ends[i] >= 0 and bodies[ends[i]] - bodies[i] == bodies[-1] and name not in ("article", "main")
            if _is_boiler(name, attrs) and not holds_all:
                if name in INLINE:
                    muted_to = ends[i]
                elif name == "header" and article:
                    muted_to = header_to = max(i, ends[i])
                elif name != "head" or ends[i] >= 0:
                    flush()
                    lines.extend([("", 0, 0)] * (0 if article else WINDOW))
                    muted_to = ends[i] if ends[i] >= 0 else i
                    loose = ends[i] < 0
            elif name in ("article", "main"):
                if not article:
                    count += 1
                article_to = max(article_to, ends[i] if ends[i] >= 0 else len(tags))
                article = count
        elif name in STANDING and i <= header_to and not _is_boiler(name, attrs):
            standing_to = ends[i]
    take(page[at:], len(tags))
    flush()
    return lines


def _runs(weights: list[int], window: int) -> list[tuple[int, int]]:
    """Stretches of lines of which none lies in a window that weighs nothing."""
    n = len(weights)
    upto = [0]
    for w in weights:
        upto.append(upto[-1] + w)
    dives_to, live = 0, []
    for i in range(n):
        if i + window <= n and upto[i + window] == upto[i]:
            dives_to = i + window
        live.append(i >= dives_to)
    runs, begin = [], None
    for i, alive in enumerate([*live, False]):
        if alive and begin is None:
            begin = i
        elif not alive and begin is not None:
            runs.append((begin, i))
            begin = None
    return runs


def _surges(weights: list[int], window: int, threshold: int) -> bool:
    return any(sum(weights[i : i + window]) > threshold for i in range(len(weights)))


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The main text of one page, one block a line; '' where there is none."""
    lines = _lines(page or "")
    texts: list[tuple[list[list[str]], list[bool], bool]] = []  # of each text its runs, which surge, and whether it weighs anything
    inside = sorted({a for _, _, a in lines if a})
    if inside:
        for number in inside:
            own = [(text, linked) for text, linked, a in lines if a == number]
            weights = [len(text) - linked + max(0, linked - LINK) for text, linked in own]
            runs = _runs(weights, window) if any(weights) else [(0, len(own))]
            surge = any(_surges(weights[a:b], window, threshold) for a, b in runs)
            texts.append(([[t for t, _ in own[a:b]] for a, b in runs], [surge] * len(runs), any(weights)))
        weighty = any(x[2] for x in texts)
    else:
        gap = [("", 0, 0)] * window
        own = gap + lines + gap
        weights = [len(text) - linked for text, linked, _ in own]
        runs = [(a, b) for a, b in _runs(weights, window) if any(weights[a:b])]
        texts.append(([[t for t, _, _ in own[a:b] if t] for a, b in runs], [_surges(weights[a:b], window, threshold) for a, b in runs], True))
        weighty = True
    surging = any(any(surges) for _, surges, _ in texts)
    kept = [line for runs, surges, weighs in texts for run, s in zip(runs, surges) if s or not surging and (weighs or not weighty) for line in run]
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: one map over the rows, no shuffle."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
