"""Main text of web pages by the line-block distribution.

Markup is stripped to lines, one per block of text; an element that ends the
flow of text (a menu, an advert, the borders of the article) leaves a gap of empty lines.
The length of every window of `WINDOW` lines, without what stands inside links, is the line-block
distribution. Text surges where the windows rise from nothing and dives
where they fall back to nothing; what lies between a surge and
its dive is kept if it is the page's article, or, on a page that marks none, if its windows rise to a fair height. There,
text that goes on in the same container after a gap is of one piece with the text before it, however short, and stretches of nothing but links are none.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import ship

WINDOW = 3
#: A stretch of an unmarked page's text surges from this share of the page's highest window.
SURGE = 0.1

# comments, declarations, tags with their attributes (a quote that is never closed is a character like any other), tags cut off
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)?+|=)*+)>"
    r"|</?[a-zA-Z][^>]*>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+))?+)?+", re.S)
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Element names and the words in class, id and role that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav footer aside form button select option script style noscript template iframe object canvas svg math textarea title dialog menu noembed noframes datalist audio video map".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "html", "body", "legend", "summary"}
#: Elements that hold text of their own; all others pass theirs on to the one around them.
HOLDERS = frozenset("div td th center fieldset details figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login paywall sidebar side widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar footer masthead "
    "comment comments commentlist respond replies reply discussion disqus share sharing social related recommended recommendations trending skip search contentinfo complementary dialog tags toc".split()
)

#: Parts that say nothing of their own in a name like `ad-box`.
NEUTRAL = frozenset("box block slot container wrapper wrap list links link bar buttons button area section panel unit item items inner outer group top bottom left right post posts article articles main page site js id widget text icon icons form message".split())

Line = tuple[str, int, bool, int]  # text, characters inside links, whether the article holds it, number of its container


def attributes_of(text: str) -> dict[str, str]:
    """Names in lower case; the first of several of one name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def names_no_article(name: str) -> bool:
    """A hint by itself, or one joined to hints and neutral parts only: `ad`, `cookie-notice`, `ad_box`, but not `with-sidebar` or `ad-hoc`."""
    if name in HINTS:
        return True
    parts = [x for x in re.split(r"[-_]+", name) if x]
    return len(parts) > 1 and not HINTS.isdisjoint(parts) and all(x in HINTS or x in NEUTRAL for x in parts)


def _hinted(attributes: str) -> bool:
    own = attributes_of(attributes)
    if "hidden" in own and own["hidden"].lower() != "false" or own.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(own.get("style", "")):
        return True
    return any(names_no_article(x) for key in ("class", "id", "role") for x in own.get(key, "").lower().split())


def lines_of(page: str) -> list[Line]:
    """The page's lines in order; empty ones stand for gaps."""
    out: list[Line] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each drops its content
    text: list[str] = []
    holders: list[tuple[int, int]] = []  # open containers: depth, number
    named: Counter[str] = Counter()  # open elements of each name
    tags: dict[str, tuple[list[int], list[int]]] = {}  # where elements of a name open and close
    state = {"dropped": 0, "article": 0, "links": 0, "header": 0, "heading": 0, "linked": 0, "held": 0, "holder": 0, "said": 0, "articles": 0, "dropper": "", "depth": 0}

    def say(piece: str) -> None:
        if piece and not state["dropped"] and (not state["header"] or state["heading"]):
            piece = html.unescape(piece)
            if not state["said"]:
                state["held"] = holders[-1][1] if holders else 0
                state["said"] = not piece.isspace()
            text.append(piece)
            state["linked"] += len(piece) * bool(state["links"])

    def end_line() -> None:
        body = " ".join("".join(text).split())
        if body:
            out.append((body, min(len(body), state["linked"]), state["article"] > 0, state["held"]))
        text.clear()
        state["linked"] = state["said"] = 0

    def gap() -> None:
        end_line()
        out.extend([("", 0, False, 0)] * WINDOW)

    def step(name: str, drops: bool, by: int) -> None:
        state["dropped"] += by * drops
        state["article"] += by * (name in ("article", "main"))
        state["links"] += by * (name == "a")
        state["header"] += by * (name == "header")
        state["heading"] += by * (name in HEADINGS)

    def close(depth: int) -> None:
        while len(stack) > depth:
            name, drops = stack.pop()
            named[name] -= 1
            if holders and holders[-1][0] == len(stack):
                holders.pop()
            border = name in ("article", "main") or drops
            if name in BLOCKS:
                end_line()
            step(name, drops, -1)
            if border and not state["article"] and not state["dropped"]:
                gap()

    def innermost(names, stop=()) -> int | None:
        if not any(named[x] for x in names):
            return None
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                return depth
            if stack[depth][0] in stop:
                return None
        return None

    def unclosed(name: str, at: int) -> bool:
        """Whether no end tag from here on is that of the open element of this name."""
        if name not in tags:
            tags[name] = tuple([m.start() for m in re.finditer(rf"<{slash}{name}\b", page, re.I)] for slash in ("", "/"))
        opens, ends = (len(x) - bisect_left(x, at) for x in tags[name])
        return ends <= opens

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0][:2] not in ("<!", "<?") and at >= len(page):
                break  # a tag cut off by the end of the page
            continue
        name, rest = m[2].lower(), m[3]
        if m[1]:
            if name == "p" and innermost(("p",)) is None:
                end_line()
            elif (depth := innermost((name,))) is not None:
                close(depth)
            continue
        if name in CLOSES_P and (depth := innermost(("p",), ("article", "main", "div", "section", "td", "li", "button"))) is not None:
            close(depth)
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            peers = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[name]
            if (depth := innermost(peers, ("ul", "ol", "dl", "table", "select", "article", "main", *(("tr",) if name in ("td", "th") else ())))) is not None:
                close(depth)
        if name in BLOCKS:
            end_line()
        if name in VOID:
            continue
        if name in ("article", "main") and state["dropped"] == 1 and state["dropper"] in ("nav", "header") and unclosed(state["dropper"], m.start()):
            close(state["depth"])  # a menu or header that is never closed ends where the article starts
        exempt = name in ("html", "body", "main", *HEADINGS) or name == "article" and not state["articles"]
        hinted = not exempt and bool(rest) and _hinted(rest)
        drops = name in DROPPED or hinted or (name == "header" and not state["article"])
        if drops and not state["dropped"]:
            state["dropper"], state["depth"] = "" if hinted else name, len(stack)
        state["articles"] += name == "article"
        if (drops or name in ("article", "main")) and not state["dropped"] and not state["article"]:
            gap()
        if name in HOLDERS:
            state["holder"] += 1
            holders.append((len(stack), state["holder"]))
        stack.append((name, drops))
        named[name] += 1
        step(name, drops, 1)
        if name in RAW:
            ends = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = ends.start() if ends else len(page)
    close(0)
    end_line()
    return out


def stretches(lines: list[Line]) -> list[tuple[int, int, bool]]:
    """(surge, dive, whether it rises to SURGE of the page's highest window) of every stretch of windows that hold text, from nothing to nothing.

    Windows live by any text and rise by what stands outside links.
    """
    sizes = np.array([len(t) for t, *_ in lines], np.int64)
    if not sizes.any():
        return []

    def windows(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[np.minimum(np.arange(len(x)) + WINDOW, len(x))] - total[:-1]

    live = np.concatenate([[False], windows(sizes) > 0, [False]])
    weights = windows(sizes - np.array([n for _, n, *_ in lines], np.int64))
    surge, dive = np.flatnonzero(live[1:] & ~live[:-1]), np.flatnonzero(~live[1:] & live[:-1])
    high = np.maximum.reduceat(weights, surge)  # between a dive and the next surge stands nothing
    return list(zip(surge.tolist(), dive.tolist(), (high >= SURGE * weights.max()).tolist(), strict=True))


def regions(lines: list[Line]) -> list[tuple[int, int]]:
    """(surge, dive) of every stretch that rises high enough or holds lines of the article."""
    own = np.concatenate([[0], np.cumsum([x[2] for x in lines])])
    return [(a, b) for a, b, up in stretches(lines) if up or own[b] > own[a]]


def main_text(page: str | None) -> str:
    """Null, empty and text-free pages give the empty string."""
    lines = lines_of(page or "")
    found = [([x for x in lines[a:b] if x[0]], up) for a, b, up in stretches(lines)]
    chosen = [kept for kept, _ in found if any(x[2] for x in kept)]
    if not chosen:
        plain = [x for x in found if any(n < len(t) for t, n, *_ in x[0])] or found
        runs: list[list] = []  # lines, whether any of them surge
        for kept, up in plain:
            if runs and runs[-1][0][-1][3] == kept[0][3]:
                runs[-1][0].extend(kept)
                runs[-1][1] |= up
            else:
                runs.append([list(kept), up])
        chosen = [kept for kept, up in runs if up]
    return " ".join(x[0] for kept in chosen for x in kept)


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row.

    A null, empty or text-free page gives the empty text. Repeated rows and null identifiers
    come out row by row, an empty table gives none; other columns of df, whatever their names, are not
    read. Pages are read whole, however long, one at a time. No shuffle.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
