"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. In the first pass each block has points: its link density, length and
stop-word density give -3 to 2, and the containers it stands in adjust them, an article by 1, a name that only hints at
boilerplate by -1, boilerplate elements and names by -4. Blocks above zero are good, below zero bad; short blocks,
headings and those that come to zero stay open. The second pass gives an open block the label of its nearest decided
neighbours, of its own kind of container if there are any: of both if they agree, else of the nearer one (of two
as near, the one before); headings look ahead.

Stop words are function words of several languages, so the language of a page need not be known.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .shared import table

MAX_LINK_DENSITY, ALL_LINKS, SHORT, LONG = 0.33, 0.9, 60, 200
STOP_LOW, STOP_HIGH = 0.08, 0.18
STOP_WORDS = frozenset("""
a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its
more most my no not of on one only or other our out she so some such than that the their them then there these they this to was we were what when
which who will with would you your
au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou par pas plus pour qu que qui sa se ses
son sont sur un une vous
aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich im ist mit nach nicht
noch nur oder sein sich sie sind so über um und von vor war was wenn werden wie wir wird zu zum zur
al como con cuando del desde donde el ella entre era es esta este fue ha hay la las lo los más me muy ni no nos para pero por porque que quien se ser si
sin sobre son su sus también tiene todo un una unos y ya
che di e il in non per una uma os do da em é não com para het een van met op te zijn niet och att som det på är den
""".split())

# Elements of HTML that start a block, that have no end tag, and whose content is no text of the page.
_BLOCK = frozenset("""address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title
tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea svg math iframe object select title".split())

# Points of containers.
ARTICLE, WEAK, STRONG = 1, -1, -4
_BAD_TAGS = frozenset("nav footer aside form button menu dialog head header".split())
_GOOD_TAGS = frozenset(["article", "main"])
_BAD_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus
footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices outbrain popup promo promos promotion related replies reply respond
share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets""".split())
#: Parts that a boilerplate name may be joined with and still be one: comment-list, site-footer.
_AROUND = frozenset("area bar block body bottom box container content inner item left links list main outer page panel post right row section site text thread top wrap wrapper".split())
_NAMED = frozenset("div section ul ol p span table td li dl figure".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)"
                    r"(?P<attrs>(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*+(?=>)|[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    points: int  # of its containers
    label: int | None = None  # 1 good, 0 bad


def _name_points(names: str) -> int:
    """Class and id names: STRONG for a name of boilerplate, WEAK for one that has such a word beside others."""
    out = 0
    for name in names.lower().split():
        parts = [x for x in re.split(r"[_\W]+", name) if x]
        bad = [x in _BAD_NAMES for x in parts]
        if any(bad):
            out = min(out, STRONG if all(b or x in _AROUND or x.isdigit() for b, x in zip(bad, parts)) else WEAK)
    return out


def _points(name: str, attrs: str, around: int) -> int:
    """The points inside an element, from those around it."""
    if name in _GOOD_TAGS:
        return around if around > 0 else around + ARTICLE
    if name in _BAD_TAGS and not (name == "header" and around > 0):
        return around + STRONG
    if attrs:
        found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
        if found.get("role", "").lower() in _BAD_ROLES or "hidden" in attrs and re.search(r"(?:^|\s)hidden(?:\s|=|$)",
            attrs) or found.get("aria-hidden") == "true":
            return around + STRONG
        if name in _NAMED:
            return around + _name_points(f"{found.get('class') or ''} {found.get('id') or ''}")
    return around


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open containers and the points in them
    unclosed: set[str] = set()  # names that have no end tag ahead
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    state = {"link": 0, "heading": False}
    anchors = 0

    def points() -> int:
        return stack[-1][1] if stack else 0

    def end() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Block(text, min(state["link"], len(text)), state["heading"], points()))
        parts.clear()
        state["link"] = 0

    def say(s: str) -> None:
        if s:
            parts.append(s)
            if anchors:
                state["link"] += len(html.unescape(s).strip())

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            say("<")
            at = lt + 1
            continue
        at = max(m.end(), lt + 1)
        if m["cdata"]:
            say(m["cdata"])
        name = (m["name"] or "").lower()
        if not name:
            continue
        if not m["close"]:
            if name in _RAW:
                if name in _BLOCK:
                    end()
                if not m["attrs"].rstrip().endswith("/") or name in ("script", "style", "title", "textarea", "select"):
                    close = None if name in unclosed else re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                    if not close:
                        unclosed.add(name)
                    at = close.end() if close else (n if name in ("script", "style") else at)
                continue
            if name == "a":
                anchors = 1
                continue
            if name in _BLOCK:
                end()
                anchors = 0 if name != "br" else anchors
                state["heading"] = name in ("h1", "h2", "h3", "h4", "h5", "h6")
            if name not in _VOID:
                inside = points()
                here = _points(name, m["attrs"], inside)
                if name in _BLOCK or here != inside:
                    if here != inside and name not in _BLOCK:
                        end()
                    if name == "p" and stack and stack[-1][0] == "p":
                        open_names[stack.pop()[0]] -= 1
                        here = _points(name, m["attrs"], points())
                    stack.append((name, here))
                    open_names[name] += 1
        elif name == "a":
            anchors = 0
        elif name in _BLOCK or open_names[name]:
            end()
            state["heading"] = False
            gone = None if open_names[name] else name
            while gone != name:
                gone = stack.pop()[0]
                open_names[gone] -= 1
    end()
    return out


def density_points(b: Block) -> int | None:
    """Points of a block by itself: links, length and stop words; None for a short block or a heading."""
    n = len(b.text)
    links = b.link_chars / n
    if links > ALL_LINKS:
        return -3
    if "\N{COPYRIGHT SIGN}" in b.text[:3]:
        return -2
    if links > MAX_LINK_DENSITY:
        return -1
    if b.heading or n < SHORT:
        return -1 if b.link_chars and not b.heading else None
    words = b.text.lower().split()
    stop = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / max(1, len(words))
    if stop < STOP_LOW:
        return -1
    return 2 if n >= LONG else 1 if stop < STOP_HIGH else 2


def _nearest(decided: list[int], k: int) -> tuple[int | None, int | None]:
    """The decided places before and after k."""
    at = bisect_left(decided, k)
    return decided[at - 1] if at else None, decided[at] if at < len(decided) else None


def classify(found: list[Block]) -> None:
    for b in found:
        own = density_points(b)
        total = b.points + (own or 0)
        if own is None:  # short: bad only by where it stands
            b.label = 0 if b.points <= STRONG + ARTICLE else None
        else:
            b.label = 1 if total > 0 else 0 if total < 0 else None
    if not any(b.label for b in found):  # nothing stands out: what is neither links nor in boilerplate is the text
        for b in found:
            b.label = int(b.points > STRONG + ARTICLE and (density_points(b) in (None,
                -1) and b.link_chars <= MAX_LINK_DENSITY * len(b.text)))
        return
    first = [b.label for b in found]
    everywhere = [k for k, v in enumerate(first) if v is not None]
    alike: dict[bool, list[int]] = {side: [k for k in everywhere if (found[k].points > 0) == side] for side in (False, True)}
    for k, b in enumerate(found):
        if first[k] is not None:
            continue
        lo, hi = _nearest(alike[b.points > 0] or everywhere, k)
        if lo is None or hi is None:
            b.label = first[hi if lo is None else lo]
        elif b.heading:
            b.label = first[hi]
        elif first[lo] == first[hi]:
            b.label = first[lo]
        else:  # between a good and a bad one: the nearer, of two as near the one before
            b.label = first[lo] if k - lo <= hi - k else first[hi]


def main_text(page: str | None) -> str:
    """Whole main text: blocks in page order joined by one space; empty if there is none."""
    found = blocks(page or "")
    classify(found)
    return " ".join(b.text for b in found if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, others) -> page_id, url, text, n_chars.

    Null or empty html, and pages without main text, give an empty text. Malformed pages are read as far as they go: an
    element that is not closed ends with the page, unless it would hide it (svg, select and the like are then passed over).
    Rows are independent, so repeated rows give equal results and an empty table none; pages of any length are read
    whole, in time in proportion to it; other columns do not matter.
    """

    def run(batches):
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of pages."""
    return extract(table(spark, sf_dir, "pages"))
