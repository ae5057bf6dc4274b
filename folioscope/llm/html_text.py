"""HTML extraction: the main text of a page by two passes of block rules.

The page is cut into blocks at block-level tags. First pass: a block in a boilerplate container (navigation, footer, advert, comments, form, ...) is bad, as
is a short one of links; one that is long enough, rich in stop words and poor in links is good; other long ones without stop words are bad, the rest is
undecided. Second pass: undecided blocks take the label of the nearest decided neighbour. All pages go this way.

Two things weigh without deciding. A class name that only may mark boilerplate ("search-methods", "related-work") makes a block doubtful: it is good
only by its text. That a block lies in an article or main element: there a long block is undecided where it would be bad, a tie of neighbours is good, and
boilerplate that interrupts the article decides nothing about its neighbours; where articles hold at least as much of the page's long prose as the rest of
it, what lies outside of them is bad.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"

# Elements and words that mark boilerplate.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title"}
SKIPPED = {*RAW, "svg", "object", "select", "button", "head"}
BOILERPLATE = {"nav", "footer", "aside", "form", "dialog", "menu"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "header", "figure", "ul", "ol", "dl", "table", "details", "fieldset", *BOILERPLATE}
BLOCKS = CONTAINERS | {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "th", "tr", "dt", "dd", "figcaption", "address", "hr", "br", "caption", "option", "legend", "summary"}
HINTS = re.compile(
    r"ads?|advert\w*|adsense|sponsored|side|sidebar|nav|navbar|breadcrumbs?|popup|modal|newsletter|subscribe|comments?|disqus|respond|footer|masthead|topbar|pagination|pager"
)
#: These mark boilerplate where the name says nothing else, or only how the element is laid out; beside a word of its own they leave it doubtful.
WEAK_HINTS = re.compile(
    r"notices?|tags?|share|sharing|sharebar|promos?|promotions?|banner|search|widgets?|copyright|disclaimer|social|related|recommended|cookies?|consent|menu|navigation|sponsors?|overlay|replies|login|bio"
)
LAYOUT = re.compile(
    r"list|box|bar|block|wrap|wrapper|container|section|area|inner|outer|rows?|cols?|columns?|items?|links?|posts?|articles?|stories|news|buttons?|btn|icons?|top|bottom|left|right|primary|secondary"
    r"|site|page|global|main|form|panel|thread|feed|slot|unit|zone|header|head|title|module|component|media|network|input|field|text|message|popup|dialog|\d+"
)
TEXT_NAMES = {"content", "body", "text", "article", "story", "prose"}
SITE_HEADERS = re.compile(r"(?:site|page)-?header|side-?bar|top-?bar|author-?bio")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
ROLES = re.compile(r"(?:^|\s)role\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert)", re.I)
STOP_WORDS = frozenset(
    "the of and a to in is was that for on are with as at be this have from or by an it not but were which their has had they you we his her its will would can "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch "
    "le la les des du et un une en que qui dans est pour pas au sur par ce il ne se plus avec son sont aux ou mais comme elle cette nous vous leur ses été "
    "el los las del se por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo".split()
)

# quotes count only as a value's, so a stray one does not swallow what follows
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|$)", re.S)
#: What never lies in a button, drawing or list of choices: one that is still open there was never closed.
ARTICLE_TAG = re.compile(r"<(?:p|h[1-6]|li|article|main|section|blockquote|table|footer|nav|aside|form)\b", re.I)

#: Production parameters of the block rules.
LONG, MANY_LINKS, STOP_LOW, STOP_HIGH = 70, 0.5, 0.10, 0.25

CLEAR, DOUBTFUL, MARKED = 0, 1, 2
GOOD, BAD, OPEN = 1, -1, 0


def _marked(name: str, attributes: str) -> int:
    """Whether an element is boilerplate by its name, class, id or role, or hidden, or may be."""
    if name in BOILERPLATE:
        return MARKED
    if not attributes or name in ("html", "body", "article", "main"):
        # a comment list may hold articles of class "comment"
        return MARKED if name == "article" and attributes and "comment" in attributes.lower() else CLEAR
    values = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attributes)).lower()
    return MARKED if HIDDEN.search(attributes) or ROLES.search(attributes) else _hinted(values)


@functools.lru_cache(maxsize=4096)
def _hinted(values: str) -> int:
    """Whether these class names and ids mark boilerplate."""
    found = CLEAR
    for name in values.split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        if SITE_HEADERS.fullmatch(name) or any(HINTS.fullmatch(p) and not (p == "side" and len(parts) > 1) for p in parts):
            return MARKED
        if parts and parts[-1] not in TEXT_NAMES and any(WEAK_HINTS.fullmatch(p) for p in parts):
            if all(WEAK_HINTS.fullmatch(p) or LAYOUT.fullmatch(p) for p in parts):
                return MARKED
            found = DOUBTFUL
    return found


class _Ends:
    """Where elements that are not read end. A place that has been found is kept until the reading has passed it, so the page is searched once per name."""

    def __init__(self, page: str):
        self.page, self.next = page, {}

    def _after(self, name: str, pattern: re.Pattern, at: int) -> tuple[int, int] | None:
        known = self.next.get(name, (-1, -1))
        if known is not None and known[0] < at:
            m = pattern.search(self.page, at)
            known = self.next[name] = m.span() if m else None
        return known

    def skipped_to(self, name: str, at: int) -> int | None:
        """The end of the element that begins here; None if it is to be read on: it was never closed."""
        end = self._after(name, re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I), at)
        if name in ("script", "style"):
            return end[1] if end else len(self.page)
        if end is None:
            return None
        if name not in RAW and name != "head":
            other = self._after("", ARTICLE_TAG, at)
            return None if other and other[0] < end[0] else end[1]
        return end[1]


def blocks_of(page: str) -> list[tuple[str, float, int, bool]]:
    """(text, link density, how far in boilerplate, in article) of every non-empty block in page order."""
    out: list[tuple[str, float, int, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # element, boilerplate here, article here
    open_: Counter[str] = Counter()  # elements on the stack by name
    ends = _Ends(page)
    pieces: list[str] = []
    linked, in_link = 0, False
    at = 0
    skip_to = None

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                _, bad, inside = stack[-1] if stack else ("", CLEAR, False)
                out.append((text, linked / len(text), bad, inside))
        pieces, linked = [], 0

    for m in TOKEN.finditer(page):
        if skip_to is not None:
            if m.start() < skip_to:
                continue
            at, skip_to = skip_to, None
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[1])
        if name in SKIPPED:
            if not closing and not m[3].endswith("/"):
                skip_to = ends.skipped_to(name, at)
                at = at if skip_to is None else skip_to
            continue
        if name == "a":
            in_link = not closing
            continue
        if name not in BLOCKS:
            continue
        flush()
        if name not in CONTAINERS:
            if name not in ("br", "hr"):
                in_link = False
            continue
        in_link = False
        if closing:
            while open_[name]:
                last = stack.pop()[0]
                open_[last] -= 1
                if last == name:
                    break
        elif not m[3].endswith("/"):
            _, bad, inside = stack[-1] if stack else ("", CLEAR, False)
            inside = inside or name in ("article", "main")
            # a header within the article holds its title, elsewhere the site's
            own = max(_marked(name, m[3]), MARKED if name == "header" and not inside else CLEAR)
            stack.append((name, max(bad, own), inside))
            open_[name] += 1
    if skip_to is None and at < len(page):
        pieces.append(page[at:])
        linked += len(page) - at if in_link else 0
    flush()
    return out


def _stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w in STOP_WORDS for w in words) / len(words)


def _first_pass(text: str, links: float, bad: int, inside: bool, apart: bool) -> int:
    """apart: the block lies outside the element that holds most of the page's text."""
    if bad == MARKED or apart or (links > MANY_LINKS and len(text) < LONG):
        return BAD
    if len(text) < LONG:
        return OPEN
    stop = _stop_density(text)
    if links > MANY_LINKS:
        return OPEN if inside and stop >= STOP_LOW and bad == CLEAR else BAD
    if stop >= STOP_HIGH or (stop >= STOP_LOW and len(text) >= 2 * LONG):
        return GOOD
    return BAD if bad == DOUBTFUL else OPEN if stop >= STOP_LOW or inside else BAD


def _second_pass(labels: list[int], inside: list[bool], silent: list[bool]) -> list[int]:
    """Undecided blocks by the nearest decided ones on either side; of two equally near ones that differ, good wins inside an article, else bad.

    silent: boilerplate within an article, which decides nothing there.
    """
    n = len(labels)
    nearest: list[list[tuple[int, int]]] = []
    for order in (range(n), range(n - 1, -1, -1)):
        found: list[tuple[int, int]] = [(OPEN, n)] * n
        for within in (False, True):
            seen, away = OPEN, n
            for i in order:
                away += 1
                if inside[i] == within:
                    found[i] = (seen, away)
                if labels[i] != OPEN and not (within and silent[i]):
                    seen, away = labels[i], 0
        nearest.append(found)
    out = list(labels)
    for i, label in enumerate(labels):
        if label == OPEN:
            (a, near_a), (b, near_b) = nearest[0][i], nearest[1][i]
            votes = {x for x, d in ((a, near_a), (b, near_b)) if x != OPEN and d == min(d for x, d in ((a, near_a), (b, near_b)) if x != OPEN)}
            out[i] = votes.pop() if len(votes) == 1 else GOOD if inside[i] else BAD
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    weight = {True: 0, False: 0}  # of text within and outside of articles: long blocks, outside only those that read like prose
    for text, links, bad, inside in blocks:
        if bad < MARKED and len(text) >= LONG and links <= MANY_LINKS and (inside or _stop_density(text) >= STOP_LOW):
            weight[inside] += len(text)
    article = weight[True] > 0 and weight[True] >= weight[False]
    apart = [article and not inside for *_, inside in blocks]
    labels = [_first_pass(*b, x) for b, x in zip(blocks, apart)]
    silent = [bad == MARKED or x for (_, _, bad, _), x in zip(blocks, apart)]
    labels = _second_pass(labels, [inside for *_, inside in blocks], silent)
    return " ".join(text for (text, *_), label in zip(blocks, labels) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """Per page its main text and that text's code points; null or empty html: an empty text.

    Rows stay as they are otherwise: repeated pages, null ids and null urls pass through; other columns are ignored; broken
    markup (unclosed tags, cut-off pages) is read as far as it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)
