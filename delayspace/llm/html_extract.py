"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass judges each by itself: blocks inside page
furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) are out; the rest are judged by
length, link density and the density of stop words, and short or middling ones stay undecided. The second
pass gives undecided blocks the label of the nearest decided neighbours.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function words of the four languages of the corpus.
STOP = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its
    may more most no not of on one only or other our out over she so some such than that the their them then there these they this to
    up was we were what when which who will with would you your
    au aux avec ce ces cette dans de des du elle elles en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour que qui sa se ses
    son sont sur un une vous y
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat im in ist kann mit nach nicht
    noch nur oder sich sie sind so um und von vor war was wenn wer werden wie wird wir zu zum zur über
    al como con de del donde el ella ellos en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se ser si sin
    sobre su sus también un una y ya""".split()
)

BLOCK = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4
    h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul""".split()
)
#: Elements whose content is not text of the page.
SILENT = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "head", "title", "textarea", "canvas", "audio", "video")
#: Elements that are furniture whatever they hold.
FURNITURE = frozenset("nav header footer aside form menu button select dialog fieldset noscript label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark furniture.
MARKS = frozenset(
    """ad ads advert advertisement adverts advertising banner bar breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disclaimer
    discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related
    replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget""".split()
)

_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE) for name in SILENT}

MANY_LINKS, LONG, SHORT = 0.5, 140, 40
MANY_STOPS, SOME_STOPS = 0.25, 0.15


#: Marks that hold for an article too: of a reader, or of another page.
OTHERS = frozenset("ad ads advert advertisement comment comments promo promoted related replies reply sponsored".split())


def _furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE and not (in_article and name == "header"):
        return True
    if not attributes.strip() or name in ("body", "html", "main"):
        return False
    marks = OTHERS if name == "article" else MARKS - {"header"} if in_article else MARKS
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
        if key in ("class", "id", "role"):
            words = [w.lower() for w in _SPLIT.split(value)]
            # "no-sidebar" and "with-sidebar" say that something else is one
            if any(w in marks and before not in ("no", "with", "without", "has", "hide") for before, w in zip(["", *words], words, strict=False)):
                return True
    return False


def tags(page: str):
    """(start, end, end mark, name, attributes) of each tag; comments and declarations have no name.

    A quoted ``>`` does not end a tag, but a quote that is never closed is a mark like any other. What is not closed goes to the page's
    end. Each part of the page is read once.
    """
    at, unclosed = 0, set()
    while m := _OPEN.search(page, at):
        if m[1]:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            yield m.start(), at, "", "", ""
            continue
        if not m[3]:
            at = m.end() if page.startswith("<![CDATA[", m.start()) else page.find(">", m.end()) + 1 or len(page)
            yield m.start(), at, "", "", ""
            continue
        at = m.end()
        while stop := _STOP.search(page, at):
            if stop[0] == ">":
                break
            close = -1 if stop[0] in unclosed else page.find(stop[0], stop.end())
            if close < 0:
                unclosed.add(stop[0])
                at = stop.end()
            else:
                at = close + 1
        end = stop.start() if stop else len(page)
        at = stop.end() if stop else len(page)
        jump = yield m.start(), at, m[2], m[3].lower(), page[m.end() : end]
        if jump is not None:
            at = jump
            yield


#: An element of the key is ended by the start of another; what stands outside of one of the values is not.
_SCOPE = {"p": ("div", "article", "section", "main", "td", "li", "body", "aside", "footer", "header", "nav", "form", "blockquote"), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}


#: What an open element of a name counts for.
_COUNTS = {"a": "links", "article": "articles", "main": "articles"} | dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "headings")


class Open:
    """Elements that are open, and where in the order those of each name stand."""

    def __init__(self):
        self.stack: list[tuple[str, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.furniture = self.links = self.articles = self.headings = 0

    def last(self, names) -> int:
        """Where the last one of these names stands, or -1."""
        best, places = -1, self.places
        for n in names:
            at = places.get(n)
            if at and at[-1] > best:
                best = at[-1]
        return best

    def start(self, name: str, furniture: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, furniture))
        self.furniture += furniture
        if name in _COUNTS:
            setattr(self, _COUNTS[name], getattr(self, _COUNTS[name]) + 1)

    def end(self, at: int) -> None:
        """End the element at this place and all in it."""
        for name, furniture in reversed(self.stack[at:]):
            self.places[name].pop()
            self.furniture -= furniture
            if name in _COUNTS:
                setattr(self, _COUNTS[name], getattr(self, _COUNTS[name]) - 1)
        del self.stack[at:]


def blocks(html: str | None) -> list[dict]:
    """Blocks in page order: text, link (characters within links), furniture, article, heading."""
    out: list[dict] = []
    text: list[str] = []
    page, open_, link, at = html or "", Open(), 0, 0
    endless: set[str] = set()

    def add(part: str) -> None:
        nonlocal link
        text.append(part)
        link += len(part) if open_.links else 0

    def close() -> None:
        nonlocal link
        got = " ".join(entities.unescape("".join(text)).split())
        if got:
            out.append({"text": got, "link": link, "furniture": open_.furniture > 0, "article": open_.articles > 0, "heading": open_.headings > 0})
        text.clear()
        link = 0

    found = tags(page)
    for start, end, closing, name, attributes in found:
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            continue
        if name in BLOCK:
            close()
        if closing:
            # an inline end tag does not close the blocks it was left open across
            if open_.places.get(name):
                open_.end(open_.places[name][-1])
            continue
        if name in SILENT:
            if attributes.endswith("/"):
                continue
            stop = None if name in endless else _ENDS[name].search(page, at)
            if not stop:
                endless.add(name)
                if name in ("head", "title"):
                    continue
            at = stop.end() if stop else len(page)
            found.send(at)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in _SCOPE:
            same = open_.last(_SAME.get(name, (name,)))
            if same > open_.last(_SCOPE[name]):
                open_.end(same)
        open_.start(name, _furniture(name, attributes, open_.articles > 0))
    if at < len(page):
        add(page[at:])
    close()
    return out


def first_pass(block: dict) -> str:
    """good, bad, near (middling) or short, by the block alone."""
    text = block["text"]
    n = len(text)
    if block["furniture"] or n and block["link"] / n > MANY_LINKS:
        return "bad"
    if not any(c.isalnum() for c in text):
        return "short" if block["article"] else "bad"
    words = _WORDS.findall(text.lower())
    stops = sum([w in STOP for w in words]) / max(1, len(words))
    if n < SHORT:
        return "short"
    if block["link"] / n <= 0.2 and (n >= LONG and stops >= SOME_STOPS or stops >= MANY_STOPS):
        return "good"
    if block["article"] or stops >= SOME_STOPS:
        return "near"
    return "short" if block["heading"] else "bad"


def second_pass(first: list[str], article: list[bool]) -> list[bool]:
    """Whether each block is main text. Undecided ones take the label of the nearer decided neighbour, good on a tie; of the page's ends, those in an article count as good."""
    n = len(first)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    last = None
    for i in range(n):
        if first[i] in ("good", "bad"):
            last = (i, first[i] == "good")
        before[i] = last
    last = None
    for i in range(n - 1, -1, -1):
        if first[i] in ("good", "bad"):
            last = (i, first[i] == "good")
        after[i] = last
    out = []
    for i, label in enumerate(first):
        if label in ("good", "bad"):
            out.append(label == "good")
        elif article[i]:
            # furniture outside of the article is no neighbour of what is within
            out.append(any(x is None or x[1] or not article[x[0]] for x in (before[i], after[i])))
        else:
            near = [(abs(i - x[0]), not x[1]) for x in (before[i], after[i]) if x]
            out.append(bool(near) and not min(near)[1])
    return out


def main_text(html: str | None) -> str:
    """The main blocks in page order, one newline between; empty if there are none."""
    found = blocks(html)
    keep = second_pass([first_pass(b) for b in found], [b["article"] for b in found])
    return "\n".join([b["text"] for b, k in zip(found, keep, strict=True) if k])


def _extract(batches):
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for b in batches:
        texts = [main_text(t.as_py()) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: id, url, text, n_chars (code points).

    Null html counts as empty, and gives an empty text. Whole pages are read, whatever their length; repeated rows
    and null ids stay as they are. No shuffle.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = slim.mapInArrow(_extract, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
