"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags.  The first pass decides each block: by the element it lies in
(navigation and forms are never text, nor adverts, notices, reader comments ... by their class unless they hold the
page's text), else by length, link density and stop-word
density.  An article or main element with prose of its own lifts the labels of its blocks by a step.  The second pass
gives short and near-good blocks the label of the nearest decided blocks before and after them.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML and words of four languages.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
    pre search section summary table tbody td tfoot th thead title tr ul""".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template svg math".split())
NEVER = frozenset("head nav aside form footer dialog menu search button select object audio video canvas".split())
CONTENT = frozenset(("article", "main"))
#: Elements that are kept on the stack; others change nothing that is asked.
CONTAINERS = NEVER | CONTENT | frozenset("""header div section ul ol dl table td figure details blockquote fieldset span p li
    h1 h2 h3 h4 h5 h6""".split())
#: Containers that are a block rather than hold blocks.
SINGLE = frozenset("span p li h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset("""ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent
    cookie cookies copyright disqus footer gdpr login menu modal nav navbar navigation newsletter notice notification pager
    pagination popup promo promoted promotion recommended related replies reply share sharing sidebar signup social sponsor
    sponsored subscribe subscription toolbar widget complementary contentinfo search""".split())
STOP_WORDS = frozenset("""a an and are as at be been but by can for from had has have he her his i in is it its not of on or
    she so that the their there they this to was we were what which who will with you
    aber als am an auch auf aus bei das dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit
    nach nicht noch nur oder sich sie sind so über um und von vor war was werden wie wird wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour plus que
    qui sa se ses son sont sur un une vous
    al como con de del el ella en entre era es esta este ha la las lo los más me mi muy no o para pero por que se ser si sin
    son su sus también un una y ya""".split())

_TAG = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+|[^<>]*)>|</?[a-zA-Z][^<>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_TOKEN = re.compile(r"[a-z0-9]+")
_STATE = re.compile(r"(?:has|no|not|with|without|is)[-_]")


def _hidden(name: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is never text, and the names of boilerplate it bears: "" none, "part" in a class name of
    several words, "whole".  ``inside`` an article its own header may be."""
    if name in NEVER or name == "header" and not inside:
        return True, ""
    kind = ""
    if not attributes or name in ("html", "body"):
        return False, kind
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            for each in value.split():
                if each in BOILERPLATE:
                    kind = "whole"
                elif name not in CONTENT and not kind and not _STATE.match(each):
                    words = _TOKEN.findall(each)
                    if not BOILERPLATE.isdisjoint(words) or "header" in words and not inside:
                        kind = "part"
        elif key == "style" and "display:none" in value.replace(" ", "") or key == "aria-hidden" and value == "true":
            return True, ""
    return re.search(r"(?:^|\s)hidden(?:\s|/|$)", attributes.lower()) is not None, kind


class _Named:
    """An element that bears a name of boilerplate, and the next such element around it."""

    __slots__ = ("whole", "around", "holds", "good")

    def __init__(self, whole: bool, around: _Named | None) -> None:
        self.whole, self.around, self.holds = whole, around, False  # holds an article or text, so isn't hidden
        self.good = 0  # characters of good text in it

    def hold(self) -> None:
        """What an element holds, those around it hold."""
        x: _Named | None = self
        while x and not x.holds:
            x.holds, x = True, x.around


class _Open:
    """An open element: its name, whether it is never text, its number if it is an article, its name of boilerplate;
    ``in_`` has the same of the nearest element that has it, itself included; the place is the number of the nearest
    element that holds blocks."""

    __slots__ = ("name", "never", "content", "named", "place", "in_never", "in_content", "in_named", "in_place")

    def __init__(self, name: str, never: bool, content: int, named: _Named | None, place: int) -> None:
        self.name, self.never, self.content, self.named = name, never, content, named
        self.place = 0 if name in SINGLE else place

    def under(self, parent: _Open | None) -> _Open:
        self.in_never = self.never or parent is not None and parent.in_never
        self.in_content = self.content or (parent.in_content if parent else 0)
        self.in_named = self.named or (parent.in_named if parent else None)
        self.in_place = self.place or (parent.in_place if parent else 0)
        return self


class _Block:
    __slots__ = ("text", "linked", "bad", "content", "heading", "named", "place")

    def __init__(self, text: str, linked: int, heading: bool, top: _Open | None) -> None:
        self.text, self.linked, self.heading = text, linked, heading
        self.bad, self.content, self.named, self.place = (
            (top.in_never, top.in_content, top.in_named, top.in_place) if top else (False, 0, None, 0))


def blocks(page: str) -> tuple[list[_Block], list[_Named]]:
    """The blocks of a page in order, with where they lie, and the elements with names of boilerplate, outer ones first."""
    found: list[_Block] = []
    names: list[_Named] = []
    parts: list[str] = []
    open_: list[_Open] = []
    count: Counter[str] = Counter()  # of the open elements by name
    contents, places, linked, link, heading, at, end = 0, 0, 0, 0, False, 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(_Block(text, linked, heading, open_[-1] if open_ else None))
        parts, linked = [], 0

    def shut(depth: int) -> None:
        """The elements from ``depth`` on end."""
        count.subtract(x.name for x in open_[depth:])
        del open_[depth:]

    def said(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link:
            linked += len(text.strip())

    while at < end:
        tag = _TAG.search(page, at)
        if not tag:
            said(page[at:])
            break
        if tag.start() > at:
            said(page[at:tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if tag[1]:
            if name == "a":
                link = max(0, link - 1)
            elif name in CONTAINERS and count[name]:
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i].name == name:
                        shut(i)
                        break
                    if open_[i].name in CONTENT and name not in NEVER and name not in CONTENT:
                        break  # a stray end tag doesn't end the article around it
            if name in BLOCKS:
                heading = False
            continue
        if name in RAW:
            if name in ("svg", "math") and (tag[3] or "").endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
            continue
        if name == "a":
            link = 1
        elif name == "body":
            if count["head"]:
                open_ = [x for x in open_ if x.name != "head"]
                count["head"] = 0
                for outer, x in zip([None, *open_], open_):
                    x.under(outer)
        elif name in CONTAINERS:
            if name == "p":
                while open_ and open_[-1].name in ("p", "span"):
                    shut(len(open_) - 1)
            elif name == "li" and count["li"]:
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i].name == "li":
                        shut(i)
                    if i >= len(open_) or open_[i].name in ("ul", "ol", "menu", "nav"):
                        break
            top = open_[-1] if open_ else None
            never, kind = _hidden(name, tag[3] or "", top is not None and top.in_content > 0)
            if not (tag[3] or "").endswith("/"):
                content = not kind and (name in CONTENT or "main" in _TOKEN.findall(tag[3] or "") and "role" in tag[3])
                contents += content
                if content and not never and top and top.in_named:
                    top.in_named.hold()
                if kind:
                    names.append(_Named(kind == "whole", top.in_named if top else None))
                places += 1
                open_.append(_Open(name, never, contents if content else 0, names[-1] if kind else None, places).under(top))
                count[name] += 1
        if name in BLOCKS:
            heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
            if name in ("p", "li", "td", "div"):
                link = 0
    flush()
    return found, names


def _first_pass(block: _Block, short: int, long: int, links: float, low: float, high: float) -> str:
    if block.bad:
        return "bad"
    text = block.text
    density = block.linked / len(text)
    if density > links or "\N{COPYRIGHT SIGN}" in text:
        return "bad"
    if len(text) < short:
        return "linked" if density > 0 else "short"
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)
    if stops >= high:
        return "good" if len(text) > long else "near"
    return "near" if stops >= low else "sparse"


def _unhidden(found: list[_Block], names: list[_Named], labels: list[str]) -> list[str]:
    """The labels with the blocks of boilerplate by name as bad, unless the element holds an article or most of the
    page's good text.  If its name is boilerplate as a whole, that counts only where no good text lies elsewhere."""
    good = [b for b, label in zip(found, labels) if label == "good"]
    for b in good:
        if b.named:
            b.named.good += len(b.text)
    apart = [False] * len(names)
    place = {id(x): i for i, x in enumerate(names)}
    for i, x in enumerate(names):  # in an element whose whole name is boilerplate and that holds no article
        apart[i] = not x.holds and (x.whole or x.around is not None and apart[place[id(x.around)]])
    for x in reversed(names):
        if x.around:
            x.around.good += x.good
    elsewhere = any(not b.named or not apart[place[id(b.named)]] for b in good)
    total = sum(len(b.text) for b in good)
    for i, x in enumerate(names):
        if 2 * x.good > total and not (elsewhere and apart[i]):
            x.hold()
    for b in found:
        b.bad = b.bad or b.named is not None and not b.named.holds
    return ["bad" if b.bad else label for b, label in zip(found, labels)]


def _lifted(found: list[_Block], labels: list[str]) -> list[str]:
    """The labels with articles as evidence.  In an article (or main element) that has prose, or if the page has good
    text in none but articles, near-good blocks are good, and short ones or those of few stop words near-good; its links go, but decide nothing
    about the blocks around them."""
    prose = {b.content for b, label in zip(found, labels) if label in ("near", "good")}
    elsewhere = any(label == "good" and not b.content for b, label in zip(found, labels))
    up = {"near": "good", "short": "near", "linked": "near", "sparse": "near", "bad": "links"}
    down = {"linked": "bad"}
    return [(up if b.content and not b.bad and (b.content in prose or not elsewhere) else down).get(label, label)
            for b, label in zip(found, labels)]


def _beside(found: list[_Block], labels: list[str]) -> list[str]:
    """The labels with the company of good blocks as evidence: in an element that holds a good block, short blocks and
    those of few stop words are near-good, and near-good ones good.  Elsewhere few stop words are bad."""
    company = {b.place for b, label in zip(found, labels) if label == "good" and b.place}
    up = {"near": "good", "short": "near", "sparse": "near"}
    return [up.get(label, label) if b.place in company else "bad" if label == "sparse" else label for b, label in zip(found, labels)]


def main_blocks(page: str, short: int = 70, long: int = 200, links: float = 0.33, low: float = 0.15,
                high: float = 0.25) -> list[str]:
    """The text of the blocks that are main text."""
    found, names = blocks(page)
    labels = _unhidden(found, names, [_first_pass(b, short, long, links, low, high) for b in found])
    labels = _beside(found, _lifted(found, labels))
    before, last = [], "bad"
    for label in labels:
        before.append(last)
        last = label if label in ("good", "bad") else last
    after, last = [], "bad"
    for label in reversed(labels):
        after.append(last)
        last = label if label in ("good", "bad") else last
    out = []
    for block, label, a, b in zip(found, labels, before, reversed(after)):
        near = (a == "good" or b == "good") if label == "near" else b == "good" if block.heading else a == b == "good"
        if label == "good" or label in ("near", "short") and near:
            out.append(block.text)
    if not out:  # a page of short blocks alone
        left = [b for b, label in zip(found, labels) if label not in ("bad", "links")]
        out = [b.text for b in [b for b in left if b.content] or left]
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of ``pages``: ``id_col``, ``url_col``, text, n_chars (code points).

    Whole pages are read; character references are decoded, white space inside a block is one space, blocks are joined
    by one line feed.  Null and empty pages have an empty text, unclosed elements end with the page or their parent.
    Repeated rows and nulls stay; other columns are not read; an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            texts = ["\n".join(main_blocks((x.as_py() or b"").decode("utf-8", "replace"))) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]
    return (rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
            .select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars"))
