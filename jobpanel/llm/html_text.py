"""Main text of web pages by tag-path ratios.

A page becomes a row of text blocks, each with the path of tags from the root. For
every path the characters outside links and the punctuation are summed and divided
by its blocks; the two ratios are fused, smoothed along the page and compared with
a threshold. The element that holds what passes is the article, together with those of
the same tag path; its blocks are the text, without the parts that pages mark as
menus, notices, forms or comments. A mark by class or id counts unless the marked
part itself holds most of the page's text.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li dd dt td th pre blockquote figcaption".split())
CLOSES = {  # an opening tag ends these open elements, up to the nearest of the second set
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])), "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
DROPPED_TAGS = frozenset("head nav footer aside button select dialog menu object canvas".split())
FORM_TAGS = frozenset("form fieldset".split())  # some pages are one form
# fixed words of class, id and role that name parts outside the article
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners "
    "sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply replies "
    "respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations widget widgets "
    "toolbar pagination pager search complementary contentinfo dialog form copyright".split())
HEADER_WORDS = frozenset("header masthead".split())
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
MODIFIERS = frozenset("no with without has have hide show is not".split())  # `with-sidebar` says what else is on the page
MOST, NEARLY_ALL = 0.5, 0.9  # share of the text at which a marked part, or marked comments, are the content
LINKED = 0.5  # share of a block in links above which it is a list of links
KEPT_TAGS = frozenset("html body main".split())
THRESHOLD = 0.5  # share of the mean score that a block's smoothed score must reach
HOLDS = 0.9  # share of the passing score that an element must hold to be the article
KERNEL = np.array([0.1, 0.2, 0.4, 0.2, 0.1])


class _Element:
    __slots__ = ("tag", "label", "parent", "dropped", "header", "article", "depth", "marked", "limit")

    def __init__(
        self, tag: str, label: str, parent: "_Element | None", dropped: bool, header: bool, limit: float | None = None
    ) -> None:
        self.tag, self.label, self.parent, self.dropped, self.header = tag, label, parent, dropped, header
        self.limit = limit  # of a marked part: the share of the text from which the mark does not count
        self.marked = (() if parent is None else parent.marked) + (() if limit is None else (self,))
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.depth = 0 if parent is None else parent.depth + 1


class _Block:
    __slots__ = ("element", "parts", "plain")

    def __init__(self, element: _Element) -> None:
        self.element, self.parts, self.plain = element, [], 0


def _words(names: str) -> set[str]:
    """Words of the names in class, id and role, without names that begin with a modifier."""
    out: set[str] = set()
    for name in names.split():
        words = _WORD.findall(name)
        if words and words[0] not in MODIFIERS:
            out.update(words)
    return out


def _open(tag: str, attributes: str, parent: _Element) -> _Element:
    label, dropped, header, limit = tag, tag in DROPPED_TAGS, tag == "header", None
    if tag in FORM_TAGS:
        limit = MOST
    if attributes.strip(" /\t\n\r"):
        names = ""
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role"):
                names += " " + (a or b or c).lower()
            elif name == "hidden":
                dropped = dropped or tag not in KEPT_TAGS
        words = _words(names)
        single = tag in LEAVES or tag == "article"
        marks = words & ({"comment", "comments", "ad", "advert", "notice", "copyright"} if single else DROPPED_WORDS)
        if marks and tag not in KEPT_TAGS:
            limit = NEARLY_ALL if marks & COMMENT_WORDS else MOST
        header = header or (tag not in KEPT_TAGS and tag != "article" and bool(words & HEADER_WORDS))
        if tag not in LEAVES:
            label = f"{tag}.{names.strip()}"
    if header and not parent.article:
        if tag == "header":
            dropped = True
        elif limit is None:
            limit = MOST
    if limit is not None and tag not in BLOCK:  # an inline element that is marked drops its text
        dropped, limit = True, None
    return _Element(tag, label, parent, dropped or parent.dropped, header or parent.header, limit)


def blocks_of(page: str) -> list[_Block]:
    """Text blocks of a page in order, with the element each one lies in."""
    root = _Element("#root", "#root", None, False, False)
    stack = [root]
    out: list[_Block] = []
    block: _Block | None = None
    at, links, n = 0, 0, len(page)

    def text(raw: str) -> None:
        nonlocal block
        if not raw:
            return
        if block is None:
            if raw.isspace():
                return
            holder = stack[-1]
            while holder.tag not in BLOCK and holder.parent is not None:
                holder = holder.parent
            block = _Block(holder)
            # an inline element that is dropped drops its text
            out.append(block)
        if stack[-1].dropped and not block.element.dropped:
            return
        value = html.unescape(raw) if "&" in raw else raw
        block.parts.append(value)
        if not links:
            block.plain += len(value)

    def pop_to(index: int) -> None:
        nonlocal block, links
        for e in stack[index:]:
            if e.tag in BLOCK:
                block = None
            if e.tag == "a":
                links -= 1
        del stack[index:]

    while at < n:
        found = page.find("<", at)
        if found < 0:
            text(page[at:])
            break
        token = _TOKEN.match(page, found)
        if token is None:  # a stray sign, or a tag cut off by the end of the page
            if re.match(r"</?[a-zA-Z]", page[found:found + 3]) and ">" not in page[found:]:
                text(page[at:found])
                break
            text(page[at:found + 1])
            at = found + 1
            continue
        text(page[at:found])
        at = token.end()
        tag = (token["tag"] or token["tag2"] or "").lower()
        if not tag:
            continue
        if token["close"] or token["close2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break
            if tag in BLOCK:
                block = None
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if end is None:
                break
            close = page.find(">", end.start())
            at = n if close < 0 else close + 1
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            block = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag in BLOCK:
                    break
            if tag in CLOSES:
                ends, limit = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        pop_to(k)
                        break
                    if stack[k].tag in limit:
                        break
        if tag in VOID:
            continue
        attributes = token["attrs"] or token["attrs2"] or ""
        if attributes.endswith("/") and tag not in BLOCK and tag != "a":
            continue
        stack.append(_open(tag, attributes, stack[-1]))
        links += tag == "a"
    return out


def _path(element: _Element) -> tuple[str, ...]:
    path = []
    while element is not None:
        path.append(element.label)
        element = element.parent
    return tuple(path)


def _kept(blocks: list[_Block], texts: list[str]) -> list[bool]:
    """Whether a block lies in no marked part, those left out that hold most of the text themselves.

    Where a page has an article element, a part counts so only if that is inside it.
    """
    inside: dict[_Element, int] = {}
    around: set[_Element] = set()
    total, article = 0, False
    for b, value in zip(blocks, texts):
        size = min(b.plain, len(value))
        total += size
        article = article or b.element.article
        for e in b.element.marked:
            inside[e] = inside.get(e, 0) + size
            if b.element.article:
                around.add(e)

    def content(e: _Element) -> bool:
        return total > 0 and inside[e] >= e.limit * total and (e in around or not article)

    return [all(content(e) for e in b.element.marked) for b in blocks]


def _in(element: _Element, holder: _Element) -> bool:
    while element is not None and element is not holder:
        element = element.parent
    return element is not None


def main_text(page: str | None) -> str:
    """Blocks of the article joined by line feeds; empty if there is none."""
    if not page:
        return ""
    blocks, texts, sums = [], [], {}
    for b in blocks_of(page):
        value = " ".join("".join(b.parts).split())
        if not value or b.element.dropped:
            continue
        blocks.append(b)
        texts.append(value)
    stay = _kept(blocks, texts)
    for k, b in enumerate(blocks):
        if b.element.header and b.element.article and b.element.tag not in HEADINGS:
            stay[k] = False
    blocks, texts = [b for b, s in zip(blocks, stay) if s], [t for t, s in zip(texts, stay) if s]
    if not blocks:
        return ""
    paths = [_path(b.element) for b in blocks]
    for b, value, path in zip(blocks, texts, paths):
        total = sums.setdefault(path, [0, 0, 0])
        total[0] += b.plain
        total[1] += len(_PUNCTUATION.findall(value))
        total[2] += 1
    text_ratio = np.array([sums[p][0] / sums[p][2] for p in paths])
    punctuation_ratio = np.array([sums[p][1] / sums[p][2] for p in paths])
    # an article is measured by its text, and more so the more it is punctuated
    fused = text_ratio * np.sqrt(1 + punctuation_ratio)
    smooth = np.convolve(np.pad(fused, 2, mode="edge"), KERNEL, mode="valid")
    chosen = smooth >= THRESHOLD * smooth.mean()
    linked = np.array([b.plain < (1 - LINKED) * len(t) for b, t in zip(blocks, texts)])
    weight = np.where(chosen & ~linked, [b.plain for b in blocks], 0)
    if not weight.any():
        weight = np.array([len(t) for t in texts])
    held: dict[_Element, float] = {}
    for b, w in zip(blocks, weight):
        e = b.element
        while e is not None:
            held[e] = held.get(e, 0) + w
            e = e.parent
    whole = weight.sum()
    article = max(
        (e for e, w in held.items() if w >= HOLDS * whole and not (e.parent is not None and e.parent.article)),
        key=lambda e: e.depth)
    if article.tag in LEAVES and article.parent is not None:
        article = article.parent
    if article.article:  # what an article element holds is its text, and so are others of the same path
        like = _path(article)
        nodes = {e for e in held if e.depth == article.depth and e.tag == article.tag and _path(e) == like}
        return "\n".join(t for b, t in zip(blocks, texts) if any(_in(b.element, e) for e in nodes))
    # elsewhere the text goes on around the element as long as no list of links does, and leaves those inside it out
    while article.parent is not None and not any(
            bad and _in(b.element, article.parent) and not _in(b.element, article) for b, bad in zip(blocks, linked)):
        article = article.parent
    return "\n".join(
        t for b, t, fits, bad in zip(blocks, texts, chosen, linked)
        if (_in(b.element, article) and not bad) or (fits and not bad) or (fits and _in(b.element, article)))


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """`pages` with `text` and `n_chars`, its code points; columns of those names are replaced.

    Character references are decoded, white space inside a block becomes one
    space, blocks are trimmed and joined in page order by one line feed; `br` is
    white space. What a page marks as not its article goes: by tag (navigation, footers,
    sidebars, scripts, headers outside an article), or by a word in class, id or role
    (menus, notices, adverts, forms, comments), unless the part so marked holds most of
    the text. Outside article elements lists of links go too. Nothing else is dropped
    from the chosen elements. A null, empty or text-free page gives empty text. Every page is
    judged alone, so repeated rows give equal rows and an empty table stays empty.
    """
    out = pages.withColumn("text", _main_text(F.col(column)))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
