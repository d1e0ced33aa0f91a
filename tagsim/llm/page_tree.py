"""One page's markup as blocks of text and the nested elements that hold them."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import xxhash

#: Names of elements and attributes of the markup language, and usual names of what is not an article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
NEVER = RAW | set("head template svg math canvas object audio video map nav aside footer form button select option datalist fieldset label dialog menu".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol"
    " p pre search section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - set("body caption dd dt html legend li summary tbody tfoot thead tr".split())
#: A start tag ends an open element of the second set, unless one of the third lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, set()),
    "article": ({"nav", "header", "head"}, {"article", "main"}), "main": ({"nav", "header", "aside", "head"}, set()),
}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar tablist".split())
NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising advertorial adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus"
    " footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion promoted recommended recommendations"
    " related replies reply respond search share sharebar sharing sidebar signup skip skiplink social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: With these beside it, `header` names the head of an article.
HEADED = set("article entry post story content section page title main".split())

TOKEN = re.compile(r"<!--(?:-?>|.*?--!?>|(?P<rest>.*))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TELLING = re.compile(r"(?:class|id|role|hidden|style)(?![^\s=])", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


def dropped_by_name(attributes: str) -> tuple[bool, bool]:
    """Whether attributes say that an element is hidden, and whether they name it as something other than an article."""
    values = {}
    for m in ATTRIBUTE.finditer(attributes):
        values.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    style = values.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    if values.get("role", "").lower() in ROLES:
        return hidden, True
    for name in f"{values.get('class', '')} {values.get('id', '')}".split():
        words = {w.lower() for w in WORDS.findall(name)}
        found = words & NAMES
        if found and not (found == {"header"} and words & HEADED or words & {"has", "no", "with"}):
            return hidden, True
    return hidden, False


@dataclass(slots=True)
class Element:
    """low and high: the blocks inside. named: taken for something other than an article, unless it holds one."""

    tag: str
    low: int
    dropped: bool
    named: bool
    high: int = 0
    parts: list = field(default_factory=list)  # hashes of what it holds, in order
    links: int = 0
    chars: int = 0
    link_chars: int = 0
    holds_article: bool = False


class Page:
    """Blocks of text, in page order, and the block elements that hold them, each with the hash of its subtree (tags and texts, without
    attributes) and whether it lies in an article or a main part."""

    def __init__(self, markup: str):
        self.blocks: list[str] = []
        self.elements: list[Element] = []
        self.hashes: dict[int, int] = {}
        self.stack = [Element("", 0, False, False)]
        self.open: Counter = Counter()  # open elements by tag
        self.text: list[str] = []
        self._read(markup)
        while len(self.stack) > 1:
            self._close()
        self._flush()

    def _read(self, markup: str) -> None:
        at, last = 0, markup.rfind(">")
        while at <= last:
            found = TOKEN.search(markup, at, last + 1)
            if not found:
                break
            self._add(markup[at : found.start()])
            # a comment without an end is the rest of the page
            at = found.end() if found["rest"] is None else len(markup)
            tag = (found["tag"] or "").lower()
            if tag and found["end"]:
                self._end(tag)
            elif tag:
                self._start(tag, found["attributes"])
                if tag in RAW:
                    closing = re.compile(f"</{tag}[\\s/>]", re.I).search(markup, at)
                    at = closing.start() if closing else len(markup)
        # what follows the last tag is text, but for the beginning of a tag that was cut off
        rest = markup[at:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)
        self._add(rest[: cut.start()] if cut else rest)

    def _add(self, text: str) -> None:
        if text and not self.stack[-1].dropped:
            self.text.append(html.unescape(text))
            top = self.stack[-1]
            n = len(text.strip())
            if n:
                top.chars += n
                top.link_chars += n if any(e.tag == "a" for e in self.stack[-3:]) else 0

    def _flush(self) -> None:
        """Ends a block."""
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            owner = next(e for e in reversed(self.stack) if not e.tag or e.tag in BLOCK)
            owner.parts.append(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))
            self.blocks.append(text)

    def _start(self, tag: str, attributes: str) -> None:
        self._end_open(*ENDS.get(tag, ({"head"} if tag in BLOCK else set(), set())))
        if tag in CLOSES_P:
            self._end_open({"p"}, {"button", "table", "td"})
        if tag in BLOCK:
            self._flush()
        elif tag in ("br", "td", "th", "img") and not self.stack[-1].dropped:
            self.text.append(" ")
        if tag in VOID or tag not in BLOCK and tag not in RAW and re.search(r"(?:^|[\s\"'])/$", attributes):
            return
        hidden, named = dropped_by_name(attributes) if TELLING.search(attributes) else (False, False)
        # code in an article has classes of its own
        named = named and not self.open["pre"] and not self.open["code"]
        named = (named or tag in NEVER or tag == "header" and not self.open["article"] and not self.open["main"]) and tag not in ("html", "body", "main")
        # a block that is named may turn out to hold the article
        never = hidden or named and (tag not in BLOCK or tag in RAW)
        self.open[tag] += 1
        self.stack.append(Element(tag, len(self.blocks), self.stack[-1].dropped or never and tag not in ("html", "body"), named))

    def _end_open(self, tags: set[str], until: set[str]) -> None:
        """Ends the innermost open element of one of tags, with what is open in it, unless one of until lies between."""
        if any(self.open[t] for t in tags):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in until:
                    return
                if self.stack[k].tag in tags:
                    while len(self.stack) > k:
                        self._close()
                    return

    def _end(self, tag: str) -> None:
        if not self.open[tag]:
            return
        block = tag in BLOCK or tag in ("td", "th")
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._close()
                return
            if not block and tag not in NEVER and self.stack[k].tag in BLOCK:
                return

    def _close(self) -> None:
        own = self.stack[-1]
        if own.tag in BLOCK:
            self._flush()
        elif own.tag in ("td", "th") and not own.dropped:
            self.text.append(" ")
        self.stack.pop()
        self.open[own.tag] -= 1
        above = self.stack[-1]
        own.high = len(self.blocks)
        above.chars += own.chars
        above.link_chars += own.chars if own.tag == "a" else own.link_chars
        above.links += own.links + (own.tag == "a")
        above.holds_article |= own.holds_article or own.tag in ("article", "main") and not own.dropped and not own.named
        if own.tag in BLOCK and own.parts:
            digest = xxhash.xxh64_intdigest(f"{own.tag}:{own.parts}".encode())
            above.parts.append(digest)
            self.hashes[len(self.elements)] = digest - (1 << 64) if digest >> 63 else digest
            self.elements.append(own)
        elif own.parts:
            above.parts.extend(own.parts)

    def article(self) -> tuple[list[str], list[tuple[int, int, int]], bool]:
        """(blocks, (hash, low, high) of each element that lies in what is left, whether that is an element that says it is an article). Left are the blocks of the main
        part, else of the outermost articles, else of the whole page, without elements that are named as something else. Where
        nothing says what the article is, lists of links go too."""
        gone = [(e.low, e.high) for e in self.elements if e.named and not e.holds_article]
        left = _without(len(self.blocks), gone)
        for tag in ("main", "article"):
            scope = [(e.low, e.high) for e in self.elements if e.tag == tag and any(left[e.low : e.high])]
            if scope:
                held = _without(len(self.blocks), scope)
                left = [a and not b for a, b in zip(left, held, strict=True)]
                break
        else:
            scope = []
            left = _without(len(self.blocks), gone + [(e.low, e.high) for e in self.elements if e.links >= 3 and e.link_chars >= e.chars and not e.holds_article and e.tag not in ("html", "body")])
        place = [0]
        for x in left:
            place.append(place[-1] + x)
        blocks = [b for b, x in zip(self.blocks, left, strict=True) if x]
        elements = []
        for k, e in enumerate(self.elements):
            low, high = place[e.low], place[e.high]
            if high > low and e.tag not in ("html", "body", "main", "article"):
                elements.append((self.hashes[k], low, high))
        return blocks, elements, bool(scope)


def _without(n: int, ranges: list[tuple[int, int]]) -> list[bool]:
    steps = [0] * (n + 1)
    for low, high in ranges:
        steps[low] += 1
        steps[high] -= 1
    out, depth = [], 0
    for s in steps[:n]:
        depth += s
        out.append(depth == 0)
    return out
