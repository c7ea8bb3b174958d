"""HTML to a sequence of text blocks with their tag paths."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TOKEN = re.compile(rf"<!--(?s:.*?)(?:-->|\Z)|<([a-zA-Z][^\s/>]*)({_QUOTED})>|</([a-zA-Z][^\s>]*)[^>]*>|<[!?/][^>]*>|<([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""(?i)(?:^|\s)(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg math object select datalist audio video canvas".split())
#: Elements that stand inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
HOLDS = frozenset("ul ol dl table html body div article section main aside nav footer header form".split())
NAME = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Block:
    """A block's text, the names on its tag path from the outside in, and the characters inside links."""

    text: str
    path: tuple[str, ...]
    linked: int = 0


@dataclass(slots=True)
class _Open:
    tag: str
    names: tuple[str, ...] = field(default=())


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("hidden", "aria-hidden"):
                out.append("hidden")
            elif key == "style":
                if "display:none" in value.replace(" ", ""):
                    out.append("hidden")
            else:
                out += [f".{n}" for n in dict.fromkeys(NAME.findall(value))]
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, white space collapsed, character references decoded.

    A block is the text between two block-level tags; inline tags do not split it. Unclosed elements
    end where HTML ends them. Scripts, styles, forms' fields and comments give no text; an empty
    page gives no block.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    links, linked, at, end = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(n for o in stack for n in o.names), min(linked, len(text))))
            parts.clear()
        linked = 0

    while at < end:
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        opened, closed = m.group(1) or m.group(4), m.group(3)
        if opened:
            tag, attributes = opened.lower(), m.group(2) or m.group(5) or ""
            if tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                    at = stop.end() if stop else (at if tag not in ("script", "style", "textarea", "title") else end)
                continue
            if tag in INLINE:
                links += tag == "a"
                if tag == "br":
                    parts.append(" ")
                continue
            flush()
            links = 0
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
                    if stack[k].tag in HOLDS:
                        break
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in HOLDS or tag not in SAME:
                    break
                if stack[k].tag in SAME[tag]:
                    del stack[k:]
            if tag not in VOID and not attributes.endswith("/"):
                stack.append(_Open(tag, _names(tag, attributes)))
        elif closed:
            tag = closed.lower()
            if tag in INLINE:
                links = max(0, links - (tag == "a"))
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
    flush()
    return out


PATH_BINS, WORD_BINS, NUMBERS = 256, 48, 8
#: Tag paths weigh more than words: they are what layouts share.
PATH_WEIGHT = 4.0
_bins: dict[str, tuple[int, float]] = {}
WORD = re.compile(r"[^\W\d_]+|[©»›]")


#: Names with a bin of their own; others share hashed bins.
NAMED = {
    n: i
    for i, n in enumerate(
        "article main section div p h1 h2 h3 h4 li ul ol blockquote pre table td th dl dt dd figure figcaption nav header footer aside form fieldset button address details hidden"
        " .ad .ads .advert .nav .menu .header .footer .sidebar .comments .comment .cookie .notice .content .post .article .related .share .banner .widget .subscribe .newsletter .search .login .copyright".split()
    )
}


def _bin(name: str, size: int) -> tuple[int, float]:
    """The bin and the sign of a name."""
    if size == PATH_BINS and name[1:] in NAMED:
        return NAMED[name[1:]], 1.0
    known = _bins.get(name)
    if known is None:
        h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
        own = len(NAMED) if size == PATH_BINS else 0
        known = (own + h % (size - own), 1.0 if h & 0x80000000 else -1.0)
        if len(_bins) < 100_000:
            _bins[name] = known
    return known


def _shares(path: tuple[str, ...]) -> list[float]:
    """The weight of each name: class names that share bins weigh less the more of them one element has."""
    out = [1.0] * len(path)
    many: list[int] = []
    for i, name in enumerate((*path, "")):
        if not name.startswith("."):
            for k in many:
                out[k] = 1 / len(many)
            many = []
        elif name not in NAMED:
            many.append(i)
    return out


WIDTH = PATH_BINS + WORD_BINS + NUMBERS


def vectors(page: list[Block]) -> np.ndarray:
    """A row for each block: hashed tag path, all its words hashed, and numbers such as length and link share."""
    x = np.zeros((len(page), WIDTH), np.float32)
    paths: dict[tuple[str, ...], np.ndarray] = {}
    for r, b in enumerate(page):
        row = x[r]
        known = paths.get(b.path)
        if known is None:
            known = np.zeros(PATH_BINS, np.float32)
            for depth, (name, share) in enumerate(zip(b.path, _shares(b.path), strict=True)):
                k, sign = _bin("/" + name, PATH_BINS)
                known[k] += PATH_WEIGHT * sign * share * (0.5 if depth + 1 < len(b.path) and not name.startswith(".") and name in ("div", "body", "html", "section") else 1.0)
            paths[b.path] = known
        row[:PATH_BINS] = known
        words = Counter(WORD.findall(b.text.lower()))
        if words:
            hashed = [0.0] * WORD_BINS
            for w, times in words.items():
                k, sign = _bin(w, WORD_BINS)
                hashed[k] += sign * times**0.5
            # a word that a long block repeats weighs no more than one that a short block consists of
            row[PATH_BINS : PATH_BINS + WORD_BINS] = np.array(hashed) / words.total() ** 0.5
        n = len(b.text)
        row[-NUMBERS:] = (np.log1p(n) / 6, b.linked / n, (b.text.count(".") + b.text.count(",")) * 20 / (n + 20), len(b.path) / 10, n > 120, b.text[-1] in ".!?:\"”»", (r + 1) / len(page), 1.0)
    return x
