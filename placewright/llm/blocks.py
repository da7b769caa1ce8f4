"""Visible text blocks of an HTML page, with what markup says about each: a tolerant tokenizer, not a tree builder."""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache
from typing import NamedTuple

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""\b(class|id|role|style|href|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements whose content a visitor never reads.
HIDDEN = {"script", "style", "noscript", "title", "template", "svg", "textarea", "select", "iframe", "object"}
#: Elements that start and end a block; the rest is inline.
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul label input".split()
)
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "wbr", "track", "param"}
#: A start tag that ends an open element of the given kinds (no end tag was written).
IMPLIED = {"li": {"li", "p"}, "p": {"p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}}
IMPLIED |= {t: {"p"} for t in "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()}
_SPACE = re.compile(r"[\s ​﻿]+")


class Block(NamedTuple):
    text: str
    tag: str  # innermost block element
    path: tuple  # open elements as (tag, marks, number), outermost first; marks: class, id and role in lower case
    linked: int  # characters of the text inside links
    links: int
    area: int  # number of the stretch between <hr> at the same depth


def squeeze(text: str) -> str:
    return " ".join(text.split()) if text.isascii() else _SPACE.sub(" ", text).strip()


@lru_cache(50_000)
def _tag(tok: str) -> tuple[str, bool, bool, str]:
    """(name, whether it ends an element, whether it closes itself, marks) of a tag as written; pages of a site repeat their tags."""
    name = _NAME.match(tok).group(1).lower()
    marks = " ".join(f"{k.lower()}={v.strip(chr(34) + chr(39))}" for k, v in _ATTR.findall(tok) if k.lower() != "href").lower() if "=" in tok else ""
    return name, tok[1] == "/", tok.endswith("/>"), marks


@lru_cache(1_000)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


def _read(raw: str) -> str:
    return squeeze(_html.unescape(raw) if "&" in raw else raw)


def blocks(page: str) -> list[Block]:
    """Blocks in reading order. Broken markup never fails: an end tag without its start is skipped, open elements end with the page."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []
    buf: list[str] = []
    anchors, linked, links, area, serial, pos = 0, 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, links
        if buf:
            text = _read("".join(buf))
            if text:
                tag = next((t for t, _, _ in reversed(stack) if t in BLOCK), "body")
                out.append(Block(text, tag, tuple(stack), min(linked, len(text)), links, area))
            buf.clear()
        linked = links = 0

    n = len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            raw, pos = page[pos:], n
        else:
            raw, pos = page[pos : m.start()], m.end()
        if raw:
            buf.append(raw)
            if anchors:
                linked += len(_read(raw))
        if m is None:
            break
        tok = m.group()
        if tok.startswith("<!") or tok.startswith("<?"):
            continue
        name, ends, alone, marks = _tag(tok)
        if ends:
            if name in HIDDEN:
                continue
            if name in BLOCK or name == "p":
                flush()
            if any(t == name for t, _, _ in stack):
                while stack:
                    t, _, _ = stack.pop()
                    if t == "a":
                        anchors = max(0, anchors - 1)
                    if t == name:
                        break
            continue
        if name in HIDDEN:
            if not alone:
                end = _end_of(name).search(page, pos)
                pos = end.end() if end else n
            continue
        if name in BLOCK:
            flush()
        if name == "hr":
            area += 1
        close = IMPLIED.get(name)
        if close:
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t in close:
                    del stack[i:]
                    break
                if t in BLOCK and not (name in {"li", "td", "th", "tr", "dt", "dd"} and t == "p"):
                    break
        if name in VOID or alone:
            continue
        serial += 1
        if name == "a":
            anchors += 1
            links += 1
        stack.append((name, marks, serial))
    flush()
    return out
