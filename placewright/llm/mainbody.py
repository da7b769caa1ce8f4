"""Main body of web pages by nearest-URL page differencing (problem 1).

Pages of a host are ordered by URL path; the text lines of each page are aligned with those of its nearest neighbours by
longest common subsequence, and shared lines are taken for frame. Markup divides the page into stretches and names some frame;
the stretches with unshared text are the body, and shared lines are deleted with the exceptions stated at :func:`main_body`.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.blocks import BLOCK, blocks
from placewright.session import cut, once

#: Paths on either side among which a page's neighbour is looked for: the nearest that is not nearly a copy of the page.
AROUND = 3
#: Cells of an alignment's table that are held at once (as bits); larger alignments are halved first.
CELLS = 400_000_000
_FRAME_TAGS = {"nav", "footer", "aside", "form", "header", "button", "label", "fieldset", "legend", "dialog", "menu"}
_FRAME_MARK = re.compile(
    r"(?:^|[\s=_\-])(nav|navbar|navigation|menu|breadcrumbs?|crumbs?|cookies?|gdpr|consent|share|sharing|social|addtoany|sidebar|widget|footer|"
    r"newsletter|signup|subscribe|skip|toolbar|adverts?|sponsor(?:ed)?|related|copyright|popup|modal|overlay|dialog|contentinfo|"
    r"complementary|alertdialog)(?:$|[\s_\-])|position:\s*fixed"
)
_TEXTUAL = {"p", "li", "ul", "ol", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "font", "figcaption", "figure", "caption", "label", "button", "form"}
_INLINE_DROP = {"a", "b", "i", "em", "strong", "span", "small", "u", "s", "sub", "sup", "abbr", "code", "mark", "font", "q", "cite", "time"}
_CRUMB = re.compile(r"^\S+(?: \S+){0,4} [»›>/] \S", re.I)
_LEGAL = re.compile(r"^(?:©|\(c\)|copyright\b)|\b(all rights reserved|powered by|privacy policy|terms of use|imprint|sitemap)\b", re.I)

KEEP, FRAME, SIDE = 0, 1, 2


@lru_cache(50_000)
def _marked(marks: str) -> bool:
    return _FRAME_MARK.search(marks) is not None


_DIGITS = re.compile(r"\d+")


def mask(text: str) -> int:
    """A line for alignment: numbers do not count."""
    return _short_mask(text) if len(text) <= 400 else _short_mask.__wrapped__(text)


@lru_cache(50_000)
def _short_mask(text: str) -> int:
    return crc32(_DIGITS.sub("#", text).lower().encode("utf-8", "replace"))


def layout(page: str) -> list[tuple[str, str, int, int, int]]:
    """(text, tag, stretch, state, linked characters) of each block; state: KEEP, FRAME by markup, SIDE under a side heading."""
    bs = blocks(page)
    nested = {serial for b in bs for serial in [s for t, _, s in b.path if t in BLOCK][:-1]}
    title = next((b for b in bs if b.tag == "h1"), None)
    around = {serial for _, _, serial in title.path} if title else set()
    out, numbers, heading, last = [], {}, False, None
    for b in bs:
        state = KEEP
        for t, marks, serial in b.path:
            if serial not in around and t not in {"html", "body"} and (t in _FRAME_TAGS or (marks and _marked(marks))):
                state = FRAME
        keep = [e for e in b.path if e[0] not in _INLINE_DROP]
        while keep and (keep[-1][0] in _TEXTUAL or (keep[-1][0] in {"div", "section", "center"} and keep[-1][2] not in nested)):
            keep.pop()
        if keep and keep[-1][0] in {"td", "th"} and keep[-1][2] not in nested:
            while keep and keep[-1][0] in {"td", "th", "tr", "tbody", "thead", "tfoot", "table"}:
                if keep.pop()[0] == "table":
                    break
        where = (keep[-1][2] if keep else 0, b.area)
        stretch = numbers.setdefault(where, len(numbers))
        if stretch != last or b.tag in {"h1", "h2"}:
            heading = False
        if b.tag in {"h3", "h4", "h5", "h6"}:
            heading = True
        last = stretch
        if state == KEEP and heading:
            state = SIDE
        if state == KEEP and b.links and b.linked >= 0.6 * len(b.text) and b.tag not in {"p", "li", "td", "th", "h1", "h2", "blockquote"}:
            state = FRAME
        if state == KEEP and len(b.text) <= 120 and b.tag not in {"h1", "h2", "li", "td", "th", "blockquote"}:
            if b.tag != "p" and (_CRUMB.search(b.text) or _LEGAL.search(b.text)):
                state = FRAME
        out.append((b.text, b.tag, stretch, state, b.linked))
    return out


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Bit rows of the table of common lengths of ``a`` and ``b``: bit j of row i is 0 where the length of the first i lines of a and the
    first j + 1 of b exceeds that of the first j. ``keep``: all rows, else only the last."""
    marks: dict[int, int] = {}
    for j, y in enumerate(b):
        marks[y] = marks.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        u = row & marks.get(x, 0)
        row = ((row + u) | (row - u)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(row: int, m: int) -> np.ndarray:
    """Common lengths with the first 0, 1, ... m lines, from a bit row."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(m // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:m]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _align(a: list[int], b: list[int], start: int, got: set[int]) -> None:
    """Adds the positions of ``a`` (counted from ``start``) in a longest common subsequence with ``b``."""
    if not a or not b:
        return
    if len(a) > 1 and len(a) * len(b) > CELLS:  # two halves of a, each with its part of b: memory of one row
        half = len(a) // 2
        upper = _lengths(_rows(a[:half], b, False)[0], len(b))
        lower = _lengths(_rows(a[half:][::-1], b[::-1], False)[0], len(b))[::-1]
        at = int(np.argmax(upper + lower))
        _align(a[:half], b[:at], start, got)
        _align(a[half:], b[at:], start + half, got)
        return
    rows, i, j = _rows(a, b, True), len(a), len(b)
    while i and j:
        bit = 1 << (j - 1)
        if rows[i] & bit:
            j -= 1
        elif not rows[i - 1] & bit:
            i -= 1
        else:
            got.add(start + i - 1)
            i, j = i - 1, j - 1


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Positions of ``own`` in a longest common subsequence with ``other``, whatever their lengths."""
    start = 0
    while start < min(len(own), len(other)) and own[start] == other[start]:
        start += 1
    end = 0
    while end < min(len(own), len(other)) - start and own[-1 - end] == other[-1 - end]:
        end += 1
    got = set(range(start)) | set(range(len(own) - end, len(own)))
    _align(own[start : len(own) - end], other[start : len(other) - end], start, got)
    return got


#: Share of the lines marked as frame that a neighbour of the same template has.
FRAMED = 0.5
#: Characters of unshared text that the stretch with the title counts for more.
TITLE = 200
_TEXT_TAGS = {"h1", "h2", "p", "li", "td", "th", "dd", "dt", "blockquote", "pre", "body"}


def main_body(parts: list[tuple], neighbours: list[list[int]]) -> list[str]:
    """Distinct block texts of the main body, in reading order.

    Stretches with unshared text are the body, all of them if some neighbour has the page's frame, else the heaviest; shared
    lines are deleted. Exceptions in the heaviest stretch: the title; text between its unshared lines; text at its ends that some neighbour lacks, or,
    with a single neighbour, headings, paragraphs, list items and quotations. Without neighbours, or where nothing is unshared, markup decides.
    """
    own = [mask(p[0]) for p in parts]
    hits: Counter = Counter()
    framed = False  # some neighbour has the page's frame
    marked = {i for i, p in enumerate(parts) if p[3] == FRAME}
    for other in neighbours:
        got = shared_lines(own, list(other))
        framed = framed or len(got & marked) >= FRAMED * max(1, len(marked)) and bool(got)
        hits.update(got)
    weight: Counter = Counter()
    fresh: dict[int, list[int]] = {}
    title = None
    for i, (text, tag, stretch, state, linked) in enumerate(parts):
        if state == KEEP:
            weight[stretch] += (len(text) - linked) * (0.15 if i in hits else 1.0) + (5 if tag in {"p", "td", "li", "blockquote"} else 0)
            if i not in hits:
                fresh.setdefault(stretch, []).append(i)
            if tag == "h1" and title is None:
                title = i
    unshared_side = [p for i, p in enumerate(parts) if i not in hits and p[3] == SIDE]
    if not weight or (neighbours and not fresh and unshared_side):  # everything is marked as frame or side, or shared: only a message may be left
        candidates = unshared_side or [p for p in parts if p[3] == SIDE]
        return list(dict.fromkeys(p[0] for p in candidates))
    if title is not None and (not fresh or not neighbours):
        best = parts[title][2]
    else:
        if title is not None:
            weight[parts[title][2]] += TITLE
        best = max(fresh, key=lambda s: (weight[s], -s)) if fresh else max(weight, key=lambda s: (weight[s], -s))
    chosen = {best, *fresh} if framed else {best}
    body = []
    for i, (text, tag, stretch, state, _) in enumerate(parts):
        if stretch not in chosen or state != KEEP:
            continue
        if i in hits and i != title:
            if stretch != best or (tag not in _TEXT_TAGS and len(text) <= 80):
                continue
            lines = fresh.get(best)
            if lines and not lines[0] < i < lines[-1]:
                if hits[i] == len(neighbours) and (len(neighbours) > 1 or tag not in {"h2", "p", "li", "blockquote"}):
                    continue
        body.append(text)
    return list(dict.fromkeys(body))


_PARTS = "array<struct<text:string,tag:string,stretch:int,state:int,linked:int>>"


def body_of(parts, near) -> list[str]:
    return main_body([(p["text"], p["tag"], p["stretch"], p["state"], p["linked"]) for p in parts], [n for n in near if n is not None])


def differing(pages: DataFrame, pieces: int | None = None) -> DataFrame:
    """(page_id, parts, near): the text blocks of each page and the lines of its neighbours, none, one or two, from both sides.

    Pages with null or blank html have no row. Pages of one host are ordered by URL path. Only lines (numbers), one version for each
    path, are ordered: over ranges of host and path, so a host of any size is spread over tasks, and each range gets the
    ``AROUND`` paths next to it from the ranges beside it. ``pieces``: number of ranges (by default Spark's). Pages without URL form one host.
    """
    url = F.coalesce("final_url", "url", F.lit(""))
    bare = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:www\.)?", "")

    @F.pandas_udf(f"struct<parts:{_PARTS},lines:array<bigint>>")
    def parse(html: pd.Series) -> pd.DataFrame:
        seen: dict[str, list] = {}  # copies of a page in one batch are parsed once
        parts = []
        for x in html:
            if x not in seen:
                seen[x] = layout(x)
            parts.append(seen[x])
        return pd.DataFrame({"parts": parts, "lines": [[mask(p[0]) for p in ps] for ps in parts]})

    @F.pandas_udf("array<array<bigint>>")
    def nearest(own: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        out = []
        for mine, b, a in zip(own, before, after):
            mine, got = Counter(mine), []
            for side in (b, a):
                for x in side:
                    if x is not None and len(x):
                        common = sum((mine & Counter(x)).values())
                        if common < 0.9 * max(len(x), sum(mine.values())):
                            got.append(list(x))
                            break
            out.append(got)
        return pd.Series(out)

    src = pages.where("page_id IS NOT NULL AND html IS NOT NULL AND length(trim(html)) > 0").select(
        "page_id", F.regexp_extract(bare, r"^([^/?#]*)", 1).alias("host"), F.regexp_replace(bare, r"^[^/?#]*|#.*$", "").alias("path"), once(parse)("html").alias("page")
    )
    parsed = cut(src.select("page_id", "host", "path", "page.parts", "page.lines", F.xxhash64("page.lines").alias("h")))
    # versions of a path are many only where the page was fetched many times: neighbours see the one with the smallest hash
    paths = parsed.groupBy("host", "path").agg(F.min_by("lines", "h").alias("lines"))
    ranged = paths.repartitionByRange(pieces, "host", "path") if pieces else paths.repartitionByRange("host", "path")
    ranged = cut(ranged.withColumn("piece", F.spark_partition_id()))
    ends = [Window.partitionBy("host", "piece").orderBy(F.col("path").asc() if step < 0 else F.col("path").desc()) for step in (-1, 1)]
    border = [ranged.withColumn("r", F.row_number().over(w)).where(F.col("r") <= AROUND).drop("r").withColumn("piece", F.col("piece") + step) for w, step in zip(ends, (-1, 1))]
    lined = ranged.withColumn("own", F.lit(True)).unionByName(border[0].unionByName(border[1]).withColumn("own", F.lit(False)))
    w = Window.partitionBy("host", "piece").orderBy("path")
    around = lined.withColumn("before", F.array(*(F.lag("lines", k).over(w) for k in range(1, AROUND + 1)))).withColumn("after", F.array(*(F.lead("lines", k).over(w) for k in range(1, AROUND + 1))))
    near = around.where("own").select("host", "path", once(nearest)("lines", "before", "after").alias("near"))
    return parsed.join(near, ["host", "path"]).select("page_id", "parts", "near")


def main_bodies(pages: DataFrame, pieces: int | None = None) -> DataFrame:
    """(page_id, paragraph): one row per distinct block text of each page's main body.

    Pages with null or blank html have no rows; a page without neighbours of another path (or only copies of itself) is
    judged by its markup alone. Repeated rows of a page have its rows each. See :func:`differing` for hosts of any size.
    """

    @F.pandas_udf("array<string>")
    def body(parts: pd.Series, near: pd.Series) -> pd.Series:
        return pd.Series([body_of(p, n) for p, n in zip(parts, near)])

    return differing(pages, pieces).select("page_id", F.explode(once(body)("parts", "near")).alias("paragraph"))
