"""Template residue, filler, and notices instead of content (problem 7): character n-gram models and likelihood-ratio windows.

The body that page differencing finds (problem 1) is judged. Four interpolated character 5-gram models (natural prose, filler,
notices, placeholders) start from seed texts; notices and prose then learn from the bodies of all pages. Character sequences are
counted where the pages lie; only the distinct ones and their counts come together. Models are scored with numpy: one table of log
ratios for each length of character sequence.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.blocks import squeeze
from placewright.llm.mainbody import body_of, differing, layout, main_body, mask
from placewright.llm.residue_seeds import filler_texts, notice_texts, placeholder_texts, prose_texts
from placewright.llm.triejoin import _spread
from placewright.session import cut, once

ORDER = 5
#: Characters of a body that is first taken for prose, at least.
LONG = 300
#: Mean log likelihood ratio (natural log, for each character) from which a window is residue; share of the body that notices must cover.
FILLER_RATIO, NOTICE_RATIO, PLACEHOLDER_RATIO, COVERAGE = 0.35, 0.12, 0.6, 0.25
#: Ratio from which a block is filler for the seeds alone, which know little prose.
CLEARLY = 1.5
#: Words of a window; longer sentences have windows that overlap by half.
WINDOW = 14
FILLER, NOTICE, HOLDER, NATURAL = 0, 1, 2, 3
#: Characters for which what a class has learnt counts at most, beside its seeds: the counts of more are scaled down to it, all alike, so
#: that bounds on ratios mean the same in tables of any size.
MASS = {NOTICE: 60_000, NATURAL: 1_000_000}
#: Characters that are counted or scored at once.
PORTION = 400_000

_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
_PIECE = re.compile(r"(?<=[.!?。！？])\s+|\s+[|·•\-–]\s+")
_NOSCRIPT = re.compile(r"(?is)<noscript[^>]*>(.*?)</noscript>")
#: Where a placeholder may stand: between the delimiters of template languages and mail merges, in capitals with underscores, in rows of X,
#: or as the printed form of a missing value. Whether it is one, the model says.
_SPAN = re.compile(
    r"\{\{\{?[^{}]+\}?\}\}|\{%[^{}%]+%\}|[$#]\{[^{}]+\}|<%[^<>]+%>|%%[^%\s]+%%|\[\[[^\[\]]+\]\]|<<[^<>]+>>|@@\w+@@|\*\|[^|]+\|\*|__[A-Za-z]\w*?__|«[^«»]+»|"
    r"\$[A-Z][A-Z_]+\$|##?[A-Z][A-Z_]{2,}##?|(?<!\d)%[A-Za-z]\w+%|(?<![\w%])%(?:\d\$)?[sd]\b|\{\d\}|\[object Object\]|\[[^\W\d][^\[\]]+\]|\{[^\W\d][\w.\- ]+\}|<[^\W\d][\w.\- ]+>|"
    r"\b[A-Z]{3,}(?:_[A-Z]+)+\b|\bX{4,}\b|\b(?:YOUR|INSERT|ADD) (?:[A-Z]{3,}\b ?){1,4}|\b[Uu]ndefined (?:index|variable|array key|property)\b|"
    r"(?:(?<=[:,] )|(?<=\bin )|(?<=\bfor )|(?<=\bat )|(?<=^About )|(?<=^Welcome to )|^)(?:(?:undefined|NaN|null)\b|None\b(?!\s[a-z]))"
)
#: One of these is in every text in which the pattern finds something.
_SIGNS = ("{", "<", "[", "$", "#", "%", "_", "@@", "*|", "«", "XXXX", "YOUR ", "INSERT ", "ADD ", "ndefined", "NaN", "null", "None")
_DOMAIN = re.compile(r"\b[\w\-]{8,}(?:\.[\w\-]+){1,4}\b")
_DIGIT = re.compile(r"\d")
_MULT = 0x9E3779B97F4A7C15
_BACK = pow(_MULT, -1, 1 << 64)


def fold(text: str) -> str:
    text = " ".join((text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split())
    return _DIGIT.sub("0", _DOMAIN.sub("example.com", text))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, place within the text, number of the text) of all texts, each between two marks."""
    joined = "".join(f"\2{t}\3" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    return codes, np.arange(len(codes)) - starts[owner], owner


def _ones(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        one = (codes + np.uint64(1)) * np.uint64(_MULT)
    return one ^ one >> np.uint64(29)


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the sequences of 1 to ORDER characters that end at each place."""
    with np.errstate(over="ignore"):
        one = _ones(codes)
        out = [one]
        for _ in range(1, ORDER):
            longer = out[-1].copy()
            longer[1:] = out[-1][:-1] * np.uint64(_MULT) + one[1:]
            out.append(longer)
    return out


def _shortened(n: int, keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sequences of n characters without their last one and without their first one."""
    with np.errstate(over="ignore"):
        first, last = _ones(ends & np.uint64(0x1FFFFF)), _ones(ends >> np.uint64(21) & np.uint64(0x1FFFFF))
        return (keys - last) * np.uint64(_BACK), keys - first * np.uint64(pow(_MULT, n - 1, 1 << 64))


def _portions(texts: list[str]):
    """The texts in lists of about ``PORTION`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 2
        if size >= PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


def _added(keys: np.ndarray, ends: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.zeros(len(found), dtype=np.int64)
    np.add.at(sums, inverse, times)
    return found, ends[first], sums


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the distinct character sequences of folded texts: hashes, ends and how often each occurs. Ends are the length,
    the last and the first character in one number (21 bits for a character)."""
    parts: list[list] = [[] for _ in range(ORDER)]
    for some in _portions(texts):
        codes, place, _ = _codes(some)
        at, times = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for n, h in reversed(list(enumerate(_hashes(codes), 1))):
            # where a longer sequence ends a shorter one does too; besides, those too near the beginning for a longer one
            more = np.flatnonzero(place >= n - 1 if n == ORDER else place == n - 1) if n > 1 else at[:0]
            at, times = np.concatenate([at, more]), np.concatenate([times, np.ones(len(more), dtype=np.int64)])
            keys, first, inverse = np.unique(h[at], return_index=True, return_inverse=True)
            sums = np.zeros(len(keys), dtype=np.int64)
            np.add.at(sums, inverse, times)
            at, times = at[first], sums
            parts[n - 1].append((keys, codes[at - n + 1] | codes[at] << np.uint64(21) | np.uint64(n << 42), sums))
        if len(parts[0]) > 16:
            parts = [[_added(*map(np.concatenate, zip(*p)))] for p in parts]
    none = np.empty(0, dtype=np.uint64)
    return [_added(*map(np.concatenate, zip(*p))) if p else (none, none, none.astype(np.int64)) for p in parts]


class Residue:
    """The fitted models: for each length the hashed character sequences seen and their log ratios (filler, notice, placeholder) to prose.

    ``learnt``: further sequences as :func:`counted`, by class (``NOTICE``, ``NATURAL``), which count for ``MASS`` characters at most.
    """

    def __init__(self, natural: list[str], notices: list[str] | None = None, learnt: dict[int, list] | None = None):
        classes = [filler_texts(), notice_texts() + list(notices or []), placeholder_texts(), prose_texts() + natural]
        known = [(c, counted([fold(t) for t in ts])) for c, ts in enumerate(classes)]
        for c, grams in (learnt or {}).items():
            share = min(1.0, MASS[c] / max(1, grams[0][2].sum()))
            known.append((c, [(keys, ends, times * share) for keys, ends, times in grams]))
        self.keys: list[np.ndarray] = []
        self.ratios: list[np.ndarray] = []
        below = None
        for n in range(1, ORDER + 1):
            keys, first, inverse = np.unique(np.concatenate([g[n - 1][0] for _, g in known]), return_index=True, return_inverse=True)
            ends = np.concatenate([g[n - 1][1] for _, g in known])[first]
            counts = np.zeros((len(keys), 4))
            np.add.at(counts, (inverse, np.repeat([c for c, _ in known], [len(g[n - 1][0]) for _, g in known])), np.concatenate([g[n - 1][2] for _, g in known]))
            if n == 1:
                total, prior = counts.sum(0, keepdims=True), np.full((1, 4), 1 / 300)
            else:
                before, after = _shortened(n, keys, ends)
                prior = below[np.searchsorted(self.keys[-1], after)]
                # how often each context was followed by a character
                context, back = np.unique(before, return_inverse=True)
                seen = np.zeros((len(context), 4))
                np.add.at(seen, back, counts)
                total = seen[back]
            below = (counts + 3.0 * prior) / (total + 3.0)
            below = np.where(total > 0, below, prior)
            ratios = np.log(below[:, :3]) - np.log(below[:, 3:])
            if n > 1:
                # a sequence of less than one count speaks in that proportion, its end without the first character for the rest
                shorter = self.ratios[-1][np.searchsorted(self.keys[-1], after)]
                ratios = shorter + np.minimum(1.0, counts.sum(1))[:, None] * (ratios - shorter)
            self.keys.append(keys)
            self.ratios.append(ratios.astype(np.float32))

    def means(self, texts: list[str]) -> np.ndarray:
        """Mean log ratio for each character of folded texts, a row for each text: filler, notice, placeholder. A sequence that no model has seen counts by its longest seen end."""
        out = [np.zeros((0, 3))]
        for some in _portions(texts):
            codes, place, owner = _codes(some)
            value = np.zeros((len(codes), 3), dtype=np.float32)
            left = np.flatnonzero(place > 0)
            for n, h in reversed(list(enumerate(_hashes(codes)))):
                asked = left[place[left] >= n]
                at = np.minimum(np.searchsorted(self.keys[n], h[asked]), len(self.keys[n]) - 1)
                hit = self.keys[n][at] == h[asked]
                value[asked[hit]] = self.ratios[n][at[hit]]
                left = np.setdiff1d(left, asked[hit], assume_unique=True) if n else left
            sums = np.add.reduceat(value, np.flatnonzero(place == 0), axis=0)
            out.append(sums / np.maximum(1, np.bincount(owner) - 1)[:, None])
        return np.concatenate(out)

    def holds(self, text: str) -> bool:
        """Whether a text holds a placeholder."""
        spans = [fold(m) for m in _spans(text)]
        return bool(spans) and bool((self.means(spans)[:, HOLDER] > PLACEHOLDER_RATIO).any())

    def blocks(self, texts: list[str]) -> list[tuple[bool, float]]:
        """For each text: whether it holds filler or a placeholder; the share of its characters in notice windows."""
        ask: dict[str, int] = {}
        asked = []
        for t in texts:
            holders = [ask.setdefault(fold(m), len(ask)) for m in _spans(t)]
            folded = fold(t)
            filler = [(ask.setdefault(w, len(ask)), len(w)) for w in _windows(folded, _SENTENCE) if len(w) >= 7]
            notice = [(ask.setdefault(w, len(ask)), len(w)) for w in _windows(folded, _PIECE)]
            asked.append((holders, filler, notice))
        means = self.means(list(ask)) if ask else None
        out = []
        for holders, filler, notice in asked:
            left = any(means[i, HOLDER] > PLACEHOLDER_RATIO for i in holders)
            left = left or any(means[i, FILLER] > (FILLER_RATIO if n >= 20 else 2 * FILLER_RATIO) and means[i, FILLER] > means[i, NOTICE] for i, n in filler)
            total = sum(n for _, n in notice)
            out.append((left, sum(n for i, n in notice if means[i, NOTICE] > NOTICE_RATIO) / total if total else 0.0))
        return out

    def pages(self, pages: list[tuple]) -> list[tuple[bool, float]]:
        """For each (visible block texts, one or more bodies): residue anywhere a visitor reads; share of a body that notices cover, at most."""
        texts = list(dict.fromkeys(t for lists in pages for ts in lists for t in ts))
        known = dict(zip(texts, self.blocks(texts)))
        out = []
        for visible, *bodies in pages:
            cover = [sum(len(b) * known[b][1] for b in body) / total for body in bodies if (total := sum(len(b) for b in body))]
            out.append((any(known[t][0] for t in visible), max(cover, default=0.0)))
        return out

    def page(self, html: str) -> tuple[bool, float]:
        """:meth:`pages` of a single page without neighbours."""
        parts = layout(html)
        return self.pages([([p[0] for p in parts], main_body(parts, []) if parts else fallback(html))])[0]


def _spans(text: str) -> list[str]:
    """Where a placeholder may stand, but for those in quotation marks, of which the text speaks."""
    out = []
    if not any(s in text for s in _SIGNS):
        return out
    for m in _SPAN.finditer(text):
        quoted = text.count('"', 0, m.start()) % 2 == 1 or text.count("“", 0, m.start()) > text.count("”", 0, m.start())
        if not quoted and not (m.start() and text[m.start() - 1].isalnum()):
            out.append(m.group())
    return out


def _windows(text: str, at: re.Pattern) -> list[str]:
    out = []
    for s in at.split(text):
        words = s.split()
        if len(words) <= WINDOW:
            out.append(s)
        else:
            out += [" ".join(words[i : i + WINDOW]) for i in range(0, len(words) - WINDOW // 2, WINDOW // 2)]
    return out


def fallback(html: str) -> list[str]:
    """Texts of noscript elements: all there is to read where nothing else is."""
    return [t for t in (squeeze(re.sub(r"<[^>]+>", " ", b)) for b in _NOSCRIPT.findall(html)) if t]


def frames(pages: DataFrame) -> DataFrame:
    """(page_id, status, visible, body, plain): texts of the visible blocks, of the main body that differencing finds and of the one that
    markup alone finds, written once. Where nothing is visible but what the neighbours show too, the texts of noscript elements are the body."""

    @F.pandas_udf("struct<visible:array<string>,body:array<string>,plain:array<string>,bare:boolean>")
    def texts(parts: pd.Series, near: pd.Series) -> pd.DataFrame:
        rows = []
        for ps, around in zip(parts, near):
            around = [n for n in around if n is not None]
            body = body_of(ps, around)
            shared = {int(line) for n in around for line in n}
            rows.append((list(dict.fromkeys(p["text"] for p in ps)), body, body_of(ps, []), bool(around) and all(mask(b) in shared for b in body) or not len(ps)))
        return pd.DataFrame(rows, columns=["visible", "body", "plain", "bare"])

    @F.pandas_udf("array<string>")
    def unscripted(html: pd.Series) -> pd.Series:
        return html.map(fallback)

    src = pages if "status" in pages.columns else pages.withColumn("status", F.lit(None).cast("int"))
    for c in ("url", "final_url"):
        if c not in src.columns:
            src = src.withColumn(c, F.lit(None).cast("string"))
    found = differing(src).select("page_id", once(texts)("parts", "near").alias("t")).select("page_id", "t.*").dropDuplicates(["page_id"])
    # the markup is looked at again only where it may hold a noscript element
    hidden = src.where("page_id IS NOT NULL AND html IS NOT NULL").select("page_id", "status", F.when(F.lower("html").contains("<noscript"), unscripted("html")).alias("unscripted"))
    first = hidden.groupBy("page_id").agg(F.max("status").alias("status"), F.max("unscripted").alias("unscripted"))
    only = F.col("bare") & (F.size(F.coalesce("unscripted", F.array())) > 0)
    return cut(found.join(first, "page_id").select("page_id", "status", "visible", F.when(only, F.col("unscripted")).otherwise(F.col("body")).alias("body"), F.when(only, F.array().cast("array<string>")).otherwise(F.col("plain")).alias("plain")))


def _learnt(blocks: DataFrame, seeds: Broadcast | None = None) -> dict[int, list]:
    """Character sequences of the distinct texts of ``blocks`` (text, notice, natural), each text once for a class, as :func:`counted`.

    With ``seeds``, texts that these alone take for filler or that hold a placeholder do not count.
    """

    def sequences(batches):
        for df in batches:
            for c, name in ((NOTICE, "notice"), (NATURAL, "natural")):
                texts = df.loc[df[name], "text"].tolist()
                folded = [fold(t) for t in texts]
                if seeds is not None:
                    filler = seeds.value.means(folded)[:, FILLER]
                    folded = [f for t, f, r in zip(texts, folded, filler) if r < CLEARLY and not seeds.value.holds(t)]
                for keys, ends, times in counted(folded):
                    yield pd.DataFrame({"c": np.full(len(keys), c, dtype=np.int8), "key": keys.view(np.int64), "ends": ends.view(np.int64), "times": times})

    once_each = _spread(blocks, "text").groupBy("text").agg(F.max("notice").alias("notice"), F.max("natural").alias("natural"))
    grams = once_each.mapInPandas(sequences, "c tinyint, key bigint, ends bigint, times bigint").groupBy("c", "key", "ends").agg(F.sum("times").alias("times")).toArrow()
    c, keys, ends, times = (grams.column(i).to_numpy() for i in range(4))
    keys, ends = keys.astype(np.int64).view(np.uint64), ends.astype(np.int64).view(np.uint64)
    size = ends >> np.uint64(42)
    return {k: [(keys[m], ends[m], times[m]) for m in ((c == k) & (size == n) for n in range(1, ORDER + 1))] for k in (NOTICE, NATURAL)}


def fit(framed: DataFrame, rounds: int = 2) -> Residue:
    """Models from the seeds and the bodies of all pages of ``framed`` (status, body).

    Prose begins with the bodies of at least ``LONG`` characters that came without error, but for blocks that the seeds alone take for
    filler or that hold a placeholder. Each round judges all pages: pages that are notices at least by half teach notices with all their blocks, pages without
    notices and residue teach prose; those between teach nothing. An error status alone decides nothing: such pages may have content.
    What reaches the driver are the distinct sequences of up to ``ORDER`` characters, which grow with the languages of a table and hardly with its pages.
    """
    context = framed.sparkSession.sparkContext
    some = framed.where("size(body) > 0")
    long = some.where((F.coalesce("status", F.lit(0)) < 400) & (F.expr("aggregate(body, 0L, (n, b) -> n + length(b))") >= LONG))
    seeds = context.broadcast(Residue([]))
    model = Residue([], learnt=_learnt(long.select(F.explode("body").alias("text"), F.lit(False).alias("notice"), F.lit(True).alias("natural")), seeds))
    seeds.destroy()
    for _ in range(rounds):
        shared = context.broadcast(model)
        taught = some.select("body", once(_teaches(shared))("body").alias("c")).where(F.col("c") >= 0)
        model = Residue([], learnt=_learnt(taught.select(F.explode("body").alias("text"), (F.col("c") == NOTICE).alias("notice"), (F.col("c") == NATURAL).alias("natural"))))
        shared.destroy()
    return model


def _teaches(shared: Broadcast):
    @F.pandas_udf("int")
    def teaches(body: pd.Series) -> pd.Series:
        judged = shared.value.pages([(b, b) for b in body])
        return pd.Series([-1 if left else NOTICE if cover >= 0.5 else NATURAL if cover < COVERAGE / 2 else -1 for left, cover in judged], dtype="int32")

    return teaches


def score_pages(pages: DataFrame, model: Residue | None = None) -> DataFrame:
    """``page_id, residue, coverage``: residue: filler or an unfilled placeholder stands in what a visitor reads; coverage: share of the main body that is a notice.

    Pages with null or blank html are no cases and have no row. What stands only in markup, comments, scripts or a
    noscript element beside visible text is not read by a visitor and does not count; a noscript element is judged where it
    is all there is. Repeated page ids have one row. The models go to the executors as a broadcast of the distinct character sequences.
    """
    framed = frames(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(framed))

    @F.pandas_udf("residue boolean, coverage double")
    def judge(visible: pd.Series, body: pd.Series, plain: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.pages(list(zip(visible, body, plain))), columns=["residue", "coverage"])

    return framed.select("page_id", once(judge)("visible", "body", "plain").alias("j")).select("page_id", "j.residue", "j.coverage")


def residue_pages(scored: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    return scored.where(F.col("residue") | (F.col("coverage") >= coverage)).select("page_id")
