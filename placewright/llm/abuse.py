"""Scores for abusive, hateful or sexual content (problem 10): FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm.abuse_seeds import training_sentences, vocabulary
from placewright.session import once

BITS = 18
#: Labelled seed sentences; documents whose passages are learnt from besides, at most, and passages of each of them, at most.
SEEDS, SAMPLE, PASSAGES = 16_000, 2_000, 200
#: For each round of learning from the sample: scores up to which a passage is learnt as ordinary, and from which as a case.
SURE = ((0.5, 0.9), (0.6, 0.8))
THRESHOLD = 0.5
#: Words of a passage; longer sentences are scored in passages of this length that overlap by half.
PASSAGE = 40

#: Digits and signs written for letters; Cyrillic and Greek letters that look like Latin ones.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "|": "l"})
_LOOKS = str.maketrans("аеорсухікѕԁјԛһոαοερνκιτ", "aeopcyxiksdjqhnaoepvkit")
_SPELT = re.compile(r"(?<![^\W_])(?:[^\W_][ \-.*_·]{1,2}){2,}[^\W_](?![^\W_])")
_MIXED = re.compile(r"(?<![\w@$!|])(?=[\w@$!|]*[a-z])(?=[\w@$!|]*[\d@$!|])[a-z\d_@$|]+(?:[!][a-z\d_@$|]+)*(?![^\W\d_])")
_STARRED = re.compile(r"(?<![\w*])[^\W\d_]+[*#]+[^\W\d_]*(?:[*#]+[^\W\d_]+)*(?![\w*])")
_SCRIPTS = re.compile(r"[^\W\d_]+")
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")
_SIGNED = re.compile(r"[a-z][\d@$!|]|[\d@$!|][a-z]")
_LATIN = re.compile(r"[a-z]")
_CUT = re.compile(r"[.!?。！？;\n]+(?=\s|$)|[。！？\n]+")
_WORD = re.compile(r"[぀-ヿ一-鿿]|[^\W_぀-ヿ一-鿿]+")


@lru_cache(100_000)
def _squash(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


@lru_cache(10_000)
def _unstarred(word: str) -> str:
    """A word with letters starred out, if it exactly fits a word of the seeds; of several the first in the alphabet."""
    pattern = re.compile("".join(c if c not in "*#" else "." for c in word))
    return min((w for w in vocabulary() if pattern.fullmatch(w)), default=word)


def plain(text: str) -> str:
    """Lower case without accents and disguise: broken encoding, look-alike letters, invisible characters, digits for letters, spelt-out and starred words."""
    if not text.isascii():
        if "Ã" in text or "Â" in text or "Ð" in text:
            for code in ("cp1252", "latin-1"):
                try:
                    text = text.encode(code).decode("utf-8")
                    break
                except UnicodeError:
                    pass
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().replace("’", "'")
        text = _SCRIPTS.sub(lambda m: m.group().translate(_LOOKS) if not m.group().isascii() and _LATIN.search(m.group()) else m.group(), text)
    else:
        text = text.lower()
    text = _SPELT.sub(lambda m: re.sub(r"[\W_]", "", m.group()), text)
    if "*" in text or "#" in text:
        text = _STARRED.sub(lambda m: _unstarred(m.group()), text)
    if _SIGNED.search(text):
        text = _MIXED.sub(lambda m: m.group().translate(_LEET) if not m.group()[0].isdigit() or m.group()[-1].isalpha() and sum(c.isdigit() for c in m.group()) <= 0.7 * len(m.group()) else m.group(), text)
    return text


def passages(text: str) -> list[str]:
    """Sentences of a text; very long ones in overlapping windows, so that one sentence in a long text decides."""
    out = []
    for s in _CUT.split(plain(text)):
        words = _WORD.findall(s)
        if not words:
            continue
        if len(words) <= PASSAGE:
            out.append(s)
        else:
            out += [" ".join(words[i : i + PASSAGE]) for i in range(0, len(words) - PASSAGE // 2, PASSAGE // 2)]
    return out


@lru_cache(200_000)
def _token(word: str) -> int:
    w = "#" if word.isdigit() else _squash(word)
    return crc32(w.encode("utf-8", "replace")) | crc32(b"+" + w.encode("utf-8", "replace")) << 32


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def features(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature, number of the passage): unigrams, bigrams, trigrams and skip-grams (one or two words left out) of words.

    A word is hashed once; longer features are sums of the hashes of their words, each multiplied by a number for its place.
    """
    rows = [[_token(w) for w in _WORD.findall(p.replace("-", "") if "-" in p else p)] for p in batch]
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    words = np.array([h for r in rows for h in r], dtype=np.uint64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    found, of = [], []
    with np.errstate(over="ignore"):
        for places in ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3)):
            n = len(words) - places[-1]
            if n <= 0:
                continue
            at = np.flatnonzero(owner[:n] == owner[places[-1] : places[-1] + n])
            mixed = np.full(len(at), np.uint64(len(places)))
            for p in places:
                mixed = mixed * _ODD[3] + words[at + p] * _ODD[p % 3] + np.uint64(p)
                mixed ^= mixed >> np.uint64(31)
            found.append((mixed * _ODD[0]) >> np.uint64(64 - BITS))
            of.append(owner[at])
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(of)


class Ftrl:
    """FTRL-proximal with per-coordinate learning rates, in small batches; L1 leaves most weights at zero. The last coordinate is the constant."""

    def __init__(self, alpha: float = 0.4, beta: float = 1.0, l1: float = 0.3, l2: float = 0.3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, xs: np.ndarray, of: np.ndarray, ys: np.ndarray) -> None:
        """A batch: features, the number of the example of each, labels of the examples."""
        xs, of = np.concatenate([xs, np.full(len(ys), 1 << BITS)]), np.concatenate([of, np.arange(len(ys))])
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(ys))))
        coords, back = np.unique(xs, return_inverse=True)
        w = self.at(coords)
        margin = np.clip(np.bincount(of, weights=w[back], minlength=len(ys)) * scale, -30, 30)
        error = (1 / (1 + np.exp(-margin)) - ys) * scale
        g = np.bincount(back, weights=error[of], minlength=len(coords))
        n = self.n[coords]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[coords] += g - sigma * w
        self.n[coords] = n + g * g

    def weights(self) -> np.ndarray:
        return self.at(np.arange((1 << BITS) + 1)).astype(np.float32)


def train(examples: list[tuple[str, int]], rounds: int = 3, batch: int = 4) -> np.ndarray:
    """Weights from labelled passages in plain spelling: one for each hashed feature (most are zero) and the constant."""
    model = Ftrl()
    ready = []
    for i in range(0, len(examples), batch):
        some = examples[i : i + batch]
        ready.append((*features([s for s, _ in some]), np.array([y for _, y in some], dtype=float)))
    for _ in range(rounds):
        for xs, of, ys in ready:
            model.update(xs, of, ys)
    return model.weights()


def scores(weights: np.ndarray, batch: list[str]) -> np.ndarray:
    xs, of = features(batch)
    n = np.bincount(of, minlength=len(batch))
    margin = (weights[-1] + np.bincount(of, weights=weights[xs], minlength=len(batch))) / np.sqrt(n + 1)
    return np.where(n > 0, 1 / (1 + np.exp(-np.clip(margin, -30, 30))), 0.0)


def score(weights: np.ndarray, passage: str) -> float:
    return float(scores(weights, [passage])[0])


def learn(texts: list[str], seeds: int = SEEDS, each: int = PASSAGES) -> np.ndarray:
    """Weights from seed sentences and from passages of ``texts`` of which the model so far is sure, either way.

    The texts carry no labels: each round learns passages scored up to its lower bound of SURE as ordinary, and those from the
    upper one as cases. The seed model knows little ordinary text, so the second round is surer than the first.
    """
    labelled = [(plain(s), y) for s, y in training_sentences(seeds)]
    some = list(dict.fromkeys(p for t in texts for p in passages(t)[:each]))
    weights = train(labelled)
    for low, high in SURE if some else ():
        more = [(p, int(s >= high)) for p, s in zip(some, scores(weights, some)) if s <= low or s >= high]
        step = max(1, -(-len(more) // max(1, len(labelled))))
        merged: list[tuple[str, int]] = []
        for i, e in enumerate(labelled):
            merged.append(e)
            merged += more[i * step : (i + 1) * step]
        weights = train(merged)
    return weights


def fit(documents: DataFrame, seeds: int = SEEDS, sample: int = SAMPLE) -> np.ndarray:
    """Weights from ``seeds`` labelled seed sentences and passages of at most ``sample`` documents, read whole.

    The sample are the documents whose hashed id is smallest: the same for any partitioning. Everything learnt from is
    bounded by these two parameters and ``PASSAGES`` passages a document.
    """
    first = documents.where("text IS NOT NULL").select(F.xxhash64("doc_id").alias("h"), "text").orderBy("h", "text").limit(sample).collect()
    return learn([r.text for r in first], seeds)


def score_documents(documents: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``doc_id, source, score, passage``: the score (0 to 1) of the worst passage of each document, and that passage in plain spelling.

    Null, empty and wordless texts score 0 and have no passage. Whole texts are read. The weights go to the executors as
    a broadcast: an array of 2^18 numbers.
    """
    spark: SparkSession = documents.sparkSession
    model = spark.sparkContext.broadcast(fit(documents) if weights is None else weights)

    @F.pandas_udf("score double, passage string")
    def worst(texts: pd.Series) -> pd.DataFrame:
        known: dict[str, int] = {}
        of = [[known.setdefault(p, len(known)) for p in passages(t)] if t else [] for t in texts]
        every = list(known)
        marks = np.concatenate([scores(model.value, every[i : i + 20_000]) for i in range(0, len(every), 20_000)]) if every else []
        rows = []
        for mine in of:
            best = max(mine, key=lambda i: marks[i], default=None)
            rows.append((0.0, None) if best is None or not marks[best] else (float(marks[best]), every[best].strip()))
        return pd.DataFrame(rows, columns=["score", "passage"])

    return documents.select("doc_id", "source", once(worst)("text").alias("w")).select("doc_id", "source", "w.score", "w.passage")


def flagged(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.where(F.col("score") >= threshold).select("doc_id")


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per source (null is a source of its own): documents, flagged documents, their rate, the mean score."""
    hit = (F.col("score") >= threshold).cast("long")
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum(hit).alias("flagged"), F.avg(hit.cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
