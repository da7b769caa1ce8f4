"""Encoding of texts with a public byte-level BPE vocabulary (problem 8).

The merges are compiled once into a deterministic automaton over tokens. Compilation adds one gadget for each merge, in
order of rank: the gadget of (u, v) -> w adds the state w and its arc, and forbids v directly after u wherever the merge
would have fired first. A sequence of tokens is the BPE encoding of its bytes if and only if every arc of it is
allowed, so an encoder only follows the byte trie and the arcs: no merge loop runs over a text.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.session import once

#: Where the public vocabularies lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the published pre-split pattern of the byte-level vocabularies, with \s written out as Unicode White_Space.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Encodings of words kept by a worker; beyond it the memory is emptied and filled again.
WORDS = 200_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the vocabulary file for the 256 bytes: printable Latin-1 stands for itself."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Deterministic tokenization automaton. State: the token emitted last (-1 at the start)."""

    def __init__(self, base: list[tuple[int, int]], merges: list[tuple[int, int, int]]):
        """base: (byte, id); merges: (left id, right id, merged id) in order of rank."""
        self.text: dict[int, bytes] = {}
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node; node 0 is the root
        self.ends: list[int] = [-1]  # node -> id of the token that ends there
        self.gadget: dict[tuple[int, int], int] = {}  # (u, v) -> rank at which v after u is taken away
        self.first: dict[int, tuple] = {}  # token -> its tokens at the left edge and the rank at which each is absorbed
        self.last: dict[int, tuple] = {}  # the same at the right edge
        never = len(merges)
        for b, i in base:
            self._state(i, bytes([b]))
            self.first[i] = self.last[i] = ((i, never),)
        for rank, (u, v, w) in enumerate(merges):
            self._state(w, self.text[u] + self.text[v])
            self.gadget[u, v] = rank
            self.first[w] = ((w, never), (u, rank), *self.first[u][1:])
            self.last[w] = ((w, never), (v, rank), *self.last[v][1:])
        self.arcs: dict[tuple[int, int], bool] = {}  # rows of the transition table that were used so far
        self.words: dict[str, tuple[int, ...]] = {}

    def _state(self, i: int, text: bytes) -> None:
        self.text[i] = text
        node = 0
        for b in text:
            nxt = self.trie.get(node << 8 | b)
            if nxt is None:
                nxt = self.trie[node << 8 | b] = len(self.ends)
                self.ends.append(-1)
            node = nxt
        if self.ends[node] < 0:
            self.ends[node] = i

    def __getstate__(self):
        return self.__dict__ | {"arcs": {}, "words": {}}

    def allowed(self, t: int, x: int) -> bool:
        """Whether the arc x leaves state t: no gadget inside fires before both its tokens are absorbed."""
        key = (t, x)
        known = self.arcs.get(key)
        if known is None:
            known = True
            for u, gone in self.last[t]:
                for v, taken in self.first[x]:
                    k = self.gadget.get((u, v))
                    if k is not None and k < gone and k <= taken:
                        known = False
                        break
                if not known:
                    break
            if len(self.arcs) > 2_000_000:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def encode_word(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-split word: states reached at every byte, then the arc labels along the only accepted path."""
        n, trie, ends, text = len(data), self.trie, self.ends, self.text
        state = [-1] * (n + 1)
        for i in range(n):
            before = state[i]
            if i and before < 0:
                continue
            node, e = 0, i
            while e < n:
                node = trie.get(node << 8 | data[e])
                if node is None:
                    break
                e += 1
                x = ends[node]
                if x >= 0 and state[e] < 0 and (not i or self.allowed(before, x)):
                    state[e] = x
        out, e = [], n
        while e:
            out.append(state[e])
            e -= len(text[state[e]])
        return tuple(out[::-1])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words = self.words
        for m in _split().finditer(text):
            w = m.group()
            ids = words.get(w)
            if ids is None:
                ids = self.encode_word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    if len(words) >= WORDS:
                        words.clear()
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(self.text[i] for i in ids).decode("utf-8", "replace")


@lru_cache(1)
def _split():
    return regex.compile(PATTERN)


@lru_cache(4)
def compile_automaton(path: str) -> Automaton:
    """From a vocabulary file with ``vocab`` and ordered ``merges`` (JSON)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, alphabet = model["vocab"], _byte_alphabet()
    base = [(b, vocab[ch]) for ch, b in alphabet.items() if ch in vocab]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Automaton(base, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])


def _shared(spark: SparkSession, directory: str, name: str):
    """The compiled automaton on every executor. Its size is that of the vocabulary (some 10 MB for 50,000 merges), whatever the corpus."""
    return spark.sparkContext.broadcast(compile_automaton(f"{directory}/{name}.json"))


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", directory: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``df`` with the token ids of ``text`` in column ``out``: whole texts, no special tokens.

    Null, like empty text, has the empty list. The strings of special tokens are ordinary text. No shuffle; one text
    is one row, however long.
    """
    auto = _shared(df.sparkSession, directory, name)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        enc = auto.value.encode
        return pd.Series([enc(t) if t else [] for t in texts])

    return df.withColumn(out, once(ids)(text))


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", directory: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``df`` with the number of tokens of ``text`` (0 for null and empty) in column ``out``."""
    auto = _shared(df.sparkSession, directory, name)

    @F.pandas_udf("bigint")
    def size(texts: pd.Series) -> pd.Series:
        enc = auto.value.encode
        return pd.Series([len(enc(t)) if t else 0 for t in texts], dtype="int64")

    return df.withColumn(out, once(size)(text))


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "text", directory: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``df`` with the text of ``ids`` in column ``out``; null ids are null."""
    auto = _shared(df.sparkSession, directory, name)

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else auto.value.decode(r) for r in rows], dtype=object)

    return df.withColumn(out, text(ids))
