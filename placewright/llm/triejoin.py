"""Similarity join of strings within shards: tries traversed with Levenshtein automata."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.session import cut

#: Texts of a shard joined in one task; larger shards are cut by segments of their texts, which loses no pair.
BLOCK = 1000
#: Texts of one segment that meet in one task; a segment with more is divided on both sides.
HOT = 20_000
#: Levenshtein distance of near texts, at most.
MOST = 3
#: So few texts are compared by length and letters one by one before the automaton reads those that are left.
FEW = 12


def build_trie(texts: list[str]) -> dict:
    """Nested dictionaries by character; the key "" holds the positions of the texts that end there."""
    root: dict = {}
    for i, t in enumerate(texts):
        node = root
        for ch in t:
            node = node.setdefault(ch, {})
        node.setdefault("", []).append(i)
    return root


def _marks(word: str) -> dict[str, int]:
    marks: dict[str, int] = {}
    for i, ch in enumerate(word):
        marks[ch] = marks.get(ch, 0) | 1 << i
    return marks


def neighbours(trie: dict, word: str, k: int) -> list[tuple[int, int]]:
    """(position, distance) of every text of the trie within ``k`` edits of ``word``; swapping two neighbouring letters is one edit.

    The automaton's state is a bit mask for each number of errors: bit i says that i characters of the word are read. A second
    mask for each number of errors holds the swaps begun: bit i says that character i + 1 came in place of character i. It runs
    down all branches at once and leaves a branch when no state is alive.
    """
    m, marks = len(word), _marks(word)
    end, full = 1 << m, (1 << (m + 1)) - 1
    out: list[tuple[int, int]] = []
    levels = range(1, k + 1)
    stack = [(trie, [(1 << (d + 1)) - 1 for d in range(k + 1)], [0] * (k + 1))]
    while stack:
        node, state, begun = stack.pop()
        for ch, child in node.items():
            if ch == "":
                for d in range(k + 1):
                    if state[d] & end:
                        out += [(i, d) for i in child]
                        break
                continue
            mark = marks.get(ch, 0)
            below = state[0]
            new = (below & mark) << 1
            row, swap = [new], [0]
            ahead = mark >> 1
            for d in levels:
                here = state[d]
                new = ((here & mark) << 1 | below | (below | new) << 1 | (begun[d] & mark) << 2) & full
                row.append(new)
                swap.append(below & ahead)
                below = here
            if row[-1]:
                stack.append((child, row, swap))
    return out


def distance(marks: dict[str, int], m: int, text: str, k: int, swapped: bool = True) -> int:
    """Edits between ``text`` and the word of length ``m`` with these marks, -1 beyond ``k`` (1 to 3): the automaton of :func:`neighbours` on one text.
    Without ``swapped`` a swap is two edits."""
    end, full = 1 << m, (1 << (m + 1)) - 1
    s0, s1, s2, s3, b1, b2, b3 = 1, 3, 7, 15, 0, 0, 0
    top = 1
    for ch in text:
        mark = marks.get(ch, 0)
        ahead = mark >> 1 if swapped else 0
        n0 = (s0 & mark) << 1
        top = n1 = ((s1 & mark) << 1 | s0 | (s0 | n0) << 1 | (b1 & mark) << 2) & full
        if k > 1:
            top = n2 = ((s2 & mark) << 1 | s1 | (s1 | n1) << 1 | (b2 & mark) << 2) & full
            b2 = s1 & ahead
            if k > 2:
                top = s3 = ((s3 & mark) << 1 | s2 | (s2 | n2) << 1 | (b3 & mark) << 2) & full
                b3 = s2 & ahead
            s2 = n2
        b1 = s0 & ahead
        s0, s1 = n0, n1
        if not top:
            return -1
    for d, state in enumerate((s0, s1, s2, s3)[: k + 1]):
        if state & end:
            return d
    return -1


def _bound(n: int) -> int:
    """Edits at which a text of length n can be near another."""
    return 0 if n <= 2 else 1 if n <= 7 else 2 if n <= 17 else 3


def reach(text: str) -> int:
    return _bound(len(text))


def swaps(a: str, b: str) -> int:
    """Edit distance in which swapping two neighbouring letters is one edit."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
    return row[-1]


def near(a: str, b: str, d: int) -> bool:
    """Texts at Levenshtein distance ``d`` are near within one edit up to seven characters (none up to two), two up to seventeen, three beyond; a swap is one edit."""
    limit = min(_bound(len(a)), _bound(len(b)))
    return d <= limit or (d == limit + 1 and swaps(a, b) <= limit)


def reached(a: str, b: str, d: int) -> bool:
    """Whether texts that the automaton found ``d`` edits apart, swaps being one, are :func:`near` and within Levenshtein distance MOST."""
    return d <= min(_bound(len(a)), _bound(len(b))) and (d < 2 or distance(_marks(a), len(a), b, MOST, False) >= 0)


_PAIRS = "array<struct<a:string,b:string,d:int>>"


def _join_lists(texts: list[str]) -> list[tuple[str, str, int]]:
    """(a, b, distance), a < b, of near texts of a sorted list; few texts meet by letters before they enter a trie."""
    if len(texts) <= FEW:
        held = lettered(texts)
        return [x for i, (q, n, mask) in enumerate(held) for x in meet_few(held[i + 1 :], q, n, mask)]
    return _meet(texts, texts, True)


@lru_cache(100_000)
def _letters(t: str) -> int:
    """Bits of the letters that occur at least once and at least twice. An edit changes at most two bits."""
    once_, twice = 0, 0
    for ch in t:
        bit = 1 << (ord(ch) & 31)
        twice |= once_ & bit
        once_ |= bit
    return once_ | twice << 32


def lettered(texts: list[str]) -> list[tuple[str, int, int]]:
    """(text, length, letters) for :func:`meet_few`."""
    return [(t, len(t), _letters(t)) for t in texts]


def meet_few(held: list[tuple[str, int, int]], q: str, n: int, mask: int) -> list[tuple[str, str, int]]:
    """(q, text, distance) of the texts of ``held`` that are near ``q`` and differ from it; length and letters leave few to the automaton."""
    k = _bound(n)
    some = [t for t, m, letters in held if -k <= m - n <= k and (mask ^ letters).bit_count() <= 2 * k and t != q] if k else []
    return _near_of(some, q, k) if some else []


def _near_of(some: list[str], q: str, k: int) -> list[tuple[str, str, int]]:
    """(q, text, distance) of those of ``some`` that are near ``q``: few are read one by one, more are a trie."""
    if len(some) > FEW:
        return [(q, some[i], d) for i, d in neighbours(build_trie(some), q, k) if reached(q, some[i], d)]
    marks, n = _marks(q), len(q)
    return [(q, t, d) for t in some if (d := distance(marks, n, t, k)) >= 0 and reached(q, t, d)]


def _meet(texts: list[str], queries: list[str], later: bool = False) -> list[tuple[str, str, int]]:
    """(query, text, distance) of near, differing texts of one segment (``later``: of texts after the query); texts whose letters differ too much are not read by a query's automaton."""
    out = []
    held = lettered(texts)
    if len(texts) <= FEW:
        return [x for q in queries for x in meet_few(held, q, len(q), _letters(q))]
    masks, sizes = np.array([x[2] for x in held], dtype=np.uint64), np.array([x[1] for x in held])
    for q in queries:
        n, mask, k = len(q), _letters(q), _bound(len(q))
        at = np.flatnonzero((np.abs(sizes - n) <= k) & (np.bitwise_count(masks ^ np.uint64(mask)) <= 2 * k))
        some = [texts[i] for i in at.tolist() if (texts[i] > q if later else texts[i] != q)]
        if some:
            out += _near_of(some, q, k)
    return out


#: Pairs that the automaton reads at once as arrays, at most and at least.
_AT_ONCE, _FEW = 200_000, 200


class _Texts:
    """Texts as arrays: letters, sizes, and bits of what occurs in them."""

    def __init__(self, texts: list[str]):
        one = np.uint64(1)
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.codes = np.array(texts, dtype="U").view(np.uint32).reshape(len(texts), -1).astype(np.uint64)
        some, twice, self.doubles = (np.zeros(len(texts), dtype=np.uint64) for _ in range(3))
        before = None
        for j, code in enumerate(self.codes.T):
            inside = self.sizes > j
            bit = np.where(inside, one << (code & np.uint64(31)), np.uint64(0))
            twice |= some & bit
            some |= bit
            if before is not None:
                self.doubles |= np.where(inside, one << (before * np.uint64(37) + code & np.uint64(63)), np.uint64(0))
            before = code
        #: as :func:`_letters`: an edit changes at most two bits. doubles: of the pairs of neighbouring letters replacing a letter changes at most four, a swap six, any other edit three.
        self.letters = some | twice << np.uint64(32)


#: Bits of doubles in which near texts of at most so many edits can differ: one edit may be a swap; more are at most MOST of Levenshtein's.
_DOUBLES = (0, 6, 4 * MOST, 4 * MOST)


def _alive(marks: np.ndarray, words: np.ndarray, of: np.ndarray, size: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """Which pairs the automaton of :func:`neighbours` accepts: pair i is of word ``of[i]`` (its marks by letter, its length) and a text of ``size[i]`` letters, row i of ``codes``; sizes ascend.
    Letters alike in seven bits are one here, which accepts more pairs, not fewer."""
    n = len(size)
    one = np.uint64(1)
    end = one << words[of]
    full = (end << one) - one
    state = [np.full(n, (1 << (d + 1)) - 1, dtype=np.uint64) for d in range(k + 1)]
    begun = [np.zeros(n, dtype=np.uint64) for _ in range(k + 1)]
    out = np.zeros(n, dtype=bool)
    for j in range(int(size[-1]) if n else 0):
        at = int(np.searchsorted(size, j, side="right"))  # the pairs whose text goes on
        mark = marks[of[at:], codes[at:, j] & np.uint64(127)]
        ahead = mark >> one
        below = state[0][at:].copy()
        new = (below & mark) << one
        state[0][at:] = new
        for d in range(1, k + 1):
            here = state[d][at:].copy()
            new = ((here & mark) << one | below | (below | new) << one | (begun[d][at:] & mark) << np.uint64(2)) & full[at:]
            state[d][at:] = new
            begun[d][at:] = below & ahead
            below = here
        to = int(np.searchsorted(size, j + 1, side="right"))
        out[at:to] = (state[k][at:to] & end[at:to]) != 0
    return out


def meet_whole(texts: list[str], queries: list[str]):
    """Yields (query, text, distance) of near, differing texts of a shard that is held at once. Lengths, letters and pairs of letters leave few
    texts to a query; the automaton reads them all at once as arrays, and those it accepts once more for their distances."""
    if len(texts) * len(queries) <= _FEW:
        few = lettered(texts)
        for q in queries:
            yield from meet_few(few, q, len(q), _letters(q))
        return
    texts = sorted(texts, key=len)
    held, asked = _Texts(texts), _Texts(queries)
    longest = len(texts[-1])
    starts = np.searchsorted(held.sizes, np.arange(longest + 2))  # of each length
    waiting: list[tuple[int, np.ndarray]] = []

    def met():
        for k in (1, 2, 3):
            some = [(i, at) for i, at in waiting if _bound(len(queries[i])) == k and len(queries[i]) < 62]
            kept = {i: at for i, at in waiting if _bound(len(queries[i])) == k and len(queries[i]) >= 62}
            if pairs < _FEW:
                kept |= dict(some)
            elif some:
                table = np.zeros((len(some), 128), dtype=np.uint64)
                for row, (i, _) in zip(table, some):
                    for ch, bits in _marks(queries[i]).items():
                        row[ord(ch) & 127] |= np.uint64(bits)
                of = np.repeat(np.arange(len(some)), [len(at) for _, at in some])
                at = np.concatenate([at for _, at in some])
                order = np.argsort(held.sizes[at], kind="stable")
                of, at = of[order], at[order]
                words = np.fromiter((len(queries[i]) for i, _ in some), dtype=np.uint64, count=len(some))
                yes = _alive(table, words, of, held.sizes[at], held.codes[at], k)
                for x, y in zip(of[yes].tolist(), at[yes].tolist()):
                    kept.setdefault(some[x][0], []).append(y)
            for i, near_ in kept.items():
                q = queries[i]
                yield from _near_of([texts[x] for x in near_ if texts[x] != q], q, k)
        waiting.clear()

    pairs = 0
    for i, q in enumerate(queries):
        n, k = len(q), _bound(len(q))
        if not k:
            continue
        low, high = (int(starts[min(max(x, 0), longest + 1)]) for x in (n - k, n + k + 1))
        at = low + np.flatnonzero(np.bitwise_count(held.letters[low:high] ^ asked.letters[i]) <= 2 * k)
        at = at[np.bitwise_count(held.doubles[at] ^ asked.doubles[i]) <= _DOUBLES[k]]
        if at.size:
            waiting.append((i, at))
            pairs += at.size
        if pairs > _AT_ONCE:
            yield from met()
            pairs = 0
    yield from met()


def _segments(n: int) -> list[tuple[int, int]]:
    """(start, length) of the MOST + 1 segments of a text of length n."""
    parts, base, extra = [], n // (MOST + 1), n % (MOST + 1)
    start = 0
    for i in range(MOST + 1):
        size = base + (1 if i >= MOST + 1 - extra else 0)
        parts.append((start, size))
        start += size
    return parts


def _key(shard: str, n: int, i: int, piece: str) -> int:
    return xxhash.xxh64_intdigest(f"{n}|{i}|{piece}|{shard}") - (1 << 63)


def _index_keys(shard: str, t: str) -> list[int]:
    return [_key(shard, len(t), i, t[s : s + n]) for i, (s, n) in enumerate(_segments(len(t)))]


def _query_keys(shard: str, t: str, longer: bool) -> list[int]:
    """Keys under which texts within distance MOST lie, of no greater length or (``longer``) of any.

    Of segment i only places are looked up at which the text left of it can have at most i errors and the text right of it at
    most MOST - i: with more errors on one side, a segment of the other side is free of errors.
    """
    keys: set[int] = set()
    for n in range(max(1, len(t) - MOST), len(t) + 1 + (MOST if longer else 0)):
        more = len(t) - n
        for i, (s, size) in enumerate(_segments(n)):
            left = max(0, s - i, s + more - (MOST - i))
            for p in range(left, min(len(t) - size, s + i, s + more + (MOST - i)) + 1):
                keys.add(_key(shard, n, i, t[p : p + size]))
    return list(keys)


def _spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` over as many tasks as the session shuffles to: adaptive execution merges small partitions by bytes, not by work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def _segment_join(held: DataFrame, asked: DataFrame, longer: bool) -> DataFrame:
    """(shard, q, t, d): differing texts of ``held`` (shard, text, texts of the shard) near to a text of ``asked`` (the same columns), both distinct.

    Two texts within Levenshtein distance 3 agree in one of four segments. Each segment is a trie of its own, of at most ``HOT``
    texts on either side: segments of more (only shards of more can have such) are divided on both sides and every part meets every part.
    """

    @F.pandas_udf("array<bigint>")
    def index_keys(shards: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_index_keys(s, t) for s, t in zip(shards, texts)])

    @F.pandas_udf("array<bigint>")
    def query_keys(shards: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_query_keys(s, t, longer) for s, t in zip(shards, texts)])

    @F.pandas_udf("array<struct<q:string,t:string,d:int>>")
    def meet(texts: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series([_meet(list(a), list(b)) for a, b in zip(texts, queries)])

    left = held.select("shard", "texts", "text", F.explode(index_keys("shard", "text")).alias("key"))
    right = asked.select("shard", "texts", "text", F.explode(query_keys("shard", "text")).alias("key"))

    def parts(df: DataFrame) -> DataFrame:
        hot = df.where(F.col("texts") > HOT).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
        return cut(hot.select("key", F.ceil(F.col("n") / HOT).alias("parts")))

    def sides(df: DataFrame, mine: DataFrame, others: DataFrame, own: str, other: str) -> DataFrame:
        one = F.lit(1).cast("bigint")
        df = df.join(mine.withColumnRenamed("parts", "own"), "key", "left").join(others.withColumnRenamed("parts", "other"), "key", "left")
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("other", one) - 1))
        return df.select("shard", "text", "key", F.pmod(F.xxhash64("text"), F.coalesce("own", one)).alias(own), every.alias(other))

    big = held.where(F.col("texts") > HOT).select("shard").limit(1).count() > 0  # a yes or no
    if big:
        hl, hr = parts(left), parts(right)
        left, right, by = sides(left, hl, hr, "x", "y"), sides(right, hr, hl, "y", "x"), ["key", "x", "y"]
    else:
        by = ["key"]
    # most keys have few texts: lists begun before the shuffle would only be sorted and sent as lists of one
    left, right = _spread(left.select("shard", "text", *by), *by), _spread(right.select("text", *by), *by)
    # a key holds its shard, so the first is every one's
    left = left.groupBy(*by).agg(F.first("shard").alias("shard"), F.collect_list("text").alias("ts"))
    right = right.groupBy(*by).agg(F.collect_list("text").alias("qs"))
    found = left.join(right, by).select("shard", F.explode(meet("ts", "qs")).alias("p"))
    return found.select("shard", "p.q", "p.t", "p.d").distinct()


def trie_join(entries: DataFrame, block: int = BLOCK, written: bool = False) -> DataFrame:
    """``entries``: (shard, text) -> (shard, a, b, distance), a < b: texts of one shard that are :func:`near` each other.

    Null or empty texts and null shards do not take part; repeated entries count once. A shard of at most ``block``
    texts is one trie. Texts of larger shards go by the segments in which two texts within Levenshtein distance 3 must agree (four
    segments, so one is free of errors), and each segment gets a trie of its own: no task holds a hot shard and no pair is lost.
    ``written``: the entries are a result of :func:`cut` and distinct already.
    """
    texts = entries.where("shard IS NOT NULL AND text IS NOT NULL AND text <> ''").select("shard", "text")
    texts = texts if written else cut(texts.distinct())
    sizes = texts.groupBy("shard").agg(F.count("*").alias("texts")).where("texts > 1")

    @F.pandas_udf(_PAIRS)
    def within(lists: pd.Series) -> pd.Series:
        return pd.Series([_join_lists(sorted(ts)) for ts in lists])

    sized = texts.join(sizes, "shard")
    small = _spread(sized.where(F.col("texts") <= block), "shard").groupBy("shard").agg(F.collect_list("text").alias("ts")).select("shard", F.explode(within("ts")).alias("p")).select("shard", "p.a", "p.b", F.col("p.d").alias("distance"))
    if not sizes.where(F.col("texts") > block).limit(1).count():  # a yes or no
        return small
    large = cut(sized.where(F.col("texts") > block))
    found = _segment_join(large, large, longer=False)
    return small.unionByName(found.select("shard", F.least("q", "t").alias("a"), F.greatest("q", "t").alias("b"), F.col("d").alias("distance")).distinct())


def trie_search(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(shard, query, text, distance): texts of ``entries`` (shard, text) equal or :func:`near` to a text of ``queries`` (shard, text), by segments only."""
    asked = cut(queries.where("text <> ''").distinct())
    held = entries.where("text <> ''").join(asked.select("shard").distinct(), "shard", "left_semi").distinct()
    sizes = held.groupBy("shard").agg(F.count("*").alias("texts"))
    held = cut(held.join(sizes, "shard"))
    same = held.join(asked, ["shard", "text"]).select("shard", F.col("text").alias("query"), "text", F.lit(0).alias("distance"))
    counted = asked.withColumn("texts", F.lit(HOT + 1))
    return same.unionByName(_segment_join(held, counted, longer=True).select("shard", F.col("q").alias("query"), F.col("t").alias("text"), F.col("d").alias("distance")))


def canonical_of(counted: dict[str, int]) -> dict[str, str]:
    """:func:`canonical_spellings` of the texts of one shard that is held at once."""
    first = {t: t for t in counted}
    best: dict[str, tuple[int, str]] = {}
    texts = sorted(t for t in counted if t)
    for a, b, _ in _join_lists(texts) if len(texts) > 1 else ():
        for t, o in ((a, b), (b, a)):
            rank = (-counted[o], o)
            if t not in best or rank < best[t]:
                best[t] = rank
    for t, rank in best.items():
        if rank < (-counted[t], t):
            first[t] = rank[1]
    return {t: first[f] for t, f in first.items()}


def canonical_spellings(counted: DataFrame) -> DataFrame:
    """``counted``: (shard, text, n) -> (shard, text, canon): each spelling goes to the most frequent spelling near it that is at
    least as frequent as itself (ties: the smaller text), and on from there once more. Longer chains of near spellings do not melt together."""
    counted = cut(counted.groupBy("shard", "text").agg(F.sum("n").alias("n")))
    found = cut(trie_join(counted, written=True))
    both = found.select("shard", F.col("a").alias("text"), F.col("b").alias("other")).unionByName(found.select("shard", F.col("b").alias("text"), F.col("a").alias("other")))
    n = counted.where("shard IS NOT NULL AND text IS NOT NULL")
    rated = both.join(n.select("shard", F.col("text").alias("other"), F.col("n").alias("of_other")), ["shard", "other"])
    best = rated.groupBy("shard", "text").agg(F.min(F.struct((-F.col("of_other")).alias("neg"), "other")).alias("m"))
    more = (-F.col("m.neg") > F.col("n")) | ((-F.col("m.neg") == F.col("n")) & (F.col("m.other") < F.col("text")))
    once_ = n.join(best, ["shard", "text"], "left").select("shard", "text", F.when(more, F.col("m.other")).otherwise(F.col("text")).alias("first"))
    again = once_.select("shard", F.col("text").alias("first"), F.col("first").alias("canon"))
    return once_.join(again, ["shard", "first"]).select("shard", "text", "canon")
