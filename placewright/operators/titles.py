"""People named with a title in running text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Titles and how senior they are.
RANK = {
    "owner": 100, "franchise owner": 100, "proprietor": 95, "founder": 95, "co-owner": 90, "co-founder": 90, "ceo": 85, "president": 80, "managing partner": 75, "principal": 70, "practice owner": 95, "partner": 60, "director": 60, "general manager": 50,
    "store manager": 45, "office manager": 40, "manager": 40, "dds": 60, "dmd": 60, "md": 60, "dvm": 60, "dc": 60,
}
_TITLE = "|".join(sorted((re.escape(t) for t in RANK), key=len, reverse=True))
_WORD = r"[A-ZÀ-Þ][\w'’\-À-ÿ]+|[A-Z]\."
_NAME = rf"(?P<name>(?:{_WORD})(?:\s+(?:{_WORD}|de|la|van|von|del|di)){{1,3}})"
_SHAPES = [
    (re.compile(rf"{_NAME}\s*(?:,|\(|–|-|:)\s*(?:the |our )?(?i:(?P<title>{_TITLE}))\b"), False),
    (re.compile(rf"\b(?i:(?P<title>{_TITLE}))\b\s*(?:,|:|–|-|is)?\s*(?:Dr\.?\s+)?{_NAME}"), False),
    (re.compile(rf"\b(?i:(?:founded|owned|owned and operated|started|run|led) by)\s+(?:Dr\.?\s+)?{_NAME}"), False),
    (re.compile(rf"{_NAME}\s+(?i:opened|owns|founded|started)\b"), True),
]


def people_in(text: str | None) -> list[tuple[str, str, int, bool]]:
    """(name, title, rank, loose) of every person a sentence names with a role, first seen first; a sentence shape without a title is loose."""
    out: dict[tuple[str, str], tuple] = {}
    for shape, loose in _SHAPES:
        for m in shape.finditer(text or ""):
            title = (m.groupdict().get("title") or ("founder" if not loose else "")).lower()
            name = re.sub(r"^(?:Meet|Contact|Ask|Dear|Our|The|With)\s+", "", m.group("name")).strip(" ,.-")
            if len(name.split()) >= 2:
                out.setdefault((name, title), (name, title, RANK.get(title, 30), loose))
    return list(out.values())


def mentions_in(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, name, title, rank, loose): people named in a text column; null texts have none."""

    @F.pandas_udf("array<struct<name:string,title:string,rank:int,loose:boolean>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([people_in(t) for t in texts])

    return df.where(F.col(text).isNotNull()).select(id_col, F.explode(find(text)).alias("p")).select(id_col, "p.*")


_SMALL = set("a an and as at but by for in of on or the to vs via de del la y".split())
_UPPER = set("llc inc ltd llp pllc pc dds dmd md dvm od dc cpa esq phd rn hvac usa us ii iii iv bbq tv diy rv atm ups".split())


def smart_title(text: str | None) -> str:
    """Title case as people write it: small words, acronyms, ordinals, Mc and O', parts of hyphenated words; mixed case is kept."""
    words = re.split(r"(\s+)", (text or "").strip())
    shouting = (text or "").isupper()

    def one(word: str, first: bool) -> str:
        low = word.lower()
        core = low.strip(".,!()&")
        if core in _UPPER:
            return word.upper()
        if low in _SMALL and not first:
            return low
        if re.fullmatch(r"\d+(?:st|nd|rd|th)", low):
            return low
        if not shouting and (re.search(r"[a-z][A-Z]", word) or (word.isupper() and 2 <= len(core) <= 4 and core.isalpha())):
            return word
        m = re.match(r"(mc)([a-z])(.{2,})$", low) or re.match(r"([odl]')([a-z])(.+)$", low)
        return m.group(1).capitalize() + m.group(2).upper() + m.group(3) if m else low[:1].upper() + low[1:]

    out = [w if not w or w.isspace() else "-".join("/".join(one(p, i == 0) for p in part.split("/")) for part in w.split("-")) for i, w in enumerate(words)]
    return "".join(out)


def smart_titles(df: DataFrame, column: str) -> DataFrame:
    @F.pandas_udf("string")
    def case(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else smart_title(t))

    return df.withColumn(column, case(column))
