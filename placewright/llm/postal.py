"""Parsing of typed postal addresses into number, street, type, direction, unit and locality."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

#: Street types, directions, units, compass and place abbreviations and states as commonly written.
TYPES = {
    "st": "street", "str": "street", "street": "street", "ave": "avenue", "av": "avenue", "aven": "avenue", "avn": "avenue", "avenue": "avenue", "rd": "road", "road": "road", "dr": "drive", "drv": "drive", "drive": "drive",
    "ln": "lane", "lane": "lane", "blvd": "boulevard", "boul": "boulevard", "boulevard": "boulevard", "ct": "court", "crt": "court", "court": "court", "cir": "circle", "circ": "circle", "circle": "circle",
    "pl": "place", "place": "place", "ter": "terrace", "terr": "terrace", "terrace": "terrace", "pkwy": "parkway", "pky": "parkway", "pkway": "parkway", "parkway": "parkway", "plz": "plaza", "plaza": "plaza",
    "sq": "square", "square": "square", "trl": "trail", "trail": "trail", "way": "way", "wy": "way", "aly": "alley", "alley": "alley", "loop": "loop", "row": "row", "walk": "walk", "xing": "crossing",
}
HIGHWAY = {"hwy": "highway", "highway": "highway", "hiway": "highway", "hway": "highway", "route": "route", "rte": "route", "rt": "route"}
DIRECTIONS = {
    "n": "n", "no": "n", "north": "n", "s": "s", "so": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w",
    "ne": "ne", "northeast": "ne", "nw": "nw", "northwest": "nw", "se": "se", "southeast": "se", "sw": "sw", "southwest": "sw",
}
UNITS = {"suite", "ste", "unit", "apt", "apartment", "room", "rm", "office", "ofc", "floor", "fl", "bldg", "building", "dept", "#"}
PLACE_WORDS = {"mt": "mount", "mtn": "mount", "st": "saint", "pt": "port", "prt": "port", "ft": "fort", "no": "north", "n": "north", "so": "south", "s": "south", "e": "east", "w": "west", "nw": "new"}
COUNTRY = {"usa", "us", "united", "states", "america"}
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il",
    "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt",
    "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa",
    "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}
_CODES = set(STATES.values())
_DIGITS = set("0123456789")
_ORDINALS = ("zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth").split()
_TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
_PLACEHOLDER = {"", "na", "n a", "none", "unknown", "tbd", "null", "address", "see website", "online", "coming soon", "various"}


class Address(NamedTuple):
    number: str
    street: str
    kind: str
    direction: str
    unit: str
    city: str
    state: str
    zip: str


def fold(text: str | None) -> str:
    """Lower case, without accents."""
    if text is None or text.isascii():
        return (text or "").lower()
    t = unicodedata.normalize("NFKD", text or "")
    return "".join(c for c in t if not unicodedata.combining(c)).lower()


@lru_cache(50_000)
def place_name(city: str | None) -> str:
    """A locality's name with its abbreviations written out."""
    words = re.findall(r"[a-z0-9]+", fold(city).replace("'", ""))
    if words and words[0] in PLACE_WORDS and len(words) > 1:
        words[0] = PLACE_WORDS[words[0]]
    name = " ".join(words)
    return "" if name in _PLACEHOLDER else name


@lru_cache(5_000)
def state_code(state: str | None) -> str:
    s = " ".join(re.findall(r"[a-z]+", fold(state)))
    return s if s in _CODES else STATES.get(s, "")


@lru_cache(50_000)
def zip5(code: str | None) -> str:
    """Five digits; codes that lost leading zeros in a number column get them back."""
    m = re.match(r"\s*(\d{3,5})(?:-\d{0,4}|\.0)?\s*$", code or "")
    return m.group(1).zfill(5) if m else ""


def ordinal(word: str) -> str:
    m = word[:1] in _DIGITS and re.fullmatch(r"(\d+)(?:st|nd|rd|th)", word)
    if m:
        n = int(m.group(1))
        return _ORDINALS[n] if n < len(_ORDINALS) else f"{n}th"
    return word


def parse(address: str | None, city: str | None = None, state: str | None = None, code: str | None = None) -> Address | None:
    """The parts of a written address; columns beside it fill what the text lacks. None where no street is written."""
    text = fold(address).replace("’", "'").replace("'", "")
    if not re.search(r"[a-z]", text) or " ".join(re.findall(r"[a-z]+", text)) in _PLACEHOLDER:
        return None
    own_city, own_state, own_zip = place_name(city), state_code(state), zip5(code)
    text = re.sub(r"#\s*(?=\w)", " # ", text)
    toks = re.findall(r"#|[a-z0-9]+(?:-[a-z0-9]+)*|[,\n()]", text)
    unit, rest, i = "", [], 0
    while i < len(toks):
        t = toks[i]
        if t in UNITS and i + 1 < len(toks) and re.fullmatch(r"[a-z]?\d+[a-z]?|[a-z]", toks[i + 1]):
            unit = toks[i + 1]
            rest.append(",")
            i += 2
            continue
        rest.append(t)
        i += 1
    zipped = ""
    for j in range(len(rest) - 1, -1, -1):
        m = rest[j][0] in _DIGITS and re.fullmatch(r"(\d{5})(?:-\d{4})?", rest[j])
        if m and not (j + 1 < len(rest) and rest[j + 1] in HIGHWAY):
            before = any(x[0] in _DIGITS and re.fullmatch(r"\d+[a-z]?", x) for x in rest[:j]) or any(x[0] in _DIGITS and re.fullmatch(r"\d+[a-z]?", x) for x in rest[j + 1 :])
            if before:
                zipped = m.group(1)
                rest[j] = ","
                break
    # the street starts at the house number: a number followed by a word on the same line segment
    start = None
    for j, t in enumerate(rest):
        if t[0] in _DIGITS and re.fullmatch(r"\d+[a-z]?(?:-\d+)?", t) and j + 1 < len(rest) and re.match(r"[a-z]|\d+(?:st|nd|rd|th)$", rest[j + 1]) and not (j and rest[j - 1] in HIGHWAY):
            start = j
            break
    if start is None:
        number, seg, other = "", [], [t for t in rest if t not in {",", "\n", "(", ")"}]
        first = []
        for t in rest:
            if t in {",", "\n", "(", ")"}:
                if first:
                    break
                continue
            first.append(t)
        seg, other = first, rest[len(first) :]
    else:
        number, j, seg = rest[start], start + 1, []
        while j < len(rest) and rest[j] not in {",", "\n", "(", ")"}:
            seg.append(rest[j])
            j += 1
        other = rest[:start] + [","] + rest[j:]
    kind = direction = ""
    name: list[str] = []
    tail: list[str] = []
    j = 0
    if len(seg) > 1 and seg[0] in DIRECTIONS and not (seg[1] in TYPES and len(seg) == 2):
        direction, j = DIRECTIONS[seg[0]], 1
    cities = (own_city.split(), place_name(city).split())
    while j < len(seg):
        t = seg[j]
        if t in HIGHWAY and j + 1 < len(seg) and re.fullmatch(r"\d+[a-z]?", seg[j + 1]):
            name, kind = [HIGHWAY[t], seg[j + 1]], HIGHWAY[t]
            j += 2
            if j < len(seg) and seg[j] in DIRECTIONS and (j + 1 == len(seg) or seg[j] not in {"north", "south", "east", "west", "new"}):
                direction = direction or DIRECTIONS[seg[j]]
                j += 1
            tail = seg[j:]
            break
        if name and t in TYPES and not (t == "st" and j + 1 < len(seg) and any(c[:1] == ["saint"] and seg[j + 1] in c for c in cities) and not any(x in TYPES for x in seg[j + 1 :])):
            kind = TYPES[t]
            j += 1
            if j < len(seg) and seg[j] in DIRECTIONS and (j + 1 == len(seg) or seg[j] in {"n", "s", "e", "w"} and not _starts_city(seg[j:], own_city)):
                direction = direction or DIRECTIONS[seg[j]]
                j += 1
            tail = seg[j:]
            break
        if name and own_city and _starts_city(seg[j:], own_city):
            tail = seg[j:]
            break
        name.append(ordinal(t))
        j += 1
    if not kind and not tail:  # no type and no comma: the locality starts at its first usual word
        for k in range(1, len(name)):
            if PLACE_WORDS.get(name[k], name[k]) in {"new", "north", "south", "east", "west", "mount", "saint", "port"} and k + 1 < len(name):
                name, tail = name[:k], name[k:]
                break
    if len(name) > 1 and not kind and name[-1] in DIRECTIONS:
        direction = direction or DIRECTIONS[name.pop()]
    words = [t for t in [*tail, *other] if t not in {",", "\n", "(", ")"} and t not in COUNTRY]
    text_state = ""
    for n in (2, 1):
        for k in range(len(words) - n + 1):
            w = " ".join(words[k : k + n])
            if w in STATES or (n == 1 and w in _CODES and (k == len(words) - 1 or w == own_state) and not (w in PLACE_WORDS and k + 1 < len(words))):
                if k or n == 1 and len(words) == 1 or w == own_state and k + n == len(words):
                    text_state = state_code(w)
                    del words[k : k + n]
                    break
        if text_state:
            break
    text_city = place_name(" ".join(w for w in words if not w.isdigit()))
    street = " ".join(name)
    if not street:
        return None
    return Address(number, street, kind, direction, unit, own_city or text_city, own_state or text_state, zipped or own_zip)


def _starts_city(words: list[str], city: str) -> bool:
    if not city:
        return False
    want = city.split()
    got = [PLACE_WORDS.get(words[0], words[0]), *words[1:]][: len(want)]
    if len(got) < len(want):
        return False
    same = sum(a == b for a, b in zip(got, want))
    return same == len(want) or (len(want) > 1 and got[0] == want[0] and abs(len(got[1]) - len(want[1])) <= 1 and len(set(got[1]) & set(want[1])) >= 0.7 * len(set(want[1])))
