"""Scalar functions over text as column expressions; everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every script, as one character class that Java and RE2 both read.
SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Latin letters with marks and the letters they stand for in comparisons.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: Column | str) -> Column:
    """Runs of white space become one blank, ends are trimmed; null stays null."""
    return F.trim(F.regexp_replace(_c(x), f"{SPACE}+", " "))


def normalize_name(x: Column | str) -> Column:
    """Lower case, letters without marks, ``&`` as "and", apostrophes dropped, everything else that is no letter or digit a blank."""
    low = F.translate(F.lower(_c(x)), MARKED, PLAIN)
    spelt = F.regexp_replace(F.regexp_replace(low, "&", " and "), "['’]", "")
    return F.trim(F.regexp_replace(spelt, "[^a-z0-9]+", " "))


def name_tokens(x: Column | str) -> Column:
    return F.filter(F.split(normalize_name(x), " "), lambda t: t != "")


def strip_edge_punct(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")


def trim_context(x: Column | str, at: Column, width: int = 60) -> Column:
    """The ``width`` characters on either side of position ``at`` (from 1; 0 gives null), on one line."""
    start = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, squeeze(F.substring(_c(x), start, at + width - start)))


def split_locality(city: Column, state: Column, code: Column, address: Column) -> Column:
    """struct(city, state, postal_code): gaps filled from "City, ST [ZIP]" in the city or at the end of the address."""
    pattern = r"([^,]+),\s*([A-Za-z]{2})(?:\s+(\d{5}(?:-\d{4})?))?\s*$"
    empty = F.lit("")
    own = F.coalesce(squeeze(city), empty)
    whole = own.rlike(r"^[^,]+,\s*[A-Za-z]{2}(?:\s+\d{5}(?:-\d{4})?)?$")
    part = lambda text, i: F.regexp_extract(text, pattern, i)
    addr = F.coalesce(address, empty)
    first = lambda *cols: F.coalesce(*(F.nullif(c, empty) for c in cols), empty)
    return F.struct(
        first(F.when(whole, F.trim(part(own, 1))).otherwise(own), F.trim(part(addr, 1))).alias("city"),
        first(F.coalesce(squeeze(state), empty), F.when(whole, F.upper(part(own, 2))), F.upper(part(addr, 2))).alias("state"),
        first(F.coalesce(squeeze(code), empty), F.when(whole, part(own, 3)), part(addr, 3)).alias("postal_code"),
    )


def city_from_address(x: Column | str) -> Column:
    """The comma segment after the first one that starts with a house number, without a trailing code; "" where unsure."""
    segment = F.regexp_extract(F.coalesce(_c(x), F.lit("")), r"(?:^|,)\s*\d+[A-Za-z]?\b[^,]*,\s*([^,]*)", 1)
    name = F.regexp_replace(squeeze(segment), r"\s+\d{4,}(?:-\d{4})?$", "")
    return F.when((F.length(name) > 2) & ~name.rlike(r"\d"), name).otherwise("")


def state_from(x: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(_c(x), F.lit("")), r",\s*([A-Z]{2})(?:\s+\d{5}(?:-\d{4})?)?(?:,?\s*(?:USA|US|United States))?\s*$", 1)


def clean_state(x: Column | str) -> Column:
    s = F.trim(F.coalesce(_c(x), F.lit("")))
    return F.when(F.length(s) == 2, F.upper(s)).otherwise(F.initcap(F.lower(s)))


def format_phone(x: Column | str) -> Column:
    """North American numbers as (ddd)-ddd-dddd, with "ext. n" where one is given; anything else on one line; null as ""."""
    raw = F.trim(F.coalesce(_c(x), F.lit("")))
    ext = F.regexp_extract(raw, r"(?i)(?:ext\.?|x|extension)\s*(\d{1,6})\s*$", 1)
    main = F.regexp_replace(raw, r"(?i)(?:ext\.?|x|extension)\s*\d{1,6}\s*$", "")
    digits = F.regexp_replace(F.regexp_replace(main, r"\D", ""), r"^1(?=\d{10}$)", "")
    shown = F.concat(F.lit("("), F.substring(digits, 1, 3), F.lit(")-"), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 4))
    return F.when(F.length(digits) == 10, F.when(ext != "", F.concat(shown, F.lit(" ext. "), ext)).otherwise(shown)).otherwise(squeeze(raw))


def split_name(x: Column | str) -> Column:
    """struct(first, rest): title dropped, initials in the middle dropped."""
    bare = F.regexp_replace(F.trim(F.coalesce(_c(x), F.lit(""))), r"(?i)^(?:dr|mr|mrs|ms|miss|prof)\.?\s+", "")
    words = F.filter(F.split(F.regexp_replace(bare, ",", " "), r"\s+"), lambda t: t != "")
    inner = F.filter(words, lambda t, i: ~((i > 0) & (i < F.size(words) - 1) & (F.length(F.regexp_replace(t, r"\.+$", "")) == 1)))
    return F.struct(F.coalesce(F.get(inner, F.lit(0)), F.lit("")).alias("first"), F.array_join(F.slice(inner, 2, 1000), " ").alias("rest"))


def brand_display_name(x: Column | str) -> Column:
    """A listing's name without store numbers."""
    cut = F.regexp_replace(F.regexp_replace(_c(x), r"(?i)(?:\b(?:no\.?|store|location|unit)\s*#?\s*|#\s*)\d{2,6}\b", ""), r"\s[-–]\s*\d{2,6}$", "")
    name = F.regexp_replace(cut, r"^[\s\-–—,]+|[\s\-–—,]+$", "")
    return F.when(name == "", _c(x)).otherwise(name)


def dedupe_key(place_id: Column, phone: Column, name: Column, address: Column, domain: Column) -> Column:
    """Identity of a listing: provider id, else the last ten digits of its phone (seven at least), else name and address, else name and domain."""
    empty = F.lit("")
    pid, tel, addr = (F.coalesce(c, empty) for c in (place_id, phone, address))
    digits = F.regexp_replace(tel, r"\D", "")
    last = F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits)
    low = F.lower(F.trim(F.coalesce(name, empty)))
    return (
        F.when(pid != "", F.lower(F.concat(F.lit("pid:"), pid)))
        .when(F.length(last) >= 7, F.concat(F.lit("tel:"), last))
        .when(addr != "", F.concat(F.lit("na:"), low, F.lit("|"), F.lower(F.trim(addr))))
        .otherwise(F.concat(F.lit("nd:"), low, F.lit("|"), F.lower(F.coalesce(domain, empty))))
    )


def fmt_duration(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m"))).when(m > 0, F.concat(m.cast("string"), F.lit("m "), two(r), F.lit("s"))).otherwise(F.concat(r.cast("string"), F.lit("s")))


#: Words after which "in" belongs to the kind of business; what stands between business and place; tails that name no place.
IN_WORDS = ["walk", "drive", "dine", "check", "drop", "move", "trade", "built", "plug", "log", "sign", "stand", "live", "pop", "all", "cash", "sit", "lie", "sleep", "buy", "sell", "turn", "opt", "tune", "phone", "call", "eat", "stay"]
BETWEEN = [r"\s+near\s+me\s+in\s+", r"\s+(?:located|based)\s+in\s+", r"\s+near\s+(?!me\b)", r"\s+around\s+", r"\s+within\s+", r"\s+@\s*", r"\s+[-–]\s+", r"\s*\|\s*"]
NO_PLACE = [r"near\s+me", r"near\s?by", r"around\s+me", r"close\s+to\s+me", r"within\s+\d+\s*(?:miles|minutes|min|mi|kilometers|km)"]


def parse_query(x: Column | str) -> Column:
    """struct(business_type, location) of a typed search: split at its first separator, else at a comma and state, else at a postal code.

    "in" after a word of IN_WORDS belongs to the kind of business. Tails such as "near me" or "within 5 miles" are
    no part of the place. A text without a place is all business type.
    """
    text = squeeze(x)
    plain_in = rf"(?<!\b(?:{'|'.join(IN_WORDS)}))\s+in\s+"
    at_first = rf"(?i)^(.+?)(?:{plain_in}|{'|'.join(BETWEEN)})(.+)$"
    tail = rf"(?i)(?:[\s,\-]*(?:{'|'.join(NO_PLACE)}))+\s*$"
    forms = [(at_first, lambda where: F.regexp_replace(where, tail, "")), (r"(?i)^([^,]+),\s*([^,]+,\s*[a-z]{2})$", None), (r"(?i)^(.+)\s+(\S+,\s*[a-z]{2})$", None), (r"^(.+?)\s*\b(\d{5}(?:-\d{4})?\b.*)$", None)]
    out = F.struct(text.alias("business_type"), F.lit("").alias("location"))
    for pattern, clean in reversed(forms):
        what, where = F.trim(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)
        where = clean(where) if clean else where
        out = F.when(where != "", F.struct(what.alias("business_type"), where.alias("location"))).otherwise(out)
    return out
