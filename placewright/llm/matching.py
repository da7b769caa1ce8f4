"""Which records describe the same business: within one source (problem 2) and across sources without keys (problem 4)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.contact import host_text, national_digits, unmarked_host, valid_host, valid_phone
from placewright.llm.names import initial_forms, listing_forms
from placewright.llm.postal import place_name, zip5
from placewright.llm import triejoin
from placewright.llm.components import components
from placewright.llm.gazetteer import parsed, resolve, zip_cities
from placewright.session import cut, once

#: A phone or site seen in more cities than this is a brand's: it links records of one city only.
BRAND_CITIES = 3
#: Rules in the order of the cascade, strongest first.
RULES = ("phone_and_name", "building_and_name", "site_and_name", "city_and_name")
#: Entries of a shard whose names are compared in one task; larger shards go through the segment join.
BLOCK = 3000
#: Listings of a city that are held at once while those with little evidence ask for their names; larger cities go by segments.
TOWN = 20_000
PHONE, SITE, BUILDING, CITY = 1, 2, 3, 4
#: Kinds of evidence and the column of a judgement that holds what a pair says of it.
KINDS = {PHONE: "phone", SITE: "site", BUILDING: "building", CITY: "city"}


def _gid(side: str, id_col: str, group: str) -> Column:
    named = F.when(F.col(group).isNull(), F.concat(F.lit("#"), F.col(id_col).cast("string"))).otherwise(F.concat(F.lit(":"), F.col(group)))
    return F.shiftleft(F.xxhash64(F.lit(side), named), 1) + (1 if side == "p" else 0)


def _listings(df: DataFrame, side: str, id_col: str, group: str, address) -> DataFrame:
    rest = ["name", address.alias("address"), "city", "state", "postal_code"]
    # digits and hosts are columns before they are judged: an expression that is used twice is else run twice
    read = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), _gid(side, id_col, group).alias("gid"), national_digits("phone").alias("phone"), host_text("website").alias("site"), *rest)
    return read.select(F.lit(side).alias("side"), "id", "gid", "name", valid_phone("phone").alias("phone"), unmarked_host(valid_host("site")).alias("site"), "address", "city", "state", "postal_code")


def packed_spellings(names: DataFrame) -> DataFrame:
    """(gid, names, fs) of (gid, name): how many names a listing has and the lines of their :func:`listing_forms`, each with its role in the first letter. A name is taken apart once."""

    @F.pandas_udf("string")
    def forms(names: pd.Series) -> pd.Series:
        return names.map(lambda of: "\n".join(listing_forms(of)))

    held = names.groupBy("gid").agg(F.collect_list("name").alias("of"))
    return held.select("gid", F.size("of").alias("names"), once(forms)("of").alias("fs"))


def _roles(fs):
    """(role, text) of packed forms, the initials of full names (role d) written out."""
    for f in fs:
        if f[0] == "w":
            for d in initial_forms(f[1:].split(" ")):
                yield "d", d
        else:
            yield f[0], f[1:]


def spellings(packed: DataFrame, *cols: str) -> DataFrame:
    """(cols, gid, role, text), a row for each spelling of ``packed`` (cols, gid, fs)."""

    @F.pandas_udf("array<string>")
    def written(forms: pd.Series) -> pd.Series:
        return forms.map(lambda fs: list(dict.fromkeys(r + t for r, t in _roles(fs.split("\n") if fs else []))))

    return packed.select(*cols, "gid", F.explode(once(written)("fs")).alias("f")).select(*cols, "gid", F.substring("f", 1, 1).alias("role"), F.expr("substring(f, 2)").alias("text"))


def evidence(businesses: DataFrame, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, attributes, names).

    rows: (side, id, gid): ``gid`` is a listing: the rows of one key of businesses (even numbers), or of one provider id of places
    (odd numbers); rows without are listings of their own. Ids and values are 64-bit hashes, so that shuffles carry numbers.
    attributes: (gid, type, value, kind, direction): distinct phones, sites, buildings and cities of a listing, so that a copy with a
    gap is helped by the other copies. names: (gid, name), distinct. Names and addresses are parsed once for each listing, not
    for each copy.
    """

    @F.pandas_udf("struct<city:string,zip:string>")
    def locality(city: pd.Series, code: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"city": [place_name(c) for c in city], "zip": [zip5(z) for z in code]})

    base = _listings(businesses, "b", "business_id", "key", F.col("address"))
    if places is not None:
        base = base.unionByName(_listings(places, "p", "listing_id", "place_id", F.coalesce(F.nullif(F.trim("street"), F.lit("")), F.col("address"))))
    base = cut(base)
    names = cut(base.where("name IS NOT NULL").select("gid", "name").distinct())
    written = base.where("address IS NOT NULL").select("gid", "address", "city", "state", "postal_code").distinct()
    built = resolve(parsed(written, "gid", F.col("address")))
    building = F.when(F.col("number") != "", F.xxhash64("locality", "street_id", "number"))
    located = built.select(F.col("id").alias("gid"), "locality", building.alias("building"), "kind", "direction")
    # the copies of a listing are in one place, so that what they share is one row before the shuffle of attributes
    contact = cut(triejoin._spread(base.select("gid", "phone", "site", "city", "postal_code"), "gid").distinct().select("gid", "phone", "site", locality("city", "postal_code").alias("l")).select("gid", "phone", "site", "l.city", "l.zip"))
    by_zip = F.broadcast(zip_cities(contact))  # five digits: at most 100,000 rows
    blank = F.lit("")
    item = lambda t, v, k=blank, d=blank: F.when(v.isNotNull(), F.struct(F.lit(t).cast("tinyint").alias("type"), v.alias("value"), k.alias("kind"), d.alias("direction")))
    number = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.xxhash64(c))
    with_city = contact.join(by_zip, "zip", "left").withColumn("town", F.when(F.col("city") != "", F.col("city")).otherwise(F.coalesce("zip_city", blank)))
    known = with_city.select("gid", number("phone").alias("phone"), number("site").alias("site"), number("town").alias("town"))
    placed = located.select("gid", F.when(~F.col("locality").startswith("~"), number("locality")).alias("town"), "building", "kind", "direction")
    # what a row says goes to its listing in one piece and is told apart and made distinct there
    said = triejoin._spread(known.unionByName(placed, allowMissingColumns=True), "gid")
    c = F.col
    said = said.select("gid", F.explode(F.array_compact(F.array(item(PHONE, c("phone")), item(SITE, c("site")), item(CITY, c("town")), item(BUILDING, c("building"), c("kind"), c("direction"))))).alias("i"))
    attributes = said.select("gid", "i.*")
    return base.select("side", "id", "gid"), cut(attributes.distinct()), names


def _pairs_of_shard(entries) -> list[tuple[int, int]]:
    """Listings (gid, fs) of one shard with near names: words with words in one trie, initials with initials in another.

    Few spellings are compared one by one. Equal spellings need no trie, and a trie is built only while some pair of listings is not linked yet. Full names are shortened to
    initials only where some listing of the shard is written with initials.
    """
    held: dict[str, dict[str, list]] = {}
    listings = set()
    entries = [(e["gid"], e["fs"].split("\n") if e["fs"] else []) for e in entries]
    typed = any(f[0] == "a" for _, fs in entries for f in fs)
    for gid, fs in entries:
        listings.add(gid)
        for role, text in _roles(fs if typed else [f for f in fs if f[0] != "w"]):
            held.setdefault("ad" if role in "ad" else role, {}).setdefault(text, []).append((gid, role))
    every = len(listings) * (len(listings) - 1) // 2
    out: set[tuple[int, int]] = set()

    def link(some, others, roles: str) -> None:
        for g, r in some:
            for h, o in others:
                if g != h and (roles != "ad" or r == "a" or o == "a"):
                    out.add((g, h) if g < h else (h, g))

    for roles, by_text in held.items():
        for same in by_text.values():
            if len(same) > 1:
                link(same, same, roles)
    for roles in ("n", "k", "ad"):
        by_text = held.get(roles)
        if not by_text or len(by_text) < 2 or len(out) == every or (roles == "ad" and not any(r == "a" for h in by_text.values() for _, r in h)):
            continue
        texts = sorted(by_text)
        if len(texts) <= triejoin.FEW:
            few = triejoin.lettered(texts)
            found = (x for i, q in enumerate(few) for x in triejoin.meet_few(few[i + 1 :], *q))
        else:
            found = _trie_pairs(texts, roles)
        for q, t, d in found:
            if _close(roles, q, t, d):
                link(by_text[q], by_text[t], roles)
    return sorted(out)


def _trie_pairs(texts: list[str], roles: str):
    """(q, t, distance), q < t, of texts that a trie and the automaton find near."""
    trie = triejoin.build_trie(texts)
    for q in texts:
        k = min(1, triejoin.reach(q)) if roles == "ad" else triejoin.reach(q)
        for i, d in triejoin.neighbours(trie, q, k):
            if texts[i] > q:
                yield q, texts[i], d


def _close(roles: str, a: str, b: str, d: int) -> bool:
    if roles == "ad":
        return d <= 1 and a.split("~")[1] == b.split("~")[1]
    return triejoin.reached(a, b, d) and (roles == "n" or d <= 1 or min(len(a), len(b)) >= 12)


def name_neighbours(attributes: DataFrame, names: DataFrame, block: int = BLOCK, town_block: int = TOWN) -> DataFrame:
    """(g, h, same), g < h: listings that share a phone, site, building or city and whose names are near; same: equal in one city.

    Names are sharded by what the listings share, each shard's forms (usual order, sorted words, without vowels, initials) go
    into tries and are joined with Levenshtein automata. Phones and sites of more than ``BRAND_CITIES`` cities are
    divided by city (no rule links listings of two cities by them). A shard of more than ``block`` entries (four a name) goes through :func:`trie_join`, which divides it without loss.
    """
    packed = cut(packed_spellings(names))
    of = {t: attributes.where(F.col("type") == t).select("gid", "value") for t in KINDS}
    of[BUILDING] = of[BUILDING].distinct()  # written with and without street type
    city = of[CITY].withColumnRenamed("value", "city")
    # a value of one listing links none
    contact = attributes.where(F.col("type").isin(PHONE, SITE)).select("gid", "type", "value")
    contact = cut(contact.join(contact.groupBy("type", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["type", "value"]))
    wide = contact.join(city, "gid").groupBy("type", "value").agg(F.count_distinct("city").alias("cities")).where(F.col("cities") > BRAND_CITIES)
    marked = cut(contact.join(wide.select("type", "value", F.lit(True).alias("wide")), ["type", "value"], "left"), contact)
    shards = of[BUILDING].select("gid", F.xxhash64(F.lit(BUILDING), "value").alias("shard"))
    shards = shards.unionByName(marked.where("wide IS NULL").select("gid", F.xxhash64("type", "value").alias("shard")))
    shards = cut(shards.unionByName(marked.where("wide").join(city, "gid").select("gid", F.xxhash64("type", "value", "city").alias("shard"))), marked)
    sizes = cut(shards.join(packed.select("gid", "names"), "gid").groupBy("shard").agg(F.count("*").alias("listings"), (4 * F.sum("names")).alias("n")).where("listings > 1").select("shard", "n"))

    @F.pandas_udf("array<struct<g:bigint,h:bigint>>")
    def near(groups: pd.Series) -> pd.Series:
        return pd.Series([_pairs_of_shard(es) for es in groups])

    few = triejoin._spread(shards.join(sizes.where(F.col("n") <= block), "shard").join(packed, "gid").select("shard", "gid", "fs"), "shard").groupBy("shard").agg(F.collect_list(F.struct("gid", "fs")).alias("es"))
    found = few.select(F.explode(once(near)("es")).alias("p")).select("p.g", "p.h")
    over = []
    if sizes.where(F.col("n") > block).limit(1).count():  # a yes or no
        over = [cut(spellings(shards.join(sizes.where(F.col("n") > block), "shard").join(packed, "gid"), "shard"))]
        found = found.unionByName(_segment_pairs(over[0]))
    town, held = town_neighbours(attributes, packed, town_block)
    found = found.withColumn("same", F.lit(False)).unionByName(town)
    return cut(found.where("g <> h").groupBy("g", "h").agg(F.max("same").alias("same")), packed, shards, sizes, *over, *held)


def _segment_pairs(entries: DataFrame) -> DataFrame:
    """(g, h): listings with near names in shards of ``entries`` (shard, gid, role, text) of any size."""
    typed = entries.where("role = 'a'").select("shard").distinct()
    entries = entries.where("role <> 'd'").unionByName(entries.where("role = 'd'").join(typed, "shard", "left_semi").select(*entries.columns))
    many = cut(entries.select("gid", "role", "text", F.concat(F.when(F.col("role").isin("a", "d"), "~").otherwise(F.col("role")), F.lit("|"), F.col("shard").cast("string")).alias("shard")))
    pairs = triejoin.trie_join(many.select("shard", "text"))
    initials = F.split(F.col("a"), "~")[1] == F.split(F.col("b"), "~")[1]
    close = pairs.where(F.when(F.col("shard").startswith("~"), initials & (F.col("distance") <= 1)).when(F.col("shard").startswith("k"), (F.col("distance") <= 1) | (F.least(F.length("a"), F.length("b")) >= 12)).otherwise(True))
    left = many.select("shard", F.col("text").alias("a"), F.col("gid").alias("ga"), F.col("role").alias("ra"))
    right = many.select("shard", F.col("text").alias("b"), F.col("gid").alias("gb"), F.col("role").alias("rb"))
    some = "ra <> 'd' OR rb <> 'd'"
    hot = close.join(left, ["shard", "a"]).join(right, ["shard", "b"]).where(some).select("ga", "gb")
    hot = hot.unionByName(left.join(right.withColumnRenamed("b", "a"), ["shard", "a"]).where("ga < gb").where(some).select("ga", "gb"))
    return hot.select(F.least("ga", "gb").alias("g"), F.greatest("ga", "gb").alias("h"))


def _pairs_of_town(entries) -> list[tuple[int, int, bool]]:
    """(g, h, same): the pairs of :func:`town_neighbours` of one city; ``entries``: (gid, mask, fs)."""
    held: dict[str, dict[str, list]] = {"n": {}, "k": {}, "a": {}, "d": {}}
    entries = [(e["gid"], e["mask"], e["fs"].split("\n") if e["fs"] else []) for e in entries]
    # words meet words, initials meet initials; shortened full names meet typed initials only
    started = {f[1:].split("~")[1] for _, _, fs in entries for f in fs if f[0] == "a"}
    for gid, mask, fs in entries:
        for role, text in _roles(fs if started else [f for f in fs if f[0] != "w"]):
            if role != "d" or text.split("~")[1] in started:
                held[role].setdefault(text, []).append((gid, mask))
    out: dict[tuple[int, int], bool] = {}

    def link(some, others, same: bool = False) -> None:
        for g, m in some:
            for h, o in others:
                if g != h and not m & o and (m.bit_count() <= 1 or o.bit_count() <= 1):
                    pair = (g, h) if g < h else (h, g)
                    out[pair] = out.get(pair, False) or same

    def asking(by_text) -> list[str]:
        return [t for t, of in by_text.items() if any(m.bit_count() <= 1 for _, m in of)]

    for role in "nk":
        by_text = held[role]
        ask = asking(by_text)
        for t in ask:
            link(by_text[t], by_text[t], role == "n")
        for q, t, d in triejoin.meet_whole(list(by_text), ask):
            if _close(role, q, t, d):
                link(by_text[q], by_text[t])
    typed: dict[str, tuple[list, list]] = {}
    for k, role in enumerate("ad"):
        for t in held[role]:
            typed.setdefault(t.split("~")[1], ([], []))[k].append(t)
    for queries, full in typed.values():
        for role, texts in (("a", queries), ("d", full)):
            for q in queries:
                if q in held[role]:
                    link(held["a"][q], held[role][q])
            for q, t, d in triejoin.meet_whole(texts, queries):
                if _close("ad", q, t, d):
                    link(held["a"][q], held[role][t])
    return [(g, h, same) for (g, h), same in out.items()]


def town_neighbours(attributes: DataFrame, packed: DataFrame, block: int = TOWN) -> tuple[DataFrame, list[DataFrame]]:
    """(g, h, same), g < h: listings of one city with near names of which no phone, site or building is on both sides: only their city
    can link them; same: a spelling is equal. And the tables that are read for it.

    One of such two listings has at most one kind of evidence. These ask the names of their city;
    that a stronger rule has linked one of them does not stop it, for that link may lead to a copy with as little evidence. A city
    of at most ``block`` listings is held at once; larger ones are asked by segments.
    """
    city = attributes.where(F.col("type") == CITY).select("gid", F.col("value").alias("city"))
    bit = F.expr(f"bit_or(CASE type WHEN {PHONE} THEN 1 WHEN {SITE} THEN 2 WHEN {BUILDING} THEN 4 ELSE 0 END)")
    towned = cut(attributes.groupBy("gid").agg(bit.alias("mask")).join(city, "gid"))
    sizes = cut(towned.groupBy("city").agg(F.count("*").alias("n"), F.min(F.bit_count("mask")).alias("least")).where("n > 1 AND least <= 1").select("city", "n"))

    @F.pandas_udf("array<struct<g:bigint,h:bigint,same:boolean>>")
    def near(groups: pd.Series) -> pd.Series:
        return pd.Series([_pairs_of_town(es) for es in groups])

    whole = towned.join(sizes.where(F.col("n") <= block), "city").join(packed, "gid").select("city", "gid", "mask", "fs")
    whole = triejoin._spread(whole, "city").groupBy("city").agg(F.collect_list(F.struct("gid", "mask", "fs")).alias("es"))
    found = whole.select(F.explode(once(near)("es")).alias("p")).select("p.g", "p.h", "p.same")
    if not sizes.where(F.col("n") > block).limit(1).count():  # a yes or no
        return found, [towned, sizes]
    large = cut(spellings(towned.join(sizes.where(F.col("n") > block), "city").join(packed, "gid"), "city", "mask").where("text <> ''"))
    return found.unionByName(_town_segments(large)), [towned, sizes, large]


def _town_segments(entries: DataFrame) -> DataFrame:
    """The pairs of :func:`town_neighbours` in cities of any size; ``entries``: (city, mask, gid, role, text)."""
    few = "bit_count(mask) <= 1"
    place = F.col("city").cast("string")
    first = F.when(F.col("role").isin("a", "d"), F.split("text", "~")[1])
    entries = entries.withColumn("shard", F.concat_ws("|", "role", place, first)).withColumn("first", first)
    typed = entries.where("role = 'a'").select("city", "first").distinct()
    full = entries.where("role = 'd'").join(typed, ["city", "first"], "left_semi").select(*entries.columns)
    entries = cut(entries.where("role <> 'd'").unionByName(full).distinct())
    meets = F.when(F.col("role") == "a", F.array(F.lit("a"), F.lit("d"))).when(F.col("role") == "d", F.array(F.lit("a"))).otherwise(F.array("role"))
    asked = entries.where(few).withColumn("other", F.explode(meets)).select("gid", "mask", "text", F.concat_ws("|", "other", place, "first").alias("shard"))
    found = triejoin.trie_search(entries.select("shard", "text"), asked.select("shard", "text"))
    close = found.where(
        F.when(F.col("shard").rlike("^[ad]"), F.col("distance") <= 1)
        .when(F.col("shard").startswith("k"), (F.col("distance") <= 1) | (F.least(F.length("query"), F.length("text")) >= 12))
        .otherwise(True)
    )
    left = asked.select("shard", F.col("text").alias("query"), F.col("gid").alias("ga"), F.col("mask").alias("ma"))
    right = entries.select("shard", "text", F.col("gid").alias("gb"), F.col("mask").alias("mb"))
    same = (F.col("distance") == 0) & F.col("shard").startswith("n")
    pairs = close.join(left, ["shard", "query"]).join(right, ["shard", "text"]).where("ga <> gb AND ma & mb = 0")
    return pairs.select(F.least("ga", "gb").alias("g"), F.greatest("ga", "gb").alias("h"), same.alias("same"))


def judged(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Adds to pairs (g, h) phone, site, building and city: what each pair of listings says of each other: '=' some value shared, '!' both have values and none is shared, '?' one has none."""
    left = attributes.select(F.col("gid").alias("g"), "type", F.col("value").alias("v1"), F.col("kind").alias("k1"), F.col("direction").alias("d1"))
    right = attributes.select(F.col("gid").alias("h"), "type", F.col("value").alias("v2"), F.col("kind").alias("k2"), F.col("direction").alias("d2"))
    fits = (F.col("v1") == F.col("v2")) & ((F.col("k1") == "") | (F.col("k2") == "") | (F.col("k1") == F.col("k2"))) & ((F.col("d1") == "") | (F.col("d2") == "") | (F.col("d1") == F.col("d2")))
    says = [F.coalesce(F.when(F.max(F.when(F.col("type") == t, fits)), "=").when(F.max(F.when(F.col("type") == t, fits)) == F.lit(False), "!"), F.lit("?")).alias(name) for t, name in KINDS.items()]
    met = pairs.join(left, "g").join(right, ["h", "type"]).groupBy("g", "h").agg(*says)
    return pairs.join(met, ["g", "h"], "left").na.fill("?", list(KINDS.values()))


def ruled(judgements: DataFrame) -> DataFrame:
    """Adds ``rule``, the strongest rule that links a pair of listings with near names; null where none does.

    Branches of a brand and further offices share name and site, not phone and building: a differing building excludes every
    rule but the phone's, a differing phone every rule but the building's, differing cities all but the building's, and two
    differing attributes every rule.
    """
    c = F.col
    apart = (c("building") == "!").cast("int") + (c("site") == "!").cast("int") + (c("phone") == "!").cast("int") >= 2
    return judgements.withColumn(
        "rule",
        F.when((c("phone") == "=") & (c("city") != "!") & ~apart, RULES[0])
        .when((c("building") == "=") & ~apart, RULES[1])
        .when((c("site") == "=") & (c("phone") != "!") & (c("building") != "!") & (c("city") != "!"), RULES[2])
        .when((c("city") == "=") & (c("phone") != "!") & (c("building") != "!") & (c("site") != "!"), RULES[3]),
    )


def precision(judgements: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(rule, labelled, agreeing, confidence): how often an attribute that a rule does not use agrees where its other conditions hold.

    The data label themselves: for the phone rule by building and site, for the others by the phone where both listings
    have one. confidence = (agreeing + s) / (labelled + 2 s), so a rule without labelled pairs has one half.
    """
    c = F.col
    phone = F.when(c("phone") == "=", 1).when(c("phone") == "!", 0)
    other = F.when((c("building") == "=") | (c("site") == "="), 1).when((c("building") == "!") | (c("site") == "!"), 0)
    holds = {
        RULES[0]: ((c("phone") == "=") & (c("city") != "!"), other),
        RULES[1]: (c("building") == "=", phone),
        RULES[2]: ((c("site") == "=") & (c("building") != "!") & (c("city") != "!"), phone),
        RULES[3]: ((c("city") == "=") & (c("building") != "!") & (c("site") != "!"), phone),
    }
    cases = F.explode(F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(r).alias("rule"), y.alias("y"))) for r, (cond, y) in holds.items()))))
    rated = judgements.select(cases.alias("c")).groupBy(c("c.rule").alias("rule")).agg(F.count("c.y").alias("labelled"), F.coalesce(F.sum("c.y"), F.lit(0)).alias("agreeing"))
    return rated.withColumn("confidence", (c("agreeing") + smoothing) / (c("labelled") + 2 * smoothing))


def settled(judgements: DataFrame, attributes: DataFrame) -> DataFrame:
    """Judgements without the rule of city and name where only a near name speaks for it and the businesses of the two listings contradict it.

    Listings are first put together by the other links. Near names then link two such businesses only if these agree in the same rule and
    the one with fewer kinds of evidence (alike: each) fits no other of its table.
    """
    weak = (F.col("rule") == RULES[3]) & ~F.col("same")
    firm = judgements.where(F.col("rule").isNotNull() & ~weak & (F.col("g") % 2 == 0) & (F.col("h") % 2 == 0))
    whole = cut(components(firm.select(F.col("g").alias("a"), F.col("h").alias("b"))))
    of = lambda name: whole.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
    near = judgements.where(weak & ((F.col("g") % 2 == 0) | (F.col("h") % 2 == 0))).select("g", "h").join(of("g"), "g", "left").join(of("h"), "h", "left")
    near = cut(near.select("g", "h", F.coalesce("of_g", "g").alias("a"), F.coalesce("of_h", "h").alias("b")))
    ends = near.select(F.col("a").alias("gid")).unionByName(near.select(F.col("b").alias("gid"))).distinct()
    members = attributes.join(of("gid"), "gid", "left").withColumn("gid", F.coalesce("of_gid", "gid")).drop("of_gid")
    members = cut(members.join(ends, "gid", "left_semi").distinct())
    pairs = near.where("a <> b").select(F.least("a", "b").alias("g"), F.greatest("a", "b").alias("h")).distinct()
    fitting = cut(ruled(judged(pairs, members)).where(F.col("rule").isNotNull()).select("g", "h"))
    both = fitting.unionByName(fitting.select(F.col("h").alias("g"), F.col("g").alias("h")))
    kinds = members.where(F.col("type") != CITY).groupBy("gid").agg(F.count_distinct("type").alias("kinds"))
    known = both.groupBy(F.col("g").alias("gid"), (F.col("h") % 2 == 0).alias("to")).agg(F.count("*").alias("others")).join(kinds, "gid", "left").na.fill(0, ["kinds"])
    side = lambda name: known.select(F.col("gid").alias(name), F.when(F.col("to"), 0).otherwise(1).alias(f"to_{name}"), F.col("others").alias(f"others_{name}"), F.col("kinds").alias(f"kinds_{name}"))
    ended = fitting.withColumn("to_g", F.abs(F.col("h") % 2).cast("int")).withColumn("to_h", F.abs(F.col("g") % 2).cast("int"))
    alone = ended.join(side("g"), ["g", "to_g"]).join(side("h"), ["h", "to_h"]).where("(kinds_g > kinds_h OR others_g = 1) AND (kinds_h > kinds_g OR others_h = 1)").select(F.col("g").alias("x"), F.col("h").alias("y"))
    good = near.join(alone, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left").where("a = b OR x IS NOT NULL").select("g", "h", F.lit(True).alias("good"))
    return judgements.join(good, ["g", "h"], "left").withColumn("rule", F.when(~(weak & F.col("good").isNull()) | F.col("rule").isNull(), F.col("rule"))).drop("good")


class Resolution:
    """Listings resolved to businesses; every step is written once and used by the queries of both problems."""

    def __init__(self, businesses: DataFrame, places: DataFrame | None = None):
        self.rows, self.attributes, names = evidence(businesses, places)
        pairs = name_neighbours(self.attributes, names)
        judgements = cut(ruled(judged(pairs, self.attributes)), pairs)
        self.judgements = cut(settled(judgements, self.attributes))
        own = self.judgements.where("rule IS NOT NULL AND g % 2 = 0 AND h % 2 = 0")
        self.clusters = cut(components(own.select(F.col("g").alias("a"), F.col("h").alias("b"))))

    def business_of(self) -> DataFrame:
        """(gid, business): every listing of businesses and the business it belongs to."""
        mine = self.rows.where("side = 'b'").select("gid").distinct()
        return mine.join(self.clusters.withColumnRenamed("node", "gid"), "gid", "left").select("gid", F.coalesce("component", "gid").alias("business"))

    def place_links(self) -> DataFrame:
        """(gid, business, rule, confidence): the cascade: each rule links listings of places that no stronger rule has resolved."""
        mixed = self.judgements.where("rule IS NOT NULL AND (g % 2 = 0) <> (h % 2 = 0)")
        edges = mixed.select(F.when(F.col("g") % 2 == 0, F.col("g")).otherwise(F.col("h")).alias("gid"), F.when(F.col("g") % 2 == 0, F.col("h")).otherwise(F.col("g")).alias("place"), "rule")
        pool = cut(edges.join(self.business_of(), "gid").select(F.col("place").alias("gid"), "business", "rule").distinct())
        passes = []
        for rule in RULES:
            passes.append(cut(pool.where(F.col("rule") == rule)))
            pool = pool.join(passes[-1].select("gid").distinct(), "gid", "left_anti")
        resolved = reduce(DataFrame.unionByName, passes)
        rated = F.broadcast(cut(precision(self.judgements).select("rule", "confidence")))  # a row for each rule
        return resolved.join(rated, "rule", "left").select("gid", "business", "rule", "confidence")


def matched_pairs(res: Resolution) -> DataFrame:
    """(business_id, listing_id, rule, confidence): all rows of a business with all rows of the places listings linked to it."""
    links = cut(res.place_links())
    linked = links.select("business").distinct()
    b = res.rows.where("side = 'b'").join(res.business_of().join(linked, "business", "left_semi"), "gid").select(F.col("id").alias("business_id"), "business")
    p = res.rows.where("side = 'p'").join(links, "gid").select(F.col("id").alias("listing_id"), "business", "rule", "confidence")
    return b.join(p, "business").select("business_id", "listing_id", "rule", "confidence")


def variant_pairs(res: Resolution, businesses: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of one business with different key and differing names as stored."""
    # the key is known by the listing's number, the name by its hash
    named = businesses.where("business_id IS NOT NULL AND name IS NOT NULL").select(F.col("business_id").alias("id"), _gid("b", "business_id", "key").alias("gid"), F.col("key").isNotNull().alias("keyed"), F.xxhash64("name").alias("name"))
    rows = named.join(res.clusters.withColumnRenamed("node", "gid"), "gid").select("id", "gid", "keyed", "name", F.col("component").alias("business"))
    x, y = rows.alias("x"), rows.alias("y")
    differ = "x.gid <> y.gid AND (x.keyed OR y.keyed) AND x.name <> y.name"
    return x.join(y, (F.col("x.business") == F.col("y.business")) & (F.col("x.id") < F.col("y.id"))).where(differ).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
