"""Postal addresses that denote the same building (problem 3): a gazetteer built from the addresses themselves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.postal import parse
from placewright.llm.triejoin import _spread, canonical_spellings, trie_join
from placewright.session import cut, once

_ADDRESS = "struct<number:string,street:string,kind:string,direction:string,unit:string,city:string,state:string,zip:string>"
#: Gazetteer entries kept for an address while it is resolved.
BEAM = 4


def parsed(df: DataFrame, id_col: str, address: Column, city: str = "city", state: str = "state", code: str = "postal_code") -> DataFrame:
    """(id, number, street, kind, direction, unit, city, state, zip) of rows with a written address; locality columns fill gaps of the text."""

    @F.pandas_udf(_ADDRESS)
    def split(a: pd.Series, c: pd.Series, s: pd.Series, z: pd.Series) -> pd.DataFrame:
        rows = [parse(*x) or (None,) * 8 for x in zip(a, c, s, z)]
        return pd.DataFrame(rows, columns=["number", "street", "kind", "direction", "unit", "city", "state", "zip"])

    src = df.where(F.col(id_col).isNotNull() & address.isNotNull())
    return src.select(F.col(id_col).alias("id"), once(split)(address, F.col(city), F.col(state), F.col(code)).alias("a")).select("id", "a.*").where("street IS NOT NULL")


def zip_cities(addresses: DataFrame) -> DataFrame:
    """(zip, zip_city): the city most rows (``n`` of each, if there is such a column) with a postal code name (ties: the smaller name). At most 100,000 rows: codes are five digits."""
    counted = addresses.where("zip <> '' AND city <> ''").groupBy("zip", "city").agg((F.sum("n") if "n" in addresses.columns else F.count("*")).alias("n"))
    return counted.groupBy("zip").agg(F.min(F.struct((-F.col("n")).alias("neg"), "city")).alias("m")).select("zip", F.col("m.city").alias("zip_city"))


_FORM = ["number", "street", "kind", "direction", "city", "state", "zip"]


def resolve(addresses: DataFrame, beam: int = BEAM) -> DataFrame:
    """Adds to parsed addresses their gazetteer entries: (..., locality, street_id), the ``beam`` best rows of an address.

    An entry is a street of a locality: street spellings are clustered within each locality and named by the most frequent one. Candidates of
    an address are the entries of its own city and of the usual city of its postal code (those without either: of ``~`` and their
    state), further near streets of these localities that have its number, and, if its locality is missing or only stated once and not
    confirmed, near streets of its state (without state: of all) that have its number. See :func:`_candidates` for the scores.
    """
    addresses = cut(addresses.withColumn("form", F.xxhash64(*_FORM)))
    forms = cut(addresses.groupBy("form", *_FORM).agg(F.count("*").alias("n")))
    by_zip = zip_cities(forms.select("zip", "city", "n"))
    stated = F.array_distinct(F.array_compact(F.array(F.nullif("city", F.lit("")), "zip_city")))
    placed = forms.join(F.broadcast(by_zip), "zip", "left").withColumn("localities", stated)
    placed = placed.withColumn("sure", (F.col("city") != "") & F.coalesce(F.levenshtein("city", "zip_city") <= 2, F.lit(False))).withColumn("once", (F.col("city") == "") | F.col("zip_city").isNull())
    placed = placed.withColumn("localities", F.when(F.size("localities") == 0, F.array(F.concat(F.lit("~"), "state"))).otherwise(F.col("localities")))
    entries = placed.select("form", "number", "street", "kind", "direction", "city", "state", "sure", "once", "n", F.explode("localities").alias("written"))
    # the streets of a locality are few: towns and streets are named for them and rows join once
    written = cut(entries.groupBy("written", "street").agg(F.sum("n").alias("n")))
    named = written.where(~F.col("written").startswith("~"))
    cities = canonical_spellings(named.select(F.lit("").alias("shard"), F.col("written").alias("text"), "n"))
    towns = cut(written.join(cities.select(F.col("text").alias("written"), F.col("canon").alias("town")), "written", "left").select("written", "street", "n", F.coalesce("town", "written").alias("locality")))
    streets = canonical_spellings(towns.select(F.col("locality").alias("shard"), F.col("street").alias("text"), "n"))
    named = towns.join(streets.select(F.col("shard").alias("locality"), F.col("text").alias("street"), F.col("canon").alias("street_id")), ["locality", "street"])
    entries = cut(entries.drop("n").join(named.drop("n"), ["written", "street"]).drop("written"))
    return addresses.join(cut(_candidates(entries, beam)), "form").drop("form")


def _candidates(entries: DataFrame, beam: int) -> DataFrame:
    """(form, locality, street_id): the ``beam`` best entries of each distinct form of an address; an entry may be repeated.

    Scores: 20 for the own city, 10 for the city of the code; the other candidates one each for the same spelling of the street, a stated
    street type and direction that the entry has, and a confirmed entry, four for a near name of the city. Contradicting type or
    direction excludes these. An entry of another locality counts only if it alone has the best score, and, where the
    address states a locality, if city and postal code of some address confirm the entry and none the stated one.
    """
    c = F.col
    asks = ["form", "street", "kind", "direction", "city"]
    spots = cut(
        entries.where(~c("locality").startswith("~")).groupBy("locality", "number", "street_id", "street")
        .agg(F.max("sure").alias("confirmed"), F.collect_set("kind").alias("kinds"), F.collect_set("direction").alias("directions"))
    )
    counted = entries.where(~c("locality").startswith("~") & (c("state") != "")).groupBy("locality", "state").agg(F.count_distinct("form").alias("n"))
    towns = counted.groupBy("locality").agg(F.max_by("state", F.struct("n", "state")).alias("of_state"))
    confirmed = spots.where("confirmed").select("locality", "street_id", "number").distinct()
    doubtful = entries.where("once").join(confirmed, ["locality", "street_id", "number"], "left_anti")
    seekers = cut(doubtful.select(*asks, c("locality").alias("own"), F.concat_ws("|", F.lit("S"), F.when(c("state") == "", "*").otherwise(c("state")), "number").alias("shard")).distinct())
    crowded = spots.groupBy("locality", "number").agg(F.count_distinct("street_id").alias("streets")).where("streets > 1").select("locality", "number")
    local = lambda df: df.withColumn("shard", F.concat_ws("|", F.lit("L"), "locality", "number"))
    states = F.array(F.coalesce("of_state", F.lit("")), F.lit("*"))
    within_state = spots.join(towns, "locality", "left").withColumn("of", F.explode(states)).withColumn("shard", F.concat_ws("|", F.lit("S"), "of", "number")).drop("of", "of_state")
    held = cut(within_state.join(seekers.select("shard").distinct(), "shard", "left_semi").unionByName(local(spots.join(crowded, ["locality", "number"], "left_semi"))))
    asked = cut(seekers.unionByName(local(entries.join(crowded, ["locality", "number"], "left_semi")).select(*asks, c("locality").alias("own"), "shard").distinct()))
    texts = held.select("shard", c("street").alias("text")).unionByName(asked.select("shard", c("street").alias("text")))
    near = cut(trie_join(texts))
    both = near.select("shard", c("a").alias("street"), c("b").alias("other")).unionByName(near.select("shard", c("b").alias("street"), c("a").alias("other")))
    both = both.unionByName(asked.select("shard", "street", c("street").alias("other")).distinct())
    met = asked.join(both, ["shard", "street"]).join(held.select("shard", c("street").alias("other"), "locality", "street_id", "confirmed", "kinds", "directions"), ["shard", "other"])
    fits = lambda x, xs: (c(x) == "") | F.array_contains(xs, c(x)) | F.array_contains(xs, "")
    has = lambda x, xs: ((c(x) != "") & F.array_contains(xs, c(x))).cast("int")
    nearly = F.when((c("city") != "") & (F.levenshtein("city", "locality") <= 2), 4).otherwise(0)
    score = (c("street") == c("other")).cast("int") + has("kind", "kinds") + has("direction", "directions") + c("confirmed").cast("int") + nearly
    rated = met.where(fits("kind", "kinds") & fits("direction", "directions")).groupBy("form", "own", "locality", "street_id").agg(F.max(score).alias("score"), F.max("confirmed").alias("confirmed"))
    inside = rated.where("own = locality").select("form", "locality", "street_id", "score")
    away = rated.where((c("own") != c("locality")) & (c("own").startswith("~") | c("confirmed")))
    best = away.withColumn("top", F.max("score").over(Window.partitionBy("form"))).where("score = top")
    alone = best.withColumn("ties", F.count("*").over(Window.partitionBy("form"))).where("ties = 1").select("form", "locality", "street_id", "score")
    given = entries.where("locality <> '~'").select("form", "locality", "street_id", F.when((c("city") != "") & (F.levenshtein("city", "locality") <= 3), 20).otherwise(10).alias("score"))
    # all of a form is in one place for both the groups and the order
    every = _spread(given.unionByName(inside).unionByName(alone), "form").groupBy("form", "locality", "street_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("form").orderBy(c("score").desc(), "locality", "street_id")
    return every.withColumn("place", F.row_number().over(order)).where(c("place") <= beam).select("form", "locality", "street_id")


def agree(a: str, b: str) -> Column:
    """Whether two parsed addresses at one street and number can be one building: what both state must not differ."""

    def same(field: str) -> Column:
        x, y = F.col(f"{a}.{field}"), F.col(f"{b}.{field}")
        return (x == "") | (y == "") | (x == y)

    place = (F.col(f"{a}.zip") == F.col(f"{b}.zip")) & (F.col(f"{a}.zip") != "") | (F.levenshtein(F.col(f"{a}.city"), F.col(f"{b}.city")) <= 2)
    return same("kind") & same("direction") & (same("state") | place)


def same_building(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id): addresses of ``left`` and ``right`` (both from :func:`resolve` over their union) at the same building.

    Join on locality, street and number; street type, direction and state must agree where both are stated; unit and
    tenant do not matter. Addresses without a number match only others without. Every pair comes out once.
    """
    # address texts repeat: distinct forms are joined and compared, then rows join back to forms
    form = ["number", "street", "kind", "direction", "city", "state", "zip"]
    key = ["locality", "street_id", "number"]
    lf = left.select(*key, *[c for c in form if c != "number"]).distinct().select(*key, F.struct(*form).alias("a"))
    rf = right.select(*key, *[c for c in form if c != "number"]).distinct().select(*key, F.struct(*form).alias("b"))
    pairs = lf.join(rf, key).where(agree("a", "b")).select("a", "b").distinct()
    la = left.select(F.col("id").alias("left_id"), F.struct(*form).alias("a")).distinct()
    ra = right.select(F.col("id").alias("right_id"), F.struct(*form).alias("b")).distinct()
    return pairs.join(la, "a").join(ra, "b").select("left_id", "right_id").distinct()


def address_frames(businesses: DataFrame, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Resolved addresses of both tables over one gazetteer; places use street, else address."""
    b = parsed(businesses, "business_id", F.col("address")).withColumn("side", F.lit("b"))
    if places is None:
        return cut(resolve(b).drop("side")), None
    p = parsed(places, "listing_id", F.coalesce(F.nullif(F.trim("street"), F.lit("")), F.col("address"))).withColumn("side", F.lit("p"))
    both = cut(resolve(b.unionByName(p)))
    return both.where("side = 'b'").drop("side"), both.where("side = 'p'").drop("side")


def matching_addresses(businesses: DataFrame, places: DataFrame) -> DataFrame:
    """(business_id, listing_id) of rows whose written addresses denote the same building."""
    b, p = address_frames(businesses, places)
    return same_building(b, p).select(F.col("left_id").alias("business_id"), F.col("right_id").alias("listing_id"))

