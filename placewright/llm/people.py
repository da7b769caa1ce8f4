"""Mentions of people at a business that mean the same person (problem 2)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.names import person
from placewright.llm.triejoin import canonical_of, canonical_spellings, swaps
from placewright.session import cut, once

#: Mentions of one business that are sorted out at once; businesses with more go by tables.
MENTIONS = 1000


def _near_given(a: str, b: str) -> bool:
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    if len(short) >= 2 and (long.startswith(short) or (len(short) >= 4 and short[-1] in "iy" and long.startswith(short[:-1]))):
        return True
    if len(short) < 3:
        return False
    return swaps(a, b) <= (1 if min(len(a), len(b)) <= 6 else 2) and (a[0] == b[0] or sorted(a) == sorted(b) or a[1:] == b[1:] or a[1:] == b or a == b[1:])


def people(names: list[tuple[str, str, str, str]]) -> list[int]:
    """Person number of each (name, given, middle, suffix) of one family at one business.

    Given names in full are grouped by nearness; junior and senior are two people, and a mention without suffix belongs
    to the only one there is. A mention with an initial, or the family name alone, goes to the one person it fits; if it
    fits several it stays alone (with its like).
    """
    number = [-1] * len(names)
    full = sorted((i for i, n in enumerate(names) if len(n[1]) > 1), key=lambda i: (not names[i][3], names[i][1], names[i][0]))
    groups: list[dict] = []  # members, givens, suffix, middles

    def fits(g: dict, i: int) -> bool:
        _, _, middle, suffix = names[i]
        return (not suffix or not g["suffix"] or suffix == g["suffix"]) and (not middle or not g["middles"] or middle in g["middles"])

    def put(g: dict, i: int) -> None:
        g["members"].append(i)
        g["givens"].add(names[i][1])
        g["suffix"] = g["suffix"] or names[i][3]
        if names[i][2]:
            g["middles"].add(names[i][2])

    def new(i: int) -> None:
        groups.append({"members": [], "givens": set(), "suffix": "", "middles": set()})
        put(groups[-1], i)

    for i in full:
        mine = [g for g in groups if any(_near_given(names[i][1], x) for x in g["givens"]) and fits(g, i)]
        exact = [g for g in mine if names[i][1] in g["givens"]]
        best = exact if exact else mine
        if len(best) == 1 or (best and len({g["suffix"] for g in best}) == 1):
            put(best[0], i)
        else:
            new(i)
    known = list(groups)
    for i in sorted((i for i, n in enumerate(names) if len(n[1]) == 1), key=lambda i: (names[i][1], names[i][3], names[i][0])):
        mine = [g for g in known if any(x[0] == names[i][1] for x in g["givens"]) and fits(g, i)]
        if len(mine) == 1:
            put(mine[0], i)
            continue
        like = [g for g in groups if g not in known and names[i][1] in g["givens"] and g["suffix"] == names[i][3]]
        if like:
            put(like[0], i)
        else:
            new(i)
    persons = list(groups)
    alone = [i for i, n in enumerate(names) if not n[1]]
    for i in alone:
        mine = [g for g in persons if fits(g, i)]
        if len(mine) == 1:
            mine[0]["members"].append(i)
        else:
            like = [g for g in groups if g not in persons]
            if like:
                put(like[0], i)
            else:
                new(i)
    for k, g in enumerate(groups):
        for i in g["members"]:
            number[i] = k
    return number


def _readings(name: str) -> list[tuple[str, str, str, str]]:
    """The readings of :func:`person`; a double family name is also looked up under each of its parts."""
    found = person(name)
    return found + [(g, m, part, s) for g, m, f, s in found if "-" in f and len(g) > 1 for part in f.split("-")]


def _pairs_at_business(ids: list, names: list[str]) -> list[tuple]:
    """(id_a, id_b), id_a < id_b, of the mentions (id, name) of one business, all of them."""
    of: dict[str, list] = {}
    for i, name in zip(ids, names):
        of.setdefault(name, []).append(i)
    if len(of) < 2:
        return []
    counted: dict[str, int] = {}
    readings = [(r, name) for name in of for r in _readings(name)]
    for (_, _, family, _), name in readings:
        counted[family] = counted.get(family, 0) + len(of[name])
    canon = canonical_of(counted)
    families: dict[str, list] = {}
    for (given, middle, family, suffix), name in readings:
        families.setdefault(canon[family], []).append((name, given, middle, suffix))
    out = set()
    for group in families.values():
        if len({g[0] for g in group}) < 2:
            continue
        group.sort()
        persons: dict[int, set[str]] = {}
        for k, g in zip(people(group), group):
            persons.setdefault(k, set()).add(g[0])
        for same in persons.values():
            for x in same:
                for y in same:
                    if x < y:
                        out.update((a, b) if a < b else (b, a) for a in of[x] for b in of[y] if a != b)
    return list(out)


def person_pairs(mentions: DataFrame, most: int = MENTIONS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: mentions at one business_key with names that differ as stored and mean the same person.

    Family names of a business are clustered by the trie join; the distinct names of one family at one business are
    then sorted out together. Null keys and names and names without a person have no pairs; repeated mentions
    all count. A business of at most ``most`` mentions is one row of one task; those with more go by tables.
    """
    rows = mentions.where("candidate_id IS NOT NULL AND business_key IS NOT NULL AND name IS NOT NULL").select(F.col("candidate_id").alias("id"), "business_key", "name")
    kind = rows.schema["id"].dataType.simpleString()

    @F.pandas_udf(f"array<struct<id_a:{kind},id_b:{kind}>>")
    def sort_out(ids: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([_pairs_at_business(i.tolist(), n.tolist()) for i, n in zip(ids, names)])

    many = rows.groupBy("business_key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("business_key")
    hot = many.limit(1).count() > 0  # a yes or no
    many = cut(many) if hot else many
    few = rows.join(many, "business_key", "left_anti") if hot else rows
    held = few.groupBy("business_key").agg(F.collect_list("id").alias("ids"), F.collect_list("name").alias("names")).where("size(ids) > 1")
    found = held.select(F.explode(once(sort_out)("ids", "names")).alias("p")).select("p.id_a", "p.id_b")
    return (found.unionByName(_pairs_by_tables(rows.join(many, "business_key", "left_semi"))) if hot else found).distinct()


def _pairs_by_tables(rows: DataFrame) -> DataFrame:
    """The pairs of :func:`person_pairs` at businesses of any size; ``rows``: (id, business_key, name)."""

    @F.pandas_udf("array<struct<given:string,middle:string,family:string,suffix:string>>")
    def read(names: pd.Series) -> pd.Series:
        return names.map(_readings)

    @F.pandas_udf("array<int>")
    def sort_out(groups: pd.Series) -> pd.Series:
        return pd.Series([people([(n["name"], n["given"], n["middle"], n["suffix"]) for n in g]) for g in groups])

    names = rows.groupBy("business_key", "name").agg(F.count("*").alias("n"))
    readings = cut(names.select("business_key", "name", "n", F.explode(read("name")).alias("r")).select("business_key", "name", "n", "r.*"))
    spelt = canonical_spellings(readings.select(F.col("business_key").alias("shard"), F.col("family").alias("text"), "n"))
    family = readings.join(spelt.select(F.col("shard").alias("business_key"), F.col("text").alias("family"), "canon"), ["business_key", "family"])
    entry = F.struct("name", "given", "middle", "suffix")
    packed = family.groupBy("business_key", "canon").agg(F.array_sort(F.collect_list(entry)).alias("g")).where("size(g) > 1")
    person_of = packed.withColumn("k", sort_out("g")).select("business_key", "canon", F.explode(F.arrays_zip(F.col("g.name").alias("name"), F.col("k").alias("k"))).alias("z"))
    members = cut(rows.join(person_of.select("business_key", "canon", F.col("z.name").alias("name"), F.col("z.k").alias("k")), ["business_key", "name"]).select("business_key", "canon", "k", "id", "name").distinct())
    x, y = members.alias("x"), members.alias("y")
    same = (F.col("x.business_key") == F.col("y.business_key")) & (F.col("x.canon") == F.col("y.canon")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id"))
    return x.join(y, same).where("x.name <> y.name").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b")).distinct()
