"""Best representative of each duplicate group (problem 6): token-level consensus.

The values of a group are split into tokens and aligned progressively: in order of weight each value is aligned to the
growing profile by dynamic programming over tokens. Every column of the profile is voted by weight, and of the existing
values the one closest to the winning sequence survives.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.contact import phone_digits, website_host
from placewright.session import cut

#: Values aligned in one task; larger groups are aligned in blocks of this size whose profiles are aligned again.
BLOCK = 256


def _align(profile: list[dict], tokens: list[dict]) -> list[dict]:
    """Align two profiles (columns of token -> weight; "" is a gap) and add their votes."""
    n, m = len(profile), len(tokens)
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        score[i][0] = -i
    for j in range(1, m + 1):
        score[0][j] = -j
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            same = 2.0 if profile[i - 1].keys() & tokens[j - 1].keys() - {""} else -0.5
            score[i][j] = max(score[i - 1][j - 1] + same, score[i - 1][j] - 1, score[i][j - 1] - 1)
    out, i, j = [], n, m
    while i or j:
        if i and j:
            same = 2.0 if profile[i - 1].keys() & tokens[j - 1].keys() - {""} else -0.5
            if score[i][j] == score[i - 1][j - 1] + same:
                out.append((profile[i - 1], tokens[j - 1]))
                i, j = i - 1, j - 1
                continue
        if i and score[i][j] == score[i - 1][j] - 1:
            out.append((profile[i - 1], None))
            i -= 1
        else:
            out.append((None, tokens[j - 1]))
            j -= 1
    return out[::-1]


def _weight(a, b):
    """Votes add up as (recency, support): recency outweighs all older votes together, support adds."""
    return a if b is None else b if a is None else [max(a[0], b[0]), a[1] + b[1]]


def _merge(profiles: list[tuple[list[dict], list]]) -> tuple[list[dict], list]:
    """Progressive alignment, heaviest profile first. A profile goes with its total weight, the weight of its gaps."""
    profiles = sorted(profiles, key=lambda p: p[1], reverse=True)
    done, total = profiles[0]
    for cols, weight in profiles[1:]:
        merged = []
        for a, b in _align(done, cols):
            a, b = a or {"": total}, b or {"": weight}
            merged.append({t: _weight(a.get(t), b.get(t)) for t in a.keys() | b.keys()})
        done, total = merged, _weight(total, weight)
    return done, total


def _consensus(profile: list[dict], by: str) -> list[str]:
    pick = (lambda w: (w[0], w[1])) if by == "recency" else (lambda w: (w[1], w[0]))
    return [t for t in (max(col.items(), key=lambda x: (pick(x[1]), x[0]))[0] for col in profile) if t]


def _distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _as_profile(v) -> tuple[list[dict], list]:
    w = [[v["stamp"], -v["id"]], v["n"]]
    return [{t: w} for t in v["tokens"]], w


def _nearest(values, consensus: list[str]):
    return min(values, key=lambda v: (_distance(list(v["tokens"]), consensus), -v["stamp"], v["id"]))["id"]


def consensus_survivor(values: DataFrame, by: str = "recency", block: int = BLOCK) -> DataFrame:
    """``values``: (key, field, id, tokens array<string>, stamp bigint) -> (key, field, id): the survivor of each group.

    ``by="recency"``: one vote outweighs all votes of older stamps together (equal stamps: the smaller id).
    ``by="support"``: votes count the rows that carry a value, recency breaks ties. A null stamp is the earliest.
    The row returned is the one closest to the consensus; of equals the latest stamp, then the smallest id.
    Rows equal in tokens are combined before the first shuffle; a group of more than ``block`` different values is
    aligned in hash blocks and block profiles are aligned again in two more rounds, so that no task holds a whole group.
    Rows with null key or null/empty tokens do not count. Repeated rows are one vote each; no rows give no rows.
    """
    earliest = -(2**63) + 1
    stamped = (
        values.where("key IS NOT NULL AND id IS NOT NULL AND tokens IS NOT NULL AND size(tokens) > 0")
        .select("key", "field", "tokens", F.coalesce("stamp", F.lit(earliest)).alias("stamp"), "id")
        .groupBy("key", "field", "tokens")
        .agg(F.max(F.struct("stamp", (-F.col("id")).alias("neg"))).alias("m"), F.count("*").alias("n"))
        .select("key", "field", "tokens", F.col("m.stamp").alias("stamp"), (-F.col("m.neg")).alias("id"), "n")
    )
    stamped = cut(stamped)  # read three times below, made once
    sizes = stamped.groupBy("key", "field").agg(F.count("*").alias("values"), F.min("id").alias("only"))
    small_ids = sizes.where("values = 1").select("key", "field", F.col("only").alias("id"))
    several = stamped.join(sizes.where("values > 1").select("key", "field", "values"), ["key", "field"])
    packed = F.collect_list(F.struct("tokens", "stamp", "id", "n")).alias("vs")

    @F.pandas_udf("long")
    def survivor(groups: pd.Series) -> pd.Series:
        return pd.Series([_nearest(vs, _consensus(_merge([_as_profile(v) for v in vs])[0], by)) for vs in groups])

    @F.pandas_udf("string")
    def profile(groups: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(_merge([_as_profile(v) for v in vs])) for vs in groups])

    @F.pandas_udf("string")
    def remerge(groups: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(_merge([tuple(json.loads(p)) for p in ps])) for ps in groups])

    @F.pandas_udf("array<string>")
    def decide(profiles: pd.Series) -> pd.Series:
        return pd.Series([_consensus(json.loads(p)[0], by) for p in profiles])

    @F.pandas_udf("int")
    def far(tokens: pd.Series, consensus: pd.Series) -> pd.Series:
        return pd.Series([_distance(list(a), list(b)) for a, b in zip(tokens, consensus)])

    one_task = several.where(F.col("values") <= block).groupBy("key", "field").agg(packed).select("key", "field", survivor("vs").alias("id"))

    large = several.where(F.col("values") > block).withColumn("h", F.xxhash64("tokens"))
    blocks = F.ceil(F.col("values") / block)
    level1 = (
        large.groupBy("key", "field", F.pmod("h", blocks).alias("b1"), F.ceil(blocks / block).alias("nb"))
        .agg(packed).select("key", "field", F.pmod(F.xxhash64("b1"), "nb").alias("b2"), profile("vs").alias("p"))
    )
    level2 = level1.groupBy("key", "field", "b2").agg(F.collect_list("p").alias("ps")).select("key", "field", remerge("ps").alias("p"))
    agreed = level2.groupBy("key", "field").agg(F.collect_list("p").alias("ps")).select("key", "field", decide(remerge("ps")).alias("consensus"))
    chosen = (
        large.join(agreed, ["key", "field"])
        .select("key", "field", F.struct((-far("tokens", "consensus")).alias("d"), "stamp", (-F.col("id")).alias("neg")).alias("s"))
        .groupBy("key", "field").agg(F.max("s").alias("s")).select("key", "field", (-F.col("s.neg")).alias("id"))
    )
    return small_ids.unionByName(one_task).unionByName(chosen)


def contact_values(businesses: DataFrame) -> DataFrame:
    """Usable phones and websites of listings as values for :func:`consensus_survivor`."""
    phone = phone_digits("phone")
    host = website_host("website")
    fields: list[tuple[str, Column, Column]] = [
        ("phone", phone, F.array(F.substring(phone, 1, 3), F.substring(phone, 4, 3), F.substring(phone, 7, 4))),
        ("website", host, F.filter(F.split(host, r"[.\-]"), lambda t: t != "")),
    ]
    base = businesses.select("key", F.col("business_id").alias("id"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("stamp"), "phone", "website")
    parts = [F.when(ok.isNotNull(), F.struct(F.lit(f).alias("field"), tokens.alias("tokens"))) for f, ok, tokens in fields]
    return base.select("key", "id", "stamp", F.explode(F.array_compact(F.array(*parts))).alias("v")).select("key", "id", "stamp", "v.field", "v.tokens")


def surviving_contacts(businesses: DataFrame) -> DataFrame:
    """(key, field, business_id): the row whose phone and the row whose website stand for each key of two or more rows."""
    repeated = businesses.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    winners = consensus_survivor(contact_values(businesses).join(repeated, "key", "left_semi"))
    return winners.select("key", "field", F.col("id").alias("business_id"))
