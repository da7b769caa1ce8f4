"""One person out of many mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions.text import normalize_name


def mention_support(mentions: DataFrame) -> DataFrame:
    """One row per business and normalised name: best rank, summed weight, sources, mentions; score = 10 rank + 4 support + 3 sources."""
    named = mentions.withColumn("person", normalize_name("name")).where("business_key IS NOT NULL AND person <> ''")
    grouped = named.groupBy("business_key", "person").agg(
        F.max("rank").alias("rank"), F.sum(F.coalesce("weight", F.lit(1))).alias("support"), F.count_distinct("source").alias("sources"), F.count("*").alias("mentions"), F.min(F.coalesce("loose", F.lit(False))).alias("all_loose")
    )
    return grouped.withColumn("score", F.coalesce("rank", F.lit(0)) * 10 + F.col("support") * 4 + F.col("sources") * 3)


def choose_person(mentions: DataFrame) -> DataFrame:
    """(business_key, person, rank, support, score, rivals): the best supported person of each business, none where two with
    different first names are level in rank and support."""
    s = mention_support(mentions)
    w = Window.partitionBy("business_key").orderBy(F.col("score").desc(), "person")
    ranked = s.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead(F.struct("rank", "support", "person")).over(w))
    rivals = s.groupBy("business_key", "rank").agg(F.count("*").alias("rivals"))
    first = lambda c: F.split(c, " ")[0]
    level = (F.col("next.rank") == F.col("rank")) & (F.col("next.support") == F.col("support")) & (first(F.col("next.person")) != first(F.col("person")))
    best = ranked.where(F.col("rn") == 1).where(~F.coalesce(level, F.lit(False)))
    return best.join(rivals, ["business_key", "rank"]).select("business_key", "person", "rank", "support", "score", "rivals")
