"""Brands: names that stand in many places, and listings that belong to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions.text import brand_display_name, name_tokens, normalize_name
from placewright.functions.urls import hostname


def brand_table(businesses: DataFrame, cities: int = 3) -> DataFrame:
    """(brand, cities): display names without store numbers that stand in at least ``cities`` cities. A given brand list can take its place."""
    named = businesses.select(normalize_name(brand_display_name("name")).alias("brand"), F.lower(F.trim("city")).alias("city")).where("brand <> '' AND city <> ''")
    return named.groupBy("brand").agg(F.count_distinct("city").alias("cities")).where(F.col("cities") >= cities)


def prefix_lookup(businesses: DataFrame, brands: DataFrame) -> DataFrame:
    """(business_id, brand, kind): the brand a name equals, else the longest one of four to two leading words, else a leading word of five letters."""
    words = name_tokens(brand_display_name("name"))
    whole = F.struct(F.lit(9).alias("n"), F.array_join(words, " ").alias("brand"))
    parts = [F.when((F.size(words) > n) & ((n > 1) | (F.length(F.get(words, F.lit(0))) > 4)), F.struct(F.lit(n).alias("n"), F.array_join(F.slice(words, 1, n), " ").alias("brand"))) for n in (4, 3, 2, 1)]
    tries = businesses.where("business_id IS NOT NULL").select("business_id", F.explode(F.array_compact(F.array(whole, *parts))).alias("t")).select("business_id", "t.n", "t.brand")
    w = Window.partitionBy("business_id").orderBy(F.col("n").desc())
    hit = tries.join(brands.select("brand"), "brand").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return hit.select("business_id", "brand", F.when(F.col("n") == 9, "exact").otherwise("prefix").alias("kind"))


def shared_domains(businesses: DataFrame, cities: int = 3) -> DataFrame:
    """(domain, cities, listings): hosts (without www) used in many cities."""
    d = businesses.select(F.regexp_replace(hostname("website"), "^www[.]", "").alias("domain"), F.lower(F.trim("city")).alias("city")).where("domain LIKE '%.%'")
    return d.groupBy("domain").agg(F.count_distinct("city").alias("cities"), F.count("*").alias("listings")).where(F.col("cities") >= cities)
