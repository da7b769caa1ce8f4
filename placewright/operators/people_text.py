"""People named by titles, mentions and texts: hygiene of names, titles, and owners told by search texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.text import name_tokens, normalize_name
from placewright.operators.mailboxes import local_part, person_locals
from placewright.operators.titles import RANK, mentions_in

#: Words that stand where a name should, and words of businesses that no person is called.
NO_NAMES = ("team", "staff", "office", "owner", "manager", "admin", "info", "support", "unknown", "none", "reception", "desk", "management", "customer", "service", "department", "the", "contact", "sales")
TRADES = ("llc", "inc", "services", "company", "clinic", "roofing", "plumbing", "bakery", "dental", "law", "electric", "repair", "salon", "spa", "moving", "coffee", "pest", "hospital", "group", "associates", "center", "shop", "market", "restaurant")
#: Trust in the kinds of search texts.
TOLD = {"answer": 3, "overview": 3, "knowledge": 3, "question": 2, "hit": 1}


def title_rank(title: Column) -> Column:
    """struct(title, rank): the longest known title that a written one contains as words; an unknown one keeps its spelling and has rank 30."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))
    out = F.struct(low.alias("title"), F.lit(30).alias("rank"))
    for known in sorted(RANK, key=lambda t: (len(t), t)):
        out = F.when(F.concat(F.lit(" "), F.regexp_replace(low, r"[^a-z\-]+", " "), F.lit(" ")).contains(f" {known} "), F.struct(F.lit(known).alias("title"), F.lit(RANK[known]).alias("rank"))).otherwise(out)
    return out


def person_words(name: Column | str) -> Column:
    """Words of a person's name without forms of address, degrees and notes in brackets."""
    bare = F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"\([^)]*\)|\"[^\"]*\"", " ")
    drop = ("mr", "mrs", "ms", "miss", "dr", "prof", "md", "dds", "dmd", "dvm", "dc", "phd", "esq", "cpa", "jr", "sr")
    return F.filter(name_tokens(bare), lambda t: ~t.isin(*drop))


def looks_like_person(name: Column | str) -> Column:
    """Two to four words, none of them a number, a role or a trade, at least one longer than a letter."""
    w = person_words(name)
    digits = (F.col(name) if isinstance(name, str) else name).rlike(r"\d")
    return F.coalesce(F.size(w).between(2, 4) & ~digits & ~F.exists(w, lambda t: t.isin(*NO_NAMES) | t.isin(*TRADES)) & F.exists(w, lambda t: F.length(t) > 1), F.lit(False))


def reranked(mentions: DataFrame, preferred: list[str]) -> DataFrame:
    """Mentions with one of the preferred titles, ranked by its place in the list: 100, 97, 94, ..."""
    spark = mentions.sparkSession
    wanted = spark.createDataFrame([(t.lower(), 100 - 3 * i) for i, t in enumerate(preferred)], "wanted string, new_rank int")  # as long as the list given
    return mentions.join(F.broadcast(wanted), F.lower(F.trim("title")) == F.col("wanted")).withColumn("rank", F.col("new_rank")).drop("wanted", "new_rank")


def told_owners(texts: DataFrame, businesses: DataFrame) -> DataFrame:
    """(business_key, name, title, rank, weight): people whom texts (business_key, kind, text) name with a role, where the text is about the business.

    A text is about a business if it holds the whole name or half of its words of three letters and more. A person called like
    the business is none. Joined on the key, containment after it.
    """
    named = businesses.where("key IS NOT NULL AND name IS NOT NULL").groupBy(F.col("key").alias("business_key")).agg(F.min(normalize_name("name")).alias("firm"))
    rows = texts.where("business_key IS NOT NULL AND text IS NOT NULL").withColumn("norm", normalize_name("text")).join(named, "business_key")
    words = F.filter(F.split("firm", " "), lambda t: F.length(t) >= 3)
    hits = F.size(F.filter(words, lambda t: F.contains(F.col("norm"), t)))
    about = F.contains(F.col("norm"), F.col("firm")) | ((F.size(words) > 0) & (2 * hits >= F.size(words)))
    kept = rows.where(about).select(F.monotonically_increasing_id().alias("row"), "business_key", "kind", "text", "firm")
    weight = F.lit(1)
    for kind, w in TOLD.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    people = mentions_in(kept.select(F.struct("row", "business_key", "kind", "firm").alias("of"), "text"), "of", "text").select("of.*", "name", "title", "rank")
    other = ~F.contains(F.col("firm"), normalize_name("name")) & looks_like_person("name")
    told = people.where(other).groupBy("business_key", "name", "row").agg(F.max(F.struct("rank", "title")).alias("m"), F.max(weight).alias("weight"))  # a text counts once
    return told.groupBy("business_key", "name").agg(F.max("m").alias("m"), F.sum("weight").alias("weight")).select("business_key", "name", "m.title", "m.rank", "weight")


def addresses_of(people: DataFrame, texts: DataFrame) -> DataFrame:
    """(business_key, name, email): addresses in texts of a business whose local part spells one of its people."""
    found = texts.where("business_key IS NOT NULL AND text IS NOT NULL").select("business_key", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24})"), 1)).alias("email"))
    boxes = found.select("business_key", F.lower("email").alias("email"), F.regexp_replace(local_part("email"), "[^a-z]", "").alias("spelt")).distinct()
    spelt = people.select("business_key", "name", F.explode(person_locals("name")).alias("l")).select("business_key", "name", F.regexp_replace("l", "[^a-z]", "").alias("spelt")).where("length(spelt) >= 3").distinct()
    return boxes.join(spelt, ["business_key", "spelt"]).select("business_key", "name", "email").distinct()
