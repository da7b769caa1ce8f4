"""Rows that leave the engine: one for each business, contact or address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GUESSED = "permutation"


def clean_addresses(emails: DataFrame) -> DataFrame:
    """Addresses trimmed and in lower case, one row for each key and address: that of the highest confidence (ties: source, then status)."""
    rows = emails.where("business_key IS NOT NULL AND email IS NOT NULL").withColumn("email", F.lower(F.trim("email"))).where("email <> ''")
    w = Window.partitionBy("business_key", "email").orderBy(F.col("confidence").desc_nulls_last(), F.col("source").asc_nulls_last(), F.col("status").asc_nulls_last(), F.col("contact_type").asc_nulls_last(), F.col("contact_name").asc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lead_contacts(addresses: DataFrame, eligible: Column, owner_types: tuple[str, ...] = ("owner", "manager"), lead: int = 5) -> DataFrame:
    """(business_key, email, confidence, contact_type, is_owner, is_best): the best eligible address of an owner and the best other one of each key.

    Ties go to the smaller address. One address for both is the owner's. The owner's is the best overall unless the other is more confident by more than ``lead``.
    """
    rows = addresses.where(eligible & F.col("confidence").isNotNull()).withColumn("is_owner", F.coalesce(F.col("contact_type").isin(*owner_types), F.lit(False)))
    w = Window.partitionBy("business_key", "is_owner").orderBy(F.col("confidence").desc(), "email")
    top = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    by = Window.partitionBy("business_key")
    top = top.withColumn("_o", F.max(F.when(F.col("is_owner"), F.col("confidence"))).over(by)).withColumn("_g", F.max(F.when(~F.col("is_owner"), F.col("confidence"))).over(by))
    owner_wins = F.col("_g").isNull() | (F.col("_o") >= F.col("_g") - lead)
    best = F.when(F.col("is_owner"), owner_wins).otherwise(F.col("_o").isNull() | ~owner_wins)
    return top.select("business_key", "email", "confidence", "contact_type", "is_owner", best.alias("is_best"))


def business_rows(businesses: DataFrame, addresses: DataFrame, leads: DataFrame) -> DataFrame:
    """One row for each key: its latest listing (ties: larger id) with counts of found and guessed addresses, all of them joined, and its best."""
    latest = businesses.where("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct("name", "phone", "website", "city", "state"), F.struct(F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp_ntz")), "business_id")).alias("b"))
    guessed = F.coalesce(F.col("source") == GUESSED, F.lit(False))
    mail = addresses.groupBy(F.col("business_key").alias("key")).agg(F.count_if(~guessed).alias("emails_found"), F.count_if(guessed).alias("emails_guessed"), F.array_join(F.array_sort(F.collect_list("email")), "; ").alias("all_emails"))
    best = leads.where("is_best").select(F.col("business_key").alias("key"), F.col("email").alias("best_email"), F.col("confidence").alias("best_confidence"))
    zero = {"emails_found": 0, "emails_guessed": 0, "all_emails": "", "best_email": ""}
    return latest.select("key", "b.*").join(mail, "key", "left").join(best, "key", "left").na.fill(zero)


def lead_rows(listed: DataFrame, leads: DataFrame) -> DataFrame:
    """A row for each contact of a business; a business without has one row without contact."""
    contact = leads.select(F.col("business_key").alias("key"), "email", "confidence", "contact_type")
    return listed.select("key", "name", "city", "state").join(contact, "key", "left")


def nested(listed: DataFrame, addresses: DataFrame) -> DataFrame:
    """(key, json): a business with its addresses as one JSON object, addresses in order."""
    mail = addresses.groupBy(F.col("business_key").alias("key")).agg(F.array_sort(F.collect_list(F.struct("email", "status", "confidence"))).alias("emails"))
    whole = listed.join(mail, "key", "left")
    return whole.select("key", F.to_json(F.struct("key", "name", "city", "state", F.coalesce("emails", F.array()).alias("emails"))).alias("json"))
