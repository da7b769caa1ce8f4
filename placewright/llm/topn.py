"""Top N items of every group (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_email(email: Column | str) -> Column:
    """Trimmed (any white space, no-break spaces included) and lower case."""
    col = F.col(email) if isinstance(email, str) else email
    return F.lower(F.regexp_replace(col, r"(?U)^[\s ﻿​]+|[\s ﻿​]+$", ""))


def top_n_per_group(df: DataFrame, group: list[str], score: str, tie: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of every group by ``score`` descending, then ``tie`` ascending (byte order for strings).

    A plain ``row_number`` filter: the optimiser turns ``rank <= n`` into a group limit that keeps ``n`` rows of a
    group on each map task before the shuffle and again after it, so a group of any size costs its reducer
    ``n`` rows for each map task. ``tie`` must identify a row within its group, else the choice between equal rows is open.
    The rank comes out as ``rank``.
    """
    order = [F.col(score).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in tie)]
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best_emails(emails: DataFrame, n: int = 3) -> DataFrame:
    """(business_key, email, confidence, rank): the ``n`` best addresses of every business.

    Rows equal in key and cleaned address are one item with their highest confidence. Rows with a null key or
    confidence, or a null or blank address, do not count; an empty table gives no rows; further columns are ignored.
    """
    items = (
        emails.select("business_key", clean_email("email").alias("email"), "confidence")
        .where("business_key IS NOT NULL AND confidence IS NOT NULL AND email IS NOT NULL AND email <> ''")
        .groupBy("business_key", "email")
        .agg(F.max("confidence").alias("confidence"))
    )
    return top_n_per_group(items, ["business_key"], "confidence", ["email"], n)
