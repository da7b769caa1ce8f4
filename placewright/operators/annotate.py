"""Verdicts for the addresses of an arbitrary table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ADDRESS = r"([A-Za-z0-9._%+\-']+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"


def cell_addresses(cell: Column) -> Column:
    """Addresses of a cell, lower case, first seen first."""
    found = F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(_ADDRESS), 1)
    return F.array_distinct(F.transform(found, lambda e: F.lower(F.regexp_replace(e, r"^[.']+|[.']+$", ""))))


def annotate(table: DataFrame, cell: str, verdicts: DataFrame, keep: tuple[str, ...] = ("valid",), row_id: str = "_row") -> DataFrame:
    """``table`` with verified_email, verify_status and verify_message.

    Each different address meets the verdict table once. A row shows its kept addresses joined by "; ", else the verdict of its
    first address; "no-email" without any, "not checked" without a verdict. Columns of the table are kept as they are.
    """
    rows = table.withColumn(row_id, F.monotonically_increasing_id()) if row_id not in table.columns else table
    items = rows.select(row_id, F.posexplode(cell_addresses(F.col(cell))).alias("pos", "email"))
    v = verdicts.select(F.lower("email").alias("email"), F.col("status").alias("_s"), F.col("message").alias("_m")).dropDuplicates(["email"])
    met = items.join(v, "email", "left")
    kept = F.when(F.col("_s").isin(*keep), F.struct("pos", "email", "_s", "_m"))
    per_row = met.groupBy(row_id).agg(F.array_sort(F.collect_list(kept)).alias("k"), F.min(F.struct("pos", "email", "_s", "_m")).alias("f"))
    first = F.when(F.size("k") > 0, F.get("k", F.lit(0))).otherwise(F.col("f"))
    shown = per_row.select(row_id, F.array_join(F.transform("k", lambda s: s["email"]), "; ").alias("verified_email"), F.coalesce(first["_s"], F.lit("not checked")).alias("verify_status"), F.coalesce(first["_m"], F.lit("")).alias("verify_message"))
    return rows.join(shown, row_id, "left").na.fill({"verified_email": "", "verify_status": "no-email", "verify_message": ""})


def broadcast_verdicts(emails: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every row with the verdict of its address; addresses are asked for once and the answers joined back."""
    asked = emails.select(F.lower(F.trim("email")).alias("address")).where("address <> ''").distinct()
    known = asked.join(verdicts.withColumnRenamed("email", "address"), "address", "left")
    return emails.withColumn("address", F.lower(F.trim("email"))).join(known, "address", "left")
