"""Cached and incremental state: look-ups with a time to live, keyed upserts, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(cache: DataFrame, at: str, now: Column, ttl_hours: float) -> DataFrame:
    """Rows of a cache that are not older than ``ttl_hours``; a null time is expired. The filter reaches the scan."""
    return cache.where(F.col(at) >= now - F.expr(f"INTERVAL {int(ttl_hours * 3600)} SECONDS"))


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: str, at: str, now: Column, ttl_hours: float) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): wanted rows with their newest fresh cache row, and those without any."""
    newest = latest_by(fresh(cache, at, now, ttl_hours).where(F.col(key).isNotNull()), [key], [F.col(at).desc()])
    return wanted.join(newest, key), wanted.join(newest.select(key), key, "left_anti")


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of every key in ``order``; the optimiser's group limit keeps one row a key on each map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def not_seen(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not finished yet (resume)."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def partial_upsert(writes: DataFrame, key: str, order: list[Column], first_wins: list[str], last_wins: list[str]) -> DataFrame:
    """Table after all writes in ``order``: some columns keep the value of a key's first write, the others take that of the last.

    Values are taken as written, nulls too. One aggregation with map-side combine: no group is held in memory.
    """
    mark = F.struct(*order)
    aggs = [F.min_by(F.struct(F.col(c)), mark)[c].alias(c) for c in first_wins] + [F.max_by(F.struct(F.col(c)), mark)[c].alias(c) for c in last_wins]
    return writes.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def coalesce_upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Facts by key: a new value replaces the old one unless it is null."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns))


def early_stop(df: DataFrame, group: list[str], order: list[Column], hit: Column) -> DataFrame:
    """Rows of each group in ``order`` up to and including the first ``hit``: a running maximum over the rows before."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.max(F.coalesce(hit, F.lit(False)).cast("int")).over(w), F.lit(0))).where("_before = 0").drop("_before")


def rollup(df: DataFrame, keys: list[str], value: str, order: list[str], sep: str = "; ", out: str = "joined") -> DataFrame:
    """Values of each group joined in order; null and empty values are left out."""
    items = F.collect_list(F.when(F.coalesce(F.col(value).cast("string"), F.lit("")) != "", F.struct(*order, F.col(value).cast("string").alias("_v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(items), lambda s: s["_v"]), sep).alias(out))


def moving_average(df: DataFrame, order: str, value: str, rows: int = 12) -> DataFrame:
    """Average of the last ``rows`` rows, for small ordered series such as batches of a run."""
    w = Window.orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("pace", F.avg(value).over(w))
