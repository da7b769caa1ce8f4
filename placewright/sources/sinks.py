"""Tables out: CSV and JSON files, appends, annotated copies."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sink(Protocol):
    def upsert(self, rows: DataFrame, status: str) -> None: ...


class NullSink:
    def upsert(self, rows: DataFrame, status: str) -> None:
        return None


class TableSink:
    """Appends rows with their stage to a Parquet folder; readers take the latest row of each id."""

    def __init__(self, path: str):
        self.path = path

    def upsert(self, rows: DataFrame, status: str) -> None:
        rows.withColumn("status", F.lit(status)).write.mode("append").parquet(self.path)


def rendered(df: DataFrame) -> DataFrame:
    """Every column as text for people: yes/no for booleans, arrays joined by "; ", nulls empty."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind == "boolean":
            c = F.when(c, "yes").when(~c, "no")
        elif kind.startswith("array<string"):
            c = F.array_join(c, "; ")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    rendered(df).write.mode(mode).csv(path, header=True, escape='"', emptyValue="")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty text becomes null, as live tables keep it."""
    return df.select(*(F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema.fields))
