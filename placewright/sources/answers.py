"""Answers of listing services: failures, honest emptiness, tools and their arguments, pages until nothing new comes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words by which a body with status 200 tells of a failure.
FAILURES = ("error", "unauthorized", "forbidden", "invalid api key", "quota", "rate limit", "too many requests", "payment required", "exception")
#: What the name and description of a tool promise, and how much.
TOOL_HINTS = {"maps": 5, "places": 5, "local": 5, "business": 5, "search": 3, "google": 2}
#: Names of the argument that takes the search.
QUERY_ARGUMENTS = ("query", "q", "search", "searchquery", "search_query", "keyword", "keywords", "text", "term")


def classify(payload: Column) -> Column:
    """'failure' for answers that carry an error or no JSON, 'empty' for honest lists of nothing, else 'rows'."""
    body = F.lower(F.trim(F.coalesce(payload, F.lit(""))))
    told = F.lower(F.coalesce(*(F.get_json_object(payload, f"$.{k}") for k in ("error", "errors", "error_message", "message"))))
    failed = (body == "") | ~body.rlike(r"^[\[{]") | F.coalesce(~told.isin("", "null", "[]", "{}", "false") & (F.get_json_object(payload, "$.error").isNotNull() | told.rlike("|".join(FAILURES))), F.lit(False))
    lists = F.coalesce(*(F.get_json_object(payload, f"$.{k}") for k in ("results", "local_results", "places", "data", "items")), F.when(body.startswith("["), payload))
    return F.when(failed, "failure").when(F.coalesce(F.trim(lists), F.lit("[]")).isin("[]", "{}", "null", ""), "empty").otherwise("rows")


def pick_tool(tools: DataFrame) -> DataFrame:
    """(server, name, score): of the tools (server, name, description, arguments) of each server the one that looks most like a search of listings; none without a query argument or promise."""
    text = F.lower(F.concat_ws(" ", "name", "description"))
    score = F.lit(0)
    for hint, points in TOOL_HINTS.items():
        score = score + F.when(text.contains(hint), points).otherwise(0)
    takes = F.exists("arguments", lambda a: F.lower(a).isin(*QUERY_ARGUMENTS))
    score = score + F.when(takes, 4).otherwise(0) - F.when(F.lower("name").rlike("detail|review|photo"), 6).otherwise(0)
    w = Window.partitionBy("server").orderBy(F.col("score").desc(), "name")
    return tools.withColumn("score", score).withColumn("_n", F.row_number().over(w)).where("_n = 1 AND score > 0").select("server", "name", "score")


def tool_arguments(schema: dict, query: str, limit: int) -> dict:
    """Arguments of a tool from its JSON schema: the search, the number of rows where it takes one, and its required defaults."""
    out: dict = {}
    fields = schema.get("properties") or {}
    for name, spec in fields.items():
        low = name.lower()
        if low in QUERY_ARGUMENTS:
            out[name] = [query] if spec.get("type") == "array" else query
        elif low in {"limit", "num", "max_results", "count", "maxcrawledplacespersearch"}:
            out[name] = limit
        elif name in (schema.get("required") or []) and "default" in spec:
            out[name] = spec["default"]
    return out


def pages_until_known(pages: DataFrame, key: str) -> DataFrame:
    """Rows (query, page, ...) of listing pages up to the first page of a query that brings no key not seen on its earlier pages."""
    first = pages.where(F.col(key).isNotNull()).groupBy("query", key).agg(F.min("page").alias("page"))
    fresh = first.groupBy("query", "page").agg(F.count("*").alias("fresh"))
    every = pages.select("query", "page").distinct().join(fresh, ["query", "page"], "left").na.fill(0, ["fresh"])
    stop = every.where("fresh = 0").groupBy("query").agg(F.min("page").alias("stop"))
    return pages.join(stop, "query", "left").where("stop IS NULL OR page < stop").drop("stop")


def generic_config(payload: str, paths: dict[str, tuple[str, ...]]) -> str:
    """A field map (JSON) for an unknown source: for each field the first of its paths that a sample object answers."""
    try:
        sample = json.loads(payload)
    except ValueError:
        return "{}"

    def at(node, path: str):
        for part in path.replace("[0]", ".0").split("."):
            node = node[int(part)] if isinstance(node, list) and part.isdigit() and int(part) < len(node) else node.get(part) if isinstance(node, dict) else None
            if node is None:
                return None
        return node

    found = {field: next((p for p in options if at(sample, p) not in (None, "", [], {})), None) for field, options in paths.items()}
    return json.dumps({k: v for k, v in found.items() if v})
