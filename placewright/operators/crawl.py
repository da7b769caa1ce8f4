"""A crawl over captured pages: which pages of a site are read, and where reading stops; people whom a page names in its structured data."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.operators.extract import extract_emails, read_page
from placewright.session import once

#: Words in the path of a page that promise contacts, best first, and those that promise none.
PROMISING = ("contact", "about", "team", "staff", "people", "owner", "story", "location", "impressum")
BARREN = ("blog", "news", "privacy", "terms", "cart", "login", "tag", "category", "careers")
#: Hosts of profiles.
PROFILES = "facebook instagram linkedin twitter x".split()


def page_score(url: Column) -> Column:
    """What a page promises by its path: 60 for the first word of PROMISING down to 10, less 5 for each level, less 30 for a barren word; the front page 45."""
    path = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1), r"/+$", ""))
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    best = F.lit(0)
    for i, word in reversed(list(enumerate(PROMISING))):
        best = F.when(path.contains(word), max(60 - 8 * i, 10)).otherwise(best)
    bad = path.rlike("|".join(f"/{w}(/|$|-)" for w in BARREN))
    return F.when(path == "", 45).otherwise(best - 5 * depth - F.when(bad, 30).otherwise(0))


def crawl_sites(pages: DataFrame, most: int = 8) -> DataFrame:
    """(site, page_id, visit, emails): the pages read of each site, in order of promise (ties: shorter URL, smaller id), up to the first that
    shows an address of the site's own domain, ``most`` at most. Pages without answer or html are not read."""
    ok = pages.where("site IS NOT NULL AND html IS NOT NULL AND status BETWEEN 200 AND 399").select("site", "page_id", F.coalesce("final_url", "url", F.lit("")).alias("at"))
    host = F.regexp_replace(F.lower("site"), r"^(?:[a-z]+://)?(?:www\.)?", "")
    found = extract_emails(pages).select("page_id", "email")
    own = ok.join(found, "page_id").where(F.col("email").endswith(F.concat(F.lit("@"), host)) | F.col("email").endswith(F.concat(F.lit("."), host))).groupBy("page_id").agg(F.count_distinct("email").alias("emails"))
    w = Window.partitionBy("site").orderBy(page_score(F.col("at")).desc(), F.length("at"), "page_id")
    ordered = ok.withColumn("visit", F.row_number().over(w)).where(F.col("visit") <= most)
    seen = ordered.join(own, "page_id", "left").na.fill(0, ["emails"])
    before = F.coalesce(F.max(F.col("emails") > 0).over(Window.partitionBy("site").orderBy("visit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return seen.withColumn("_stop", before).where("NOT _stop").select("site", "page_id", "visit", "emails")


def profile_links(pages: DataFrame, most: int = 6) -> DataFrame:
    """(page_id, href, pos): the first links of a page to profiles on social hosts."""

    @F.pandas_udf("array<string>")
    def links(html: pd.Series) -> pd.Series:
        out = []
        for page in html:
            hrefs = [a[0] for a in read_page(page).links]
            out.append([h for h in hrefs if re.match(rf"(?i)https?://(?:www\.|[a-z]{{2}}\.)?(?:{'|'.join(PROFILES)})\.com(?:[/?#]|$)", h)][:most])
        return pd.Series(out)

    return pages.where("html IS NOT NULL").select("page_id", F.posexplode(once(links)("html")).alias("pos", "href"))


_PEOPLE = {"founder", "founders", "owner", "employee", "employees", "member", "members", "author"}


def _persons(node, role: str = "", depth: int = 0):
    """(name, title, role) of the people in structured data."""
    if depth > 8:
        return
    if isinstance(node, list):
        for x in node:
            yield from _persons(x, role, depth + 1)
        return
    if isinstance(node, str):
        if role and node.strip():
            yield " ".join(node.split()), "", role
        return
    if not isinstance(node, dict):
        return
    kind = node.get("@type")
    kinds = {str(k).lower() for k in (kind if isinstance(kind, list) else [kind])}
    if ("person" in kinds or role) and isinstance(node.get("name"), str) and node["name"].strip():
        yield " ".join(node["name"].split()), " ".join(str(node.get("jobTitle") or "").split()), role
    for key, value in node.items():
        if key.lower() in _PEOPLE:
            yield from _persons(value, key.lower().rstrip("s"), depth + 1)
        elif isinstance(value, dict | list):
            yield from _persons(value, "", depth + 1)


def structured_people(pages: DataFrame) -> DataFrame:
    """(page_id, name, title, role): people in the JSON-LD bodies of pages, as founder, owner, employee, member or author of something, or for themselves."""

    @F.pandas_udf("array<struct<name:string,title:string,role:string>>")
    def people(html: pd.Series) -> pd.Series:
        out = []
        for page in html:
            found: dict[tuple, None] = {}
            for body in read_page(page).jsonld if page and "ld+json" in page else ():
                try:
                    for p in _persons(json.loads(body)):
                        found[p] = None
                except ValueError:
                    continue
            out.append(list(found))
        return pd.Series(out)

    return pages.where("html IS NOT NULL").select("page_id", F.explode(once(people)("html")).alias("p")).select("page_id", "p.*")
