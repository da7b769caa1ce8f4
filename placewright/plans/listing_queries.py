"""Queries over listings: text functions, keys, joins, caches, upserts and rollups, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placewright.functions import text as T
from placewright.functions import urls as U
from placewright.operators import annotate, brands, extract, owners, payloads, state
from placewright.session import table

NOW = "TIMESTAMP '2025-06-01 00:00:00'"


def _b(s, d):
    return table(s, d, "businesses")


def squeeze(s, d):
    return table(s, d, "owner_candidates").select("candidate_id", T.squeeze("name").alias("name"))


def normalize_name(s, d):
    return _b(s, d).select("business_id", T.normalize_name("name").alias("name"))


def name_tokens(s, d):
    words = _b(s, d).select(F.explode(T.name_tokens("name")).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def split_locality(s, d):
    p = table(s, d, "places")
    return p.select("listing_id", T.split_locality(F.col("city"), F.col("state"), F.col("postal_code"), F.col("address")).alias("l")).select("listing_id", "l.*")


def city_from_address(s, d):
    return _b(s, d).select("business_id", T.city_from_address("address").alias("city"))


def state_from(s, d):
    return _b(s, d).select("business_id", T.state_from("address").alias("state"))


def clean_state(s, d):
    return _b(s, d).select("business_id", T.clean_state("state").alias("state"))


def format_phone(s, d):
    return _b(s, d).select("business_id", T.format_phone("phone").alias("phone"))


def split_name(s, d):
    return table(s, d, "owner_candidates").select("candidate_id", T.split_name("name").alias("n")).select("candidate_id", "n.first", "n.rest")


def dedupe_key(s, d):
    c = F.col
    return _b(s, d).select("business_id", T.dedupe_key(c("place_id"), c("phone"), c("name"), c("address"), c("domain")).alias("dedupe_key"))


def brand_display_name(s, d):
    return _b(s, d).select("business_id", T.brand_display_name("name").alias("brand"))


def normalize_url(s, d):
    return _b(s, d).select("business_id", U.normalize_url("website").alias("url"))


def hostname(s, d):
    return _b(s, d).select("business_id", U.hostname("website").alias("host"))


def registered_domain(s, d):
    return _b(s, d).select(U.registered_domain("website").alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


def same_site(s, d):
    p = table(s, d, "pages")
    return p.select("page_id", U.same_site(F.col("url"), F.col("site")).alias("same"))


def parse_query(s, d):
    return _b(s, d).where("query IS NOT NULL").select("query").distinct().select("query", T.parse_query("query").alias("q")).select("query", "q.*")


def fmt_duration(s, d):
    return table(s, d, "documents").select("doc_id", T.fmt_duration(F.col("n_chars")).alias("duration"))


def trim_context(s, d):
    docs = table(s, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", T.trim_context("text", F.instr("text", "@"), 20).alias("context")).where("context IS NOT NULL")


def text_addresses(s, d):
    return extract.text_addresses(table(s, d, "documents"), "doc_id", "text")


def page_hrefs(s, d):
    return extract.href_links(table(s, d, "pages"))


def rank_links(s, d):
    pages = table(s, d, "pages")
    links = extract.href_links(pages).join(pages.select("page_id", "site"), "page_id")
    own = F.when(F.col("href").rlike("(?i)^https?://"), U.same_site(F.col("href"), F.col("site"))).otherwise(~F.col("href").rlike("^(#|[a-z]+:)"))
    return extract.rank_links(links.where(own), "site", 5).select("site", "href", "score", "rank")


def page_jsonld(s, d):
    body = F.regexp_extract("html", r'<script type="application/ld\+json">([^<]*)</script>', 1)
    return table(s, d, "pages").where(body != "").select("page_id", F.get_json_object(body, "$.telephone").alias("telephone"), F.get_json_object(body, "$.@type").alias("type"))


def page_title(s, d):
    return table(s, d, "pages").where("html IS NOT NULL").select("page_id", T.squeeze(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"))


def page_ok(s, d):
    p = table(s, d, "pages")
    ok = F.col("status").between(200, 299) & (F.coalesce(F.length("html"), F.lit(0)) > 0)
    return p.groupBy("site").agg(F.count("*").alias("pages"), F.count_if(ok).alias("ok_pages"), F.max("fetched_at").alias("last_fetch"))


def place_payload(s, d):
    raw = F.col("raw")
    return table(s, d, "places").select("listing_id", payloads.first_dig(raw, ("category", "kind")).alias("category"), payloads.as_int(payloads.dig(raw, "page")).alias("page"), payloads.as_int(payloads.dig(raw, "pos")).alias("pos"))


def normalize_status(s, d):
    e = table(s, d, "emails")
    return e.groupBy(payloads.normalize_status(F.upper(F.col("status"))).alias("status")).agg(F.count("*").alias("n"))


def join_business_emails(s, d):
    keys = _b(s, d).where("key IS NOT NULL").select(F.col("key").alias("business_key")).distinct()
    e = table(s, d, "emails").join(keys, "business_key").groupBy("business_key").agg(F.count("*").alias("rows"), F.count("email").alias("addresses"), F.max("confidence").alias("best"))
    return e


def anti_seen(s, d):
    done = _b(s, d).where("key IS NOT NULL").select(F.col("key").alias("business_key"))
    return state.not_seen(table(s, d, "emails").where("business_key IS NOT NULL"), done, ["business_key"]).groupBy("business_key").agg(F.count("*").alias("rows"))


def cache_hits(s, d):
    p = table(s, d, "pages").select("url", "page_id", "status", "fetched_at")
    hits, _ = state.cache_lookup(p.select("url").distinct(), p.withColumn("neg", -F.col("page_id")), "url", "fetched_at", F.expr(NOW), 24 * 90)
    return hits.groupBy("url").agg(F.max("fetched_at").alias("fetched_at"))


def cache_misses(s, d):
    p = table(s, d, "pages").select("url", "page_id", "fetched_at")
    return state.cache_lookup(p.select("url").distinct(), p, "url", "fetched_at", F.expr(NOW), 24 * 90)[1]


def ttl_prune(s, d):
    p = table(s, d, "pages")
    return state.fresh(p, "fetched_at", F.expr(NOW), 24 * 120).groupBy("site").agg(F.count("*").alias("kept"))


def newest_listing(s, d):
    p = table(s, d, "places").where("query IS NOT NULL")
    return state.latest_by(p.select("query", "listing_id", "fetched_at"), ["query"], [F.col("fetched_at").desc_nulls_last(), F.col("listing_id")])


def cross_query_dedupe(s, d):
    b = _b(s, d).where("key IS NOT NULL").select("key", "business_id", "query", "run_id", "arrived_at")
    return state.latest_by(b, ["key"], [F.col("arrived_at").asc_nulls_last(), F.col("business_id")])


def found_per_query(s, d):
    return cross_query_dedupe(s, d).groupBy("query").agg(F.count("*").alias("found"))


def partial_upsert(s, d):
    return state.partial_upsert(_b(s, d), "key", [F.col("arrived_at"), F.col("business_id")], ["place_id", "category", "phone", "rating"], ["name", "website", "website_status"])


def coalesce_upsert(s, d):
    e = table(s, d, "emails").withColumn("domain", F.lower(F.regexp_extract("email", "@(.*?) *$", 1))).where("domain <> '' AND arrived_at IS NOT NULL")
    facts = lambda x: x.groupBy("domain").agg(F.max("mx_found").alias("has_mx"), F.max(F.when(F.col("status") == "catch_all", True)).alias("is_catch_all"))
    return state.coalesce_upsert(facts(e.where("arrived_at < TIMESTAMP '2024-07-01'")), facts(e.where("arrived_at >= TIMESTAMP '2024-07-01'")), "domain", ["has_mx", "is_catch_all"])


def stage_latest(s, d):
    from placewright.streaming.stages import latest

    return latest(table(s, d, "events"), "user_id", "ts", "event_type")


def events_by_day(s, d):
    from placewright.streaming.stages import windowed_counts

    return windowed_counts(table(s, d, "events").where("ts IS NOT NULL"), "ts", "event_type")


def early_stop(s, d):
    e = table(s, d, "emails").where("business_key IS NOT NULL AND email IS NOT NULL").groupBy("business_key", "email").agg(F.max("confidence").alias("confidence"), F.max(F.col("status").isin("valid", "catch_all")).alias("hit"))
    walked = state.early_stop(e, ["business_key"], [F.col("confidence").desc_nulls_last(), F.col("email")], F.col("hit"))
    return walked.groupBy("business_key").agg(F.count("*").alias("checked"), F.max("hit").alias("stopped"))


def best_per_kind(s, d):
    e = table(s, d, "emails").where("business_key IS NOT NULL AND email IS NOT NULL AND contact_type IS NOT NULL").groupBy("business_key", "contact_type", "email").agg(F.max(F.coalesce("confidence", F.lit(-1))).alias("confidence"))
    return state.latest_by(e, ["business_key", "contact_type"], [F.col("confidence").desc(), F.col("email")])


def status_counts(s, d):
    e = table(s, d, "emails")
    return e.groupBy("provider").agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status") == "invalid").alias("invalid"), F.count_distinct("business_key").alias("businesses"))


def run_counters(s, d):
    b = _b(s, d)
    return b.groupBy("run_id").agg(
        F.count("*").alias("rows"), F.count_distinct("key").alias("listings"), F.count_if(F.coalesce("website", F.lit("")) == "").alias("no_website"), F.count_if("is_chain").alias("chains"), F.count_if(F.col("website_status") == "ok").alias("sites_ok"), F.count("rating").alias("rated")
    )


def db_stats(s, d):
    names = ("businesses", "places", "owner_candidates", "emails", "pages", "documents")
    out = None
    for n in names:
        c = table(s, d, n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


def string_rollup(s, d):
    return state.rollup(table(s, d, "lineitem"), ["l_orderkey"], "l_partkey", ["l_linenumber"])


def notes_rollup(s, d):
    rows = table(s, d, "emails").where("business_key IS NOT NULL AND notes IS NOT NULL AND notes <> ''").select("business_key", "notes").distinct()
    return state.rollup(rows, ["business_key"], "notes", ["notes"])


def pace(s, d):
    per_day = table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return state.moving_average(per_day, "day", "n").select("day", "n", F.round("pace", 6).alias("pace"))


def owner_support(s, d):
    return owners.mention_support(table(s, d, "owner_candidates")).select("business_key", "person", "rank", "support", "sources", "mentions", "score")


def choose_owner(s, d):
    return owners.choose_person(table(s, d, "owner_candidates"))


def brand_table(s, d):
    return brands.brand_table(_b(s, d))


def prefix_lookup(s, d):
    return brands.prefix_lookup(_b(s, d), brands.brand_table(_b(s, d)))


def shared_domains(s, d):
    return brands.shared_domains(_b(s, d))


def host_listed(s, d):
    hosts = brands.shared_domains(_b(s, d)).select(F.col("domain").alias("host"))
    return U.listed(_b(s, d).select("business_id", "website"), "website", hosts).select("business_id")


def verdict_broadcast(s, d):
    e = table(s, d, "emails")
    addr = F.lower(F.trim("email"))
    verdicts = e.where("status = 'valid'").select(addr.alias("email")).where("email <> ''").groupBy("email").agg(F.count("*").alias("valid_rows"))
    out = annotate.broadcast_verdicts(e.select("business_key", "email"), verdicts)
    return out.groupBy("business_key").agg(F.count("*").alias("rows"), F.count("valid_rows").alias("known"))


def annotate_table(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    verdicts = table(s, d, "emails").select(F.lower(F.trim("email")).alias("email"), "status").where("email <> '' AND status IS NOT NULL").groupBy("email").agg(F.min("status").alias("status")).withColumn("message", F.lit(""))
    return annotate.annotate(docs, "text", verdicts, row_id="doc_id").groupBy("verify_status").agg(F.count("*").alias("docs"))


def site_coverage(s, d):
    sites = table(s, d, "pages").select("site", "business_key").distinct()
    b = _b(s, d).select("key", U.hostname("website").alias("host")).withColumn("host", F.regexp_replace("host", "^www\\.", "")).distinct()
    return sites.join(b, (sites.business_key == b.key) & (sites.site == b.host), "left").groupBy("site").agg(F.max(F.col("key").isNotNull()).alias("on_listing"))


def rank_by_rating(s, d):
    b = _b(s, d).where("city IS NOT NULL AND rating IS NOT NULL AND reviews IS NOT NULL").select("city", "business_id", "rating", "reviews")
    w = Window.partitionBy("city").orderBy(F.col("rating").desc(), F.col("reviews").desc(), "business_id")
    return b.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


QUERIES = {
    f.__name__: f
    for f in (
        squeeze, normalize_name, name_tokens, split_locality, city_from_address, state_from, clean_state, format_phone, split_name, dedupe_key, brand_display_name, normalize_url, hostname, registered_domain, same_site, parse_query, fmt_duration, trim_context,
        text_addresses, page_hrefs, rank_links, page_jsonld, page_title, page_ok, place_payload, normalize_status, join_business_emails, anti_seen, cache_hits, cache_misses, ttl_prune, newest_listing, cross_query_dedupe, found_per_query, partial_upsert,
        coalesce_upsert, stage_latest, events_by_day, early_stop, best_per_kind, status_counts, run_counters, db_stats, string_rollup, notes_rollup, pace, owner_support, choose_owner, brand_table, prefix_lookup, shared_domains, host_listed,
        verdict_broadcast, annotate_table, site_coverage, rank_by_rating,
    )
}
