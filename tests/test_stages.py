"""Verdicts, contacts, exports, crawl, people in pages and texts, answers of services."""

import json

from pyspark.sql import functions as F

from placewright.operators import crawl, exports, payloads, people_text, verdicts
from placewright.sources import answers, files

E = "business_key string, email string, source string, status string, confidence int, contact_type string, contact_name string, on_business_domain boolean"


def test_verdict_shapes(spark):
    rows = [("numbered", '{"result": 3}'), ("numbered", '{"result": "7"}'), ("text", "ok_for_all"), ("flagged", '{"status": "unknown", "is_catch_all_domain": true}'), ("reasoned", '{"status": "deliverable", "reason": "accepted_email"}'), ("coded", '{"code": "ok", "message": "disposable host"}'), ("sub_status", '{"status": "valid", "error": "no credit"}'), ("none", "{}"), ("text", None)]
    got = [r.status for r in verdicts.read_verdicts(spark.createDataFrame(rows, "shape string, payload string")).collect()]
    assert got == ["catch_all", "unknown", "catch_all", "catch_all", "valid", "risky", "unknown", "unknown", "unknown"]


def test_verify_in_order(spark):
    wanted = spark.createDataFrame([("a@x.de", None), ("b@x.de", None), ("c@x.de", None), ("noreply@x.de", None), ("d@x.de", False), ("bad", None), (None, None)], "email string, mx_found boolean")
    pair = "email string, status string"
    got = {r.email: (r.status, r.by) for r in verdicts.verify_in_order(wanted, spark.createDataFrame([("a@x.de", "valid"), (None, "x")], pair), spark.createDataFrame([("b@x.de", "risky")], pair), 1, [F.col("email")]).collect()}
    assert got == {"a@x.de": ("valid", "cache"), "b@x.de": ("risky", "service"), "c@x.de": ("not_checked", "budget"), "noreply@x.de": ("invalid", "local"), "d@x.de": ("invalid", "local"), "bad": ("invalid", "local")}


def test_guesses_and_labels(spark):
    df = spark.createDataFrame([("Shop.Gmail.com", "ann.lee", "Ann", "Lee"), ("own.org", "alee", "Ann", "Lee"), (None, "zzz", None, None), ("m.facebook.com", "lee", "Ann", "Lee")], "d string, l string, f string, n string")
    got = [tuple(r) for r in df.select(verdicts.guessable(F.col("d")), verdicts.pattern_label(F.col("l"), F.col("f"), F.col("n"))).collect()]
    assert got == [("free_mail_domain", "{first}.{last}"), (None, "{f}{last}"), ("no_domain", None), ("platform_or_social_domain", "{last}")]
    assert len(spark.range(1).select(verdicts.role_locals(2, F.array(F.lit("info"), F.lit("bake")))).first()[0]) == 7
    ids = spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "e array<string>").select(verdicts.batch_id(F.col("e"))).distinct().collect()
    assert len(ids) == 1 and len(ids[0][0]) == 20


def test_contacts_and_rows(spark):
    rows = [("k", " A@x.de", "mailto", "valid", 80, "owner", None, True), ("k", "a@x.de", "jsonld", "valid", 90, "owner", None, True), ("k", "b@x.de", "permutation", "valid", 96, "general", None, True), ("k", "c@x.de", "mailto", "invalid", 99, "general", None, True), ("k", "", "mailto", "valid", 99, "general", None, True), (None, "d@x.de", "mailto", "valid", 9, None, None, None)]
    e = exports.clean_addresses(spark.createDataFrame(rows, E))
    leads = exports.lead_contacts(e, F.col("status") == "valid")
    assert {(r.email, r.is_owner, r.is_best) for r in leads.collect()} == {("a@x.de", True, False), ("b@x.de", False, True)}
    b = spark.createDataFrame([(1, "k", "Old", None), (2, "k", "New", None), (3, "m", "Alone", None)], "business_id bigint, key string, name string, updated_at timestamp_ntz").selectExpr("*", "'p' AS phone", "'w' AS website", "'c' AS city", "'s' AS state", "'x' AS emails_found")
    listed = exports.business_rows(b, e, leads)
    got = {r.key: (r.name, r.emails_found, r.emails_guessed, r.best_email) for r in listed.collect()}
    assert got == {"k": ("New", 2, 1, "b@x.de"), "m": ("Alone", 0, 0, "")}
    assert sorted((r.key, r.email) for r in exports.lead_rows(listed, leads).na.fill("").collect()) == [("k", "a@x.de"), ("k", "b@x.de"), ("m", "")]
    nested = {r.key: json.loads(r.json) for r in exports.nested(listed, e).collect()}
    assert [x["email"] for x in nested["k"]["emails"]] == ["a@x.de", "b@x.de", "c@x.de"] and nested["m"]["emails"] == []
    assert [r.over_cap for r in verdicts.worth_verifying(e, per_kind=1).orderBy("contact_type", "place").collect()] == [False, True, False]


def test_crawl_stops_at_an_own_address(spark):
    rows = [
        (1, "www.shop.com", "https://shop.com/", 200, "<a href='mailto:x@other.com'>mail</a>"), (2, "www.shop.com", "https://shop.com/contact", 200, "<p>nothing</p>"),
        (3, "www.shop.com", "https://shop.com/about", 200, "<a href='mailto:me@shop.com'>mail</a>"), (4, "www.shop.com", "https://shop.com/blog/1", 200, "<p>x</p>"), (5, "www.shop.com", "https://shop.com/contact-us", 500, "<p>x</p>"), (6, None, "https://x.com", 200, "<p>x</p>"), (7, "b.com", None, 200, None),
    ]
    df = spark.createDataFrame(rows, "page_id int, site string, url string, status int, html string").selectExpr("*", "CAST(NULL AS STRING) AS final_url", "1 AS page_pos", "CAST(NULL AS STRING) AS business_key")
    got = [(r.page_id, r.visit) for r in crawl.crawl_sites(df).orderBy("visit").collect()]
    assert got == [(2, 1), (3, 2)]


def test_people_in_structured_data(spark):
    ld = '{"@type": "LocalBusiness", "name": "Shop", "founder": {"@type": "Person", "name": "Ann  Lee", "jobTitle": "Founder"}, "employee": ["Bo Ek", {"name": "Cy Do"}], "review": [{"author": {"@type": "Person", "name": "Di Fo"}}]}'
    page = f'<a href="https://www.facebook.com/shop">f</a><a href="https://notfacebook.com/x">n</a><script type="application/ld+json">{ld}</script><script type="application/ld+json">{{broken</script>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    assert {(r.name, r.title, r.role) for r in crawl.structured_people(df).collect()} == {("Ann Lee", "Founder", "founder"), ("Bo Ek", "", "employee"), ("Cy Do", "", "employee"), ("Di Fo", "", "author")}
    assert [(r.page_id, r.href) for r in crawl.profile_links(df).collect()] == [(1, "https://www.facebook.com/shop")]


def test_owners_told_by_texts(spark):
    b = spark.createDataFrame([("k", "Golden Mill Bakery"), ("n", None)], "key string, name string")
    t = spark.createDataFrame([("k", "overview", "Golden Mill Bakery is run by Maria Ulmann, owner of the shop."), ("k", "hit", "Maria Ulmann, owner. Somewhere else."), ("k", "hit", None), (None, "hit", "x")], "business_key string, kind string, text string")
    got = people_text.told_owners(t, b).collect()
    assert [(r.name, r.title, r["rank"], r.weight) for r in got] == [("Maria Ulmann", "owner", 100, 3)]
    mail = spark.createDataFrame([("k", "hit", "Write to m.ulmann@gm.org or info@gm.org")], t.schema)
    assert [r.email for r in people_text.addresses_of(got and spark.createDataFrame([("k", "Maria Ulmann")], "business_key string, name string"), mail).collect()] == ["m.ulmann@gm.org"]
    names = spark.createDataFrame([("Dr. Ann Lee",), ("Front Desk",), ("Ann",), ("Oak Dental",), ("A B",), (None,), ("Ann 2 Lee",)], "n string")
    assert [r[0] for r in names.select(people_text.looks_like_person("n")).collect()] == [True, False, False, False, False, False, False]
    titles = spark.createDataFrame([("Co-Owner & Chef",), ("Store Manager",), (None,), ("chef",)], "t string").select(people_text.title_rank(F.col("t")).alias("t")).select("t.*")
    assert [tuple(r) for r in titles.collect()] == [("co-owner", 90), ("store manager", 45), ("", 30), ("chef", 30)]


def test_text_blocks(spark):
    body = {"data": {"ai_overview": {"text": "Run by  Ann"}, "knowledge_graph": {"founder": "Ann", "since": 1990}, "people_also_ask": [{"question": "Who?", "answer": "Ann"}], "organic_results": [{"title": "T", "snippet": "S"}, {}]}}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, None), (3, "[]"), (4, "{broken")], "id int, payload string")
    assert [(r.kind, r.text) for r in payloads.text_blocks(df).orderBy("pos").collect()] == [("overview", "text: Run by Ann"), ("knowledge", "founder: Ann; since: 1990"), ("question", "question: Who?; answer: Ann"), ("hit", "T; S")]


def test_answers_of_services(spark):
    rows = [('{"results": []}',), ('{"error": "no"}',), (None,), ("<html>",), ('{"results": [{"name": "x"}]}',), ('[]',), ('{"message": "Rate limit reached"}',), ('[{"a": 1}]',)]
    assert [r[0] for r in spark.createDataFrame(rows, "p string").select(answers.classify(F.col("p"))).collect()] == ["empty", "failure", "failure", "failure", "rows", "empty", "failure", "rows"]
    tools = [("s", "place_details", "Details of a place", ["id"]), ("s", "maps_search", "Search google maps", ["query"]), ("t", "weather", "Weather", ["city"])]
    assert [tuple(r)[:2] for r in answers.pick_tool(spark.createDataFrame(tools, "server string, name string, description string, arguments array<string>")).collect()] == [("s", "maps_search")]
    assert answers.tool_arguments({"properties": {"q": {"type": "string"}, "limit": {}, "lang": {"default": "en"}}, "required": ["lang"]}, "x", 5) == {"q": "x", "limit": 5, "lang": "en"}
    pages = spark.createDataFrame([("q", 1, "a"), ("q", 1, "b"), ("q", 2, "c"), ("q", 3, "a"), ("q", 4, "d"), ("r", 1, None)], "query string, page int, id string")
    assert sorted((r.page, r.id) for r in answers.pages_until_known(pages, "id").collect()) == [(1, "a"), (1, "b"), (2, "c")]
    assert json.loads(answers.generic_config('{"title": "x", "gps": {"lat": 1}}', {"name": ("name", "title"), "latitude": ("gps.lat",), "phone": ("tel",)})) == {"name": "title", "latitude": "gps.lat"}


def test_lists_of_hosts_and_searches(spark, tmp_path):
    (tmp_path / "h.txt").write_text("# x\n0.0.0.0 Bad.com worse.org\nhttps://third.net/x\n127.0.0.1 localhost\n")
    hosts = files.read_hosts(spark, str(tmp_path / "h.txt"))
    assert sorted(r.host for r in hosts.collect()) == ["bad.com", "third.net", "worse.org"]
    assert [r.host for r in files.add_hosts(hosts, spark.createDataFrame([("BAD.com",), ("new.io",), (None,)], "host string")).collect()] == ["new.io"]
    (tmp_path / "q.csv").write_text("id,Search\n1,dentist in austin\n2,\n3,dentist in austin\n")
    assert [r.raw for r in files.read_query_table(spark, str(tmp_path / "q.csv")).collect()] == ["dentist in austin"]
    (tmp_path / "s.csv").write_text('﻿sep=;\nName;Email\n"two\nlines";a@b.de\n')
    df = files.read_table(spark, str(tmp_path / "s.csv"))
    assert df.columns == ["Name", "Email"] and [tuple(r) for r in df.collect()] == [("two\nlines", "a@b.de")]
