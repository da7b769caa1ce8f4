"""Scalar functions, extraction, payloads, files, annotation, state and streaming."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from placewright.functions import text as T
from placewright.functions import urls as U
from placewright.operators import annotate, extract, payloads, state
from placewright.sources import files, sinks
from placewright.streaming import stages


def one(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn("x").alias("y")).orderBy("i").collect()]


def test_phones(spark):
    got = one(spark, T.format_phone, "9563246856", "1-956-324-6856", "(956) 324-6856 ext. 12", "+44 20 7946 0958", "", None)
    assert got == ["(956)-324-6856", "(956)-324-6856", "(956)-324-6856 ext. 12", "+44 20 7946 0958", "", ""]


def test_queries(spark):
    q = ["dentist in austin tx", "coffee shop - Boulder CO", "Roofing Companies, Dallas, TX", "barber shop 90210", "walk in clinic in austin tx", "restaurants in Austin within 5 miles", "hvac contractor"]
    got = [tuple(r) for r in one(spark, T.parse_query, *q)]
    assert got == [("dentist", "austin tx"), ("coffee shop", "Boulder CO"), ("Roofing Companies", "Dallas, TX"), ("barber shop", "90210"), ("walk in clinic", "austin tx"), ("restaurants", "Austin"), ("hvac contractor", "")]


def test_names_and_places(spark):
    assert one(spark, T.normalize_name, "McDonald's #1234", "Zoë & Co", None) == ["mcdonalds 1234", "zoe and co", None]
    assert [tuple(r) for r in one(spark, T.split_name, "Dr. Priya K. Patel", "Cher", None)] == [("Priya", "Patel"), ("Cher", ""), ("", "")]
    assert one(spark, T.city_from_address, "220 Oak Ave, Austin, TX 78702", "Austin, TX", None) == ["Austin", "", ""]
    assert one(spark, T.brand_display_name, "Subway Store #1234", "Acme - 0421", "#12") == ["Subway", "Acme", "#12"]


def test_urls(spark):
    assert one(spark, U.normalize_url, "Example.com", "HTTP://A.b/c#d", "//x.org?q=1", "", None) == ["https://example.com/", "http://a.b/c", "https://x.org/?q=1", "", ""]
    assert one(spark, U.registered_domain, "https://shop.acme.co.uk/x", "www.a.example.com", "localhost", "1.2.3.4", "co.uk", None) == ["acme.co.uk", "example.com", "", "", "", ""]
    hosts = spark.createDataFrame([("bad.com",)], "host string")
    df = spark.createDataFrame([(1, "https://x.y.bad.com/"), (2, "good.com"), (3, None)], "id int, u string")
    assert [r.id for r in U.listed(df, "u", hosts).collect()] == [1]


@pytest.mark.parametrize(
    "page, domain, want",
    [
        ('<a href="mailto:Office@Acme.com?subject=hi">x</a> sales@acme.com and info [at] acme (dot) com', "", {"office@acme.com", "sales@acme.com", "info@acme.com"}),
        (f'<span data-cfemail="{"2f" + "".join(f"{ord(c) ^ 0x2f:02x}" for c in "billing@acme.com")}"></span>', "", {"billing@acme.com"}),
        ('<script type="application/ld+json">{"email": "hello@acme.com"}</script>', "", {"hello@acme.com"}),
        ("logo@2x.png and text", "", set()),
        ("info&#64;acme.com", "", {"info@acme.com"}),
        ("Join us at meetup.com today", "joes.com", set()),
        ("Reach dispatch at joes.com", "joes.com", {"dispatch@joes.com"}),
        ("", "", set()),
    ],
)
def test_page_addresses(page, domain, want):
    assert {e for e, _, _ in extract.page_addresses(page, domain)} == want


def test_address_keeps_best_source(spark):
    assert extract.page_addresses('a@acme.com <a href="mailto:a@acme.com">Write</a>')[0] == ("a@acme.com", "mailto", "Write")
    pages = spark.createDataFrame([(1, "s", 0, "<p>a@acme.com</p>"), (2, "s", 1, '<a href="mailto:a@acme.com">w</a>'), (3, "s", 2, None)], "page_id int, site string, page_pos int, html string")
    assert [tuple(r) for r in extract.best_per_site(extract.extract_emails(pages), pages).collect()] == [("s", "a@acme.com", "mailto", 2)]


def test_parse_pages(spark):
    html = "<title> A  b</title><nav>menu</nav><p>Hello <b>you</b></p><script>x</script><a href='/contact'>Contact us</a><a href='#x'>no</a>"
    r = extract.parse_pages(spark.createDataFrame([(1, "s", "https://s.org/", None, html)], "page_id int, site string, url string, final_url string, html string")).first()
    assert r.title == "A b" and r.text == "menu Hello you Contact us no" and "menu" not in r.people_text and [tuple(x) for x in r.links] == [("https://s.org/contact", "Contact us")]


def test_payloads(spark):
    rows = [
        json.dumps({"title": " Joe's ", "gps_coordinates": {"latitude": "30.1"}, "reviews": "1,204", "types": ["a", "b", "c", "d"], "address": "Joe's, 1 Oak St", "website": {"url": "joes.com"}}),
        json.dumps({"name": "Gone", "permanently_closed": True}), json.dumps({"phone": "1"}), "not json", None,
    ]
    got = payloads.places_from_payloads(spark.createDataFrame([(x,) for x in rows], "payload string")).collect()
    assert len(got) == 1 and got[0]["name"] == "Joe's" and got[0].latitude == 30.1 and got[0].reviews == 1204 and got[0].address == "1 Oak St" and got[0].website == "joes.com"
    path, found = payloads.find_result_rows({"meta": {"tags": [{"a": 1}] * 4}, "data": {"results": [{"name": "x"}]}})
    assert path == "data.results" and found == [{"name": "x"}]


def test_statuses(spark):
    df = spark.createDataFrame([("OK", "ok", ""), ("accept-all", "ok", "Catch-All domain"), (None, "ko", "timeout"), ("odd", "ok", "disposable")], "s string, c string, m string")
    got = [tuple(r) for r in df.select(payloads.normalize_status(F.col("s")), payloads.code_verdict(F.col("c"), F.col("m"))).collect()]
    assert got == [("valid", "valid"), ("catch_all", "catch_all"), ("unknown", "unknown"), ("unknown", "risky")]


def test_search_hits(spark):
    body = json.dumps({"data": {"organic_results": [{"url": "https://a.org", "title": " T  x"}, {"link": "ftp://no"}, {"link": "http://b.org", "rank": 7}]}})
    got = [(r.url, r.title, r.position) for r in payloads.search_hits(spark.createDataFrame([(body,), (None,)], "payload string")).collect()]
    assert got == [("https://a.org", "T x", 1), ("http://b.org", "", 7)]


def test_annotate(spark):
    t = spark.createDataFrame([(1, "A@x.org, b@x.org"), (2, "b@x.org"), (3, "none"), (4, None), (5, "new@x.org")], "id int, cell string")
    v = spark.createDataFrame([("a@x.org", "valid", "ok"), ("b@x.org", "invalid", "no")], "email string, status string, message string")
    got = {r.id: (r.verified_email, r.verify_status) for r in annotate.annotate(t, "cell", v).collect()}
    assert got == {1: ("a@x.org", "valid"), 2: ("", "invalid"), 3: ("", "no-email"), 4: ("", "no-email"), 5: ("", "not checked")}


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿Name,Email Address\n"Joe, Sr",a@x.org\nAnn,\n')
    df = files.read_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["Name", "Email Address"] and df.count() == 2 and files.email_column(df) == "Email Address"
    (tmp_path / "list.txt").write_text("a@x.org\nb@x.org\n")
    assert files.read_table(spark, str(tmp_path / "list.txt")).columns == ["email"]
    (tmp_path / "q.txt").write_text("# no\nDentist in X\n\ndentist  in x\nroofer\n")
    assert [r.raw for r in files.read_queries(spark, str(tmp_path / "q.txt")).collect()] == ["Dentist in X", "roofer"]
    (tmp_path / "h.txt").write_text("0.0.0.0 bad.com # x\nhttps://worse.org/a\n127.0.0.1 localhost\n")
    assert {r.host for r in files.read_hosts(spark, str(tmp_path / "h.txt")).collect()} == {"bad.com", "worse.org"}
    (tmp_path / "j.jsonl").write_text('{"email":"A@x.org","status":"invalid"}\n{"email":"a@x.org","status":"valid"}\n{"email":"b@x.o')
    assert [(r.email, r.status) for r in files.read_journal(spark, str(tmp_path / "j.jsonl")).collect()] == [("a@x.org", "valid")]
    (tmp_path / "log.txt").write_text("[1/2] valid a@x.org ok\nnoise\n[2/2] invalid a@x.org no box\n")
    assert [tuple(r) for r in files.read_run_log(spark, str(tmp_path / "log.txt")).collect()] == [("a@x.org", "invalid", "no box")]
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"name": "a", "query": "X"}, {"name": "b", "query": ""}, {"name": "c", "query": "y"}]}))
    assert {r["name"] for r in files.read_places(spark, str(tmp_path / "p.json"), "x").collect()} == {"a", "b"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, True, ["a", "b"], None)], "id int, ok boolean, notes array<string>, x string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().asDict() == {"id": "1", "ok": "yes", "notes": "a; b", "x": None}
    sinks.TableSink(str(tmp_path / "t")).upsert(df, "done")
    assert spark.read.parquet(str(tmp_path / "t")).first().status == "done"
    assert sinks.blank_to_null(spark.createDataFrame([("",)], "a string")).first().a is None


def test_state(spark):
    w = spark.createDataFrame([("k", 1, "a", "p"), ("k", 2, None, None), (None, 3, "z", "z")], "key string, t int, f string, l string")
    assert [tuple(r) for r in state.partial_upsert(w, "key", [F.col("t")], ["f"], ["l"]).collect()] == [("k", "a", None)]
    old, new = spark.createDataFrame([("d", True, None), ("e", None, True)], "k string, a boolean, b boolean"), spark.createDataFrame([("d", None, False), ("f", True, True)], "k string, a boolean, b boolean")
    assert {tuple(r) for r in state.coalesce_upsert(old, new, "k", ["a", "b"]).collect()} == {("d", True, False), ("e", None, True), ("f", True, True)}
    walk = spark.createDataFrame([("k", 1, False), ("k", 2, True), ("k", 3, False), ("m", 1, None)], "k string, o int, h boolean")
    assert sorted((r.k, r.o) for r in state.early_stop(walk, ["k"], [F.col("o")], F.col("h")).collect()) == [("k", 1), ("k", 2), ("m", 1)]
    roll = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 3, None), ("n", 1, "")], "k string, o int, v string")
    assert {r.k: r.joined for r in state.rollup(roll, ["k"], "v", ["o"]).collect()} == {"k": "a; b", "n": ""}


def test_stream_equals_batch(spark, tmp_path):
    schema = "id bigint, at timestamp, stage string"
    rows = [(i % 5, datetime(2024, 1, 1 + i % 9), f"s{i % 3}") for i in range(40)]
    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(src)
    df = spark.read.parquet(src)
    want = sorted(tuple(r) for r in stages.latest(df, "id", "at", "stage").collect())
    for _ in range(2):  # the second start finds nothing new
        stages.upsert_stream(spark, src, df.schema, "id", "at", "stage", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(tuple(r) for r in stages.current(spark, str(tmp_path / "out")).collect()) == want
