"""Sites, mailboxes, people in text, title case, brands and owners."""

from pyspark.sql import functions as F

from placewright.operators import brands, discovery, mailboxes, owners, titles


def test_confirm_sites(spark):
    p = spark.createDataFrame([(1, "k", "<title>Joe</title><p>Joe's  Plumbing, 12 Oak St, call (299) 800-4177</p>"), (2, "k", None), (3, None, "x"), (4, "z", "x")], "page_id int, business_key string, html string")
    b = spark.createDataFrame([("k", 7, "Joe's Plumbing", "299-800-4177", "12 Oak St, X"), ("k", 8, None, None, None)], "key string, business_id int, name string, phone string, address string")
    got = {(r.page_id, r.business_id): (r.phone_on_page, r.name_on_page, r.street_on_page) for r in discovery.confirm_sites(p, b).collect()}
    assert got == {(1, 7): (True, True, True), (1, 8): (False, False, False)}


def test_pick_sites(spark):
    rows = [("k", "Golden Mill Bakery", "goldenmillbakery.com"), ("k", "Golden Mill Bakery", "dir.com"), ("m", "A", None), ("n", "Oak Dental", "http://"), (None, "x", "x.com")]
    assert [tuple(r) for r in discovery.pick_sites(spark.createDataFrame(rows, "key string, name string, website string")).collect()] == [("k", "goldenmillbakery.com", 60)]


def test_mailboxes(spark):
    df = spark.createDataFrame([("Info@a.com",), ("noreply@a.com",), ("jane.doe@a.com",), ("x@@a",), ("",)], "email string")
    assert [r.k for r in df.select(mailboxes.kind("email").alias("k")).collect()] == ["role", "unread", "personal", "malformed", "malformed"]
    names = spark.createDataFrame([("k", "Jane Doe"), ("k", "Cher"), ("k", None), (None, "Jane Doe")], "business_key string, name string")
    assert names.select(mailboxes.person_locals("name").alias("l")).first().l[:4] == ["jane", "jane.doe", "janedoe", "jdoe"]
    mails = spark.createDataFrame([("k", "J.Doe@a.com"), ("k", "cher1@a.com"), ("q", "jdoe@a.com"), (None, "jdoe@a.com"), ("k", None)], "business_key string, email string")
    assert {tuple(r) for r in mailboxes.spelling_mailboxes(mails, names).collect()} == {("k", "j.doe@a.com", "jane doe"), ("k", "cher1@a.com", "cher")}


def test_people_in_text(spark):
    assert titles.people_in("Meet Jane Doe (general manager) of Acme") == [("Jane Doe", "general manager", 50, False)]
    assert ("Jane Doe", "owner", 100, False) in titles.people_in("Our owner, Jane Doe, answers.")
    assert titles.people_in("Bettina Tarom opened the van in 1978")[0][3] is True
    assert titles.people_in("no names here") == [] and titles.people_in(None) == []
    df = spark.createDataFrame([(1, "Jane Doe, Owner"), (2, None)], "i int, t string")
    assert [tuple(r) for r in titles.mentions_in(df, "i", "t").collect()] == [(1, "Jane Doe", "owner", 100, False)]


def test_title_case():
    cases = {"JOE'S PLUMBING & HEATING LLC": "Joe's Plumbing & Heating LLC", "mcdonald's of round rock": "McDonald's of Round Rock", "o'brien and sons": "O'Brien and Sons", "the 1st stop": "The 1st Stop", "KFC grill": "KFC Grill", "": ""}
    assert {k: titles.smart_title(k) for k in cases} == cases


def test_brands(spark):
    rows = [(i, f"Acme Diner #{100 + i}" if i % 2 else "ACME DINER", f"city{i}", "acme.example.com") for i in range(6)] + [(10, "Acme Diner Express", "x", None), (11, "Solo", "x", None), (12, None, None, None)]
    df = spark.createDataFrame(rows, "business_id int, name string, city string, website string")
    table = brands.brand_table(df)
    assert [tuple(r) for r in table.collect()] == [("acme diner", 6)]
    assert {r.business_id: r.kind for r in brands.prefix_lookup(df, table).collect()} == {**{i: "exact" for i in range(6)}, 10: "prefix"}


def test_choose_person(spark):
    rows = [("k", "Ann Lee", 90, 1, "a", False), ("k", "ann  lee", 90, 3, "b", False), ("k", "Bob Ray", 90, 1, "a", False), ("m", "Ann Lee", 80, 1, "a", True), ("m", "Bob Ray", 80, 1, "a", True), (None, "X Y", 1, 1, "a", False), ("n", None, 1, 1, "a", False)]
    got = owners.choose_person(spark.createDataFrame(rows, "business_key string, name string, rank int, weight int, source string, loose boolean")).collect()
    assert [(r.business_key, r.person, r.support, r.rivals) for r in got] == [("k", "ann lee", 4, 2)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "business_id int, name string, city string, website string, key string, phone string, address string")
    assert brands.brand_table(none).count() == 0 and discovery.pick_sites(none).count() == 0
    assert none.select(F.size(discovery.distinctive_tokens("name"))).count() == 0
