"""Queries of the stages after listing: guesses, verdicts, crawl, people in pages, contacts and exports, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewright.functions import text as T
from placewright.operators import crawl, exports, payloads, people_text, verdicts
from placewright.operators.titles import RANK
from placewright.session import table
from placewright.sources import answers

#: Checks a business takes by kind of guess, checks in ten seconds of one key.
CHECKS = {"found": 0.30, "owner": 0.15, "generic": 0.45}
PER_10S, HOURS = 57, 8


def run_plan(s, d):
    n = table(s, d, "businesses").where("run_id IS NOT NULL").groupBy("run_id").agg(F.count("*").alias("businesses"))
    per_hour = F.lit(PER_10S * 360)
    all_ = sum(CHECKS.values())
    return n.select("run_id", "businesses", per_hour.alias("checks_per_hour"), F.round(F.col("businesses") * CHECKS["found"], 6).alias("found"), F.round(F.col("businesses") * CHECKS["found"] / per_hour, 9).alias("hours_found"), F.round(F.col("businesses") * all_ / per_hour, 9).alias("hours_all"), F.greatest(F.lit(1), F.ceil(F.round(F.col("businesses") * all_, 6) / (PER_10S * 360 * HOURS))).cast("bigint").alias("keys_for_all"))


def run_headline(s, d):
    b = table(s, d, "businesses").where("run_id IS NOT NULL")
    e = table(s, d, "emails").where("business_key IS NOT NULL").withColumnRenamed("business_key", "key")
    own = b.groupBy("run_id").agg(F.count("*").alias("businesses"), F.count_if(F.coalesce(F.trim("website"), F.lit("")) != "").alias("with_website"), F.count_if("is_chain").alias("chains"))
    # addresses are counted by key first: a key's rows in a run multiply, its addresses don't
    by_key = e.groupBy("key").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("contact_type").isin("owner", "manager"), F.lit(False))).alias("owner"), F.max(F.coalesce(F.col("status") == "valid", F.lit(False))).alias("valid"))
    mail = b.where("key IS NOT NULL").groupBy("run_id", "key").agg(F.count("*").alias("rows")).join(by_key, "key").groupBy("run_id").agg(F.count("*").alias("with_any_email"), F.count_if("owner").alias("owner_emails"), F.count_if("valid").alias("verified"), F.sum(F.col("n") * F.col("rows")).alias("total_emails"))
    return own.join(mail, "run_id", "left").na.fill(0)


def deferred_guess_keys(s, d):
    e = table(s, d, "emails").where("notes LIKE '%unproven%' AND business_key IS NOT NULL").groupBy(F.col("business_key").alias("key")).agg(F.max(F.when(F.col("contact_type").isin("owner", "manager"), 1).otherwise(0)).alias("owner_guess"), F.max(F.coalesce("confidence", F.lit(0))).alias("confidence"))
    keys = table(s, d, "businesses").where("key IS NOT NULL").groupBy("key").agg(F.min("updated_at").alias("since"))
    return e.join(keys, "key").orderBy(F.desc("owner_guess"), F.desc("confidence"), "since")


def progress_view(s, d):
    b, e = table(s, d, "businesses"), table(s, d, "emails").where("business_key IS NOT NULL").select(F.col("business_key").alias("key"), F.lit(True).alias("has")).distinct()
    return b.join(e, "key", "left").groupBy("run_id", "website_status").agg(F.count_distinct("key").alias("keys"), F.count_distinct(F.when(F.col("has"), F.col("key"))).alias("with_email"), F.count_if(F.col("website").isNull()).alias("no_site"))


def domain_guessable(s, d):
    return table(s, d, "businesses").select("business_id", verdicts.guessable(F.col("domain")).alias("reason"))


def gen_role_locals(s, d):
    tier = F.when(F.col("is_chain"), 1).when(F.col("reviews") > 100, 2).otherwise(3)
    b = table(s, d, "businesses").where("domain IS NOT NULL")
    locals_ = F.when(tier == 1, verdicts.role_locals(1)).when(tier == 2, verdicts.role_locals(2)).otherwise(verdicts.role_locals(3))
    return b.select("domain", F.posexplode(locals_).alias("pos", "local")).groupBy("local", "pos").agg(F.count_distinct("domain").alias("domains"))


def semi_exclude(s, d):
    e = exports.clean_addresses(table(s, d, "emails"))
    known = e.where("source <> 'permutation'").select("business_key", "email")
    return e.where("source = 'permutation'").select("business_key", "email").join(known, ["business_key", "email"], "left_anti")


def pattern_label(s, d):
    e = table(s, d, "emails").where("contact_name IS NOT NULL AND email IS NOT NULL")
    n = T.split_name("contact_name")
    return e.select(F.lower(F.trim("email")).alias("email"), n["first"].alias("first"), n["rest"].alias("last")).select("email", "first", "last", verdicts.pattern_label(F.regexp_extract("email", "^([^@]*)@", 1), F.col("first"), F.col("last")).alias("label")).where("label IS NOT NULL").distinct()


def _payloads(s, d):
    """Answers of every shape, made from the statuses at hand."""
    e = table(s, d, "emails").where("email IS NOT NULL AND status IS NOT NULL").select(F.lower(F.trim("email")).alias("email"), "status").where("email <> ''").distinct()
    j = lambda **kv: F.to_json(F.struct(*(v.alias(k) for k, v in kv.items())))
    st = F.col("status")
    number = F.when(st == "valid", 0).when(st == "invalid", 1).when(st == "disposable", 2).when(st == "catch_all", 3).otherwise(4)
    code = F.when(st == "valid", "ok").when(st == "invalid", "ko").when(st == "catch_all", "ca").otherwise("mb")
    shapes = {"result_word": j(result=st), "sub_status": j(status=st, sub_status=F.lit("role_based")), "numbered": j(result=number), "flagged": j(status=st, is_catch_all_domain=F.lit(True)), "text": st, "reasoned": j(status=st, reason=F.lit("accepted_email")), "coded": j(code=code, message=F.lit("Mailbox busy, try again"))}
    return e.select("email", F.explode(F.create_map(*(x for k, v in shapes.items() for x in (F.lit(k), v)))).alias("shape", "payload"))


def vendor_verdicts(s, d):
    return verdicts.read_verdicts(_payloads(s, d)).groupBy("shape", "status").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def prefilter(s, d):
    e = table(s, d, "emails").where("email IS NOT NULL").select(F.lower(F.trim("email")).alias("email"), "mx_found").distinct()
    return e.select("email", "mx_found", verdicts.prefilter(F.col("email"), F.col("mx_found")).alias("verdict"))


def verify_one(s, d):
    e = table(s, d, "emails").where("email IS NOT NULL").withColumn("email", F.lower(F.trim("email"))).where("email <> ''")
    wanted = e.groupBy("email").agg(F.min("mx_found").alias("mx_found"))
    known = e.where("provider = 'mailprobe'").select("email", "status")
    answers = e.where("provider = 'checkbox'").select("email", "status")
    return verdicts.verify_in_order(wanted, known, answers, 1000, [F.col("email")])


def found_worth_verifying(s, d):
    e = exports.clean_addresses(table(s, d, "emails")).where("source <> 'permutation'")
    return verdicts.worth_verifying(e).select("business_key", "email", "contact_type", "place", "over_cap")


def keep_candidate(s, d):
    e = table(s, d, "emails").where("email IS NOT NULL AND status NOT IN ('invalid', 'disposable') AND NOT coalesce(is_low_value, false)")
    return e.groupBy("business_key").agg(F.count("*").alias("kept"))


def drop_no_mx(s, d):
    e = table(s, d, "emails").where("NOT (source = 'permutation' AND mx_found IS NOT NULL AND NOT mx_found)")
    return e.groupBy("source").agg(F.count("*").alias("kept"))


def tag_owner_emails(s, d):
    e = exports.clean_addresses(table(s, d, "emails"))
    owners = table(s, d, "owner_candidates").where("business_key IS NOT NULL AND name IS NOT NULL").select("business_key", F.lower(F.trim("name")).alias("who")).distinct().withColumn("known", F.lit(True))
    tagged = e.withColumn("who", F.lower(F.trim("contact_name"))).join(owners, ["business_key", "who"], "left")
    return tagged.select("business_key", "email", F.when(F.col("known"), "owner").otherwise(F.col("contact_type")).alias("contact_type"))


def batch_id(s, d):
    e = exports.clean_addresses(table(s, d, "emails"))
    return e.groupBy("business_key").agg(verdicts.batch_id(F.collect_set("email")).alias("batch"), F.count_distinct("email").alias("n"))


def retry_split(s, d):
    e = table(s, d, "emails").where("email IS NOT NULL")
    return e.groupBy(F.when(F.col("status").isin("unknown", "risky"), "retry").otherwise("done").alias("file"), "status").agg(F.count("*").alias("n"))


def query_type(s, d):
    q = table(s, d, "businesses").where("query IS NOT NULL").select("business_id", T.parse_query("query")["business_type"].alias("kind"))
    return q.groupBy("kind").agg(F.count("*").alias("n"))


def is_medical(s, d):
    told = F.lower(F.concat_ws(" ", "category", "query"))
    return table(s, d, "businesses").select("business_id", told.rlike(r"\b(dent(al|ist)|doctor|medical|clinic|chiropract(or|ic)|veterinar(ian|y)|physician|hospital|orthodont(ist|ics))\b").alias("medical"))


def _leads(s, d):
    e = exports.clean_addresses(table(s, d, "emails"))
    return e, exports.lead_contacts(e, F.coalesce(~F.col("is_low_value") & ~F.col("status").isin("invalid", "disposable"), F.lit(False)))


def lead_contacts(s, d):
    return _leads(s, d)[1]


def business_rows(s, d):
    e, leads = _leads(s, d)
    return exports.business_rows(table(s, d, "businesses"), e, leads).select("key", "name", "city", "emails_found", "emails_guessed", "all_emails", "best_email", "best_confidence")


def lead_rows(s, d):
    e, leads = _leads(s, d)
    return exports.lead_rows(exports.business_rows(table(s, d, "businesses"), e, leads), leads)


def nested_leads(s, d):
    e, leads = _leads(s, d)
    return exports.nested(exports.business_rows(table(s, d, "businesses"), e, leads), e)


def crawl_site(s, d):
    return crawl.crawl_sites(table(s, d, "pages"))


def social_links(s, d):
    return crawl.profile_links(table(s, d, "pages"))


def owner_jsonld(s, d):
    return crawl.structured_people(table(s, d, "pages"))


def text_blocks(s, d):
    docs = table(s, d, "documents").where("text IS NOT NULL AND source IN ('ai_overview', 'search_snippet')")
    body = F.to_json(F.struct(F.when(F.col("source") == "ai_overview", F.col("text")).alias("ai_overview"), F.when(F.col("source") == "search_snippet", F.array(F.struct(F.col("url").alias("url"), F.col("text").alias("snippet")))).alias("organic_results")))
    return payloads.text_blocks(docs.select("doc_id", body.alias("payload"))).select("doc_id", "kind", "text")


def normalize_title(s, d):
    t = table(s, d, "owner_candidates").where("title IS NOT NULL").select("title").distinct()
    return t.select("title", people_text.title_rank(F.col("title")).alias("t")).select("title", F.col("t.title").alias("known"), "t.rank")


def looks_like_person(s, d):
    return table(s, d, "owner_candidates").where("name IS NOT NULL").select("candidate_id", people_text.looks_like_person("name").alias("person"))


def reranked(s, d):
    return people_text.reranked(table(s, d, "owner_candidates"), ["founder", "owner", "manager"]).select("candidate_id", "title", "rank")


def _told(s, d):
    kind = F.when(F.col("source") == "ai_overview", "overview").when(F.col("source") == "search_snippet", "hit")
    return table(s, d, "documents").select("business_key", kind.alias("kind"), "text").where("kind IS NOT NULL")


def owner_search(s, d):
    return people_text.told_owners(_told(s, d), table(s, d, "businesses"))


def harvest_person_emails(s, d):
    people = table(s, d, "owner_candidates").where("business_key IS NOT NULL AND name IS NOT NULL").select("business_key", "name").distinct()
    return people_text.addresses_of(people, table(s, d, "documents").select("business_key", "text"))


def classify_payload(s, d):
    p = table(s, d, "places").select("listing_id", F.when(F.col("listing_id") % 4 == 0, F.lit('{"results": []}')).when(F.col("listing_id") % 4 == 1, F.lit('{"error": "quota exceeded"}')).when(F.col("listing_id") % 4 == 2, F.lit(None)).otherwise(F.concat(F.lit('{"results": ['), "raw", F.lit("]}"))).alias("payload"))
    return p.select("listing_id", answers.classify(F.col("payload")).alias("kind"))


def listing_pages(s, d):
    p = table(s, d, "places").where("query IS NOT NULL").select("query", F.get_json_object("raw", "$.page").cast("int").alias("page"), "place_id", "listing_id").where("page IS NOT NULL")
    return answers.pages_until_known(p, "place_id").select("listing_id", "page")


def recheck(s, d):
    """Undecided addresses with the verdict of a second service."""
    e = table(s, d, "emails").where("email IS NOT NULL AND provider IS NOT NULL AND status IS NOT NULL").select(F.lower(F.trim("email")).alias("email"), "provider", "status")
    one, two = (e.where(F.col("provider") == p).groupBy("email").agg(F.max("status").alias(c)) for p, c in (("mailprobe", "first"), ("checkbox", "second")))
    return one.join(two, "email", "left").select("email", F.when(F.col("first").isin("unknown", "risky"), F.coalesce("second", "first")).otherwise(F.col("first")).alias("status"))


def recent_sample(s, d):
    return table(s, d, "businesses").orderBy(F.desc_nulls_last("updated_at"), F.desc("business_id")).limit(200).select("business_id", "key", "updated_at")


_FUNCTIONS = (
    normalize_title, looks_like_person, reranked, owner_search, harvest_person_emails, classify_payload, listing_pages, recheck, recent_sample,
    run_plan, run_headline, deferred_guess_keys, progress_view, domain_guessable, gen_role_locals, semi_exclude, pattern_label, vendor_verdicts, prefilter, verify_one, found_worth_verifying, keep_candidate, drop_no_mx, tag_owner_emails, batch_id,
    retry_split, query_type, is_medical, lead_contacts, business_rows, lead_rows, nested_leads, crawl_site, social_links, owner_jsonld, text_blocks,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_CLEAN = """(SELECT * EXCLUDE (n) FROM (SELECT * REPLACE (lower(trim(email)) AS email), row_number() OVER (PARTITION BY business_key, lower(trim(email)) ORDER BY confidence DESC NULLS LAST, source NULLS LAST, status NULLS LAST, contact_type NULLS LAST, contact_name NULLS LAST) AS n
 FROM emails WHERE business_key IS NOT NULL AND email IS NOT NULL AND trim(email) <> '') WHERE n = 1)"""
_LEADS = f"""(WITH r AS (SELECT *, coalesce(contact_type IN ('owner', 'manager'), false) AS is_owner FROM {_CLEAN} WHERE coalesce(NOT is_low_value AND status NOT IN ('invalid', 'disposable'), false) AND confidence IS NOT NULL),
 t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_key, is_owner ORDER BY confidence DESC, email) AS k FROM r) WHERE k = 1),
 m AS (SELECT business_key, max(CASE WHEN is_owner THEN confidence END) AS o, max(CASE WHEN NOT is_owner THEN confidence END) AS g FROM t GROUP BY 1)
 SELECT t.business_key, email, confidence, contact_type, is_owner, CASE WHEN is_owner THEN g IS NULL OR o >= g - 5 ELSE o IS NULL OR NOT (g IS NULL OR o >= g - 5) END AS is_best FROM t JOIN m USING (business_key))"""
_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(updated_at, TIMESTAMP '1900-01-01') DESC, business_id DESC) AS k FROM businesses WHERE key IS NOT NULL) WHERE k = 1)"
_ROLES = verdicts.ROLES
_FREE = "|".join(h.replace(".", "\\.") for h in verdicts.FREE_MAIL)
_PLAT = "|".join(h.replace(".", "\\.") for h in verdicts.PLATFORMS)
_JUNK = "|".join(h.replace(".", "\\.") for h in verdicts.JUNK)
_SYN = "(length(email) <= 254 AND regexp_full_match(email, '[A-Za-z0-9._%+''-]{1,64}@([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\\.)+[A-Za-z]{2,24}') AND NOT regexp_matches(email, '^\\.|\\.@|\\.\\.'))"
_PRE = f"CASE WHEN NOT {_SYN} THEN 'invalid' WHEN regexp_extract(email, '@([^@]*)$', 1) IN ({', '.join(map(repr, verdicts.THROWAWAY))}) THEN 'disposable' WHEN regexp_extract(email, '^(.*)@', 1) IN ({', '.join(map(repr, verdicts.UNREAD))}) THEN 'invalid' WHEN NOT coalesce(mx_found, true) THEN 'invalid' END"

SQL = {
    "run_plan": "SELECT run_id, n AS businesses, 20520 AS checks_per_hour, round(n * 0.3::DOUBLE, 6) AS found, round(n * 0.3::DOUBLE / 20520, 9) AS hours_found, round(n * 0.9::DOUBLE / 20520, 9) AS hours_all, greatest(1, CAST(ceil(round(n * 0.9::DOUBLE, 6) / (20520 * 8)) AS BIGINT)) AS keys_for_all FROM (SELECT run_id, count(*) AS n FROM businesses WHERE run_id IS NOT NULL GROUP BY 1)",
    "run_headline": """WITH j AS (SELECT b.run_id, b.key, e.contact_type, e.status FROM businesses b JOIN emails e ON e.business_key = b.key WHERE b.run_id IS NOT NULL)
SELECT b.run_id, count(*) AS businesses, count(*) FILTER (coalesce(trim(website), '') <> '') AS with_website, count(*) FILTER (is_chain) AS chains,
 (SELECT count(DISTINCT key) FROM j WHERE j.run_id = b.run_id) AS with_any_email, (SELECT count(DISTINCT key) FROM j WHERE j.run_id = b.run_id AND contact_type IN ('owner', 'manager')) AS owner_emails,
 (SELECT count(DISTINCT key) FROM j WHERE j.run_id = b.run_id AND status = 'valid') AS verified, (SELECT count(*) FROM j WHERE j.run_id = b.run_id) AS total_emails FROM businesses b WHERE b.run_id IS NOT NULL GROUP BY b.run_id""",
    "deferred_guess_keys": "SELECT b.key, max(CASE WHEN e.contact_type IN ('owner', 'manager') THEN 1 ELSE 0 END) AS owner_guess, max(coalesce(e.confidence, 0)) AS confidence, min(b.updated_at) AS since FROM businesses b JOIN emails e ON e.business_key = b.key WHERE e.notes LIKE '%unproven%' GROUP BY b.key",
    "progress_view": "SELECT run_id, website_status, count(DISTINCT key) AS keys, count(DISTINCT key) FILTER (key IN (SELECT business_key FROM emails WHERE business_key IS NOT NULL)) AS with_email, count(*) FILTER (website IS NULL) AS no_site FROM businesses GROUP BY 1, 2",
    "domain_guessable": f"SELECT business_id, CASE WHEN dm = '' THEN 'no_domain' WHEN regexp_matches(dm, '(^|\\.)({_FREE})$') THEN 'free_mail_domain' WHEN regexp_matches(dm, '(^|\\.)({_PLAT})$') THEN 'platform_or_social_domain' WHEN regexp_matches(dm, '(^|\\.)({_JUNK})$') THEN 'not_a_business_domain' END AS reason FROM (SELECT business_id, lower(trim(coalesce(domain, ''))) AS dm FROM businesses)",
    "gen_role_locals": f"WITH b AS (SELECT domain, CASE WHEN is_chain THEN 3 WHEN reviews > 100 THEN 6 ELSE 21 END AS k FROM businesses WHERE domain IS NOT NULL), r AS (SELECT unnest({_ROLES}) AS local, unnest(range({len(_ROLES)})) AS pos) SELECT local, CAST(pos AS INTEGER) AS pos, count(DISTINCT domain) AS domains FROM b JOIN r ON r.pos < b.k GROUP BY 1, 2",
    "semi_exclude": f"SELECT business_key, email FROM {_CLEAN} WHERE source = 'permutation'",
    "prefilter": f"SELECT DISTINCT email, mx_found, {_PRE} AS verdict FROM (SELECT lower(trim(email)) AS email, mx_found FROM emails WHERE email IS NOT NULL)",
    "verify_one": f"""WITH e AS (SELECT * REPLACE (lower(trim(email)) AS email) FROM emails WHERE trim(email) <> ''), w AS (SELECT email, min(mx_found) AS mx_found FROM e GROUP BY 1),
k AS (SELECT email, max(status) AS known FROM e WHERE provider = 'mailprobe' AND status IS NOT NULL GROUP BY 1), a AS (SELECT email, max(status) AS answer FROM e WHERE provider = 'checkbox' GROUP BY 1),
r AS (SELECT w.email, known, answer, {_PRE.replace('(email', '(w.email').replace('length(w.email)', 'length(w.email)')} AS local FROM w LEFT JOIN k USING (email) LEFT JOIN a USING (email)),
q AS (SELECT email, row_number() OVER (ORDER BY email) <= 1000 AS asked FROM r WHERE known IS NULL AND local IS NULL)
SELECT r.email, coalesce(known, local, CASE WHEN asked THEN coalesce(answer, 'unknown') END, 'not_checked') AS status, CASE WHEN known IS NOT NULL THEN 'cache' WHEN local IS NOT NULL THEN 'local' WHEN asked THEN 'service' ELSE 'budget' END AS "by" FROM r LEFT JOIN q USING (email)""",
    "found_worth_verifying": f"SELECT business_key, email, contact_type, place, place > 3 AS over_cap FROM (SELECT *, row_number() OVER (PARTITION BY business_key, contact_type ORDER BY on_business_domain DESC NULLS LAST, confidence DESC NULLS LAST, length(email), email) AS place FROM {_CLEAN} WHERE source <> 'permutation')",
    "keep_candidate": "SELECT business_key, count(*) AS kept FROM emails WHERE email IS NOT NULL AND status NOT IN ('invalid', 'disposable') AND NOT coalesce(is_low_value, false) GROUP BY 1",
    "drop_no_mx": "SELECT source, count(*) AS kept FROM emails WHERE coalesce(source, '') <> 'permutation' OR coalesce(mx_found, true) GROUP BY 1",
    "tag_owner_emails": f"SELECT e.business_key, email, CASE WHEN o.who IS NOT NULL THEN 'owner' ELSE contact_type END AS contact_type FROM {_CLEAN} e LEFT JOIN (SELECT DISTINCT business_key, lower(trim(name)) AS who FROM owner_candidates WHERE business_key IS NOT NULL AND name IS NOT NULL) o ON e.business_key = o.business_key AND lower(trim(e.contact_name)) = o.who",
    "batch_id": f"SELECT business_key, substr(sha1(string_agg(email, chr(10) ORDER BY email)), 1, 20) AS batch, count(*) AS n FROM {_CLEAN} GROUP BY 1",
    "retry_split": "SELECT CASE WHEN status IN ('unknown', 'risky') THEN 'retry' ELSE 'done' END AS file, status, count(*) AS n FROM emails WHERE email IS NOT NULL GROUP BY 1, 2",
    "is_medical": "SELECT business_id, regexp_matches(lower(concat_ws(' ', category, query)), '\\b(dent(al|ist)|doctor|medical|clinic|chiropract(or|ic)|veterinar(ian|y)|physician|hospital|orthodont(ist|ics))\\b') AS medical FROM businesses",
    "lead_contacts": f"SELECT * FROM {_LEADS}",
    "business_rows": f"""SELECT b.key, b.name, b.city, coalesce(m.f, 0) AS emails_found, coalesce(m.g, 0) AS emails_guessed, coalesce(m.a, '') AS all_emails, coalesce(l.email, '') AS best_email, l.confidence AS best_confidence FROM {_LATEST} b
LEFT JOIN (SELECT business_key, count(*) FILTER (coalesce(source, '') <> 'permutation') AS f, count(*) FILTER (source = 'permutation') AS g, string_agg(email, '; ' ORDER BY email) AS a FROM {_CLEAN} GROUP BY 1) m ON m.business_key = b.key LEFT JOIN (SELECT * FROM {_LEADS} WHERE is_best) l ON l.business_key = b.key""",
    "lead_rows": f"SELECT b.key, b.name, b.city, b.state, l.email, l.confidence, l.contact_type FROM {_LATEST} b LEFT JOIN {_LEADS} l ON l.business_key = b.key",
    "text_blocks": "SELECT doc_id, CASE WHEN source = 'ai_overview' THEN 'overview' ELSE 'hit' END AS kind, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents WHERE source IN ('ai_overview', 'search_snippet') AND trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> ''",
}
SQL["vendor_verdicts"] = """WITH e AS (SELECT DISTINCT lower(trim(email)) AS email, status AS s FROM emails WHERE trim(email) <> '' AND status IS NOT NULL), k AS (SELECT *, CASE WHEN s IN ('valid', 'invalid', 'risky', 'catch_all', 'disposable', 'unknown') THEN s ELSE 'unknown' END AS t FROM e),
v AS (SELECT 'result_word' AS shape, t AS status FROM k UNION ALL SELECT 'sub_status', CASE WHEN t = 'invalid' THEN 'risky' ELSE t END FROM k
UNION ALL SELECT 'numbered', CASE WHEN s IN ('valid', 'invalid', 'disposable', 'catch_all') THEN s ELSE 'unknown' END FROM k UNION ALL SELECT 'flagged', CASE WHEN t IN ('valid', 'invalid') THEN t ELSE 'catch_all' END FROM k
UNION ALL SELECT 'text', t FROM k UNION ALL SELECT 'reasoned', CASE WHEN t = 'valid' THEN t ELSE 'catch_all' END FROM k UNION ALL SELECT 'coded', CASE WHEN s = 'valid' THEN 'valid' ELSE 'unknown' END FROM k)
SELECT shape, status, count(*) AS n, sum(CASE WHEN status = 'valid' THEN 90.0::DOUBLE WHEN status IN ('catch_all', 'risky') THEN 50.0::DOUBLE END) AS score FROM v GROUP BY 1, 2"""

_BY_LENGTH = sorted(RANK, key=lambda t: (len(t), t), reverse=True)
_LOW = "trim(regexp_replace(lower(title), '\\s+', ' ', 'g'))"
_PADDED = f"(' ' || regexp_replace({_LOW}, '[^a-z-]+', ' ', 'g') || ' ')"
SQL |= {
    "normalize_title": f"SELECT DISTINCT title, CASE {' '.join(f"WHEN contains({_PADDED}, ' {t} ') THEN '{t}'" for t in _BY_LENGTH)} ELSE {_LOW} END AS known, CASE {' '.join(f"WHEN contains({_PADDED}, ' {t} ') THEN {RANK[t]}" for t in _BY_LENGTH)} ELSE 30 END AS rank FROM owner_candidates WHERE title IS NOT NULL",
    "reranked": "SELECT candidate_id, title, CASE lower(trim(title)) WHEN 'founder' THEN 100 WHEN 'owner' THEN 97 ELSE 94 END AS rank FROM owner_candidates WHERE lower(trim(title)) IN ('founder', 'owner', 'manager')",
    "classify_payload": "SELECT listing_id, CASE listing_id % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'failure' WHEN 2 THEN 'failure' ELSE CASE WHEN raw IS NULL THEN 'failure' ELSE 'rows' END END AS kind FROM places",
    "listing_pages": """WITH p AS (SELECT query, CAST(json_extract_string(raw, '$.page') AS INTEGER) AS page, place_id, listing_id FROM places WHERE query IS NOT NULL), q AS (SELECT * FROM p WHERE page IS NOT NULL),
f AS (SELECT query, page, count(*) FILTER (place_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM q e WHERE e.query = q.query AND e.place_id = q.place_id AND e.page < q.page)) AS fresh FROM q GROUP BY 1, 2)
SELECT listing_id, page FROM q WHERE page < coalesce((SELECT min(page) FROM f WHERE f.query = q.query AND fresh = 0), 1000000)""",
    "recheck": "WITH e AS (SELECT lower(trim(email)) AS email, provider, status FROM emails WHERE email IS NOT NULL AND status IS NOT NULL), a AS (SELECT email, max(status) AS s FROM e WHERE provider = 'mailprobe' GROUP BY 1), b AS (SELECT email, max(status) AS t FROM e WHERE provider = 'checkbox' GROUP BY 1) SELECT a.email, CASE WHEN s IN ('unknown', 'risky') THEN coalesce(t, s) ELSE s END AS status FROM a LEFT JOIN b USING (email)",
    "recent_sample": "SELECT business_id, key, updated_at FROM businesses ORDER BY updated_at DESC NULLS LAST, business_id DESC LIMIT 200",
}
