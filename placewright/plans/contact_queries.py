"""Queries about sites, mailboxes and people, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewright.operators import discovery, extract, mailboxes, titles
from placewright.plans.listing_sql import _host, _norm
from placewright.session import table


def discovery_query(s, d):
    c = F.col
    return table(s, d, "businesses").select("business_id", discovery.discovery_query(c("name"), c("city"), c("state")).alias("q"))


def distinctive_tokens(s, d):
    rows = table(s, d, "businesses")
    return rows.select("business_id", F.array_join(discovery.distinctive_tokens("name", discovery.generic_words(rows)), " ").alias("tokens"))


def confirm_website(s, d):
    return discovery.confirm_sites(table(s, d, "pages"), table(s, d, "businesses"))


def pick_website(s, d):
    return discovery.pick_sites(table(s, d, "businesses"))


def mailbox_kind(s, d):
    return table(s, d, "emails").where("email IS NOT NULL").groupBy(mailboxes.kind("email").alias("kind")).agg(F.count("*").alias("n"))


def syntax_ok(s, d):
    return table(s, d, "emails").where("email IS NOT NULL").select(F.trim("email").alias("email"), mailboxes.syntax_ok("email").alias("ok")).distinct()


def email_domains(s, d):
    return table(s, d, "emails").where("email IS NOT NULL").groupBy(mailboxes.domain_part("email").alias("domain")).agg(F.count("*").alias("rows"), F.count_distinct("business_key").alias("businesses"))


def gen_person_locals(s, d):
    return table(s, d, "owner_candidates").where("name IS NOT NULL").select("candidate_id", F.posexplode(mailboxes.person_locals("name")).alias("pos", "local"))


def email_matches_person(s, d):
    return mailboxes.spelling_mailboxes(table(s, d, "emails"), table(s, d, "owner_candidates"))


def owner_text(s, d):
    return titles.mentions_in(table(s, d, "owner_candidates"), "candidate_id", "evidence")


def smart_title(s, d):
    return titles.smart_titles(table(s, d, "businesses").select("business_id", "name"), "name")


def extract_emails(s, d):
    return extract.extract_emails(table(s, d, "pages"))


def site_absorb(s, d):
    pages = table(s, d, "pages")
    return extract.best_per_site(extract.extract_emails(pages), pages)


def parse_page(s, d):
    return extract.parse_pages(table(s, d, "pages")).select("page_id", "title", F.length("text").alias("chars"), F.size("links").alias("links"), F.size("jsonld").alias("bodies"))


QUERIES = {f.__name__: f for f in (discovery_query, distinctive_tokens, confirm_website, pick_website, mailbox_kind, syntax_ok, email_domains, gen_person_locals, email_matches_person, owner_text, smart_title, extract_emails, site_absorb, parse_page)}

_NAMES = f"(SELECT DISTINCT {_norm('name')} AS n FROM businesses WHERE name IS NOT NULL AND {_norm('name')} <> '')"
_GEN = f"(SELECT coalesce(list(w), []) FROM (SELECT w FROM (SELECT n, unnest(list_distinct(string_split(n, ' '))) AS w FROM {_NAMES}) GROUP BY w HAVING count(*) >= {discovery.LEAST} AND count(*) >= {discovery.COMMON} * (SELECT count(*) FROM {_NAMES})))"
_TOK = f"list_filter(string_split({_norm('name')}, ' '), lambda t: length(t) > 1 AND NOT list_contains(g.g, t))"
_LOCAL, _DOM = "lower(regexp_extract(trim(email), '^(.*)@', 1))", "lower(regexp_extract(trim(email), '@([^@]*)$', 1))"
_OK = "(length(trim(email)) <= 254 AND regexp_matches(trim(email), '^[A-Za-z0-9._%+\\-'']{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9\\-]{0,61}[A-Za-z0-9])?\\.)+[A-Za-z]{2,24}$') AND NOT regexp_matches(trim(email), '^\\.|\\.@|\\.\\.'))"
_PL = """list_filter(list_transform([f, f || '.' || l, f || l, fi || l, fi || '.' || l, l, f || li, f || '_' || l, l || '.' || f, l || fi], lambda x: x), lambda x: length(x) >= 2)"""
_PERSON = f"""(SELECT *, t[1] AS f, t[-1] AS l, substr(t[1], 1, 1) AS fi, substr(t[-1], 1, 1) AS li FROM (SELECT *, list_filter(string_split({_norm('name')}, ' '), lambda w: w <> '') AS t FROM owner_candidates WHERE name IS NOT NULL) WHERE len(t) > 0)"""

SQL = {
    "discovery_query": """SELECT business_id, CASE WHEN name IS NULL THEN concat_ws(' ', nullif(trim(regexp_replace(coalesce(city, ''), '\\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(coalesce(state, ''), '\\s+', ' ', 'g')), ''))
  ELSE concat_ws(' ', '"' || trim(regexp_replace(name, '\\s+', ' ', 'g')) || '"', nullif(trim(regexp_replace(coalesce(city, ''), '\\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(coalesce(state, ''), '\\s+', ' ', 'g')), '')) END AS q FROM businesses""",
    "distinctive_tokens": f"SELECT business_id, array_to_string({_TOK}, ' ') AS tokens FROM businesses, (SELECT {_GEN} AS g) g",
    "pick_website": f"""WITH r AS (SELECT key, regexp_replace({_host('website')}, '^www\\.', '') AS host, {_TOK} AS t FROM businesses, (SELECT {_GEN} AS g) g WHERE key IS NOT NULL),
s AS (SELECT key, host, max(CASE WHEN j <> '' AND (lab = j OR (length(j) >= 6 AND contains(lab, j))) THEN 60 WHEN len(t) > 0 THEN CAST(floor(45 * len(list_filter(t, lambda x: contains(lab, x))) / len(t)) AS INTEGER) ELSE 0 END) AS score
  FROM (SELECT *, replace(split_part(host, '.', 1), '-', '') AS lab, array_to_string(t, '') AS j FROM r WHERE host LIKE '%.%') GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nx FROM s WINDOW w AS (PARTITION BY key ORDER BY score DESC, host))
SELECT key, host, score FROM n WHERE rn = 1 AND score >= 40 AND (nx IS NULL OR score - nx >= 10)""",
    "mailbox_kind": f"SELECT CASE WHEN NOT {_OK} THEN 'malformed' WHEN {_LOCAL} IN ({', '.join(repr(x) for x in mailboxes.UNREAD)}) THEN 'unread' WHEN {_LOCAL} IN ({', '.join(repr(x) for x in mailboxes.ROLES)}) THEN 'role' ELSE 'personal' END AS kind, count(*) AS n FROM emails WHERE email IS NOT NULL GROUP BY 1",
    "gen_person_locals": f"""SELECT candidate_id, CAST(pos AS INTEGER) AS pos, local FROM (SELECT candidate_id, unnest(x) AS local, unnest(range(len(x))) AS pos FROM (SELECT candidate_id, CASE WHEN len(t) = 1 THEN [f] ELSE [v[i] FOR i IN range(1, len(v) + 1) IF list_position(v, v[i]) = i] END AS x FROM (SELECT *, {_PL} AS v FROM {_PERSON})))""",
    "syntax_ok": f"SELECT DISTINCT trim(email) AS email, {_OK} AS ok FROM emails WHERE email IS NOT NULL",
    "email_domains": f"SELECT {_DOM} AS domain, count(*) AS rows, count(DISTINCT business_key) AS businesses FROM emails WHERE email IS NOT NULL GROUP BY 1",
    "email_matches_person": f"""WITH p AS (SELECT DISTINCT business_key, array_to_string(t, ' ') AS person, regexp_replace(unnest(CASE WHEN len(t) = 1 THEN [f] ELSE {_PL} END), '[^a-z]', '', 'g') AS spelt FROM {_PERSON} WHERE business_key IS NOT NULL),
e AS (SELECT DISTINCT business_key, lower(trim(email)) AS email, regexp_replace({_LOCAL}, '[^a-z]', '', 'g') AS spelt FROM emails WHERE business_key IS NOT NULL AND email IS NOT NULL)
SELECT DISTINCT e.business_key, e.email, p.person FROM e JOIN p ON e.business_key = p.business_key AND e.spelt = p.spelt WHERE length(p.spelt) >= 3""",
}
