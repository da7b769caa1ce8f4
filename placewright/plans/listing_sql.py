"""The queries of listing_queries in SQL for DuckDB."""

from __future__ import annotations

from placewright.operators.extract import ADDRESS
from placewright.plans.listing_queries import NOW

_WS = "[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _norm(x: str) -> str:
    marked = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
    plain = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
    return f"trim(regexp_replace(regexp_replace(replace(translate(lower({x}), '{marked}', '{plain}'), '&', ' and '), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _brand(x: str) -> str:
    cut = f"regexp_replace(regexp_replace({x}, '(?i)(?:\\b(?:no\\.?|store|location|unit)\\s*#?\\s*|#\\s*)\\d{{2,6}}\\b', '', 'g'), '\\s[-–]\\s*\\d{{2,6}}$', '')"
    name = f"regexp_replace({cut}, '^[\\s\\-–—,]+|[\\s\\-–—,]+$', '', 'g')"
    return f"CASE WHEN {name} = '' THEN {x} ELSE {name} END"


def _host(x: str) -> str:
    u = f"regexp_replace(trim(coalesce({x}, '')), '^[A-Za-z][A-Za-z0-9+.\\-]*://', '')"
    return f"lower(regexp_replace(regexp_extract({u}, '^(?:[^/?#@]*@)?([^/?#:]*)', 1), '^\\.+|\\.+$', '', 'g'))"


def _domain(x: str) -> str:
    h = _host(x)
    return f"CASE WHEN NOT contains({h}, '.') OR regexp_matches({h}, '^[\\d.]+$|\\.\\.|\\s') OR NOT regexp_matches({h}, '\\.[a-z]{{2,}}$') THEN '' ELSE regexp_extract({h}, '([^.]+\\.[^.]+)$', 1) END"


_PHONE = r"""
SELECT business_id, CASE WHEN length(dig) = 10 THEN '(' || substr(dig, 1, 3) || ')-' || substr(dig, 4, 3) || '-' || substr(dig, 7, 4) || CASE WHEN ext <> '' THEN ' ext. ' || ext ELSE '' END
  ELSE trim(regexp_replace(raw, '\s+', ' ', 'g')) END AS phone
FROM (SELECT business_id, raw, ext, CASE WHEN length(d) = 11 AND d LIKE '1%' THEN substr(d, 2) ELSE d END AS dig FROM (
  SELECT business_id, trim(coalesce(phone, '')) AS raw, regexp_extract(trim(coalesce(phone, '')), '(?i)(?:ext\.?|x|extension)\s*(\d{1,6})\s*$', 1) AS ext,
    regexp_replace(regexp_replace(trim(coalesce(phone, '')), '(?i)(?:ext\.?|x|extension)\s*\d{1,6}\s*$', ''), '[^0-9]', '', 'g') AS d FROM businesses))"""

_DEDUPE = r"""
SELECT business_id, CASE WHEN coalesce(place_id, '') <> '' THEN lower('pid:' || place_id) WHEN length(d) >= 7 THEN 'tel:' || d
  WHEN coalesce(address, '') <> '' THEN 'na:' || lower(trim(coalesce(name, ''))) || '|' || lower(trim(address))
  ELSE 'nd:' || lower(trim(coalesce(name, ''))) || '|' || lower(coalesce(domain, '')) END AS dedupe_key
FROM (SELECT *, right(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g'), 10) AS d FROM businesses)"""

_FIRST = "SELECT key, business_id, query, run_id, arrived_at FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY arrived_at NULLS LAST, business_id) AS r FROM businesses WHERE key IS NOT NULL) WHERE r = 1"
_BRANDS = f"SELECT brand, count(DISTINCT city) AS cities FROM (SELECT {_norm(_brand('name'))} AS brand, lower(trim(city)) AS city FROM businesses) WHERE brand <> '' AND city <> '' GROUP BY 1 HAVING count(DISTINCT city) >= 3"
_SUPPORT = f"""SELECT business_key, person, max(rank) AS rank, CAST(sum(coalesce(weight, 1)) AS BIGINT) AS support, count(DISTINCT source) AS sources, count(*) AS mentions
FROM (SELECT *, {_norm('name')} AS person FROM owner_candidates WHERE business_key IS NOT NULL) WHERE person <> '' GROUP BY 1, 2"""

SQL = {
    "squeeze": f"SELECT candidate_id, {_sq('name')} AS name FROM owner_candidates",
    "normalize_name": f"SELECT business_id, {_norm('name')} AS name FROM businesses",
    "name_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest(string_split({_norm('name')}, ' ')) AS token FROM businesses) WHERE token <> '' GROUP BY 1",
    "city_from_address": rf"""SELECT business_id, CASE WHEN length(c) > 2 AND NOT regexp_matches(c, '\d') THEN c ELSE '' END AS city FROM (
  SELECT business_id, regexp_replace({_sq("regexp_extract(coalesce(address, ''), '(?:^|,)" + chr(92) + "s*" + chr(92) + "d+[A-Za-z]?" + chr(92) + "b[^,]*," + chr(92) + "s*([^,]*)', 1)")}, '\s+\d{{4,}}(?:-\d{{4}})?$', '') AS c FROM businesses)""",
    "state_from": r"SELECT business_id, regexp_extract(coalesce(address, ''), ',\s*([A-Z]{2})(?:\s+\d{5}(?:-\d{4})?)?(?:,?\s*(?:USA|US|United States))?\s*$', 1) AS state FROM businesses",
    "format_phone": _PHONE,
    "dedupe_key": _DEDUPE,
    "brand_display_name": f"SELECT business_id, {_brand('name')} AS brand FROM businesses",
    "hostname": f"SELECT business_id, {_host('website')} AS host FROM businesses",
    "registered_domain": f"SELECT {_domain('website')} AS domain, count(*) AS n FROM businesses GROUP BY 1",
    "normalize_url": r"""SELECT business_id, CASE WHEN u = '' OR regexp_extract(f, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) = '' THEN '' ELSE lower(regexp_extract(f, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1))
  || CASE WHEN regexp_extract(f, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(f, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) END || regexp_extract(f, '^[^?#]*(\?[^#]*)', 1) END AS url
FROM (SELECT business_id, u, CASE WHEN u LIKE '//%' THEN 'https:' || u WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN u ELSE 'https://' || u END AS f FROM (SELECT business_id, trim(coalesce(website, '')) AS u FROM businesses))""",
    "clean_state": "SELECT business_id, CASE WHEN length(trim(coalesce(state, ''))) = 2 THEN upper(trim(state)) ELSE array_to_string(list_transform(string_split(lower(trim(coalesce(state, ''))), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') END AS state FROM businesses",
    "parse_query": r"""SELECT DISTINCT query, CASE WHEN regexp_matches(query, '(?i)\s(in|near)\s') THEN regexp_extract(query, '(?i)^(.+?)\s+(?:in|near)\s+', 1) ELSE query END AS business_type,
  CASE WHEN regexp_matches(query, '(?i)\s(in|near)\s') THEN regexp_extract(query, '(?i)^.+?\s+(?:in|near)\s+(.+)$', 1) ELSE '' END AS location FROM businesses WHERE query IS NOT NULL""",
    "same_site": "SELECT page_id, regexp_extract(url, '([^./]+\\.[a-z]+)(/|$|\\?)', 1) = regexp_extract(site, '([^./]+\\.[a-z]+)$', 1) AS same FROM pages".replace("\\\\", "\\"),
    "fmt_duration": "SELECT doc_id, CASE WHEN h > 0 THEN h || 'h ' || lpad(CAST(m AS VARCHAR), 2, '0') || 'm' WHEN m > 0 THEN m || 'm ' || lpad(CAST(s AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS duration FROM (SELECT doc_id, n_chars // 3600 AS h, n_chars % 3600 // 60 AS m, n_chars % 60 AS s FROM documents)",
    "trim_context": f"SELECT doc_id, {_sq('substr(text, greatest(i - 20, 1), i + 20 - greatest(i - 20, 1))')} AS context FROM (SELECT doc_id, text, instr(text, '@') AS i FROM documents) WHERE i > 0",
    "text_addresses": f"SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{ADDRESS}'))) AS email FROM documents WHERE text IS NOT NULL",
    "page_hrefs": """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*\\bhref="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""",
    "page_jsonld": """SELECT page_id, json_extract_string(b, '$.telephone') AS telephone, json_extract_string(b, '$."@type"') AS type FROM (
  SELECT page_id, regexp_extract(html, '<script type="application/ld\\+json">([^<]*)</script>', 1) AS b FROM pages) WHERE b <> ''""",
    "page_title": f"SELECT page_id, {_sq(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?is)<title>(.*?)</title>' + chr(39) + ', 1)')} AS title FROM pages WHERE html IS NOT NULL",
    "page_ok": "SELECT site, count(*) AS pages, count(*) FILTER (status BETWEEN 200 AND 299 AND coalesce(length(html), 0) > 0) AS ok_pages, max(fetched_at) AS last_fetch FROM pages GROUP BY 1",
    "place_payload": "SELECT listing_id, coalesce(nullif(json_extract_string(raw, '$.category'), ''), nullif(json_extract_string(raw, '$.kind'), '')) AS category, CAST(json_extract_string(raw, '$.page') AS BIGINT) AS page, CAST(json_extract_string(raw, '$.pos') AS BIGINT) AS pos FROM places",
    "normalize_status": "SELECT CASE WHEN status IN ('valid', 'invalid', 'risky', 'catch_all', 'disposable') THEN status ELSE 'unknown' END AS status, count(*) AS n FROM emails GROUP BY 1",
    "join_business_emails": "SELECT business_key, count(*) AS rows, count(email) AS addresses, max(confidence) AS best FROM emails JOIN (SELECT DISTINCT key FROM businesses WHERE key IS NOT NULL) ON business_key = key GROUP BY 1",
    "anti_seen": "SELECT business_key, count(*) AS rows FROM emails WHERE business_key IS NOT NULL AND business_key NOT IN (SELECT key FROM businesses WHERE key IS NOT NULL) GROUP BY 1",
    "cache_hits": f"SELECT url, max(fetched_at) AS fetched_at FROM pages WHERE url IS NOT NULL AND fetched_at >= {NOW} - INTERVAL 90 DAY GROUP BY 1",
    "cache_misses": f"SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE url IS NOT NULL AND fetched_at >= {NOW} - INTERVAL 90 DAY)",
    "ttl_prune": f"SELECT site, count(*) AS kept FROM pages WHERE fetched_at >= {NOW} - INTERVAL 120 DAY GROUP BY 1",
    "newest_listing": "SELECT query, listing_id, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fetched_at DESC NULLS LAST, listing_id) AS r FROM places WHERE query IS NOT NULL) WHERE r = 1",
    "cross_query_dedupe": _FIRST,
    "found_per_query": f"SELECT query, count(*) AS found FROM ({_FIRST}) GROUP BY 1",
    "partial_upsert": """SELECT f.key, f.place_id, f.category, f.phone, f.rating, l.name, l.website, l.website_status
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY arrived_at NULLS FIRST, business_id) AS r FROM businesses WHERE key IS NOT NULL) f
JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY arrived_at DESC NULLS LAST, business_id DESC) AS r FROM businesses WHERE key IS NOT NULL) l ON f.key = l.key AND f.r = 1 AND l.r = 1""",
    "coalesce_upsert": """WITH e AS (SELECT lower(regexp_extract(email, '@(.*?) *$', 1)) AS domain, mx_found, status, arrived_at FROM emails WHERE arrived_at IS NOT NULL),
f AS (SELECT domain, arrived_at >= TIMESTAMP '2024-07-01' AS new, bool_or(mx_found) AS has_mx, bool_or(CASE WHEN status = 'catch_all' THEN true END) AS is_catch_all FROM e WHERE domain <> '' GROUP BY 1, 2)
SELECT coalesce(n.domain, o.domain) AS domain, coalesce(n.has_mx, o.has_mx) AS has_mx, coalesce(n.is_catch_all, o.is_catch_all) AS is_catch_all
FROM (SELECT * FROM f WHERE new) n FULL JOIN (SELECT * FROM f WHERE NOT new) o ON n.domain = o.domain""",
    "stage_latest": "SELECT user_id, m.ts AS ts, m.event_type AS event_type FROM (SELECT user_id, max({'ts': ts, 'event_type': event_type}) AS m FROM events WHERE user_id IS NOT NULL GROUP BY 1)",
    "events_by_day": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "early_stop": """WITH e AS (SELECT business_key, email, max(confidence) AS confidence, bool_or(status IN ('valid', 'catch_all')) AS hit FROM emails WHERE business_key IS NOT NULL AND email IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, coalesce(max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY business_key ORDER BY confidence DESC NULLS LAST, email ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT business_key, count(*) AS checked, bool_or(hit) AS stopped FROM w WHERE before = 0 GROUP BY 1""",
    "best_per_kind": """WITH e AS (SELECT business_key, contact_type, email, max(coalesce(confidence, -1)) AS confidence FROM emails WHERE business_key IS NOT NULL AND email IS NOT NULL AND contact_type IS NOT NULL GROUP BY 1, 2, 3)
SELECT business_key, contact_type, email, confidence FROM (SELECT *, row_number() OVER (PARTITION BY business_key, contact_type ORDER BY confidence DESC, email) AS r FROM e) WHERE r = 1""",
    "status_counts": "SELECT provider, count(*) AS checks, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'invalid') AS invalid, count(DISTINCT business_key) AS businesses FROM emails GROUP BY 1",
    "run_counters": "SELECT run_id, count(*) AS rows, count(DISTINCT key) AS listings, count(*) FILTER (coalesce(website, '') = '') AS no_website, count(*) FILTER (is_chain) AS chains, count(*) FILTER (website_status = 'ok') AS sites_ok, count(rating) AS rated FROM businesses GROUP BY 1",
    "db_stats": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("businesses", "places", "owner_candidates", "emails", "pages", "documents")),
    "string_rollup": "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), '; ' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS joined FROM lineitem GROUP BY 1",
    "notes_rollup": "SELECT business_key, string_agg(notes, '; ' ORDER BY notes) AS joined FROM (SELECT DISTINCT business_key, notes FROM emails WHERE business_key IS NOT NULL AND notes <> '') GROUP BY 1",
    "pace": "SELECT day, n, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS pace FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)",
    "owner_support": f"SELECT *, coalesce(rank, 0) * 10 + support * 4 + sources * 3 AS score FROM ({_SUPPORT})",
    "choose_owner": f"""WITH s AS (SELECT *, coalesce(rank, 0) * 10 + support * 4 + sources * 3 AS score FROM ({_SUPPORT})),
r AS (SELECT *, row_number() OVER w AS rn, lead(rank) OVER w AS r2, lead(support) OVER w AS s2, lead(person) OVER w AS p2, count(*) OVER (PARTITION BY business_key, rank) AS rivals FROM s WINDOW w AS (PARTITION BY business_key ORDER BY score DESC, person))
SELECT business_key, person, rank, support, score, rivals FROM r WHERE rn = 1 AND NOT coalesce(r2 = rank AND s2 = support AND split_part(p2, ' ', 1) <> split_part(person, ' ', 1), false) AND rank IS NOT NULL""",
    "brand_table": _BRANDS,
    "prefix_lookup": f"""WITH b AS ({_BRANDS}), w AS (SELECT business_id, string_split({_norm(_brand('name'))}, ' ') AS t FROM businesses),
t AS (SELECT business_id, 9 AS n, array_to_string(t, ' ') AS brand FROM w UNION ALL SELECT business_id, n, array_to_string(t[1:n], ' ') FROM w, (VALUES (4), (3), (2), (1)) v(n) WHERE len(t) > n AND (n > 1 OR length(t[1]) > 4))
SELECT business_id, brand, CASE WHEN n = 9 THEN 'exact' ELSE 'prefix' END AS kind FROM (SELECT business_id, t.brand, n, row_number() OVER (PARTITION BY business_id ORDER BY n DESC) AS r FROM t JOIN b ON t.brand = b.brand) WHERE r = 1""",
    "shared_domains": f"SELECT domain, count(DISTINCT city) AS cities, count(*) AS listings FROM (SELECT regexp_replace({_host('website')}, '^www[.]', '') AS domain, lower(trim(city)) AS city FROM businesses) WHERE domain LIKE '%.%' GROUP BY 1 HAVING count(DISTINCT city) >= 3",
    "verdict_broadcast": "WITH v AS (SELECT lower(trim(email)) AS a, count(*) AS valid_rows FROM emails WHERE status = 'valid' AND trim(email) <> '' GROUP BY 1) SELECT business_key, count(*) AS rows, count(valid_rows) AS known FROM emails LEFT JOIN v ON lower(trim(email)) = a GROUP BY 1",
    "site_coverage": f"""SELECT site, bool_or(key IS NOT NULL) AS on_listing FROM (SELECT DISTINCT site, business_key FROM pages)
LEFT JOIN (SELECT DISTINCT key, regexp_replace({_host('website')}, '^www\\.', '') AS host FROM businesses) ON business_key = key AND site = host GROUP BY 1""",
    "rank_by_rating": "SELECT city, business_id, rating, reviews, rank FROM (SELECT city, business_id, rating, reviews, row_number() OVER (PARTITION BY city ORDER BY rating DESC, reviews DESC, business_id) AS rank FROM businesses WHERE city IS NOT NULL AND rating IS NOT NULL AND reviews IS NOT NULL) WHERE rank <= 3",
}

_LOC = "'^([^,]+),\\s*([A-Za-z]{2})(?:\\s+(\\d{5}(?:-\\d{4})?))?$'"
_END = "'([^,]+),\\s*([A-Za-z]{2})(?:\\s+(\\d{5}(?:-\\d{4})?))?\\s*$'"
SQL["split_locality"] = f"""WITH p AS (SELECT listing_id, coalesce({_sq('city')}, '') AS c, coalesce({_sq('state')}, '') AS s, coalesce({_sq('postal_code')}, '') AS z, coalesce(address, '') AS a FROM places), q AS (SELECT *, regexp_matches(c, {_LOC}) AS w FROM p)
SELECT listing_id, coalesce(nullif(CASE WHEN w THEN trim(regexp_extract(c, {_LOC}, 1)) ELSE c END, ''), nullif(trim(regexp_extract(a, {_END}, 1)), ''), '') AS city,
 coalesce(nullif(s, ''), CASE WHEN w THEN upper(regexp_extract(c, {_LOC}, 2)) END, nullif(upper(regexp_extract(a, {_END}, 2)), ''), '') AS state,
 coalesce(nullif(z, ''), CASE WHEN w THEN nullif(regexp_extract(c, {_LOC}, 3), '') END, nullif(regexp_extract(a, {_END}, 3), ''), '') AS postal_code FROM q"""
SQL["split_name"] = """WITH n AS (SELECT candidate_id, list_filter(regexp_split_to_array(replace(regexp_replace(trim(coalesce(name, '')), '(?i)^(?:dr|mr|mrs|ms|miss|prof)\\.?\\s+', ''), ',', ' '), '\\s+'), lambda t: t <> '') AS w FROM owner_candidates),
k AS (SELECT candidate_id, [w[i] FOR i IN range(1, len(w) + 1) IF NOT (i > 1 AND i < len(w) AND length(regexp_replace(w[i], '\\.+$', '')) = 1)] AS x FROM n)
SELECT candidate_id, coalesce(x[1], '') AS first, coalesce(array_to_string(x[2:], ' '), '') AS rest FROM k"""
