"""Queries of the ten problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewright.llm import abuse, gazetteer, mainbody, matching, mixing, people, residue, survivorship, tokenizer, topn
from placewright.session import table


def p1_found(spark, sf_dir):
    return mainbody.main_bodies(table(spark, sf_dir, "pages"))


def p2_found(spark, sf_dir):
    listings = table(spark, sf_dir, "businesses")
    business = matching.variant_pairs(matching.Resolution(listings), listings)
    owner = people.person_pairs(table(spark, sf_dir, "owner_candidates"))
    kinds = [df.select(F.lit(k).alias("kind"), "id_a", "id_b") for k, df in (("business", business), ("owner", owner))]
    return kinds[0].unionByName(kinds[1])


def p3_found(spark, sf_dir):
    return gazetteer.matching_addresses(table(spark, sf_dir, "businesses"), table(spark, sf_dir, "places"))


def _resolution(spark, sf_dir):
    return matching.Resolution(table(spark, sf_dir, "businesses"), table(spark, sf_dir, "places"))


def p4_found(spark, sf_dir):
    return p4_matches(spark, sf_dir).select("business_id", "listing_id").distinct()


def p4_matches(spark, sf_dir):
    return matching.matched_pairs(_resolution(spark, sf_dir))


def p5_found(spark, sf_dir):
    return topn.best_emails(table(spark, sf_dir, "emails")).select("business_key", "email")


def p6_found(spark, sf_dir):
    return survivorship.surviving_contacts(table(spark, sf_dir, "businesses"))


def p7_scores(spark, sf_dir):
    return residue.score_pages(table(spark, sf_dir, "pages"))


def p7_found(spark, sf_dir):
    return residue.residue_pages(p7_scores(spark, sf_dir))


def p8_ids(spark, sf_dir):
    return tokenizer.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _mixture(spark, sf_dir):
    targets = table(spark, sf_dir, "mix_targets")
    sized = mixing.sized_documents(table(spark, sf_dir, "documents"), targets)
    plan = mixing.budgets(sized, targets)
    return mixing.mix(sized, plan), plan


def p9_mix(spark, sf_dir):
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark, sf_dir):
    return mixing.shares(*_mixture(spark, sf_dir))


def p10_scores(spark, sf_dir):
    return abuse.score_documents(table(spark, sf_dir, "documents"))


def p10_found(spark, sf_dir):
    return abuse.flagged(p10_scores(spark, sf_dir))


def p10_source_rates(spark, sf_dir):
    return abuse.source_rates(p10_scores(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_scores": p7_scores, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_scores": p10_scores, "p10_source_rates": p10_source_rates}

SQL = {
    "p5_found": """
WITH i AS (
  SELECT business_key, lower(trim(email, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS email, max(confidence) AS confidence
  FROM emails WHERE business_key IS NOT NULL AND confidence IS NOT NULL AND email IS NOT NULL GROUP BY 1, 2)
SELECT business_key, email FROM (
  SELECT *, row_number() OVER (PARTITION BY business_key ORDER BY confidence DESC, email) AS r FROM i WHERE email <> '')
WHERE r <= 3""",
    "p6_found": r"""
WITH k AS (SELECT key FROM businesses WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1),
d AS (SELECT b.*, regexp_replace(regexp_replace(lower(phone), '(extension|ext|x|#).*$', ''), '[^0-9]', '', 'g') AS dig,
        regexp_replace(regexp_extract(regexp_replace(lower(trim(website)), '^[a-z][a-z0-9+.-]*:/*', ''), '^([^/?#]*)', 1), '^www[0-9]?\.', '') AS host
      FROM businesses b JOIN k USING (key)),
u AS (SELECT key, 'phone' AS field, business_id, updated_at FROM (SELECT *, CASE WHEN length(dig) = 11 AND dig LIKE '1%' THEN substr(dig, 2)
        WHEN length(dig) = 13 AND dig LIKE '001%' THEN substr(dig, 4) ELSE dig END AS ten FROM d)
      WHERE length(ten) = 10 AND ten NOT IN ('1234567890', '0123456789', '9876543210', '0987654321') AND ten <> repeat(substr(ten, 1, 1), 10)
      UNION ALL
      SELECT key, 'website', business_id, updated_at FROM d WHERE regexp_matches(host, '^([a-z0-9_-]+\.)+[a-z]+$'))
SELECT key, field, business_id FROM (
  SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY updated_at DESC NULLS LAST, business_id) AS r FROM u) WHERE r = 1""",
}
