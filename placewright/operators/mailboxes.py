"""Local parts of mail addresses: which spell a person, which are shared boxes, which are malformed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.text import name_tokens

#: Mailboxes of a role, and mailboxes nobody reads.
ROLES = (
    "info contact hello office admin sales team mail support service help inquiries enquiries booking bookings appointments reception frontdesk orders shop quotes estimates accounts billing schedule dispatch care general jobs careers press marketing hr"
).split()
UNREAD = "noreply no-reply donotreply do-not-reply postmaster mailer-daemon bounce bounces abuse hostmaster webmaster".split()


def local_part(email: Column | str) -> Column:
    e = F.col(email) if isinstance(email, str) else email
    return F.lower(F.regexp_extract(F.trim(e), r"^(.*)@", 1))


def domain_part(email: Column | str) -> Column:
    e = F.col(email) if isinstance(email, str) else email
    return F.lower(F.regexp_extract(F.trim(e), r"@([^@]*)$", 1))


def syntax_ok(email: Column | str) -> Column:
    """Whether a text is a well-formed address: one @, sane dots and hyphens, a top-level name of letters, 254 characters at most."""
    e = F.trim(F.col(email) if isinstance(email, str) else email)
    return F.coalesce(
        (F.length(e) <= 254) & e.rlike(r"^[A-Za-z0-9._%+\-']{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$") & ~e.rlike(r"^\.|\.@|\.\."), F.lit(False)
    )


def kind(email: Column | str) -> Column:
    l = local_part(email)
    return F.when(~syntax_ok(email), "malformed").when(l.isin(*UNREAD), "unread").when(l.isin(*ROLES), "role").otherwise("personal")


def person_locals(name: Column | str) -> Column:
    """Local parts that spell a person, likeliest first: from first name f and last name l; one word gives only itself."""
    t = name_tokens(name)
    f, l = F.get(t, F.lit(0)), F.element_at(t, -1)
    fi, li = F.substring(f, 1, 1), F.substring(l, 1, 1)
    cat = F.concat
    dot, under = F.lit("."), F.lit("_")
    two = F.array(f, cat(f, dot, l), cat(f, l), cat(fi, l), cat(fi, dot, l), l, cat(f, li), cat(f, under, l), cat(l, dot, f), cat(l, fi))
    return F.when(F.size(t) == 0, F.array().cast("array<string>")).when(F.size(t) == 1, F.array(f)).otherwise(F.filter(F.array_distinct(two), lambda x: F.length(x) >= 2))


def spelling_mailboxes(emails: DataFrame, mentions: DataFrame) -> DataFrame:
    """(business_key, email, person): addresses whose letters spell a person mentioned at the same business.

    Joined on business and spelled letters, not by comparing every address with every person.
    """
    letters = lambda c: F.regexp_replace(c, "[^a-z]", "")
    spelt = mentions.where("business_key IS NOT NULL AND name IS NOT NULL").select("business_key", F.array_join(name_tokens("name"), " ").alias("person"), F.explode(person_locals("name")).alias("l"))
    spelt = spelt.select("business_key", "person", letters("l").alias("spelt")).where("length(spelt) >= 3").distinct()
    boxes = emails.where("business_key IS NOT NULL").select("business_key", F.lower(F.trim("email")).alias("email"), letters(local_part("email")).alias("spelt")).where("spelt <> ''").distinct()
    return boxes.join(spelt, ["business_key", "spelt"]).select("business_key", "email", "person").distinct()
