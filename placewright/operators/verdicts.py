"""Answers of verification services to one status, and the order in which an address gets its verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.operators.mailboxes import ROLES, UNREAD, domain_part, local_part, syntax_ok
from placewright.operators.payloads import code_verdict, dig, normalize_status

#: Numeric results of one service, and the words of another that its own table overrides.
RESULT_CODES = {"0": "valid", "1": "invalid", "2": "disposable", "3": "catch_all", "4": "unknown"}
TEXT_RESULTS = {"ok": "valid", "ok_for_all": "catch_all", "fail": "invalid", "email_disabled": "invalid", "dead_server": "invalid", "invalid_mx": "invalid", "accept_all": "catch_all", "disposable": "disposable", "spamtrap": "invalid", "smtp_protocol": "unknown", "antispam_system": "unknown", "unknown": "unknown"}
#: Mail hosts of private people, and hosts whose pages belong to somebody else than the host.
FREE_MAIL = "gmail.com yahoo.com hotmail.com outlook.com aol.com icloud.com live.com msn.com protonmail.com gmx.com".split()
PLATFORMS = "facebook.com instagram.com linkedin.com twitter.com x.com yelp.com youtube.com tiktok.com pinterest.com google.com".split()
JUNK = "example.com sentry.io wixpress.com domain.com email.com".split()
THROWAWAY = "mailinator.com guerrillamail.com 10minutemail.com tempmail.com yopmail.com trashmail.com".split()


def _mapped(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for word, status in table.items():
        out = F.when(value == word, status).otherwise(out)
    return out


def _yes(payload: Column, path: str) -> Column:
    return F.lower(F.coalesce(dig(payload, path), F.lit(""))).isin("true", "1", "yes")


def _result_word(p: Column) -> Column:
    return normalize_status(F.coalesce(dig(p, "result"), dig(p, "resultcode")))


def _sub_status(p: Column) -> Column:
    role = F.coalesce(dig(p, "sub_status"), F.lit("")).isin("role_based", "role_based_catch_all")
    status = normalize_status(dig(p, "status"))
    return F.when(role & (status == "invalid"), "risky").otherwise(status)


def _numbered(p: Column) -> Column:
    return _mapped(dig(p, "result"), RESULT_CODES, normalize_status(dig(p, "result")))


def _flagged(p: Column) -> Column:
    status = normalize_status(dig(p, "status"))
    return F.when(_yes(p, "is_catch_all_domain") & ~status.isin("valid", "invalid"), "catch_all").otherwise(status)


def _text(p: Column) -> Column:
    word = F.lower(F.trim(p))
    return _mapped(word, TEXT_RESULTS, normalize_status(word))


def _reasoned(p: Column) -> Column:
    status = normalize_status(dig(p, "status"))
    return F.when(F.coalesce(dig(p, "reason"), F.lit("")).isin("accept_all", "accepted_email") & (status != "valid"), "catch_all").otherwise(status)


#: How each shape of answer is read. Names describe the shape, further ones can be passed.
SHAPES: dict[str, Callable[[Column], Column]] = {
    "result_word": _result_word, "sub_status": _sub_status, "numbered": _numbered, "flagged": _flagged, "text": _text, "reasoned": _reasoned,
    "coded": lambda p: code_verdict(dig(p, "code"), dig(p, "message")),
}


def read_verdicts(answers: DataFrame, shape: str = "shape", payload: str = "payload", shapes: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Adds ``status``, ``is_catch_all``, ``is_disposable`` and ``score`` to answers, by the shape named in each row.

    An answer that carries an error, an unknown shape and a null payload are unknown. A valid answer scores 90, a catch-all or risky one 50.
    """
    status = F.lit("unknown")
    for name, reader in (SHAPES | (shapes or {})).items():
        status = F.when(F.col(shape) == name, reader(F.col(payload))).otherwise(status)
    failed = F.col(payload).isNull() | (F.coalesce(dig(F.col(payload), "error"), F.lit("")) != "")
    out = answers.withColumn("status", F.when(failed, "unknown").otherwise(status))
    return out.withColumns({
        "is_catch_all": F.col("status") == "catch_all", "is_disposable": F.col("status") == "disposable",
        "score": F.when(F.col("status") == "valid", 90.0).when(F.col("status").isin("catch_all", "risky"), 50.0),
    })


def guessable(domain: Column) -> Column:
    """Why addresses of a domain are not worth guessing; null if they are."""
    d = F.lower(F.trim(F.coalesce(domain, F.lit(""))))
    ends = lambda hosts: d.rlike(r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in hosts) + ")$")
    return F.when(d == "", "no_domain").when(ends(FREE_MAIL), "free_mail_domain").when(ends(PLATFORMS), "platform_or_social_domain").when(ends(JUNK), "not_a_business_domain")


def prefilter(email: Column, mx_found: Column) -> Column:
    """The verdict that needs no service: malformed and unread boxes and hosts without mail exchange are invalid, throw-away hosts disposable; else null."""
    return (
        F.when(~syntax_ok(email), "invalid").when(domain_part(email).isin(*THROWAWAY), "disposable").when(local_part(email).isin(*UNREAD), "invalid").when(~F.coalesce(mx_found, F.lit(True)), "invalid")
    )


def verify_in_order(wanted: DataFrame, known: DataFrame, answers: DataFrame, budget: int, order: list[Column]) -> DataFrame:
    """(email, status, by) of wanted (email, mx_found): a known verdict, else the prefilter, else an answer while the budget lasts, else 'not_checked'.

    Only addresses that neither is known nor filtered use the budget, in ``order``. The rank comes from a row number over hash-free
    counts of a sorted range, so nothing but one running number goes through a single task.
    """
    k = known.where("email IS NOT NULL AND status IS NOT NULL").groupBy("email").agg(F.max("status").alias("known"))
    a = answers.where("email IS NOT NULL").groupBy("email").agg(F.max("status").alias("answer"))
    rows = wanted.where("email IS NOT NULL").join(k, "email", "left").join(a, "email", "left").withColumn("local", prefilter(F.col("email"), F.col("mx_found")))
    free = F.col("known").isNotNull() | F.col("local").isNotNull()
    asked = rows.where(~free).orderBy(*order).limit(budget).select("email", F.lit(True).alias("asked"))
    rows = rows.join(asked, "email", "left")
    return rows.select(
        "email",
        F.coalesce("known", "local", F.when(F.col("asked"), F.coalesce("answer", F.lit("unknown"))), F.lit("not_checked")).alias("status"),
        F.when(F.col("known").isNotNull(), "cache").when(F.col("local").isNotNull(), "local").when(F.col("asked"), "service").otherwise("budget").alias("by"),
    )


def worth_verifying(emails: DataFrame, per_kind: int = 3) -> DataFrame:
    """Adds ``place`` and ``over_cap`` to the found addresses of a business: by kind of contact, first those of its own domain, the most confident, the shortest."""
    w = Window.partitionBy("business_key", "contact_type").orderBy(F.col("on_business_domain").desc_nulls_last(), F.col("confidence").desc_nulls_last(), F.length("email"), "email")
    return emails.withColumn("place", F.row_number().over(w)).withColumn("over_cap", F.col("place") > per_kind)


def batch_id(emails: Column) -> Column:
    """A name for a set of addresses, whatever their order."""
    return F.substring(F.sha1(F.array_join(F.array_sort(emails), "\n")), 1, 20)


def role_locals(tier: int, more: Column | None = None) -> Column:
    """Role mailboxes to guess, likeliest first: three, six or all of them; ``more``: an array of others, from tier two on."""
    base = F.array(*(F.lit(r) for r in ROLES[: {1: 3, 2: 6}.get(tier, 21)]))
    return base if more is None or tier < 2 else F.array_distinct(F.concat(base, F.coalesce(more, F.array().cast("array<string>"))))


def pattern_label(local: Column, first: Column, last: Column) -> Column:
    """The template a local part follows, given a person's names; null if none."""
    f, l = F.lower(first), F.lower(last)
    fi, li = F.substring(f, 1, 1), F.substring(l, 1, 1)
    forms = [("{first}.{last}", F.concat(f, F.lit("."), l)), ("{first}{last}", F.concat(f, l)), ("{f}{last}", F.concat(fi, l)), ("{f}.{last}", F.concat(fi, F.lit("."), l)), ("{first}", f), ("{last}", l), ("{first}{l}", F.concat(f, li)), ("{first}_{last}", F.concat(f, F.lit("_"), l)), ("{last}.{first}", F.concat(l, F.lit("."), f))]
    out = F.lit(None).cast("string")
    for label, form in reversed(forms):
        out = F.when(F.lower(local) == form, label).otherwise(out)
    return out
