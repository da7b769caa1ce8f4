"""Phones and websites as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def national_digits(phone: Column | str) -> Column:
    """The digits of a phone without extension and country prefix (1, +1, 001)."""
    main = F.regexp_replace(F.lower(_c(phone)), r"(extension|ext|x|#).*$", "")
    digits = F.regexp_replace(main, r"\D", "")
    return F.regexp_replace(digits, r"^(?:001|1)(?=\d{10}$)", "")


def phone_digits(phone: Column | str) -> Column:
    """The ten national digits of a phone, or null: extension and country prefix (1, +1, 001) dropped.

    Null for short or long numbers and for placeholders (one digit throughout, counting up or down).
    """
    return valid_phone(national_digits(phone))


def valid_phone(ten: Column | str) -> Column:
    """:func:`national_digits` if they are a phone's, else null."""
    ten = _c(ten)
    ok = (F.length(ten) == 10) & ~ten.rlike(r"^(\d)\1{9}$") & ~ten.isin("1234567890", "0123456789", "9876543210", "0987654321")
    return F.when(ok, ten)


def host_text(url: Column | str) -> Column:
    """What stands in the place of the host in a typed website, lower-case and without ``www.``."""
    u = F.regexp_replace(F.lower(F.trim(_c(url))), r"^[a-z][a-z0-9+.\-]*:/*", "")
    host = F.regexp_replace(F.regexp_extract(u, r"^([^/?#]*)", 1), r"^[^@]*@|:\d*$", "")
    return F.regexp_replace(F.regexp_replace(host, r"^www\d?\.", ""), r"\.+$", "")


def website_host(url: Column | str) -> Column:
    """Lower-case host of a typed website without ``www.``, or null where none is named (blank, ``http://``, ``n/a``)."""
    return valid_host(host_text(url))


def valid_host(host: Column | str) -> Column:
    """:func:`host_text` if it names a host, else null."""
    host = _c(host)
    return F.when(host.rlike(r"^(?:[\p{L}\p{N}_](?:[\p{L}\p{N}_\-]*[\p{L}\p{N}_])?\.)+\p{L}[\p{L}\p{N}\-]*\p{L}$"), host)


def site_key(url: Column | str) -> Column:
    """Host without the mark of a retired or archived copy in front (old., old-, legacy., archive-, ...): the identity of a site for matching."""
    return unmarked_host(website_host(url))


def unmarked_host(host: Column | str) -> Column:
    """:func:`website_host` without the mark of a retired or archived copy."""
    return F.regexp_replace(_c(host), r"^(?:old|legacy|archive|classic|former)[.\-](?=.*\.)", "")
