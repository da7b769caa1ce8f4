"""URLs, hosts and registered domains as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-label public suffixes known here; further ones are a parameter. A one-label suffix needs no list.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "com.mx", "co.in", "co.za", "com.ar", "com.tr", "com.cn", "com.sg", "com.hk", "co.kr")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_url(x: Column | str) -> Column:
    """https where no scheme is written, scheme and host in lower case, "/" where no path is, fragment dropped; "" where no host is named."""
    u = F.trim(F.coalesce(_c(x), F.lit("")))
    full = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    part = lambda i: F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", i)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    return F.when((u == "") | (part(2) == ""), "").otherwise(F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, F.coalesce(part(4), F.lit(""))))


def hostname(x: Column | str) -> Column:
    """Lower-case host without port and user; "" for none."""
    u = F.regexp_replace(F.trim(F.coalesce(_c(x), F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_extract(u, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.regexp_replace(host, r"^\.+|\.+$", ""))


def registered_domain(x: Column | str, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The label under the public suffix together with it; "" for bare suffixes, numbers and names without a dot."""
    h = hostname(x)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    long = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    return (
        F.when((n < 2) | h.rlike(r"^[\d.]+$|\.\.|\s") | ~h.rlike(r"\.[a-z]{2,}$"), "")
        .when(two.isin(*suffixes), F.when(n >= 3, long).otherwise(""))
        .otherwise(two)
    )


def same_site(a: Column, b: Column) -> Column:
    da, db = registered_domain(a), registered_domain(b)
    return F.when((da != "") & (db != ""), da == db).otherwise((hostname(a) != "") & (hostname(a) == hostname(b)))


def host_parents(x: Column | str) -> Column:
    """A host and its parents down to the registered domain, longest first."""
    h = hostname(x)
    labels = F.split(h, r"\.")
    stop = F.size(labels) - F.size(F.split(registered_domain(x), r"\."))
    return F.when(registered_domain(x) == "", F.array(h)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(stop, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, 100), ".")))


def listed(df: DataFrame, url: str, hosts: DataFrame, host: str = "host") -> DataFrame:
    """Rows whose host or one of its parents is in ``hosts``: an equi-join on exploded parents, whatever the size of the list."""
    wanted = hosts.select(F.lower(F.trim(host)).alias("_parent")).where("_parent <> ''").distinct()
    keyed = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_parent", F.explode(host_parents(url)))
    return keyed.join(wanted, "_parent", "left_semi").dropDuplicates(["_row"]).drop("_row", "_parent")
