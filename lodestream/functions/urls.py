"""Hosts and URLs as column expressions: the four domain normalisers, parts of hosts, page addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.writing import let

_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
_LABELS = r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def url_host(url: Column) -> Column:
    """What stands between the scheme and the path of a URL, '' without a scheme."""
    return F.regexp_extract(strip(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def valid_host(host: Column) -> Column:
    """A dotted ASCII name that is neither local nor an address; its last label has at least two characters."""
    return host.rlike(_LABELS) & host.rlike(r"\.[a-z0-9-]{2,}$") & ~host.rlike(r"\.local$") & ~host.rlike(_IPV4)


def discovery_domain(value: Column) -> Column:
    """The host of a value found in a page or list, without ``www.``, user and port; null where that isn't a valid host."""

    def host_of(text: Column) -> Column:
        host = F.when(F.contains(text, F.lit("://")), F.regexp_extract(text, r"^[a-z0-9+.-]*://([^/?#]*)", 1)).otherwise(F.regexp_extract(text, r"^([^/?#]*)", 1))
        host = F.regexp_replace(strip(host), r"^[^@]*@", "")
        host = F.regexp_replace(F.regexp_replace(F.substring_index(host, ":", 1), r"^\.+|\.+$", ""), r"^www\.", "")
        return F.when(~text.rlike(r"^(?:mailto:|tel:|javascript:|#)"), host)

    return let(let(F.lower(strip(value)), host_of), lambda h: F.when(valid_host(h), h))


def _bare(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(value)), "^https?://", ""), r"^www\.", "")


def ingest_domain(value: Column) -> Column:
    """Lower case without scheme, ``www.``, path and trailing dots; not validated, keeps a port."""
    return F.regexp_replace(F.substring_index(_bare(value), "/", 1), r"\.+$", "")


def fingerprint_domain(value: Column) -> Column:
    """Like the ingest form, but with its path; only trailing slashes go."""
    return F.regexp_replace(_bare(value), "/+$", "")


def promote_domain(value: Column) -> Column:
    """Like the ingest form, but with its trailing dots; null when nothing is left."""
    return F.nullif(F.substring_index(_bare(value), "/", 1), F.lit(""))


def plain_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(strip(host)), r"^www\.", "")


def top_label(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def second_label(host: Column) -> Column:
    """The label before the last, or the host itself when it has but one."""
    parts = F.split(host, r"\.")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), host)


def homepage(domain: Column) -> Column:
    return F.when(domain.rlike("^https?://"), domain).otherwise(F.concat(F.lit("https://"), domain))


def parents(host: Column) -> Column:
    """The host and all its parents that have a dot: a.b.c gives a.b.c and b.c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def page_address(url: Column) -> Column:
    """Scheme, host, path without trailing slashes and query of a page's address; the fragment goes."""
    whole = F.regexp_replace(strip(url), "#.*$", "")
    path, query = F.substring_index(whole, "?", 1), F.regexp_extract(whole, r"(\?.+)$", 1)
    return F.concat(F.regexp_replace(path, "/+$", ""), query)
