"""Canonical forms of hosts and URLs: what is left when only formatting is taken away.

All of it is built-in column expressions, so it stays inside the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.writing import let

#: White space, control and format characters, and characters without a shape of their own.
INVISIBLE = r"[\p{Z}\p{Cc}\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]+"
_DOTS = "".join(map(chr, (0x2024, 0x3002, 0xFE52, 0xFF0E, 0xFF61)))
_HYPHENS = "".join(map(chr, (0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2043, 0x2212, 0xFE58, 0xFE63, 0xFF0D)))
_MARKS = r"[\p{P}\p{S}]"


def _width_table() -> dict[str, str]:
    """Wide and narrow characters with their ordinary form, by Unicode's own decomposition."""
    table = {}
    for code in range(0x3000, 0x10000):
        kind, _, rest = unicodedata.decomposition(chr(code)).partition(" ")
        if kind in ("<wide>", "<narrow>") and " " not in rest:
            table[chr(code)] = chr(int(rest, 16))
    table |= dict.fromkeys(_DOTS, ".") | dict.fromkeys(_HYPHENS, "-")
    return table


_TABLE = _width_table()


def plain(value: Column) -> Column:
    """Without white space and invisible characters, ordinary width, dots and hyphens, lower case."""
    seen = F.regexp_replace(value, INVISIBLE, "")
    full = F.translate(seen, "".join(_TABLE), "".join(_TABLE.values()))
    return F.lower(F.when(value.rlike(r"^[!-~]*\z"), value).otherwise(full))  # visible ASCII has nothing to take away


def canonical_host(value: Column) -> Column:
    """A host without its formatting; null for null, blank and values without an inner dot.

    Formatting: white space, invisible characters, case, width, kinds of dot and hyphen,
    punctuation at either end, a scheme and one leading ``www.``.
    """
    edges = rf"^{_MARKS}*(?:[a-z][a-z0-9+.\-]*:/+{_MARKS}*)?(?:www\.(?=[^.]+\.))?|{_MARKS}+$"
    clean = value.rlike(r"^(?!www\.)[a-z0-9][a-z0-9.\-]*[a-z0-9]\z")
    bare = F.when(clean, value).otherwise(F.regexp_replace(plain(value), edges, ""))
    return let(bare, lambda x: F.when(F.instr(x, ".") > 1, x))


def canonical_url(value: Column) -> Column:
    """A URL without its formatting; null for null and blank values.

    Besides what holds for every value: doubled separators, a trailing slash of the path,
    an empty query, query field or fragment, and the order of the query fields.
    """

    def whole(x: Column) -> Column:
        return F.when(x.rlike(r"^[a-z0-9](?:.*[a-z0-9])?\z"), x).otherwise(F.regexp_replace(x, rf"^{_MARKS}+|{_MARKS}+$", ""))

    def path(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, "/{2,}", "/"), "/$", "")

    def query(x: Column) -> Column:
        sorted_fields = F.array_join(F.array_sort(F.filter(F.split(x, "&"), lambda f: f != "")), "&")
        fields = F.when(F.contains(x, F.lit("&")), sorted_fields).otherwise(x)
        return let(fields, lambda f: F.when(f != "", F.concat(F.lit("?"), f)).otherwise(""))

    def head(x: Column) -> Column:
        parts = F.concat(path(F.substring_index(x, "?", 1)), query(F.regexp_replace(x, r"^[^?]*\?*", "")))
        return F.when(F.contains(x, F.lit("?")), parts).otherwise(path(x))

    def with_fragment(x: Column) -> Column:
        fragment = let(F.regexp_replace(x, "^[^#]*#*", ""), lambda f: F.when(f != "", F.concat(F.lit("#"), f)).otherwise(""))
        both = F.concat(let(F.substring_index(x, "#", 1), head), fragment)
        return F.when(F.contains(x, F.lit("#")), both).otherwise(head(x))

    return let(let(let(plain(value), whole), with_fragment), lambda x: F.when(x != "", x))
