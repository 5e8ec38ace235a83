"""Small column expressions for written values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Every character that counts as white space at the ends of a value.
_EDGE = r"[\s\p{Z}\x{85}\x{200B}\x{FEFF}]+"


def trimmed_lower(value: Column) -> Column:
    """Lower case without surrounding white space of any kind."""
    return F.lower(F.regexp_replace(value, f"^{_EDGE}|{_EDGE}$", ""))
