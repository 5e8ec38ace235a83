"""What a page holds: text, links, assets, meta data, and the addresses of a sitemap.

HTML is parsed once for each row in Arrow batches with the standard library's parser; everything after
that is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What can be read from a page.
FIELDS = {"anchors": "array<struct<href:string,text:string>>", "scripts": "array<string>", "stylesheets": "array<string>", "head_links": "array<string>", "meta": "map<string,string>"}
_KIND = pa.schema([("anchors", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))), *((n, pa.list_(pa.string())) for n in ("scripts", "stylesheets", "head_links")), ("meta", pa.map_(pa.string(), pa.string()))])


class _Page(HTMLParser):
    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.anchors, self.scripts, self.styles, self.links, self.meta, self._open = base, [], [], [], [], {}, None

    def _absolute(self, ref: str) -> str | None:
        try:
            return urljoin(self.base, ref.strip())
        except ValueError:
            return None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "a":
            self._open = None
            if a.get("href") and (to := self._absolute(a["href"])) and not re.match(r"(?i)#|mailto:|tel:|javascript:", a["href"].strip()):
                self._open = [to, [a.get("title", ""), a.get("aria-label", "")]]
                self.anchors.append(self._open)
        elif tag == "script" and a.get("src") and (to := self._absolute(a["src"])):
            self.scripts.append(to)
        elif tag == "link" and a.get("href") and (to := self._absolute(a["href"])):
            self.links.append(to)
            if "stylesheet" in a.get("rel", "").lower().split():
                self.styles.append(to)
        elif tag == "meta" and (name := (a.get("name") or a.get("property", "")).strip().lower()) and a.get("content"):
            self.meta[name] = a["content"].strip()

    def handle_endtag(self, tag):
        if tag == "a":
            self._open = None

    def handle_data(self, data):
        if self._open:
            self._open[1].append(data)


def _parsed(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: dict[str, list] = {f: [] for f in fields}
        for text, base in zip(*(c.to_pylist() for c in b.columns[-2:]), strict=True):
            page = _Page(base or "")
            try:
                page.feed(text or "")
                page.close()
            except (AssertionError, ValueError):  # what was read until then counts
                pass
            if "anchors" in found:
                found["anchors"].append([{"href": h, "text": " ".join(" ".join(t).split())} for h, t in page.anchors])
            for f, value in (("scripts", page.scripts), ("stylesheets", page.styles), ("head_links", page.links), ("meta", list(page.meta.items()))):
                if f in found:
                    found[f].append(value)
        yield pa.record_batch([*b.columns[:-2], *(pa.array(v, _KIND.field(f).type) for f, v in found.items())], names=[*b.schema.names[:-2], *found])


def parse_pages(df: DataFrame, row_id: str, text: str, base_url: Column, fields: tuple[str, ...] = tuple(FIELDS), **keep: Column) -> DataFrame:
    """Anchors (absolute, with their text), scripts, stylesheets, head links and meta data of each page, as far as asked for by ``fields``.

    Other columns are carried along by ``keep``, so nothing has to be joined back.
    """
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), *(c.alias(n) for n, c in keep.items()), F.col(text).alias("_text"), base_url.alias("_base"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]]
    return rows.mapInArrow(lambda batches: _parsed(batches, list(fields)), ", ".join([*kinds, *(f"{f} {FIELDS[f]}" for f in fields)]))


def link_address(url: Column) -> Column:
    """Scheme, host, path without trailing slashes and query of an absolute http(s) URL; null for others."""
    return F.when(url.rlike("(?i)^https?://"), F.concat(F.regexp_extract(url, r"^([^?#]*?)/*(?:[?#]|$)", 1), F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1)))


def unescape(text: Column) -> Column:
    """A text with its entities resolved, inside the JVM: the named ones of HTML 4 and ``apos``, and numeric ones, with their semicolon."""
    names = F.create_map(*(F.lit(x) for name, code in [*name2codepoint.items(), ("apos", 39)] for x in (name, chr(code))))

    def number(digits: Column, base: int) -> Column:
        code = F.conv(digits, base, 10).try_cast("int")
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def resolved(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        code = F.when(name.rlike("^#[0-9]"), number(F.substr(name, F.lit(2)), 10)).when(name.startswith("#"), number(F.substr(name, F.lit(3)), 16)).otherwise(F.try_element_at(names, name))
        return F.coalesce(F.concat(code, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), resolved), ""))


def page_text(page: Column) -> Column:
    """Shown words of a page in lower case: scripts, styles and tags go, entities are resolved, white space collapses."""
    seen = F.regexp_replace(page, r"(?s)<script.*?</script>|<style.*?</style>", " ")
    seen = F.regexp_replace(seen, r"<[^>]+>", " ")
    seen = F.when(F.contains(seen, F.lit("&")), unescape(seen)).otherwise(seen)
    return F.lower(F.trim(F.regexp_replace(seen, r"(?U)\s+", " ")))


def keywords_present(text: Column, words: list[str]) -> Column:
    """How many of some words a text contains, each counted once."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


@F.pandas_udf(T.ArrayType(T.StringType()))
def sitemap_urls(xml: pd.Series) -> pd.Series:
    """The addresses of a sitemap in order, each once; none where the text isn't valid XML."""

    def one(text: str | None) -> list[str]:
        try:
            root = ElementTree.fromstring(text or "")
        except (ElementTree.ParseError, ValueError):
            return []
        found = ((e.text or "").strip() for e in root.iter() if isinstance(e.tag, str) and e.tag.lower().rpartition("}")[2] == "loc")
        return list(dict.fromkeys(u for u in found if u))

    return xml.map(one)


def same_site(href: Column, site: Column) -> Column:
    host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"(?i)^https?://([^/?#]*)", 1)), r"^www\.", "")
    return host(href) == host(site)


def resolve(base: str, ref: str) -> str:
    """An address relative to another, without its fragment."""
    parts = urlsplit(urljoin(base, ref))
    return urlunsplit((parts.scheme, parts.netloc, parts.path.rstrip("/"), parts.query, ""))
