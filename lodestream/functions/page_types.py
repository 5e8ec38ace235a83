"""Kinds of page by reasons: a kind holds when at least two of its reasons do. Rules are data, compiled to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.pages import keywords_present
from lodestream.functions.writing import let

#: For each kind its reasons. A reason looks at ``path`` or ``query`` keys or ``html`` or ``text``
#: for any of some words, for a pattern, or for at least n different words.
KINDS = {
    "product": [
        ("url_path_contains_product_identifier", "path", "any", ["product", "products", "item", "sku", "p/", "/p"]),
        ("url_query_contains_product_identifier", "query", "any", ["variant", "sku", "product"]),
        ("product_schema_detected", "html", "pattern", r'"@type"\s*:\s*"product"'),
        ("sku_or_price_schema_detected", "html", "pattern", r"""itemprop\s*=\s*["'](?:sku|price)["']"""),
        ("purchase_cta_detected", "text", "pattern", r"\b(?:add to cart|add to bag|buy now)\b"),
        ("price_signal_detected", "text", "pattern", r"(?:\$|€|£)\s?\d"),
        ("variant_selector_signal_detected", "text", "pattern", r"\b(?:select size|choose size|select color|choose color|variant)\b"),
    ],
    "category": [
        ("url_path_contains_category_identifier", "path", "any", ["collections", "category", "categories", "shop", "catalog"]),
        ("query_contains_listing_controls", "query", "any", ["page", "sort", "filter"]),
        ("product_grid_pattern_detected", "html", 2, ["product-card", "product-grid", "collection-grid", "grid-item", "product-list"]),
        ("faceted_filters_or_listing_copy_detected", "text", 2, ["filter", "sort by", "price range", "showing", "results"]),
        ("pagination_detected", "text", "pattern", r"\b(page\s+\d+|next\s*page|pagination|showing\s+\d+\s*[–-]\s*\d+\s+of\s+\d+)\b"),
    ],
    "cart": [
        ("url_path_contains_cart_identifier", "path", "any", ["cart", "basket", "bag"]),
        ("line_items_and_subtotal_signals_detected", "text", 2, ["quantity", "subtotal", "remove", "line item", "update cart", "total"]),
        ("cart_item_markup_detected", "html", "pattern", r"""class\s*=\s*["'][^"']*(cart-item|line-item|mini-cart)[^"']*["']"""),
    ],
    "checkout": [
        ("url_path_contains_checkout_identifier", "path", "any", ["checkout", "shipping", "payment"]),
        ("shipping_payment_address_form_signals_detected", "text", 3, ["shipping", "payment", "billing", "address", "card number", "place order", "delivery"]),
        ("checkout_form_fields_detected", "html", "pattern", r"""name\s*=\s*["'](?:address|postal|zip|card(?:number)?|payment)["']"""),
        ("checkout_stepper_detected", "text", "pattern", r"\b(?:step\s*\d|shipping\s*>\s*payment|checkout\s+step)\b"),
    ],
    "contact": [
        ("url_path_contains_contact_identifier", "path", "any", ["contact", "support", "help"]),
        ("contact_email_detected", "both", "pattern", r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"),
        ("contact_phone_detected", "text", "pattern", r"\+?\d[\d\s().-]{7,}\d"),
        ("contact_form_copy_detected", "text", "any", ["contact form", "get in touch", "message us"]),
        ("contact_address_detected", "text", "any", ["address"]),
    ],
}


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)), "^/+|/+$", "")


def query_keys(url: Column) -> Column:
    """The names of a URL's query fields that have a value."""
    query = F.lower(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    named = F.filter(F.split(query, "&"), lambda f: f.rlike("^[^=]+=."))
    return F.transform(named, lambda f: F.substring_index(f, "=", 1))


def reasons(url: Column, html: Column, text: Column) -> dict[str, Column]:
    """For each kind the reasons that hold, none when it's only one. ``text`` is the page's text in lower case."""
    page = {"path": url_path(url), "html": F.lower(html), "text": text}
    keys = query_keys(url)
    out = {}
    for kind, rules in KINDS.items():
        found = []
        for name, where, test, of in rules:
            if where == "query":
                holds = F.arrays_overlap(keys, F.array(*map(F.lit, of)))
            elif where == "both":
                holds = F.contains(page["html"], F.lit("mailto:")) | page["text"].rlike(of)
            elif test == "pattern":
                holds = page[where].rlike(of)
            else:
                holds = keywords_present(page[where], of) >= (1 if test == "any" else test)
            found.append(F.when(holds, F.lit(name)))
        both = F.array_compact(F.array(*found))
        out[kind] = F.when(F.size(both) >= 2, both).otherwise(F.array().cast("array<string>"))
    return out


def reasons_once(url: Column, html: Column, text: Column) -> Column:
    """``reasons`` as one struct, each of the three parts computed once however many reasons look at it."""
    parts = F.struct(url.alias("url"), html.alias("html"), text.alias("text"))
    return let(parts, lambda r: F.struct(*(c.alias(k) for k, c in reasons(r["url"], r["html"], r["text"]).items()), per_page(r["html"], r["text"]).alias("per_page")))


def is_homepage(url: Column) -> Column:
    return url_path(url).isin("", "index", "index.html", "home")


def per_page(html: Column, text: Column) -> Column:
    """How many products a page shows: its product boxes, else its buttons, at most 120."""
    boxes = F.regexp_count(F.lower(html), F.lit("product-card|grid-item|product-item|collection-product"))
    return F.least(F.when(boxes > 0, boxes).otherwise(F.regexp_count(text, F.lit(r"\badd to cart\b"))), F.lit(120))
