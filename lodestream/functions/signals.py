"""Signals read from URLs, hosts and pages by rule tables. Rules compile to column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.urls import top_label
from lodestream.functions.writing import let

#: For each country its top-level domains, URL patterns and host words that prove it, and
#: URL patterns that only prove its language.
COUNTRIES = {
    "de": (["bayern", "berlin", "de", "hamburg", "koeln", "nrw", "saarland"], ["/de-de/", "/de_de/", "/deutschland", "/germany"], ["deutschland", "germany"], ["/de/", "/kategorie", "/produkt", "/produkte", "/warenkorb", "lang=de", "locale=de"]),
    "nl": (["nl"], ["/nederland", "/netherlands", "/nl-nl/", "/nl_nl/"], ["nederland", "netherlands"], ["/categorie", "/nl/", "/producten", "/winkelwagen", "lang=nl", "locale=nl"]),
    "fr": (["fr"], ["/fr-fr/", "/fr_fr/", "/france"], ["france"], ["/categorie", "/fr/", "/panier", "/produits", "lang=fr", "locale=fr"]),
    "it": (["it"], ["/it-it/", "/it_it/", "/italia", "/italy"], ["italia", "italy"], ["/carrello", "/categoria", "/it/", "/prodotti", "lang=it", "locale=it"]),
    "es": (["es"], ["/es-es/", "/es_es/", "/espana", "/españa", "/spain"], ["espana", "españa", "spain"], ["/carrito", "/categoria", "/es/", "/productos", "lang=es", "locale=es"]),
    "ch": (["ch", "swiss"], ["/ch/", "/de-ch/", "/fr-ch/", "/it-ch/", "/schweiz", "/suisse", "/svizzera", "/switzerland"], ["schweiz", "suisse", "svizzera", "swiss", "switzerland"], ["/carrello", "/de/", "/fr/", "/it/", "/panier", "/prodotti", "/produits", "/produkte", "/warenkorb"]),
    "us": (["us"], ["/en-us/", "/en_us/", "/united-states", "/united_states", "/us/", "/usa"], ["united-states", "unitedstates", "usa"], ["/cart", "/category", "/checkout", "/en/", "/products", "lang=en", "locale=en"]),
}

#: Shop patterns of a URL with their labels and hundredths of a point.
SHOP_PATTERNS = [("product", 30, ["/product"]), ("shop", 25, ["/shop"]), ("cart", 20, ["/cart"]), ("checkout", 20, ["/checkout"]), ("warenkorb", 20, ["/warenkorb"]), ("category", 15, ["/category", "/kategorie"]), ("collections", 15, ["/collections"]), ("store", 15, ["/store"])]

#: The six URL patterns that are looked for when none are given.
DEFAULT_PATTERNS = ["/products", "/collections", "/cart", "/checkout", "/shop", "/store"]

#: For each platform its threshold and, for each part of a page, weight in hundredths and pattern.
PLATFORMS = {
    "shopify": (35, {"html": (25, r"shopify|cdn\.shopify\.com|shopify\.section"), "headers": (20, "x-shopify|shopify"), "cookies": (20, "_shopify|shopify"), "scripts": (20, "shopify"), "whatweb": (15, "shopify")}),
    "woocommerce": (35, {"html": (20, "woocommerce|wp-content/plugins/woocommerce"), "headers": (15, "x-wp|wordpress|woocommerce"), "cookies": (25, "woocommerce|wordpress|wp_woocommerce"), "scripts": (25, "woocommerce|wp-content"), "whatweb": (15, "woocommerce|wordpress")}),
    "prestashop": (30, {"html": (20, "prestashop"), "headers": (10, "prestashop"), "cookies": (30, "prestashop"), "scripts": (25, "prestashop"), "whatweb": (15, "prestashop")}),
    "shopware": (30, {"html": (20, "shopware|data-shopware"), "headers": (15, "shopware"), "cookies": (20, "shopware"), "scripts": (30, "shopware"), "whatweb": (15, "shopware")}),
}

#: Front-end libraries by pattern, and words of shop navigation.
STACK = {"alpine": r"alpine(?:\.js)?", "angular": "angular|ng-", "bootstrap": "bootstrap", "jquery": "jquery", "react": r"react|_next/static|next\.js|nextjs", "tailwind": "tailwind", "vue": r"vue(?:\.js)?|nuxt"}
NAVIGATION = ["/cart", "/checkout", "/product", "add to cart", "shop now"]


def _hits(tests: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(t, F.lit(name)) for t, name in tests)))


def _contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def country_tests(url: Column, domain: Column, country: str, lowered: bool = False) -> tuple[list[tuple[Column, str]], list[tuple[Column, str]]]:
    """(tests that prove the country, tests of its language), each with the signal's name; ``lowered`` tells that the URL is in lower case already."""
    if country not in COUNTRIES:
        return [], []
    tlds, paths, words, language = COUNTRIES[country]
    low, tld = url if lowered else F.lower(url), top_label(domain)
    proof = [(tld == t, f"tld:{t}") for t in tlds] + [(F.contains(low, F.lit(p)), f"url:{p}") for p in paths] + [(F.contains(domain, F.lit(w)), f"domain:{w}") for w in words]
    return proof, [(F.contains(low, F.lit(p)), f"url:{p}") for p in language]


def country_signals(url: Column, domain: Column, country: str) -> tuple[Column, Column]:
    """(sorted signals that prove the country, sorted signals of its language) of a URL and its host."""
    none = F.array().cast("array<string>")
    proof, language = (F.array_sort(_hits(t)) if t else none for t in country_tests(url, domain, country))
    return proof, language


def shop_tests(url: Column) -> list[tuple[Column, str]]:
    low = F.lower(url)
    return [(_contains_any(low, words), label) for label, _, words in SHOP_PATTERNS]


def bits(tests: list[tuple[Column, str]]) -> Column:
    """One bit for each test that holds: a set that combines by ``bit_or``. At most 63 tests."""
    return sum((F.when(t, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (t, _) in enumerate(tests)), F.lit(0).cast("long"))


def names_of(mask: Column, tests: list[tuple[Column, str]]) -> Column:
    """The sorted names of a set of bits."""
    return F.array_sort(F.array_compact(F.array(*(F.when(mask.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(name)) for i, (_, name) in enumerate(tests)))))


def shop_labels(url: Column) -> Column:
    return _hits(shop_tests(url))


def shop_points(url: Column) -> Column:
    """Hundredths of a point, at most 100: integers, so that sums don't depend on their order."""
    low = F.lower(url)
    return F.least(F.lit(100), sum((F.when(_contains_any(low, words), points).otherwise(0) for _, points, words in SHOP_PATTERNS), F.lit(0)))


def clean_patterns(patterns: list[str] | None) -> list[str]:
    """Trimmed, in lower case, without blanks and repeats; the defaults when none are left."""
    kept = dict.fromkeys(p.strip().lower() for p in patterns or [] if p and p.strip())
    return list(kept) or DEFAULT_PATTERNS


def first_pattern(url: Column, patterns: list[str] | None = None) -> Column:
    """The first of some patterns, in their order, that a URL contains; '' for none."""
    low = F.lower(url)
    return F.coalesce(*(F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in clean_patterns(patterns)), F.lit(""))


def first_segment(url: Column, patterns: list[str] | None = None) -> Column:
    """The same with patterns as path segments; null for none, so that the row can be dropped."""
    low, words = F.lower(url), [p.strip("/") for p in clean_patterns(patterns)]
    return F.coalesce(*(F.when(F.contains(low, F.lit(f"/{w}")), F.lit(f"/{w}")) for w in words))


def map_values(m: Column) -> Column:
    """A map's entries as ``name:value`` in lower case; none for null."""
    return F.coalesce(F.transform(F.map_entries(m), lambda e: F.lower(F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit(""))))), F.array().cast("array<string>"))


def map_lines(m: Column) -> Column:
    """The same, one entry on each line; '' for null."""
    return F.array_join(map_values(m), "\n")


def lines(*parts: Column) -> Column:
    """Strings and arrays of strings as lines in lower case; nulls and blanks are left out."""
    return F.lower(F.concat_ws("\n", *parts))


def platform(html: Column, headers: Column, cookies: Column, scripts: Column, links: Column, plugins: Column) -> Column:
    """struct(platform, confidence in hundredths, signals as ``part:value``, stack) of a page by weighted rules.

    The rule with the highest confidence at or above its threshold wins, the earlier one on a tie. Without
    a winner, two words of shop navigation make it ``custom_ecommerce``.
    """
    text, none = F.lower(F.coalesce(html, F.lit(""))), F.array().cast("array<string>")
    low = lambda a: F.transform(F.coalesce(a, none), lambda v: F.lower(v))
    values = {"headers": map_values(headers), "cookies": map_values(cookies), "scripts": low(scripts), "whatweb": low(F.map_keys(plugins))}

    def said(part: str, rx: str) -> Column:
        """What speaks for a rule in one part: of a page the first place that matches, else every value that does."""
        if part == "html":
            return F.when(text.rlike(rx), F.array(F.regexp_extract(text, f"({rx})", 1))).otherwise(none)
        return F.filter(values[part], lambda v: v.rlike(rx))

    def candidate(order: int, name: str, threshold: int, rules: dict) -> Column:
        total = sum(w for w, _ in rules.values())
        named = lambda f, p: F.transform(f[p], lambda v: F.concat(F.lit(f"{p}:"), v))

        def judged(f: Column) -> Column:
            points = sum((F.when(F.size(f[p]) > 0, w).otherwise(0) for p, (w, _) in rules.items()), F.lit(0))
            share = F.floor((points * 200 + total) / (2 * total)).cast("int")
            return F.when(share >= threshold, F.struct(share.alias("confidence"), F.lit(order).alias("order"), F.lit(name).alias("platform"), F.concat(*(named(f, p) for p in rules)).alias("signals")))

        return let(F.struct(*(said(p, rx).alias(p) for p, (_, rx) in rules.items())), judged)

    candidates = [candidate(-i, name, *rule) for i, (name, rule) in enumerate(PLATFORMS.items())]
    best = F.array_max(F.array_compact(F.array(*candidates)))
    shown = lines(text, links)
    custom = sum((F.contains(shown, F.lit(w)).cast("int") for w in NAVIGATION), F.lit(0)) >= 2
    everything = lines(text, scripts)
    return F.struct(
        F.coalesce(best["platform"], F.when(custom, F.lit("custom_ecommerce")), F.lit("unknown")).alias("platform"),
        F.coalesce(best["confidence"], F.when(custom, 55).otherwise(0)).alias("confidence"),
        F.coalesce(best["signals"], F.when(custom, F.array(F.lit("heuristic:ecommerce_navigation"))), none).alias("signals"),
        _hits([(everything.rlike(rx), name) for name, rx in STACK.items()]).alias("stack"),
    )


#: How a list page tells its total, in order.
TOTALS = [r"showing\s+\d+\s*[–-]\s*\d+\s+of\s+(\d{1,7})", r"\bof\s+(\d{1,7})\s+products\b", r"\b(\d{1,7})\s+products\b", r"\b(\d{1,7})\s+items\b"]


def listing_total(text: Column) -> Column:
    """The first number above zero by which a page tells how many things it lists."""
    low = F.lower(text)
    found = [F.regexp_extract(low, rx, 1).try_cast("int") for rx in TOTALS]
    return F.coalesce(*(F.when(n > 0, n) for n in found))


def last_page(text: Column) -> Column:
    """The highest page number that a page names."""
    return F.array_max(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\bpage\s*(\d{1,4})\b"), F.lit(1)), lambda x: x.try_cast("int")))


def count_bucket(n: Column) -> Column:
    return F.when(n <= 0, None).when(n <= 50, "1-50").when(n <= 200, "51-200").when(n <= 1000, "201-1000").when(n > 1000, "1000+")


#: Endings that hint at a country, and endings too large to be read whole from a paged index.
ENDING_COUNTRIES = {"de": "DE", "at": "AT", "ch": "CH", "nl": "NL", "se": "SE", "ae": "AE", "us": "US", "fr": "FR", "it": "IT", "es": "ES", "pl": "PL"}
OVERSIZED_ENDINGS = ("com", "net", "org", "de", "nl")


def country_hint(domain: Column, plugins: Column) -> Column:
    """The country a scanner's ``country`` plugin names with two letters, else the one that the ending hints at."""
    named = F.upper(F.trim(F.coalesce(F.get_json_object(plugins["country"], "$.version[0]"), F.get_json_object(plugins["country"], "$.version"), F.get_json_object(plugins["country"], "$.value"))))
    ending = F.create_map(*(F.lit(x) for pair in ENDING_COUNTRIES.items() for x in pair))[top_label(domain)]
    return F.coalesce(F.when(F.length(named) == 2, named), ending)


#: The endings that are read for a country.
COUNTRY_ENDINGS = {"de": ["de"], "at": ["at"], "ch": ["ch"], "nl": ["nl"], "se": ["se"], "us": ["us"], "ae": ["ae"]}


def endings(countries: list[str], given: list[str] | None = None) -> list[str]:
    """The endings to read for some countries, in order and each once; oversized ones are passed over even if given."""
    wanted = given or [e for c in countries if c for e in COUNTRY_ENDINGS.get(c.lower(), [])]
    return [e for e in dict.fromkeys(wanted) if e not in OVERSIZED_ENDINGS]


def product_links(links: Column) -> Column:
    """How many addresses look like products; null for none."""
    return F.nullif(F.size(F.filter(links, lambda u: F.lower(u).rlike("/product|/item|sku"))), F.lit(0))
