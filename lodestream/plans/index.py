"""Queries over crawl indexes, domains, sources and pages, and their SQL (one DuckDB text for each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import pages, signals, urls
from lodestream.operators import keyed
from lodestream.plans.index_sql import SQL  # noqa: F401
from lodestream.session import materialize
from lodestream.sources.crawl_index import page_rows
from lodestream.sources.tables import table
from lodestream.streaming.arrivals import windowed_counts

_second = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
_joined = lambda c: F.array_join(c, "|")
COUNTRY, FLOOR = "de", 5


# --- scans and filters -------------------------------------------------------------------------------------
def _index(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "crawl_candidates").select("row_id", F.coalesce("candidate_url", F.lit("")).alias("url"), "normalized_domain", "fetched_at", F.from_json("source_metadata", "crawl string, status string, mime string, languages string").alias("m"))
    return page_rows(raw, F.col("m.status"), F.col("m.mime")).select("row_id", "url", "normalized_domain", "fetched_at", F.nullif("m.crawl", F.lit("")).alias("crawl"), "m.languages")


def r_index_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows that answered with a page, by crawl and first language."""
    rows = _index(spark, folder).select("crawl", F.nullif(F.substring_index("languages", ",", 1), F.lit("")).alias("language"), F.length("url").alias("n"))
    return rows.groupBy("crawl", "language").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_chars"))


def r_first_pattern(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by the first default pattern that their URL contains, and by its first segment."""
    rows = _index(spark, folder).select(signals.first_pattern(F.col("url")).alias("pattern"), signals.first_segment(F.col("url"), ["/p/", "winkel", " /Cart "]).alias("segment"))
    return rows.groupBy("pattern", "segment").agg(F.count(F.lit(1)).alias("n_rows"))


def r_like_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """URLs that match any of some patterns in the countries' endings, counted by ending (patterns as SQL wildcards)."""
    low = F.lower("url")
    rows = _index(spark, folder).where(low.like("%/shop%") | low.like("%/kategorie/%") | low.like("%size=4_%"))
    ending = urls.top_label(urls.discovery_domain(urls.url_host(F.col("url"))))
    return rows.select(ending.alias("ending")).where(F.col("ending").isin("de", "nl", "fr", "ch")).groupBy("ending").agg(F.count(F.lit(1)).alias("n_rows"))


# --- import ------------------------------------------------------------------------------------------------
_SETS = ("country_signals", "language_signals", "matched_patterns")


def _tests(country: str) -> dict[str, list]:
    proof, language = signals.country_tests(F.col("low"), F.col("domain"), country, lowered=True)
    return dict(zip(_SETS, (proof, language, signals.shop_tests(F.col("low"))), strict=True))


def _by_country(of) -> Column:
    """The value that belongs to a row's country."""
    return F.coalesce(*(F.when(F.col("country") == c, of(c)) for c in signals.COUNTRIES))


def _signalled(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows with their host, once for each country, and their signals as sets of bits."""
    rows = _index(spark, folder).withColumn("domain", urls.discovery_domain(urls.url_host(F.col("url")))).withColumn("low", F.lower("url"))
    # What doesn't depend on the country is computed before a row is repeated for each.
    rows = rows.select("row_id", "url", "low", "domain", "crawl", "fetched_at", signals.bits(signals.shop_tests(F.col("low"))).alias("matched_patterns"), signals.shop_points(F.col("low")).alias("points"), F.explode(F.array(*map(F.lit, signals.COUNTRIES))).alias("country"))
    return rows.select("*", *(_by_country(lambda c, n=n: signals.bits(_tests(c)[n])).alias(n) for n in _SETS if n != "matched_patterns"))


def fold_by_domain(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each country and domain (and each value of the columns ``by``): capped points, sets of signals, first URL and last crawl.

    All aggregates combine on the map side (sets by ``bit_or``), so a domain with a third of all rows costs no
    more than another.
    """
    rows = rows.where("domain is not null and country_signals > 0").withColumn("points", F.when(F.col("points") > 0, F.col("points")).otherwise(FLOOR))
    folded = rows.groupBy("country", "domain", *by).agg(F.least(F.lit(100), F.sum("points")).cast("int").alias("score"), F.min_by("url", "row_id").alias("source_url"), F.max_by("crawl", "row_id").alias("crawl_id"), F.max("fetched_at").alias("last_seen_at"), *(F.bit_or(n).alias(n) for n in _SETS))
    return folded.select("country", "domain", *by, urls.top_label(F.col("domain")).alias("tld"), "score", *(_by_country(lambda c, n=n: signals.names_of(F.col(n), _tests(c)[n])).alias(n) for n in _SETS), "source_url", "crawl_id", "last_seen_at")


def r_import(spark: SparkSession, folder: str) -> DataFrame:
    """The index of each country's domains, folded from the crawl."""
    out = fold_by_domain(_signalled(spark, folder))
    return out.select("domain", "tld", "country", "score", *(_joined(c).alias(c) for c in ("country_signals", "language_signals", "matched_patterns")), "source_url", "crawl_id", _second("last_seen_at").alias("last_seen_at"))


def r_import_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Why rows were taken or left out for each country, in one pass."""
    rows, proof, language = _signalled(spark, folder), F.col("country_signals") > 0, F.col("language_signals") > 0
    n = lambda test, name: F.sum(F.when(test, 1).otherwise(0)).alias(name)
    valid = F.col("domain").isNotNull()
    return rows.groupBy("crawl", "country").agg(F.count(F.lit(1)).alias("n_read"), n(~valid, "n_invalid"), n(valid & proof, "n_accepted"), n(valid & ~proof, "n_skipped"), n(valid & ~proof & language, "n_language_only"))


def r_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The index of earlier crawls, and of rows without one, with the newest crawl merged in; all rows are folded once."""
    newest = _index(spark, folder).agg(F.max("crawl")).first()[0]
    rows = _signalled(spark, folder).withColumn("is_new", F.coalesce(F.col("crawl") == newest, F.lit(False)))
    folded = materialize(fold_by_domain(rows, "is_new").withColumn("key", F.struct("country", "domain")), "folded")
    old, new = (folded.where(t).drop("is_new") for t in ("not is_new", "is_new"))
    rules = {"score": "greatest", "matched_patterns": "union", "country_signals": "new", "source_url": "old_or_new", "crawl_id": "new", "last_seen_at": "new"}
    out = keyed.merge(old, new, "key", rules)
    return out.select("key.country", "key.domain", "score", *(_joined(c).alias(c) for c in ("matched_patterns", "country_signals")), "source_url", "crawl_id", _second("last_seen_at").alias("last_seen_at"), "merge_state")


# --- domains -----------------------------------------------------------------------------------------------
def r_domain_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The normal forms of every discovered domain."""
    d, host = F.col("domain"), urls.discovery_domain(F.col("domain"))
    out = table(spark, folder, "discovered_candidates").select("candidate_id", host.alias("discovery"), urls.ingest_domain(d).alias("ingest"), urls.fingerprint_domain(d).alias("fingerprint"), urls.promote_domain(d).alias("promote"), urls.plain_host(d).alias("plain"))
    return out.select("*", urls.second_label(F.col("discovery")).alias("second_label"), urls.top_label(F.col("discovery")).alias("top_label"), urls.homepage(F.col("ingest")).alias("homepage"))


def r_suffix_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts of the index that are known domains or below one, with the domain."""
    hosts = table(spark, folder, "common_crawl_domains").select(urls.discovery_domain(F.col("domain")).alias("host"))
    known = table(spark, folder, "domains").select(urls.discovery_domain(F.col("normalized_domain")).alias("name"))
    return keyed.suffix_matches(hosts, "host", known, "name")


def r_word_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows by which of some words their host contains: an alternation, not a join."""
    found = F.regexp_extract(F.lower("domain"), "(outlet|boutique|winkel|laden|markt|haus)", 1)
    return table(spark, folder, "common_crawl_domains").select(F.nullif(found, F.lit("")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_rows"))


def r_new_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows of a country whose domain isn't known, best first."""
    ccd = table(spark, folder, "common_crawl_domains").where((F.lower("country") == COUNTRY) & (F.col("ecommerce_score") >= 0.3))
    fresh = keyed.new_rows(ccd, table(spark, folder, "domains"), ["domain"])
    return keyed.top_rows(fresh, 200, F.desc("ecommerce_score"), F.desc_nulls_last("last_seen_at"), F.desc("id")).select("id", "domain", "ecommerce_score", _second("last_seen_at").alias("last_seen_at"))


def r_index_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each country, above a score, and not yet known, in one pass after one join."""
    ccd = table(spark, folder, "common_crawl_domains").select(F.lower("country").alias("country"), "domain", "ecommerce_score")
    known = table(spark, folder, "domains").select("domain", F.lit(True).alias("known")).distinct()
    good = F.col("ecommerce_score") >= 0.3
    n = lambda test, name: F.sum(F.when(test, 1).otherwise(0)).alias(name)
    return ccd.join(known, "domain", "left").groupBy("country").agg(F.count(F.lit(1)).alias("n_rows"), n(good, "n_good"), n(good & F.col("known").isNull(), "n_new"))


def r_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The first discovery of each host by id, and which rows survive an over-fetch of five times the limit."""
    found = table(spark, folder, "discovered_candidates").select("candidate_id", "domain", "source_type")
    some = keyed.top_rows(found, 5 * 300, F.asc("candidate_id"))
    first = keyed.first_wins(some, urls.discovery_domain(F.col("domain")), "candidate_id")
    return keyed.top_rows(first.where(~F.col("key").rlike("[0-9]{3,}")), 300, F.asc("candidate_id")).select(F.col("key").alias("host"), "candidate_id", "source_type")


def r_latest_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """The latest fingerprint of each domain."""
    prints = table(spark, folder, "domain_fingerprints").select("id", "domain_id", "platform", "confidence", "detected_at")
    return keyed.latest(prints, "domain_id", "detected_at", "id").select("domain_id", F.col("id").alias("fingerprint_id"), "platform", F.col("confidence").cast("double").alias("confidence"))


def r_domain_overview(spark: SparkSession, folder: str) -> DataFrame:
    """Every domain with its latest fingerprint and status and the number of its sources."""
    domains = table(spark, folder, "domains").select("id", "normalized_domain")
    prints = keyed.latest(table(spark, folder, "domain_fingerprints").select("id", "domain_id", "platform", "detected_at"), "domain_id", "detected_at", "id").select(F.col("domain_id").alias("id"), F.col("platform").alias("latest_platform"))
    status = keyed.latest(table(spark, folder, "domain_status_snapshots").select("snapshot_id", "domain_id", "status", "snapshot_at"), "domain_id", "snapshot_at", "snapshot_id").select(F.col("domain_id").alias("id"), F.col("status").alias("latest_status"))
    sources = table(spark, folder, "domain_sources").groupBy(F.col("domain_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return domains.join(prints, "id", "left").join(status, "id", "left").join(sources, "id", "left").select("id", "normalized_domain", "latest_platform", "latest_status", F.coalesce("n", F.lit(0)).alias("n_sources"))


def filtered(domains: DataFrame, word=None, status=None, platform=None, country=None, niche=None, business_model=None, least=None, most=None) -> DataFrame:
    """Domains under up to eight optional filters; one that isn't given leaves its condition out."""
    same = lambda c, v: F.col(c) == F.lit(v)
    return keyed.where_given(
        domains,
        [
            (word, F.contains(F.lower("normalized_domain"), F.lower(F.lit(word)))), (status, same("status", status)), (platform, same("platform", platform)), (country, F.upper("country") == F.upper(F.lit(country))),
            (niche, same("niche", niche)), (business_model, same("business_model", business_model)), (least, F.col("confidence") >= F.lit(least)), (most, F.col("confidence") <= F.lit(most)),
        ],
    )


def r_domain_page(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of domains that a crawl found, newest first, under some and under the other optional filters."""
    domains = table(spark, folder, "domains")
    crawled = table(spark, folder, "domain_sources").where("source_type = 'common_crawl'").select(F.col("domain_id").alias("id"))

    def page(name: str, rows: DataFrame, number: int) -> DataFrame:
        shown = keyed.page_of(rows.join(crawled, "id", "left_semi"), number, 25, F.desc_nulls_last("updated_at"), F.desc("id"))
        return shown.select(F.lit(name).alias("page"), "id", "normalized_domain", "platform", F.col("confidence").cast("double").alias("confidence"))

    return page("a", filtered(domains, country="de", least=20, word="R"), 2).unionByName(page("b", filtered(domains, status="pending", business_model="b2c", most=95), 1)).unionByName(page("c", filtered(domains, platform="shopify", niche="toys"), 1))


def r_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of the overview in one scan."""
    n = lambda test, name: F.sum(F.when(test, 1).otherwise(0)).alias(name)
    d = table(spark, folder, "domains")
    return d.agg(F.count(F.lit(1)).alias("n_domains"), n(F.col("confidence") >= 70, "n_sure"), n(F.col("business_model") == "b2b", "n_b2b"), n(F.col("visited_at").isNull(), "n_new"), F.round(F.coalesce(F.avg("confidence"), F.lit(0)), 2).cast("double").alias("mean_confidence"))


def r_platform_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The four platforms with the most domains."""
    d = table(spark, folder, "domains").where("platform is not null").groupBy("platform").agg(F.count(F.lit(1)).alias("n_domains"))
    return keyed.top_rows(d, 4, F.desc("n_domains"), F.asc("platform"))


def r_filter_values(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct values of the columns that can be filtered by."""
    d, columns = table(spark, folder, "domains"), ["platform", "niche", "business_model", "status"]
    pair = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns)))
    return d.select(pair.alias("p")).select("p.name", "p.value").where("value is not null").distinct()


def r_source_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and latest find by kind and name of source."""
    return table(spark, folder, "domain_sources").groupBy("source_type", "source_name").agg(F.count(F.lit(1)).alias("n_rows"), _second(F.max("discovered_at")).alias("last_found"))


def r_store_search(spark: SparkSession, folder: str) -> DataFrame:
    """Domains found by a word in their name or in their metadata's store name."""
    d, store = table(spark, folder, "domains"), F.get_json_object("metadata", "$.store_name")
    whole = F.try_parse_json("metadata").isNotNull()
    word = F.contains(F.lower("normalized_domain"), F.lit("zu")) | F.contains(F.lower(F.when(whole, store)), F.lit("zu"))
    return d.where(word).select("id", F.when(whole, store).alias("store_name"))


def r_all_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Every host of any table, with the tables that have it."""
    parts = [table(spark, folder, t).select(urls.discovery_domain(F.col(c)).alias("host"), F.lit(t).alias("t")) for t, c in (("domains", "normalized_domain"), ("discovered_candidates", "domain"), ("common_crawl_domains", "domain"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("host is not null").groupBy("host").agg(*(F.max(F.when(F.col("t") == t, 1).otherwise(0)).alias(f"in_{t}") for t in ("domains", "discovered_candidates", "common_crawl_domains")))
    return both


def r_seen_span(spark: SparkSession, folder: str) -> DataFrame:
    """First and last sight of each host over domains and crawl: the first is kept, the last replaced."""
    d = table(spark, folder, "domains").select(urls.discovery_domain(F.col("normalized_domain")).alias("host"), F.col("first_seen_at").alias("a"), F.col("last_seen_at").alias("b"))
    c = table(spark, folder, "crawl_candidates").select(F.col("normalized_domain").alias("host"), F.col("fetched_at").alias("a"), F.col("fetched_at").alias("b"))
    return d.unionByName(c).where("host is not null").groupBy("host").agg(_second(F.min("a")).alias("first_seen"), _second(F.max("b")).alias("last_seen"))


def r_seed_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Search terms: each seed with each country and wording (both fixed lists), in order and without repeats."""
    seeds = table(spark, folder, "discovered_candidates").select(F.trim("keyword_seed").alias("seed")).where("seed <> ''").distinct()
    fixed = lambda *v: F.explode(F.array(*map(F.lit, v)))
    return seeds.select("seed", fixed("de", "nl", "").alias("country")).select("seed", "country", fixed("shop", "online kaufen").alias("term")).select(F.trim(F.concat_ws(" ", "seed", F.nullif("country", F.lit("")), "term")).alias("query")).distinct()


def r_score_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows by hundredths of shop points of their URL and its labels."""
    rows = table(spark, folder, "common_crawl_domains").select(F.coalesce("source_url", F.lit("")).alias("u"))
    return rows.select(signals.shop_points(F.col("u")).alias("points"), _joined(signals.shop_labels(F.col("u"))).alias("labels")).groupBy("points", "labels").agg(F.count(F.lit(1)).alias("n_rows"))


def r_json_lists(spark: SparkSession, folder: str) -> DataFrame:
    """How often each member stands in the index's JSON lists, and how often first."""
    rows = table(spark, folder, "common_crawl_domains").select(F.coalesce(F.from_json("matched_patterns", "array<string>"), F.array().cast("array<string>")).alias("a"))
    each = rows.select(F.posexplode("a").alias("at", "member"))
    return each.groupBy("member").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("n_first"))


def r_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Arrivals of index rows by day and crawl pattern: the batch form of the streaming count."""
    rows = table(spark, folder, "crawl_candidates").select("loaded_at", "matched_pattern").where("loaded_at is not null")
    return windowed_counts(rows, "loaded_at", "matched_pattern", "1 day").select(_second("window_start").alias("window_start"), "key", "n")


# --- pages -------------------------------------------------------------------------------------------------
def _bundles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_bundles")


def r_platforms(spark: SparkSession, folder: str) -> DataFrame:
    """Platform, confidence, signals and front-end libraries of every page."""
    found = signals.platform(F.col("html"), F.col("headers"), F.col("cookies"), F.concat(F.coalesce("script_urls", F.array()), F.coalesce("stylesheet_urls", F.array())), F.col("links"), F.col("whatweb_plugins"))
    out = _bundles(spark, folder).select("bundle_id", found.alias("f"))
    return out.select("bundle_id", "f.platform", "f.confidence", _joined(F.col("f.signals")).alias("signals"), _joined(F.col("f.stack")).alias("stack"))


def r_flat_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Headers and cookies of every page as lines, and how many links of its own site it has."""
    own = F.size(F.filter(F.coalesce("links", F.array()), lambda x: pages.same_site(x, F.col("whatweb_target_url"))))
    return _bundles(spark, folder).select("bundle_id", F.md5(signals.map_lines(F.col("headers"))).alias("headers"), F.length(signals.map_lines(F.col("cookies"))).alias("cookie_chars"), F.when(F.col("whatweb_target_url").isNotNull(), own).otherwise(0).alias("n_own"))


#: Words that make an address worth reading first.
PRIORITY = ["product", "products", "collection", "category", "shop", "cart", "checkout"]


def r_page_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The addresses of each page to read next: its own first, then by place of a priority word and length, three at most."""
    b = _bundles(spark, folder).select("bundle_id", F.col("whatweb_target_url").alias("home"), F.array_distinct(F.concat(F.array("whatweb_target_url"), F.coalesce("links", F.array()))).alias("links"))
    each = b.select("bundle_id", "home", F.posexplode("links").alias("ord", "url")).where("url is not null")
    low = F.lower("url")
    place = F.least(*(F.when(F.contains(low, F.lit(p)), F.instr(low, p) - 1).otherwise(9999) for p in PRIORITY))
    order = Window.partitionBy("bundle_id").orderBy(F.when(F.col("url") == F.col("home"), 0).otherwise(1), place, F.length("url"), "ord")  # a page's links: bounded
    return each.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("bundle_id", "rank", "url")


def r_page_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by the total they tell and their last page number."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]+>", " ")
    n = signals.listing_total(text)
    return _bundles(spark, folder).select(signals.count_bucket(n).alias("bucket"), signals.last_page(text).alias("last_page")).groupBy("bucket", "last_page").agg(F.count(F.lit(1)).alias("n_pages"))


def r_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """The shown words of every page, and how many words of shop navigation are among them."""
    text = _bundles(spark, folder).select("bundle_id", pages.page_text(F.coalesce("html", F.lit(""))).alias("text"))
    return text.select("bundle_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), pages.keywords_present(F.col("text"), ["cart", "shop", "checkout"]).alias("n_words"))


def _parsed(spark: SparkSession, folder: str, *fields: str, **keep) -> DataFrame:
    return pages.parse_pages(_bundles(spark, folder), "bundle_id", "html", F.coalesce("whatweb_target_url", F.lit("")), fields, **keep)


def r_page_links(spark: SparkSession, folder: str) -> DataFrame:
    """The links of every page to its own site, each once."""
    links = _parsed(spark, folder, "anchors", site=F.col("whatweb_target_url")).select("row_id", "site", F.explode("anchors").alias("a")).where(pages.same_site(F.col("a.href"), F.col("site")))
    return links.select(F.col("row_id").alias("bundle_id"), pages.link_address(F.col("a.href")).alias("url")).where("url is not null").distinct()


def outer_domains(parsed: DataFrame, own: Column, ignored: list[str], word: str) -> DataFrame:
    """(domain, n_pages, n_named): the domains that parsed pages link to other than their ``own``, and how many of the links name ``word`` in text or address."""
    links = parsed.select("row_id", own.alias("own"), F.explode("anchors").alias("a"))
    out = links.select("row_id", "own", urls.discovery_domain(urls.url_host(F.col("a.href"))).alias("domain"), F.contains(F.lower(F.concat_ws(" ", "a.text", "a.href")), F.lit(word)).alias("named"))
    return out.where(F.col("domain").isNotNull() & ~F.col("domain").isin(ignored) & (F.col("own").isNull() | (F.col("domain") != F.col("own")))).groupBy("domain").agg(F.countDistinct("row_id").alias("n_pages"), F.sum(F.col("named").cast("int")).alias("n_named"))


IGNORED_HOSTS = ["facebook.com", "google.com", "instagram.com", "linkedin.com", "pinterest.com", "twitter.com", "youtube.com"]


def r_outer_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Domains that a directory's entries link to, other than the directory's own: each discovered candidate as an entry of the page it was found on."""
    entry = F.concat(F.lit('<li><a href="https://'), F.col("domain"), F.lit('">'), F.coalesce("keyword_seed", F.lit("")), F.lit("</a></li>"))
    found = table(spark, folder, "discovered_candidates").select("candidate_id", entry.alias("html"), "source_url")
    parsed = pages.parse_pages(found, "candidate_id", "html", F.coalesce("source_url", F.lit("")), ("anchors",), own=urls.discovery_domain(urls.url_host(F.col("source_url"))))
    return outer_domains(parsed, F.col("own"), IGNORED_HOSTS, "online")


def r_page_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Scripts, stylesheets and meta data of every page."""
    return _parsed(spark, folder, "scripts", "stylesheets", "meta").select(F.col("row_id").alias("bundle_id"), _joined(F.col("scripts")).alias("scripts"), F.size("stylesheets").alias("n_stylesheets"), F.size(F.map_keys("meta")).alias("n_meta"))


def _named(*functions) -> dict:
    return {f.__name__: f for f in functions}


QUERIES = _named(
    r_index_scan, r_first_pattern, r_like_patterns, r_import, r_import_counts, r_merge, r_domain_forms, r_suffix_matches, r_word_hosts, r_new_domains, r_index_counts, r_first_wins, r_latest_fingerprint,
    r_domain_overview, r_domain_page, r_dashboard, r_platform_counts, r_filter_values, r_source_counts, r_store_search, r_all_hosts, r_seen_span, r_seed_queries, r_score_bands, r_json_lists, r_event_windows,
    r_platforms, r_flat_maps, r_page_sample, r_page_counts, r_page_text, r_page_links, r_outer_domains, r_page_assets,
)
