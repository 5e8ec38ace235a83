"""Queries over page kinds, checked rows, resolved ids and patched documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import json_docs, page_types, pages, signals, urls
from lodestream.operators import checks
from lodestream.plans.index_sql import _q, discovery, url_host
from lodestream.sources.tables import table

_STATUSES = ["pending", "queued", "crawling", "processed", "failed"]


def _rules() -> dict:
    return {
        "status": F.col("status").isin(_STATUSES),
        "confidence": F.col("confidence").between(0, 100),
        "country": checks.optional(F.col("country"), F.length("country") == 2),
        "domain": urls.discovery_domain(F.col("normalized_domain")).isNotNull(),
        "span": checks.optional(F.col("last_seen_at"), F.col("first_seen_at") <= F.col("last_seen_at")),
    }


def r_broken_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Domains by the rules they break."""
    rows = checks.checked(table(spark, folder, "domains"), _rules())
    return rows.select(F.array_join("failed", "|").alias("failed")).groupBy("failed").agg(F.count(F.lit(1)).alias("n_rows"))


def r_resolved_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The domain of every index row: by normalised host, else by the host as written."""
    ccd, d = table(spark, folder, "common_crawl_domains"), table(spark, folder, "domains")
    found = checks.resolve(ccd, d, "id", [(urls.discovery_domain(F.col("domain")), urls.discovery_domain(F.col("normalized_domain"))), (F.col("domain"), F.col("domain"))])
    return found.withColumnsRenamed({"row_id": "ccd_id", "known_id": "domain_id"})


def r_patched(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's context with its kind put in and its ending replaced."""
    doc = json_docs.patch_json(F.col("context"), source_type=F.col("source_type"), tld=F.lit("x"))
    out = table(spark, folder, "domain_sources").select("id", doc.alias("doc"))
    return out.select("id", F.get_json_object("doc", "$.source_type").alias("source_type"), F.get_json_object("doc", "$.tld").alias("tld"), F.get_json_object("doc", "$.source_url").alias("source_url"))


def r_merged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata of each domain merged into a default document, to any depth."""
    default = F.lit('{"store_name": "none given", "seen": {"by": ["crawl"]}}')
    merged = table(spark, folder, "domains").select("id", json_docs.merge_json(default, F.col("metadata")).alias("m"))
    return merged.select("id", *(F.get_json_object("m", f"$.{k}").alias(n) for n, k in (("store_name", "store_name"), ("seen", "seen.by[0]"), ("contact_url", "contact_url"))))


def r_page_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of every page by at least two reasons, whether it's a home page, and how many products it shows."""
    page, url = F.coalesce("html", F.lit("")), F.coalesce(F.get("links", F.lit(0)), F.col("whatweb_target_url"), F.lit(""))
    rows = table(spark, folder, "page_bundles").select("bundle_id", page.alias("html"), url.alias("url"), pages.page_text(page).alias("text"))
    found = rows.select("bundle_id", page_types.is_homepage(F.col("url")).alias("is_home"), page_types.reasons_once(F.col("url"), F.col("html"), F.col("text")).alias("k"))
    return found.select("bundle_id", "is_home", *(F.array_join(F.col("k")[k], "|").alias(k) for k in page_types.KINDS), F.col("k")["per_page"].alias("per_page"))


def r_domain_products(spark: SparkSession, folder: str) -> DataFrame:
    """For each domain the total its pages tell, else its highest page number times the most products on a page."""
    page = F.coalesce("html", F.lit(""))
    rows = table(spark, folder, "page_bundles").where("domain_id is not null").select("domain_id", "bundle_id", page.alias("html"), pages.page_text(page).alias("text"))
    each = rows.select("domain_id", "bundle_id", signals.listing_total(F.col("text")).alias("told"), signals.last_page(F.col("text")).alias("page"), page_types.per_page(F.col("html"), F.col("text")).alias("n"))
    of = each.groupBy("domain_id").agg(F.min_by("told", F.when(F.col("told").isNotNull(), F.col("bundle_id"))).alias("told"), F.max("page").alias("page"), F.max("n").alias("n"))
    guess = F.coalesce("told", F.when((F.col("page") >= 2) & (F.col("n") >= 1), F.col("page") * F.col("n")))
    return of.select("domain_id", "n", guess.alias("guess"), signals.count_bucket(guess).alias("bucket"))


def r_country_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by the country that their scan or their host's ending hints at."""
    rows = table(spark, folder, "page_bundles").select(signals.country_hint(urls.discovery_domain(urls.url_host(F.col("whatweb_target_url"))), F.col("whatweb_plugins")).alias("country"))
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("n_pages"))


def r_product_links(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by how many of their links look like products, with the sizes in words."""
    n = signals.product_links(F.coalesce("links", F.array()))
    rows = table(spark, folder, "page_bundles").select(n.alias("n_links"), F.format_string("%d of %d", F.coalesce(n, F.lit(0)), F.size(F.coalesce("links", F.array()))).alias("said"))
    return rows.groupBy("n_links", "said").agg(F.count(F.lit(1)).alias("n_pages"))


_BROKEN = {
    "confidence": "confidence between 0 and 100", "country": "country is null or length(country) = 2", "domain": f"{discovery('normalized_domain')} is not null",
    "span": "last_seen_at is null or first_seen_at <= last_seen_at", "status": f"status in ({', '.join(map(_q, _STATUSES))})",
}

QUERIES = {f.__name__: f for f in (r_broken_rules, r_resolved_ids, r_patched, r_merged_documents, r_page_kinds, r_domain_products, r_country_hints, r_product_links)}
_SITE = discovery(url_host("whatweb_target_url"))
SQL = {
    "r_merged_documents": "with m as (select id, case when json_valid(metadata) and json_type(metadata) = 'OBJECT' then metadata else '{}' end as m from domains) select id, case when list_contains(json_keys(m), 'store_name') then m ->> '$.store_name' else 'none given' end as store_name, 'crawl' as seen, m ->> '$.contact_url' as contact_url from m",
    "r_country_hints": f"select case {' '.join(f"when split_part({_SITE}, '.', -1) = '{e}' then '{c}'" for e, c in signals.ENDING_COUNTRIES.items())} end as country, count(*) as n_pages from page_bundles group by 1",
    "r_product_links": "with l as (select nullif(len(list_filter(coalesce(links, []), lambda u: regexp_matches(lower(u), '/product|/item|sku'))), 0)::int as n, len(coalesce(links, [])) as m from page_bundles) select n as n_links, coalesce(n, 0) || ' of ' || m as said, count(*) as n_pages from l group by 1, 2",
    "r_broken_rules": "select failed, count(*) as n_rows from (select array_to_string(list_filter([" + ", ".join(f"case when not coalesce({t}, false) then '{n}' end" for n, t in _BROKEN.items()) + "], lambda x: x is not null), '|') as failed from domains) group by 1",
    "r_resolved_ids": f"""with c as (select id, domain, {discovery('domain')} as h from common_crawl_domains), a as (select {discovery('normalized_domain')} as h, min(id) as i from domains group by 1), b as (select domain, min(id) as i from domains group by 1)
      select c.id as ccd_id, coalesce(a.i, b.i) as domain_id from c left join a on a.h = c.h left join b on b.domain = c.domain""",
    "r_patched": "with s as (select id, source_type, case when json_valid(context) then context end as c from domain_sources) select id, coalesce(source_type, c ->> '$.source_type') as source_type, 'x' as tld, c ->> '$.source_url' as source_url from s",
}
