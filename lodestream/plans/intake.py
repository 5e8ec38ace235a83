"""Queries over index files, discovery seeds, upserts and the pages of a domain, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import json_docs, page_types, pages, signals, urls
from lodestream.operators import keyed
from lodestream.plans.index_sql import _any, _bare, _q, discovery, page_text
from lodestream.session import shared_dir
from lodestream.sources import crawl_index
from lodestream.sources.tables import table

_second = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- index files -------------------------------------------------------------------------------------------
def _index_files(spark: SparkSession, folder: str) -> tuple[list[str], DataFrame]:
    """The files of an index written in two crawls whose columns differ, with one that can't be read, and their rows."""
    raw = table(spark, folder, "crawl_candidates").select(F.coalesce("candidate_url", F.lit("")).alias("url"), F.from_json("source_metadata", "crawl string, status string, languages string").alias("m"))
    rows = raw.select("url", "m.*")
    root = f"{shared_dir(spark)}/lodestream/files-{uuid.uuid4().hex}"
    newest = F.col("crawl").isNotNull() & F.endswith("crawl", F.lit("0"))
    for name, part in (("a", rows.where(newest)), ("b", rows.where(~F.coalesce(newest, F.lit(False))).drop("languages"))):
        part.coalesce(1).write.parquet(f"{root}/crawl={name}/subset=warc")
    # What isn't Parquet, under a name that is listed.
    spark.createDataFrame([("no parquet",)], "value string").coalesce(1).write.text(f"{root}/crawl=c/subset=warc/broken.parquet")
    listed = {name: crawl_index.listed_files(spark, f"{root}/crawl={name}/subset=warc") for name in "abc"}
    paths = crawl_index.index_paths(root, "abc", listed)
    return paths, crawl_index.read_index(spark, paths, skip_corrupt=True)


def r_index_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of an index's files, whose columns differ; one file can't be read and is missing in the counts."""
    _, read = _index_files(spark, folder)
    return read.groupBy("crawl").agg(F.count(F.lit(1)).alias("n_rows"), F.count("languages").alias("n_languages"), F.countDistinct(F.col("_metadata.file_path")).alias("n_files"))


def r_index_run(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of a run over the same files."""
    return crawl_index.run_summary(*_index_files(spark, folder))


def r_index_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates from the index by patterns, countries and niches."""
    rows = table(spark, folder, "common_crawl_domains").select(F.col("source_url").alias("url"), "country", F.col("crawl_id").alias("crawl"))
    return crawl_index.candidates(rows.where("url is not null"), ["/shop", "/Products ", ""], 40, ["DE", "nl", " "], ["markt", "winkel"])


def r_country_endings(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows of the endings that are read for some countries."""
    wanted = signals.endings(["AT", "se", "us", "DE", "FR", "ch", None, ""])
    return table(spark, folder, "common_crawl_domains").where(F.lower("tld").isin(wanted)).groupBy(F.lower("tld").alias("ending")).agg(F.count(F.lit(1)).alias("n_rows"))


def r_segment_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows by their first path segment of some; rows without any are dropped."""
    found = signals.first_segment(F.coalesce("candidate_url", F.lit("")), ["/shop/", "cart", "/collections"])
    return table(spark, folder, "crawl_candidates").select(found.alias("segment")).where("segment is not null").groupBy("segment").agg(F.count(F.lit(1)).alias("n_rows"))


def r_first_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows by the first two of their matched patterns."""
    some = F.slice(F.coalesce(F.from_json("matched_patterns", "array<string>"), F.array().cast("array<string>")), 1, 2)
    return table(spark, folder, "common_crawl_domains").select(F.array_join(some, "|").alias("first_two")).groupBy("first_two").agg(F.count(F.lit(1)).alias("n_rows"))


def r_scanner_values(spark: SparkSession, folder: str) -> DataFrame:
    """A scanner's line for every fingerprint, read again: a list, a scalar and an object as payloads."""
    prints = table(spark, folder, "domain_fingerprints").select("id", "platform", "frontend_stack")
    line = F.to_json(F.struct(F.struct(F.coalesce("frontend_stack", F.array().cast("array<string>")).alias(" Stack "), F.coalesce("platform", F.lit("")).alias("Platform"), F.struct("id").alias("Meta")).alias("plugins")))
    read = prints.select("id", crawl_index.scanner_plugins(F.concat(F.lit("started\n"), line)).alias("p"))
    return read.select("id", F.get_json_object(F.col("p")["stack"], "$.values[0]").alias("first_library"), F.get_json_object(F.col("p")["platform"], "$.value").alias("platform"), F.get_json_object(F.col("p")["meta"], "$.id").cast("bigint").alias("meta_id"))


# --- discovery ---------------------------------------------------------------------------------------------
#: The pages of a seed that are searched for further domains.
SEED_PATHS = ["", "/partners", "/brands", "/stockists", "/retailers"]


def r_page_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """The addresses to search for every known host: each host with each of the fixed paths."""
    hosts = table(spark, folder, "domains").select(urls.discovery_domain(F.col("normalized_domain")).alias("host")).where("host is not null").distinct()
    return hosts.select("host", F.explode(F.array(*(F.concat(F.lit("https://"), "host", F.lit(p)) for p in SEED_PATHS))).alias("url"))


def r_source_context(spark: SparkSession, folder: str) -> DataFrame:
    """How many entries each find's context has once nulls are dropped."""
    entries = json_docs.without_nulls(F.from_json("context", "map<string,string>"))
    return table(spark, folder, "domain_sources").select("id", F.coalesce(F.size(F.map_keys(entries)), F.lit(0)).alias("n_entries"))


# --- upserts -----------------------------------------------------------------------------------------------
def r_domain_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Known domains with the crawl's latest row for each host taken in.

    Status is kept, the first sight too; the last is replaced, as is the country where the update has one, even by null; metadata are merged to any depth.
    """
    d = table(spark, folder, "domains").select("id", urls.ingest_domain(F.col("normalized_domain")).alias("host"), "status", "country", "first_seen_at", "last_seen_at", "metadata")
    known = keyed.first_wins(d, F.col("host"), "id").select("host", "status", "country", "first_seen_at", "last_seen_at", "metadata")
    c = table(spark, folder, "common_crawl_domains").select("id", urls.ingest_domain(F.col("domain")).alias("host"), "country", "tld", "crawl_id", "last_seen_at")
    new = keyed.latest(c, "host", "last_seen_at", "id")
    doc = F.to_json(F.struct(F.struct("tld", "crawl_id").alias("crawl")))
    update = new.select("host", F.lit("pending").alias("status"), "country", F.col("last_seen_at").alias("first_seen_at"), "last_seen_at", doc.alias("metadata"))
    out = keyed.merge(known, update, "host", {"status": "old_or_new", "country": "new", "first_seen_at": "old_or_new", "last_seen_at": "new", "metadata": "json"})
    return out.select("host", "status", "country", _second("first_seen_at").alias("first_seen"), _second("last_seen_at").alias("last_seen"), F.get_json_object("metadata", "$.crawl.tld").alias("tld"), F.get_json_object("metadata", "$.contact_url").alias("contact_url"), "merge_state")


def r_promoted(spark: SparkSession, folder: str) -> DataFrame:
    """How many domains promoting one country's index rows inserts, updates and leaves."""
    c = table(spark, folder, "common_crawl_domains").where((F.lower("country") == "de") & (F.col("ecommerce_score") >= 0.3)).select("id", urls.promote_domain(F.col("domain")).alias("host"), "last_seen_at", "ecommerce_score")
    known = table(spark, folder, "domains").select(urls.promote_domain(F.col("normalized_domain")).alias("host")).where("host is not null").distinct().withColumn("score", F.lit(None).cast("double"))
    update = keyed.latest(c, "host", "last_seen_at", "id").select("host", F.col("ecommerce_score").alias("score"))
    return keyed.merge(known, update, "host", {"score": "greatest"}).groupBy("merge_state").agg(F.count(F.lit(1)).alias("n_domains"), F.count("score").alias("n_scored"))


def r_legacy_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Finds of one kind rewritten: another kind, and a job type in the context unless there is one; a null context becomes an object."""
    old = F.col("source_type") == "sitemap"
    job = F.coalesce(F.get_json_object("context", "$.discovery_job_type"), F.lit("homepage_fetch"))
    doc = F.when(old, json_docs.patch_json(F.col("context"), discovery_job_type=job)).otherwise(F.col("context"))
    rows = table(spark, folder, "domain_sources").select("id", F.when(old, "manual").otherwise(F.col("source_type")).alias("source_type"), doc.alias("context"))
    return rows.select("id", "source_type", F.get_json_object("context", "$.discovery_job_type").alias("job_type"))


# --- grids -------------------------------------------------------------------------------------------------
def r_latest_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A page of the domains whose latest fingerprint is fairly sure, in order of a column that can be sorted by."""
    prints = keyed.latest(table(spark, folder, "domain_fingerprints").select("id", "domain_id", "confidence", "detected_at"), "domain_id", "detected_at", "id")
    sure = prints.where(F.col("confidence").between(40, 90)).select(F.col("domain_id").alias("id"))
    rows = table(spark, folder, "domains").join(sure, "id", "left_semi")
    return keyed.sorted_page(rows, "last_seen_at", "id", 3, 50, ["last_seen_at", "confidence", "normalized_domain"]).select("id", "normalized_domain", _second("last_seen_at").alias("last_seen"))


def r_next_chunk(spark: SparkSession, folder: str) -> DataFrame:
    """The domains that follow an id, as many as a step takes."""
    return keyed.next_chunk(table(spark, folder, "domains").where("status = 'pending'"), "id", 100, 40).select("id", "normalized_domain", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"))


def r_display_values(spark: SparkSession, folder: str) -> DataFrame:
    """The front-end libraries in each domain's metadata as they are displayed."""
    stack = F.get_json_object(F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata")), "$.frontend_stack")
    shown = json_docs.display_values(F.when(stack.startswith("["), stack))
    return table(spark, folder, "domains").select("id", F.array_join(shown, "|").alias("stack"))


#: The attributes of a fingerprint that are kept.
KEPT = ["platform", "confidence", "signals", "frontend_stack", "raw", "raw_payload", "matched_rules", "reasons"]


def r_fingerprint_json(spark: SparkSession, folder: str) -> DataFrame:
    """Every fingerprint as a JSON document of the attributes that are kept."""
    prints = table(spark, folder, "domain_fingerprints")
    doc = json_docs.kept_json({c: F.col(c) for c in prints.columns}, KEPT)
    return prints.select("id", doc.alias("doc")).select("id", F.get_json_object("doc", "$.platform").alias("platform"), F.get_json_object("doc", "$.signals[0]").alias("first_signal"), F.get_json_object("doc", "$.detected_at").alias("not_kept"))


# --- pages of a domain -------------------------------------------------------------------------------------
def r_first_pages(spark: SparkSession, folder: str) -> DataFrame:
    """For each domain the first page of each kind in order of its pages, and whether there is any.

    First pages are minima of (order, address), combined on the map side.
    """
    page, url = F.coalesce("html", F.lit("")), F.coalesce(F.get("links", F.lit(0)), F.col("whatweb_target_url"), F.lit(""))
    rows = table(spark, folder, "page_bundles").where("domain_id is not null").select("domain_id", "bundle_id", page.alias("html"), url.alias("url"), pages.page_text(page).alias("text"))
    found = page_types.reasons_once(F.col("url"), F.col("html"), F.col("text"))
    each = rows.select("domain_id", "bundle_id", "url", found.alias("k"))
    of = each.groupBy("domain_id").agg(*(F.min_by("url", F.when(F.size(F.col("k")[k]) > 0, F.col("bundle_id"))).alias(f"{k}_url") for k in ("product", "category", "cart", "checkout")))
    return of.select("*", *(F.col(f"{k}_url").isNotNull().alias(f"{k}_found") for k in ("product", "category", "cart", "checkout")))


def r_all_links(spark: SparkSession, folder: str) -> DataFrame:
    """How many different addresses every page has in its anchors, its head and its list of links together."""
    parsed = pages.parse_pages(table(spark, folder, "page_bundles"), "bundle_id", "html", F.coalesce("whatweb_target_url", F.lit("")), ("anchors", "head_links"), links=F.coalesce("links", F.array().cast("array<string>")))
    every = F.concat(F.transform("anchors", lambda a: a["href"]), F.col("head_links"), F.col("links"))
    return parsed.select(F.col("row_id").alias("bundle_id"), F.size(F.array_distinct(F.array_compact(every))).alias("n_links"))


def _named(*functions) -> dict:
    return {f.__name__: f for f in functions}


QUERIES = _named(
    r_index_files, r_index_run, r_index_candidates, r_country_endings, r_segment_rows, r_first_matches, r_scanner_values, r_page_seeds, r_source_context, r_domain_upsert, r_promoted, r_legacy_jobs, r_latest_filter, r_next_chunk,
    r_display_values, r_fingerprint_json, r_first_pages, r_all_links,
)


def _kind_reasons(url: str, html: str, text: str) -> dict[str, str]:
    """For each kind a list of the reasons that hold, in SQL, from the same rules."""
    path = rf"regexp_replace(lower(regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)), '^/+|/+$', '', 'g')"
    keys = rf"list_transform(list_filter(string_split(lower(regexp_extract({url}, '^[^?#]*\?([^#]*)', 1)), '&'), lambda f: regexp_matches(f, '^[^=]+=.')), lambda f: split_part(f, '=', 1))"
    part = {"path": path, "html": f"lower({html})", "text": text}
    out = {}
    for kind, rules in page_types.KINDS.items():
        found = []
        for name, where, test, of in rules:
            if where == "query":
                holds = f"list_has_any({keys}, [{', '.join(map(_q, of))}])"
            elif where == "both":
                holds = f"contains({part['html']}, 'mailto:') or regexp_matches({text}, {_q(of)})"
            elif test == "pattern":
                holds = f"regexp_matches({part[where]}, {_q(of)})"
            elif test == "any":
                holds = _any(part[where], of)
            else:
                holds = " + ".join(f"contains({part[where]}, {_q(w)})::int" for w in of) + f" >= {test}"
            found.append(f"case when {holds} then {_q(name)} end")
        out[kind] = f"list_filter([{', '.join(found)}], lambda x: x is not null)"
    return out


_PER_PAGE = "least(case when len(regexp_extract_all(lower(html), 'product-card|grid-item|product-item|collection-product')) > 0 then len(regexp_extract_all(lower(html), 'product-card|grid-item|product-item|collection-product')) else len(regexp_extract_all(text, '\\badd to cart\\b')) end, 120)::int"
_PAGES = f"p as (select bundle_id, domain_id, coalesce(html, '') as html, coalesce(links[1], whatweb_target_url, '') as url, {page_text('html')} as text from page_bundles)"
_REASONS = f"k as (select *, {', '.join(f'{sql} as r_{kind}' for kind, sql in _kind_reasons('url', 'html', 'text').items())} from p)"
_HOME = r"regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)), '^/+|/+$', '', 'g') in ('', 'index', 'index.html', 'home')"
_TOLD = "coalesce(" + ", ".join(f"case when try_cast(regexp_extract(text, {_q(rx)}, 1) as int) > 0 then try_cast(regexp_extract(text, {_q(rx)}, 1) as int) end" for rx in signals.TOTALS) + ")"


def _ingest(c: str) -> str:
    return rf"regexp_replace(split_part({_bare(c)}, '/', 1), '\.+$', '')"


def _promote(c: str) -> str:
    return f"nullif(split_part({_bare(c)}, '/', 1), '')"


def _day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


_NEWEST = "(ends_with(source_metadata ->> '$.crawl', '0'))"
_SEGMENT = "lower(coalesce(candidate_url, ''))"
_STACK = "case when json_valid(metadata) and json_type(metadata, '$.frontend_stack') = 'ARRAY' then cast(json_extract(metadata, '$.frontend_stack') as varchar[]) end"
_FIRST = ", ".join(f"arg_min(url, bundle_id) filter (where len(r_{k}) >= 2) as {k}_url" for k in ("product", "category", "cart", "checkout"))
SQL = {
    "r_page_kinds": f"with {_PAGES}, {_REASONS} select bundle_id, {_HOME} as is_home, {', '.join(f'''case when len(r_{k}) >= 2 then array_to_string(r_{k}, '|') else '' end as {k}''' for k in page_types.KINDS)}, {_PER_PAGE} as per_page from k",
    "r_domain_products": f"""with {_PAGES}, e as (select domain_id, bundle_id, {_TOLD} as told, list_max(list_transform(regexp_extract_all(text, '\\bpage\\s*(\\d{{1,4}})\\b', 1), lambda x: try_cast(x as int))) as page, {_PER_PAGE} as n from p where domain_id is not null),
      o as (select domain_id, arg_min(told, bundle_id) filter (where told is not null) as told, max(page) as page, max(n) as n from e group by 1), g as (select domain_id, n, coalesce(told, case when page >= 2 and n >= 1 then page * n end) as guess from o)
      select *, case when guess is null or guess <= 0 then null when guess <= 50 then '1-50' when guess <= 200 then '51-200' when guess <= 1000 then '201-1000' else '1000+' end as bucket from g""",
    "r_first_pages": f"with {_PAGES}, {_REASONS}, f as (select domain_id, {_FIRST} from k where domain_id is not null group by 1) select *, {', '.join(f'{k}_url is not null as {k}_found' for k in ('product', 'category', 'cart', 'checkout'))} from f",
    "r_index_files": f"select source_metadata ->> '$.crawl' as crawl, count(*) as n_rows, count(case when {_NEWEST} then source_metadata ->> '$.languages' end) as n_languages, 1 as n_files from crawl_candidates group by 1",
    "r_index_run": "select 3 as n_listed, 2 as n_processed, 1 as n_skipped, count(*) as n_rows from crawl_candidates",
    "r_index_candidates": "select source_url as url, coalesce(country, '') as country, coalesce(crawl_id, '') as crawl from common_crawl_domains where (contains(lower(source_url), '/shop') or contains(lower(source_url), '/products')) and lower(coalesce(country, '')) in ('de', 'nl') and (contains(lower(source_url), 'markt') or contains(lower(source_url), 'winkel')) order by 1, 3, 2 limit 200",
    "r_country_endings": "select lower(tld) as ending, count(*) as n_rows from common_crawl_domains where lower(tld) in ('at', 'se', 'us', 'ch') group by 1",
    "r_segment_rows": f"select case when contains({_SEGMENT}, '/shop') then '/shop' when contains({_SEGMENT}, '/cart') then '/cart' when contains({_SEGMENT}, '/collections') then '/collections' end as segment, count(*) as n_rows from crawl_candidates where segment is not null group by 1",
    "r_first_matches": "select array_to_string(coalesce(cast(case when json_valid(matched_patterns) then matched_patterns end as json)::varchar[], [])[1:2], '|') as first_two, count(*) as n_rows from common_crawl_domains group by 1",
    "r_scanner_values": "select id, frontend_stack[1] as first_library, coalesce(platform, '') as platform, id as meta_id from domain_fingerprints",
    "r_display_values": f"select id, coalesce(array_to_string(list_filter(list_transform({_STACK}, lambda x: trim(x)), lambda x: x <> ''), '|'), '') as stack from domains",
    "r_fingerprint_json": "select id, platform, signals[1] as first_signal, null::varchar as not_kept from domain_fingerprints",
    "r_next_chunk": "select id, normalized_domain, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') as created from domains where status = 'pending' and id > 100 order by id limit 40",
    "r_latest_filter": f"""with l as (select *, row_number() over (partition by domain_id order by detected_at desc nulls last, id desc) as rn from domain_fingerprints where domain_id is not null)
      select d.id, d.normalized_domain, {_day('d.last_seen_at')} as last_seen from domains d where d.id in (select domain_id from l where rn = 1 and confidence between 40 and 90) order by d.last_seen_at desc nulls last, d.id desc limit 50 offset 100""",
    "r_legacy_jobs": "select id, case when source_type = 'sitemap' then 'manual' else source_type end as source_type, case when source_type = 'sitemap' then coalesce(case when json_valid(context) then context ->> '$.discovery_job_type' end, 'homepage_fetch') else case when json_valid(context) then context ->> '$.discovery_job_type' end end as job_type from domain_sources",
    "r_source_context": "select id, case when json_valid(context) and json_type(context) = 'OBJECT' then len(list_filter(json_keys(context), lambda k: json_type(json_extract(context, '$.' || k)) <> 'NULL')) else 0 end::int as n_entries from domain_sources",
    "r_page_seeds": f"with h as (select distinct {discovery('normalized_domain')} as host from domains) select host, 'https://' || host || p as url from h, (select unnest(['', '/partners', '/brands', '/stockists', '/retailers']) as p) where host is not null",
    "r_domain_upsert": f"""with o as (select * from (select {_ingest('normalized_domain')} as host, status, country, first_seen_at, last_seen_at, case when json_valid(metadata) then metadata end as m, row_number() over (partition by {_ingest('normalized_domain')} order by id) as rn from domains where normalized_domain is not null) where rn = 1),
      n as (select * from (select {_ingest('domain')} as host, country, tld, last_seen_at, row_number() over (partition by {_ingest('domain')} order by last_seen_at desc nulls last, id desc) as rn from common_crawl_domains where domain is not null) where rn = 1)
      select coalesce(o.host, n.host) as host, case when o.host is null then 'pending' when n.host is null then o.status else coalesce(o.status, 'pending') end as status, case when n.host is null then o.country else n.country end as country,
        {_day('case when o.host is null then n.last_seen_at when n.host is null then o.first_seen_at else coalesce(o.first_seen_at, n.last_seen_at) end')} as first_seen, {_day('case when n.host is null then o.last_seen_at else n.last_seen_at end')} as last_seen,
        n.tld, o.m ->> '$.contact_url' as contact_url, case when n.host is null then 'kept' when o.host is null then 'inserted' else 'updated' end as merge_state from o full join n on o.host = n.host""",
    "r_promoted": f"""with n as (select * from (select {_promote('domain')} as host, ecommerce_score as s, row_number() over (partition by {_promote('domain')} order by last_seen_at desc nulls last, id desc) as rn from common_crawl_domains where lower(country) = 'de' and ecommerce_score >= 0.3 and {_promote('domain')} is not null) where rn = 1),
      o as (select distinct {_promote('normalized_domain')} as host from domains where {_promote('normalized_domain')} is not null)
      select case when n.host is null then 'kept' when o.host is null then 'inserted' else 'updated' end as merge_state, count(*) as n_domains, count(s) as n_scored from o full join n on o.host = n.host group by 1""",
    "r_all_links": r"""with a as (select bundle_id, whatweb_target_url as site, coalesce(links, []) as links, regexp_extract_all(coalesce(html, ''), '<a\b[^>]*?\bhref="([^"]+)"', 1) as refs from page_bundles),
      u as (select bundle_id, list_concat(list_transform(refs, lambda r: case when regexp_matches(r, '^https?://') then r else regexp_extract(coalesce(site, ''), '^(https?://[^/?#]*)', 1) || r end), links) as l from a)
      select bundle_id, len(list_distinct(list_filter(l, lambda x: x is not null)))::int as n_links from u""",
}
