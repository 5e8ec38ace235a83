"""DuckDB texts for the queries of ``index``; rule tables are the same, so the values come from one place."""

from __future__ import annotations

from lodestream.functions import signals


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def url_host(c: str) -> str:
    return f"regexp_extract({_strip(c)}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"


def discovery(c: str) -> str:
    text = f"lower({_strip(c)})"
    host = f"case when contains({text}, '://') then regexp_extract({text}, '^[a-z0-9+.-]*://([^/?#]*)', 1) else regexp_extract({text}, '^([^/?#]*)', 1) end"
    host = rf"regexp_replace(regexp_replace(split_part(regexp_replace({_strip(host)}, '^[^@]*@', ''), ':', 1), '^\.+|\.+$', '', 'g'), '^www\.', '')"
    label = "[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    good = rf"regexp_matches({host}, '^{label}(?:\.{label})+$') and regexp_matches({host}, '\.[a-z0-9-]{{2,}}$') and not regexp_matches({host}, '\.local$') and not regexp_matches({host}, '^(?:{octet}\.){{3}}{octet}$')"
    return f"(case when not regexp_matches({text}, '^(?:mailto:|tel:|javascript:|#)') and {good} then {host} end)"


def _bare(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({_strip(c)}), '^https?://', ''), '^www\.', '')"


def _site(c: str) -> str:
    return f"regexp_replace(lower(regexp_extract({c}, '^[hH][tT][tT][pP][sS]?://([^/?#]*)', 1)), '^www\\.', '')"


def page_text(c: str) -> str:
    seen = f"regexp_replace(regexp_replace(coalesce({c}, ''), '(?s)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    plain = f"replace(replace(replace(replace({seen}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
    return f"lower(trim(regexp_replace({plain}, '[\\s\\p{{Z}}\\x{{85}}\\x{{b}}\\x{{1c}}-\\x{{1f}}]+', ' ', 'g')))"


def _any(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


def _hits(tests: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"case when {t} then {_q(n)} end" for t, n in tests) + "], lambda x: x is not null)"


def _country(url: str, domain: str, country: str) -> tuple[str, str]:
    tlds, paths, words, language = signals.COUNTRIES[country]
    proof = [(f"split_part({domain}, '.', -1) = '{t}'", f"tld:{t}") for t in tlds] + [(f"contains(lower({url}), '{p}')", f"url:{p}") for p in paths] + [(f"contains({domain}, '{w}')", f"domain:{w}") for w in words]
    return _hits(proof), _hits([(f"contains(lower({url}), '{p}')", f"url:{p}") for p in language])


def _points(url: str) -> str:
    return "least(100, " + " + ".join(f"case when {_any(f'lower({url})', w)} then {p} else 0 end" for _, p, w in signals.SHOP_PATTERNS) + ")"


def _labels(url: str) -> str:
    return _hits([(_any(f"lower({url})", w), label) for label, _, w in signals.SHOP_PATTERNS])


_DAY = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_INDEX = """
with raw as (
  select row_id, coalesce(candidate_url, '') as url, normalized_domain, fetched_at, case when json_valid(source_metadata) then source_metadata end as m from crawl_candidates
), idx as (
  select row_id, url, normalized_domain, fetched_at, nullif(m ->> '$.crawl', '') as crawl, m ->> '$.languages' as languages
  from raw where trim(m ->> '$.status') in ('200', '301', '302') and contains(lower(coalesce(m ->> '$.mime', '')), 'text/html')
)
"""
_SIGNALLED = _INDEX + f""", dom as (select *, {discovery(url_host('url'))} as domain from idx
), sig as ({' union all '.join(f"select '{c}' as country, row_id, url, domain, crawl, fetched_at, {proof} as cs, {language} as ls, {_labels('url')} as ps, {_points('url')} as points from dom" for c in signals.COUNTRIES for proof, language in [_country('url', 'domain', c)])})
"""  # fmt: skip


def _fold(name: str, test: str) -> str:
    flat = lambda c: f"list_sort(list_distinct(flatten(list({c}))))"
    return f"""{name} as (
  select country, domain, least(100, sum(case when points > 0 then points else 5 end))::int as score, {flat('cs')} as cs, {flat('ls')} as ls, {flat('ps')} as ps,
    arg_min(url, row_id) as source_url, arg_max(crawl, row_id) filter (where crawl is not null) as crawl_id, max(fetched_at) as seen
  from sig where domain is not null and len(cs) > 0 and {test} group by country, domain)"""


_TAIL = "array_to_string({0}, '|')"
_PRIORITY = ["product", "products", "collection", "category", "shop", "cart", "checkout"]
_PLACE = "least(" + ", ".join(f"case when contains(lower(url), '{p}') then instr(lower(url), '{p}') - 1 else 9999 end" for p in _PRIORITY) + ")"


def _map_lines(m: str) -> str:
    return f"coalesce(array_to_string(list_transform(map_entries({m}), lambda e: lower(e.key || ':' || coalesce(e.value, ''))), chr(10)), '')"


def _map_values(m: str) -> str:
    return f"coalesce(list_transform(map_entries({m}), lambda e: lower(e.key || ':' || coalesce(e.value, ''))), [])"


def _said(part: str, rx: str) -> str:
    if part == "html":
        return f"case when regexp_matches(html, {_q(rx)}) then [regexp_extract(html, {_q('(' + rx + ')')}, 1)] else [] end"
    return f"list_filter({part}, lambda v: regexp_matches(v, {_q(rx)}))"


def _platforms() -> str:
    low = lambda e: f"list_transform({e}, lambda v: lower(v))"
    parts = {"html": "lower(coalesce(html, ''))", "headers": _map_values("headers"), "cookies": _map_values("cookies"), "scripts": low("list_concat(coalesce(script_urls, []), coalesce(stylesheet_urls, []))"), "whatweb": low("coalesce(map_keys(whatweb_plugins), [])")}
    text = "with p as (select bundle_id, coalesce(links, []) as links, " + ", ".join(f"{e} as {n}" for n, e in parts.items()) + " from page_bundles), "
    for i, (_, (_, of)) in enumerate(signals.PLATFORMS.items()):
        text += f"f{i} as (select bundle_id, {', '.join(f'{_said(part, rx)} as s_{part}' for part, (_, rx) in of.items())} from p), "
    text += "rules as (" + " union all ".join(
        f"select bundle_id, {i} as rank, '{name}' as platform, {threshold} as threshold, floor((({' + '.join(f'case when len(s_{part}) > 0 then {w} else 0 end' for part, (w, _) in of.items())}) * 200 + {(total := sum(w for w, _ in of.values()))}) / {2 * total}.0)::int as confidence, "
        f"array_to_string(flatten([{', '.join(f'list_transform(s_{part}, lambda v: {_q(part + chr(58))} || v)' for part in of)}]), '|') as signals from f{i}"
        for i, (name, (threshold, of)) in enumerate(signals.PLATFORMS.items())
    )
    joined = "lower(array_to_string(scripts, chr(10)))"
    shown = "html || chr(10) || lower(array_to_string(links, chr(10)))"
    custom = " + ".join(f"case when contains({shown}, '{w}') then 1 else 0 end" for w in signals.NAVIGATION)
    stack = _hits([(f"regexp_matches(html || chr(10) || {joined}, {_q(rx)})", n) for n, rx in signals.STACK.items()])
    return text + f"""), best as (select *, row_number() over (partition by bundle_id order by confidence desc, rank) as rn from rules where confidence >= threshold),
rest as (select bundle_id, {custom} >= 2 as custom, array_to_string({stack}, '|') as stack from p)
select r.bundle_id, coalesce(b.platform, case when custom then 'custom_ecommerce' end, 'unknown') as platform, coalesce(b.confidence, case when custom then 55 else 0 end) as confidence,
  coalesce(b.signals, case when custom then 'heuristic:ecommerce_navigation' end, '') as signals, r.stack from rest r left join best b on r.bundle_id = b.bundle_id and b.rn = 1"""


def _latest(t: str, key: str, at: str, rid: str) -> str:
    return f"(select * from (select *, row_number() over (partition by {key} order by {at} desc nulls last, {rid} desc) as rn from {t} where {key} is not null) where rn = 1)"


SQL = {
    "r_index_scan": _INDEX + "select crawl, nullif(split_part(languages, ',', 1), '') as language, count(*) as n_rows, sum(length(url))::bigint as n_chars from idx group by 1, 2",
    "r_first_pattern": _INDEX + f"""select coalesce({', '.join(f"case when contains(lower(url), '{p}') then '{p}' end" for p in signals.DEFAULT_PATTERNS)}, '') as pattern,
      coalesce({', '.join(f"case when contains(lower(url), '/{w}') then '/{w}' end" for w in ('p', 'winkel', 'cart'))}) as segment, count(*) as n_rows from idx group by 1, 2""",
    "r_like_patterns": _INDEX + f"select split_part(d, '.', -1) as ending, count(*) as n_rows from (select {discovery(url_host('url'))} as d from idx where lower(url) like '%/shop%' or lower(url) like '%/kategorie/%' or lower(url) like '%size=4_%') where split_part(d, '.', -1) in ('de', 'nl', 'fr', 'ch') group by 1",
    "r_import": _SIGNALLED + ", " + _fold("f", "true") + f" select domain, split_part(domain, '.', -1) as tld, country, score, {_TAIL.format('cs')} as country_signals, {_TAIL.format('ls')} as language_signals, {_TAIL.format('ps')} as matched_patterns, source_url, crawl_id, {_DAY.format('seen')} as last_seen_at from f",
    "r_import_counts": _SIGNALLED + "select crawl, country, count(*) as n_read, count(*) filter (domain is null) as n_invalid, count(*) filter (domain is not null and len(cs) > 0) as n_accepted, count(*) filter (domain is not null and len(cs) = 0) as n_skipped, count(*) filter (domain is not null and len(cs) = 0 and len(ls) > 0) as n_language_only from sig group by 1, 2",
    "r_merge": _SIGNALLED + ", " + _fold("o", "coalesce(crawl < (select max(crawl) from idx), true)") + ", " + _fold("n", "crawl = (select max(crawl) from idx)") + f"""
      select coalesce(o.country, n.country) as country, coalesce(o.domain, n.domain) as domain, greatest(o.score, n.score) as score, {_TAIL.format('list_sort(list_distinct(list_concat(coalesce(o.ps, []), coalesce(n.ps, []))))')} as matched_patterns,
        {_TAIL.format('case when n.domain is null then o.cs else n.cs end')} as country_signals, coalesce(o.source_url, n.source_url) as source_url, case when n.domain is null then o.crawl_id else n.crawl_id end as crawl_id,
        {_DAY.format('case when n.domain is null then o.seen else n.seen end')} as last_seen_at, case when n.domain is null then 'kept' when o.domain is null then 'inserted' else 'updated' end as merge_state
      from o full join n on o.domain = n.domain and o.country = n.country""",
    "r_domain_forms": rf"""with d as (select candidate_id, {discovery('domain')} as discovery, regexp_replace(split_part({_bare('domain')}, '/', 1), '\.+$', '') as ingest, regexp_replace({_bare('domain')}, '/+$', '') as fingerprint, nullif(split_part({_bare('domain')}, '/', 1), '') as promote, regexp_replace(lower({_strip('domain')}), '^www\.', '') as plain from discovered_candidates)
      select *, case when contains(discovery, '.') then split_part(discovery, '.', -2) else discovery end as second_label, split_part(discovery, '.', -1) as top_label, case when regexp_matches(ingest, '^https?://') then ingest else 'https://' || ingest end as homepage from d""",
    "r_suffix_matches": f"""with h as (select distinct {discovery('domain')} as host from common_crawl_domains), n as (select distinct {discovery('normalized_domain')} as name from domains)
      select host, arg_max(name, length(name)) as listed from h join n on host = name or ends_with(host, '.' || name) group by host""",
    "r_word_hosts": "select nullif(regexp_extract(lower(domain), '(outlet|boutique|winkel|laden|markt|haus)', 1), '') as word, count(*) as n_rows from common_crawl_domains group by 1",
    "r_new_domains": f"select id, domain, ecommerce_score, {_DAY.format('last_seen_at')} as last_seen_at from common_crawl_domains c where lower(country) = 'de' and ecommerce_score >= 0.3 and not exists (select 1 from domains d where d.domain = c.domain) order by ecommerce_score desc, c.last_seen_at desc nulls last, id desc limit 200",
    "r_index_counts": "select lower(country) as country, count(*) as n_rows, count(*) filter (ecommerce_score >= 0.3) as n_good, count(*) filter (ecommerce_score >= 0.3 and not exists (select 1 from domains d where d.domain = c.domain)) as n_new from common_crawl_domains c group by 1",
    "r_first_wins": f"""with s as (select candidate_id, source_type, {discovery('domain')} as host from discovered_candidates order by candidate_id limit 1500)
      select host, candidate_id, source_type from (select *, row_number() over (partition by host order by candidate_id) as rn from s where host is not null) where rn = 1 and not regexp_matches(host, '[0-9]{{3,}}') order by candidate_id limit 300""",
    "r_latest_fingerprint": f"select domain_id, id as fingerprint_id, platform, confidence::double as confidence from {_latest('domain_fingerprints', 'domain_id', 'detected_at', 'id')}",
    "r_domain_overview": f"""select d.id, d.normalized_domain, f.platform as latest_platform, s.status as latest_status, coalesce(n.n, 0) as n_sources from domains d
      left join {_latest('domain_fingerprints', 'domain_id', 'detected_at', 'id')} f on f.domain_id = d.id left join {_latest('domain_status_snapshots', 'domain_id', 'snapshot_at', 'snapshot_id')} s on s.domain_id = d.id
      left join (select domain_id, count(*) as n from domain_sources group by 1) n on n.domain_id = d.id""",
    "r_domain_page": " union all ".join(f"(select '{n}' as page, id, normalized_domain, platform, confidence::double as confidence from domains where {w} and id in (select domain_id from domain_sources where source_type = 'common_crawl') order by updated_at desc nulls last, id desc limit 25 offset {o})" for n, w, o in (("a", "upper(country) = 'DE' and confidence >= 20 and contains(lower(normalized_domain), 'r')", 25), ("b", "status = 'pending' and business_model = 'b2c' and confidence <= 95", 0), ("c", "platform = 'shopify' and niche = 'toys'", 0))),
    "r_dashboard": "select count(*) as n_domains, count(*) filter (confidence >= 70) as n_sure, count(*) filter (business_model = 'b2b') as n_b2b, count(*) filter (visited_at is null) as n_new, round(coalesce(sum(confidence) / count(confidence), 0), 2)::double as mean_confidence from domains",
    "r_platform_counts": "select platform, count(*) as n_domains from domains where platform is not null group by 1 order by 2 desc, 1 limit 4",
    "r_filter_values": " union ".join(f"select '{c}' as name, {c} as value from domains where {c} is not null" for c in ("platform", "niche", "business_model", "status")),
    "r_source_counts": f"select source_type, source_name, count(*) as n_rows, {_DAY.format('max(discovered_at)')} as last_found from domain_sources group by 1, 2",
    "r_store_search": "with m as (select id, normalized_domain, (case when json_valid(metadata) then metadata end) ->> '$.store_name' as store_name from domains) select id, store_name from m where contains(lower(normalized_domain), 'zu') or contains(lower(store_name), 'zu')",
    "r_all_hosts": f"""with h as (select {discovery('normalized_domain')} as host, 1 as t from domains union all select {discovery('domain')}, 2 from discovered_candidates union all select {discovery('domain')}, 3 from common_crawl_domains)
      select host, max((t = 1)::int) as in_domains, max((t = 2)::int) as in_discovered_candidates, max((t = 3)::int) as in_common_crawl_domains from h where host is not null group by 1""",
    "r_seen_span": f"""with h as (select {discovery('normalized_domain')} as host, first_seen_at as a, last_seen_at as b from domains union all select normalized_domain, fetched_at, fetched_at from crawl_candidates)
      select host, {_DAY.format('min(a)')} as first_seen, {_DAY.format('max(b)')} as last_seen from h where host is not null group by 1""",
    "r_seed_queries": "with s as (select distinct trim(keyword_seed) as seed from discovered_candidates where trim(keyword_seed) <> '') select distinct trim(concat_ws(' ', seed, nullif(c, ''), t)) as query from s, (values ('de'), ('nl'), ('')) as x(c), (values ('shop'), ('online kaufen')) as y(t)",
    "r_score_bands": f"with s as (select coalesce(source_url, '') as u from common_crawl_domains) select {_points('u')} as points, {_TAIL.format(_labels('u'))} as labels, count(*) as n_rows from s group by 1, 2",
    "r_json_lists": "with a as (select case when json_valid(matched_patterns) then json_extract_string(matched_patterns, '$[*]') end as l from common_crawl_domains), e as (select unnest(l) as member, generate_subscripts(l, 1) as i from a) select member, count(*) as n_rows, count(*) filter (i = 1) as n_first from e group by 1",
    "r_event_windows": f"select {_DAY.format('date_trunc(' + _q('day') + ', loaded_at)')} as window_start, matched_pattern as key, count(*) as n from crawl_candidates where loaded_at is not null group by 1, 2",
    "r_platforms": _platforms(),
    "r_flat_maps": rf"""select bundle_id, md5({_map_lines('headers')}) as headers, length({_map_lines('cookies')}) as cookie_chars,
      len(list_filter(coalesce(links, []), lambda x: regexp_replace(lower(regexp_extract(x, '(?i)^https?://([^/?#]*)', 1)), '^www\.', '') = regexp_replace(lower(regexp_extract(coalesce(whatweb_target_url, chr(0)), '(?i)^https?://([^/?#]*)', 1)), '^www\.', '') and whatweb_target_url is not null))::int as n_own from page_bundles""",
    "r_page_sample": f"""with b as (select bundle_id, whatweb_target_url as home, list_concat([whatweb_target_url], coalesce(links, [])) as l from page_bundles), e as (select bundle_id, home, unnest(l) as url, generate_subscripts(l, 1) as i from b),
      d as (select bundle_id, home, url, min(i) as i from e where url is not null group by 1, 2, 3), r as (select *, row_number() over (partition by bundle_id order by case when url = home then 0 else 1 end, {_PLACE}, length(url), i) as rank from d) select bundle_id, rank::int as rank, url from r where rank <= 3""",
    "r_page_counts": "with t as (select lower(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')) as t from page_bundles), n as (select t, coalesce("
    + ", ".join(f"case when try_cast(regexp_extract(t, {_q(rx)}, 1) as int) > 0 then try_cast(regexp_extract(t, {_q(rx)}, 1) as int) end" for rx in signals.TOTALS)
    + r""") as n from t) select case when n is null then null when n <= 50 then '1-50' when n <= 200 then '51-200' when n <= 1000 then '201-1000' else '1000+' end as bucket, list_max(list_transform(regexp_extract_all(t, '\bpage\s*(\d{1,4})\b', 1), lambda x: try_cast(x as int))) as last_page, count(*) as n_pages from n group by 1, 2""",
    "r_page_links": rf"""with a as (select bundle_id, whatweb_target_url as site, unnest(regexp_extract_all(html, '<a\b[^>]*?\bhref="([^"]+)"', 1)) as ref from page_bundles where whatweb_target_url is not null),
      u as (select bundle_id, site, case when regexp_matches(ref, '^https?://') then ref else regexp_extract(site, '^(https?://[^/?#]*)', 1) || ref end as url from a where not regexp_matches(lower(ref), '^(#|mailto:|tel:|javascript:)'))
      select distinct bundle_id, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^[^?#]*(\?[^#]+)', 1) as url from u where {_site('url')} = {_site('site')}""",
    "r_outer_domains": rf"""with e as (select candidate_id, {discovery(url_host('source_url'))} as own, {discovery(url_host("'https://' || regexp_replace(regexp_replace(domain, '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+$', ''), '[" + chr(9) + chr(10) + chr(13) + "]', '', 'g')"))} as d, contains(lower(coalesce(keyword_seed, '') || ' https://' || domain), 'online') as named from discovered_candidates where domain is not null)
      select d as domain, count(distinct candidate_id) as n_pages, sum(named::int) as n_named from e where d is not null and d not in ('facebook.com', 'google.com', 'instagram.com', 'linkedin.com', 'pinterest.com', 'twitter.com', 'youtube.com') and (own is null or d <> own) group by 1""",
    "r_page_assets": r"""with a as (select bundle_id, regexp_extract(coalesce(whatweb_target_url, ''), '^(https?://[^/?#]*)', 1) as site, regexp_extract_all(coalesce(html, ''), '<script\b[^>]*?\bsrc="([^"]+)"', 1) as s, regexp_extract_all(coalesce(html, ''), '<link\b[^>]*?\brel="stylesheet"') as c, list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '<meta\b[^>]*?\b(?:name|property)="([^"]+)"', 1), lambda x: lower(x))) as m from page_bundles)
      select bundle_id, array_to_string(list_transform(s, lambda x: case when regexp_matches(x, '^https?://') then x else site || x end), '|') as scripts, len(c)::int as n_stylesheets, len(m)::int as n_meta from a""",
    "r_page_text": f"select bundle_id, length(t) as n_chars, md5(t) as digest, contains(t, 'cart')::int + contains(t, 'shop')::int + contains(t, 'checkout')::int as n_words from (select bundle_id, {page_text('html')} as t from page_bundles)",
}
