"""Queries of the general training-data problems, over whole tables, and their SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.writing import trimmed_lower
from lodestream.operators.balanced import heavy_keys, key_states
from lodestream.operators.history import Dimension, merge_history, observations
from lodestream.session import materialize
from lodestream.sources.tables import table


#: Batches in which the logs are merged, in order of loading (ids number it).
BATCHES = 3


def _merged(df: DataFrame, value: str, at: str, row_id: str) -> DataFrame:
    """The versions after merging a log batch by batch, in the order in which it was loaded."""
    first, last = df.agg(F.min(row_id), F.max(row_id)).first()
    step = ((last or 0) - (first or 0)) // BATCHES + 1
    dimension, rid = Dimension(), F.col(row_id)
    for i in range(BATCHES):
        begin = (first or 0) + i * step
        batch = (rid >= begin) & (rid < begin + step)  # as a range, so that it reaches the scan
        dimension = merge_history(dimension, observations(df.where(batch if i else batch | rid.isNull()), "domain_id", trimmed_lower(F.col(value)), at, row_id))
    return dimension.versions()


def _histories(spark: SparkSession, folder: str) -> DataFrame:
    logs = (("status", "domain_status_snapshots", "snapshot_at", "snapshot_id"), ("platform", "domain_fingerprints", "detected_at", "id"))
    with ThreadPoolExecutor(len(logs)) as pool:  # the two logs don't depend on each other, so their jobs share the cluster
        done = list(pool.map(lambda log: _merged(table(spark, folder, log[1]), log[0], *log[2:]), logs))
    both = (h.withColumn("attribute", F.lit(log[0])) for h, log in zip(done, logs, strict=True))
    first, second = (h.withColumnsRenamed({"entity": "domain_id", "value": "attr_value"}) for h in both)
    return first.unionByName(second)


def _second(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every version of each domain's status and platform."""
    return _histories(spark, folder).select("attribute", "domain_id", "attr_value", _second("valid_from"))


def p1_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Every version with the end of its period; open versions have none."""
    return _histories(spark, folder).select("attribute", "domain_id", "attr_value", _second("valid_from"), _second("valid_to"), "is_current")


def _key_tables(spark: SparkSession, folder: str):
    crawl, ccd = table(spark, folder, "crawl_candidates"), table(spark, folder, "common_crawl_domains")
    yield "normalized_domain", crawl, trimmed_lower(F.col("normalized_domain")), F.col("fetched_at"), F.col("row_id")
    yield "country", ccd, trimmed_lower(F.col("country")), F.col("last_seen_at"), F.col("id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values with at least a fiftieth of all rows of their table."""
    out = []
    for name, df, key, at, rid in _key_tables(spark, folder):
        states = materialize(key_states(df, key, at, rid), "keys")
        # All rows are those of the states and the ones without a key; only the latter are counted anew, from the key alone.
        total = (states.agg(F.sum("n_rows")).first()[0] or 0) + df.where(key.isNull()).count()
        out.append(heavy_keys(states, total, 0.02).select(F.lit(name).alias("field_name"), F.col("key").alias("key_value")))
    return out[0].unionByName(out[1])


def p4_key_states(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, first and last time and longest pause of every key."""
    out = [key_states(df, key, at, rid).select(F.lit(name).alias("field_name"), F.col("key").alias("key_value"), "n_rows", _second("first_at"), _second("last_at"), F.col("longest_pause_s").cast("bigint").alias("longest_pause_s")) for name, df, key, at, rid in _key_tables(spark, folder)]
    return out[0].unionByName(out[1])


_CLEAN = r"lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_VERSIONS = rf"""
with seen as (
  select 'status' as attribute, domain_id, {_CLEAN.format('status')} as v, snapshot_at as t, snapshot_id as i from domain_status_snapshots
  union all
  select 'platform', domain_id, {_CLEAN.format('platform')}, detected_at, id from domain_fingerprints
), one as (
  select *, row_number() over (partition by attribute, domain_id, t order by i desc) as rn from seen
  where domain_id is not null and v is not null and t is not null
), marked as (
  select *, lag(v) over (partition by attribute, domain_id order by t) as before from one where rn = 1
), versions as (
  select attribute, domain_id, v, t, lead(t) over (partition by attribute, domain_id order by t) as t_to
  from marked where before is null or before <> v
)
"""
_KEYS = rf"""
with k as (
  select 'normalized_domain' as field_name, {_CLEAN.format('normalized_domain')} as key_value, fetched_at as t from crawl_candidates
  union all
  select 'country', {_CLEAN.format('country')}, last_seen_at from common_crawl_domains
)
"""

QUERIES = {"p1_found": p1_found, "p1_periods": p1_periods, "p4_found": p4_found, "p4_key_states": p4_key_states}
SQL = {
    "p1_found": _VERSIONS + "select attribute, domain_id, v as attr_value, strftime(t, '%Y-%m-%d %H:%M:%S') as valid_from from versions",
    "p1_periods": _VERSIONS + "select attribute, domain_id, v as attr_value, strftime(t, '%Y-%m-%d %H:%M:%S') as valid_from, strftime(t_to, '%Y-%m-%d %H:%M:%S') as valid_to, t_to is null as is_current from versions",
    "p4_found": _KEYS + "select field_name, key_value from k join (select field_name, count(*) as total from k group by 1) using (field_name) where key_value is not null group by field_name, key_value, total having count(*) * 50 >= total",
    "p4_key_states": _KEYS + """
, g as (select *, epoch_us(t) - lag(epoch_us(t)) over (partition by field_name, key_value order by t) as pause from k where key_value is not null)
select field_name, key_value, count(*) as n_rows, strftime(min(t), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(t), '%Y-%m-%d %H:%M:%S') as last_at, cast(floor(max(pause) / 1e6) as bigint) as longest_pause_s
from g group by 1, 2""",
}
