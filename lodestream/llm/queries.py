"""Queries of the training-data problems, over whole tables. Their SQL is in ``sql``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.writing import trimmed_lower
from lodestream.llm import format_dups, history_dups, mixing, mojibake, survivor, templates, tokenize
from lodestream.llm.forms import canonical_host, canonical_url
from lodestream.llm.sql import SQL  # noqa: F401
from lodestream.operators.keyed import small_or_shuffled
from lodestream.session import materialize
from lodestream.sources.tables import table

_CONTEXT = ["keyword_seed", "source_url", "discovery_job_type", "matched_pattern", "tld"]
_METADATA = ["store_name", "homepage_url", "contact_url", "product_count_guess", "frontend_stack"]


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the three tables that name the same things in different writings."""
    domains, found, crawl = (table(spark, folder, t) for t in ("domains", "discovered_candidates", "crawl_candidates"))
    return (
        format_dups.keyed(domains, "id", canonical_host(F.col("normalized_domain")), "domains")
        .unionByName(format_dups.keyed(found, "candidate_id", canonical_host(F.col("domain")), "discovered_candidates"))
        .unionByName(format_dups.keyed(crawl, "row_id", canonical_url(F.col("candidate_url")), "crawl_candidates"))
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that repeats an earlier one but for formatting."""
    of = format_dups.groups(_written(spark, folder))
    return of.where("id <> first_id").select(F.col("tag").alias("tbl"), "first_id", F.col("id").alias("copy_id"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One record for each thing, with the number of its copies."""
    of = format_dups.groups(_written(spark, folder))
    return of.where("id = first_id").select(F.col("tag").alias("tbl"), "first_id", "copies")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each crawl whose host is in domains or an earlier crawl, exactly or nearly.

    Domains are accepted first, then the crawls are admitted to the same persistent chunk table.
    """
    ccd, domains = table(spark, folder, "common_crawl_domains"), table(spark, folder, "domains")
    # One row for each batch, so they are few enough to be numbered in one task.
    names = ccd.select("crawl_id").where("crawl_id is not null").distinct()
    eras = small_or_shuffled(names.select("crawl_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("crawl_id")).alias("era")))
    new = ccd.select("id", canonical_host(F.col("domain")).alias("host"), "crawl_id").join(eras, "crawl_id", "left").select("id", "host", "era")
    old = domains.select("id", canonical_host(F.col("normalized_domain")).alias("host"), F.lit(0).alias("era"))
    store = history_dups.ChunkStore(spark, f"accepted_{uuid.uuid4().hex}", history_dups.parts_for(spark, new.select("host").unionByName(old.select("host"))))
    store.admit(old, F.col("host"), F.col("era"), "id")
    found = materialize(store.admit(new, F.col("host"), F.col("era"), "id"), "repeats")
    store.drop()
    return found.withColumnRenamed("row_id", "ccd_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The record that gives each field of each group's survivor."""
    trust = small_or_shuffled(table(spark, folder, "source_trust").select(trimmed_lower(F.col("source_type")).alias("trusted"), "trust_rank"))
    sources = table(spark, folder, "domain_sources").select("id", "domain_id", "source_type", "source_reference", "discovered_at", "context")
    ranked = sources.join(trust, trimmed_lower(sources["source_type"]) == trust["trusted"], "left")
    has = {"source_type": F.col("source_type").isNotNull()} | survivor.json_fields(F.col("context"), _CONTEXT)
    key = F.when(F.col("domain_id").isNotNull() & F.col("source_reference").isNotNull(), F.struct("domain_id", "source_reference"))
    a = survivor.fill_sources(survivor.skyline(ranked, key, F.col("id"), has, F.col("trust_rank"), F.col("discovered_at")), list(has))

    domains = table(spark, folder, "domains")
    has = survivor.json_fields(F.col("metadata"), _METADATA)
    b = survivor.fill_sources(survivor.skyline(domains, canonical_host(F.col("normalized_domain")), F.col("id"), has, F.lit(None), F.col("updated_at")), list(has))
    return a.select(F.lit("domain_sources").alias("tbl"), "*").unionByName(b.select(F.lit("domains").alias("tbl"), "*"))


def _residue(spark: SparkSession, folder: str) -> DataFrame:
    return templates.residue(table(spark, folder, "page_bundles"), "bundle_id", ["html", "whatweb_error", "disqualifiers"], "domain_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records and fields that hold template residue, filler, error pages or script notices."""
    return _residue(spark, folder).select(F.col("rec").alias("bundle_id"), F.col("field").alias("field_name"))


def p6_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many fields hold what kind of residue."""
    return _residue(spark, folder).select("field", F.explode("reasons").alias("reason")).groupBy("field", "reason").count()


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document's text."""
    return tokenize.encode(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("row_id", "doc_id")


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document's ids decode to its text again."""
    documents = table(spark, folder, "documents")
    back = tokenize.decode_all(tokenize.encode(documents, "doc_id", "text"), "row_id", "ids")
    whole = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("before"))
    joined = whole.select("doc_id", F.md5("before").alias("a")).join(back.select(F.col("row_id").alias("doc_id"), F.md5("text").alias("b")), "doc_id")
    return joined.select("doc_id", (F.col("a") == F.col("b")).alias("same"))


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """How many ids cover each document's text, and the characters at which the first begins and the last ends."""
    found = tokenize.spans(table(spark, folder, "documents"), "doc_id", "text")
    return found.select(F.col("row_id").alias("doc_id"), (F.size("ids") > 0).alias("has_ids"), F.coalesce(F.array_min("begins"), F.lit(0)).alias("first_begin"), F.coalesce(F.array_max("ends"), F.lit(0)).alias("last_end"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mix_targets")
    return mixing.mix(mixing.sized(table(spark, folder, "documents"), "doc_id", "source", "text"), targets), targets


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix, with how often each stands in it."""
    return _mixed(spark, folder)[0].withColumnRenamed("row_id", "doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's target and actual share of all tokens of the mix."""
    return mixing.shares(*_mixed(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents whose text was decoded with a wrong encoding."""
    return mojibake.restored(table(spark, folder, "documents"), "doc_id", "text").select(F.col("row_id").alias("doc_id"))


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The affected documents with all of their text that can be restored."""
    return mojibake.restored(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("row_id", "doc_id")


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p6_reasons": p6_reasons, "p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip, "p7_spans": p7_spans, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_restored": p9_restored}
