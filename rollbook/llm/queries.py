"""Queries of this subpackage, and the SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.llm import addresses, entities, languages, linkage, mixing, residue, survivors, tokenizing
from rollbook.work import cut, load


def _mix(spark, sf_dir):
    targets = load(spark, sf_dir, "mix_targets")
    sizes = cut(mixing.document_sizes(load(spark, sf_dir, "documents"), targets), "p9-sizes")
    return mixing.mix(sizes, targets), targets, sizes


def _linked(spark, sf_dir):
    return linkage.linked(load(spark, sf_dir, "members"), None, load(spark, sf_dir, "registry_members"))


def _segments(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return languages.classify(docs, languages.train(docs))


def _businesses(spark, sf_dir, smallest=True):
    members = load(spark, sf_dir, "members")
    rows = entities.member_features(members.withColumn("s", F.xxhash64("company_name")), ["s"])
    return members, cut(entities.businesses(members, rows, smallest), "businesses")


QUERIES = {
    "p1_found": lambda s, d: survivors.judged(load(s, d, "members"), load(s, d, "directories")),
    "p1_fused": lambda s, d: survivors.survivors(load(s, d, "members"), None, load(s, d, "directories")),
    "p1_sources": lambda s, d: survivors.sources(load(s, d, "members"), None, load(s, d, "directories")),
    "p2_found": lambda s, d: _linked(s, d).select("member_id", "npi"),
    "p2_matches": _linked,
    "p3_found": lambda s, d: entities.variants(*_businesses(s, d, False)),
    "p1_businesses": lambda s, d: _businesses(s, d)[1].select("member_id", "business"),
    "p5_found": lambda s, d: residue.find_residue(load(s, d, "members")),
    "p7_found": lambda s, d: addresses.same_location(load(s, d, "members")),
    "p8_ids": lambda s, d: tokenizing.encode(load(s, d, "documents")),
    "p8_texts": lambda s, d: tokenizing.decode(tokenizing.encode(load(s, d, "documents"))),
    "p9_mix": lambda s, d: _mix(s, d)[0],
    "p10_found": lambda s, d: languages.found(languages.by_document(_segments(s, d))),
    "p10_segments": lambda s, d: _segments(s, d),
    "p10_documents": lambda s, d: languages.by_document(_segments(s, d)),
    "p9_shares": lambda s, d: mixing.shares(*_mix(s, d)),
}
SQL: dict[str, str] = {
    "p8_texts": "select doc_id, coalesce(text, '') as text from documents",
}
