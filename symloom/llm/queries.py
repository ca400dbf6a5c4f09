"""The registered queries of this subpackage: each applies its operator to the whole table."""

from __future__ import annotations

from symloom.llm import base_queries, context_tree, exact_dedup, license_scan, mixing, packing, pii, quality_model, quality_rules, simhash, toxicity
from symloom.llm.common import table


def op1_toxicity(spark, sf_dir):
    return toxicity.decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark, sf_dir):
    return license_scan.decisions(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op4_simhash_neardup(spark, sf_dir):
    return simhash.decisions(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark, sf_dir):
    return quality_model.decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark, sf_dir):
    return quality_rules.decisions(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark, sf_dir):
    return context_tree.decisions(table(spark, sf_dir, "documents"))


def op8_pii(spark, sf_dir):
    return pii.decisions(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark, sf_dir):
    return mixing.decisions(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")} | base_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality_rules.SQL, "op10_exact_dedup": exact_dedup.SQL} | base_queries.ORACLE
