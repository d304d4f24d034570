"""Registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (hard_negatives, html_template, importance_resampling, mixing, packing, pii, quality_rules,
               sharding, simhash, token_counts, token_files, tokenization_automaton, voronoi_knn)
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]

EVERY_QUERY = 20


def op1_token_counts(spark, d):
    return token_counts.section_token_counts(read_table(spark, d, "documents"))


def op2_best_fit_packing(spark, d):
    return packing.pack_documents(read_table(spark, d, "documents"))


def op3_token_files(spark, d):
    return token_files.token_round_trip(read_table(spark, d, "documents"))


def op4_html_extraction(spark, d):
    return html_template.extract_main_text(read_table(spark, d, "pages"))


def op5_exact_top_k(spark, d):
    return voronoi_knn.top_k_inner_product(read_table(spark, d, "embeddings"),
                                           query=f"vec_id % {EVERY_QUERY} = 0")


def op6_quality_rules(spark, d):
    verdicts = quality_rules.quality_verdicts(read_table(spark, d, "documents"))
    return verdicts.withColumn("failed_rules", F.array_join("failed_rules", ","))


def op7_pii(spark, d):
    return pii.personal_data(read_table(spark, d, "documents"))


def op8_mixing(spark, d):
    plan = mixing.mixture_plan(read_table(spark, d, "documents"))
    return plan.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).alias("taken"))


def op9_sharding(spark, d):
    return sharding.shard_documents(read_table(spark, d, "documents"))


def op10_simhash_dedup(spark, d):
    return simhash.simhash_components(read_table(spark, d, "documents"))


def op11_hard_negatives(spark, d):
    moved = "if(vec_id % 7 = 0, (label + 1) % 10, label)"
    return hard_negatives.mine_hard_negatives(read_table(spark, d, "embeddings"), label=moved,
                                              anchor=f"vec_id % {hard_negatives.ANCHOR_EVERY} = 0")


def op12_importance_resampling(spark, d):
    return importance_resampling.resample(read_table(spark, d, "documents"),
                                          read_table(spark, d, "benchmark"))


def op13_tokenization_automaton(spark, d):
    return tokenization_automaton.round_trip_digest(read_table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_files": op3_token_files,
    "op4_html_extraction": op4_html_extraction,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_tokenization_automaton": op13_tokenization_automaton,
}
