"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cropledger.llm import ann, conv_repair, decontaminate, html_main, line_dedup, mixture, ngram_join, pii, prefix_trie, sharding, substring_dedup, suffix_dedup, toxicity
from cropledger.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op2_jaccard(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op3_line_dedup(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op4_suffix_dedup(table(spark, sf_dir, "documents"))


def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.op5_html_main(table(spark, sf_dir, "pages"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6_pseudonyms(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op7_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.op8_mixture(table(spark, sf_dir, "documents"))


def op8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.op8_copies(table(spark, sf_dir, "documents"))


def op8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.op8_shares(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op9_sharding(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op10_nearest(table(spark, sf_dir, "embeddings"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_repair.op11_repair(table(spark, sf_dir, "conversations"))


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op12_passages(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op13_prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_jaccard, op3_line_dedup, op4_suffix_dedup, op5_html_main, op6_pseudonyms, op7_decontaminate, op8_mixture,
              op8_copies, op8_shares, op9_sharding, op10_nearest, op11_repair, op12_passages,
              op13_prefix_trie)
}
ORACLES: dict[str, str] = {"op2_jaccard": ngram_join.OP2_SQL, "op3_line_dedup": line_dedup.OP3_SQL, "op7_decontaminate": decontaminate.OP7_SQL,
                           "op8_mixture": mixture.OP8_SQL, "op11_repair": conv_repair.OP11_SQL, "op12_passages": substring_dedup.OP12_SQL,
                           "op13_prefix_trie": prefix_trie.OP13_SQL}
