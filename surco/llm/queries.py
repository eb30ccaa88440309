"""The registered queries of this folder: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from surco.llm import bpe, conversations, lookup_sketch, merkle, mixing, packing, quality_rules, ranking, sharding, simhash, suffixes, token_files, toxicity
from surco.llm.common import table
from surco.session import ship

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "conversations")


QUERIES = {
    "op1_simhash_dedup": lambda spark, sf_dir: simhash.near_duplicates(_documents(spark, sf_dir)),
    "op2_quality_rules": lambda spark, sf_dir: quality_rules.judge(_documents(spark, sf_dir)),
    "op3_best_fit_packing": lambda spark, sf_dir: packing.pack(_documents(spark, sf_dir), VOCABULARY),
    "op4_lookup_fingerprints": lambda spark, sf_dir: lookup_sketch.fingerprints(_documents(spark, sf_dir)),
    "op5_source_mixing": lambda spark, sf_dir: mixing.mix(_documents(spark, sf_dir)),
    "op6_quality_ranking": lambda spark, sf_dir: ranking.score(_documents(spark, sf_dir), table(spark, sf_dir, "labels")),
    "op7_suffix_dedup": lambda spark, sf_dir: suffixes.removed(_documents(spark, sf_dir)),
    "op8_lpt_sharding": lambda spark, sf_dir: sharding.shard(_documents(spark, sf_dir)),
    "op9_token_files": lambda spark, sf_dir: token_files.round_trip(_documents(spark, sf_dir), VOCABULARY),
    "op10_toxicity": lambda spark, sf_dir: toxicity.score(_documents(spark, sf_dir), table(spark, sf_dir, "labels")),
    "op11_merkle_manifest": lambda spark, sf_dir: merkle.audit(_documents(spark, sf_dir)),
    "op12_conversation_repair": lambda spark, sf_dir: conversations.damaged_and_repaired(_conversations(spark, sf_dir)),
    "op13_byte_bpe": lambda spark, sf_dir: bpe.round_trip(_documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN),
}

ORACLES = {"op2_quality_rules": quality_rules.oracle(), "op11_merkle_manifest": merkle.oracle()}
