"""The registered queries: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.bpe import digests, encode, read_ranks
from plumbline.llm.collocations import collocations
from plumbline.llm.common import documents
from plumbline.llm.imatch import fingerprints
from plumbline.llm.jaccard import jaccard_join
from plumbline.llm.langid import detect_language
from plumbline.llm.lexical import lexical_search
from plumbline.llm.mixing import mix_sources
from plumbline.llm.passages import drop_repeated_passages
from plumbline.llm.pii import find_pii
from plumbline.llm.ranking import rank_quality
from plumbline.llm.repetition import repetition_rules
from plumbline.llm.sharding import shard_rows
from plumbline.llm.toxicity import toxicity

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


def op2_detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_language(documents(spark, sf_dir))


def op3_drop_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(documents(spark, sf_dir))


def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(documents(spark, sf_dir))


def op5_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_other")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "mix.domain", "mix.language", "mix.origin", "mix.epoch", "mix.n_tokens")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_rank_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path(VOCABULARY))
    return digests(encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op12_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_detect_language": op2_detect_language,
    "op3_drop_repeated_passages": op3_drop_repeated_passages,
    "op4_repetition_rules": op4_repetition_rules,
    "op5_find_pii": op5_find_pii,
    "op6_mix_sources": op6_mix_sources,
    "op7_toxicity": op7_toxicity,
    "op8_rank_quality": op8_rank_quality,
    "op9_fingerprints": op9_fingerprints,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_shard_ring": op12_shard_ring,
    "op13_lexical_search": op13_lexical_search,
}
