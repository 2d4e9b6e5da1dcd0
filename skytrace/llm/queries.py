"""The registered queries of this subpackage: name, call and oracle SQL (None where SQL can't say it)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from skytrace.llm import (
    additive,
    lexical,
    merkle,
    mixing,
    near_dedup,
    neighbours,
    packing,
    page_text,
    personal_data,
    pieces,
    quality_rules,
    toxicity,
    weighted_sampling,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def tokenizer_file(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), ["doc_id"])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.with_edits(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_near_dedup": (op1_near_dedup, None),
    "op2_page_text": (op2_page_text, None),
    "op3_neighbours": (op3_neighbours, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_quality_rules": (op5_quality_rules, quality_rules.OP5_SQL),
    "op6_pieces": (op6_pieces, None),
    "op7_quality": (op7_quality, None),
    "op8_packing": (op8_packing, None),
    "op9_personal_data": (op9_personal_data, personal_data.OP9_SQL),
    "op10_mixing": (op10_mixing, mixing.OP10_SQL),
    "op11_fingerprints": (op11_fingerprints, None),
    "op12_manifest": (op12_manifest, merkle.OP12_SQL),
    "op13_search": (op13_search, lexical.OP13_SQL),
}
