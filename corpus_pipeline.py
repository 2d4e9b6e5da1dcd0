"""The corpus pipeline: each stage applies one operator of ``skytrace.llm`` to what the one before kept.

Rules reject poor documents, one document of each near-duplicate class stays, personal data is
redacted, sources are mixed to their target weights (documents repeat or go), and texts are encoded.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from skytrace.llm import mixing, near_dedup, personal_data, pieces, quality_rules
from skytrace.llm.queries import table, tokenizer_file
from skytrace.session import scratch_path


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs, table(spark, sf_dir, "labels"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, width=5, percent=80)


def _personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.redacted(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = [c for c in docs.columns if c not in ("text", "ids", "n_ids")]
    return pieces.encoded(docs, tokenizer_file("piece_bpe_32k.model"), keep)


STAGES = [
    ("quality rules", _rules),
    ("near-dedup", _near_dedup),
    ("personal data", _personal),
    ("mixing", _mix),
    ("encoding", _encode),
]

#: Near-duplicate classes are a transitive closure over set similarity, too slow as SQL on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = os.path.join(scratch_path(spark, "stage"), name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
