"""From raw documents to packed token sequences, in five stages of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame: the columns of ``docs`` for all but the
last, which returns the pieces of its packed sequences. No SQL expresses the stages; ``tests/llm`` holds
them against plain versions on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import line_dedup, near_copies, packing, quality_rules, secret_scan
from quillspark.llm.common import materialise
from quillspark.llm.queries import tokenizer_path

#: Workers stay between stages, beside an executor's full heap: they keep fewer words than for packing alone.
CACHE_WORDS = 150_000


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the list learned from ``labels`` keep."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that equal or nearly equal an earlier one."""
    return line_dedup.dedup_lines(docs)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are 0.8 similar: SimHash keys, then the exact rest."""
    return near_copies.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"), CACHE_WORDS)


STAGES = [
    ("quality_rules", reject_low_quality),
    ("line_dedup", remove_repeated_lines),
    ("simhash", keep_one_of_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
