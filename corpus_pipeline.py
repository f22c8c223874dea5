"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Every stage takes all rows that its predecessor kept. The first three filter: toxic documents go, one document of
each group of near-duplicates stays, documents that hold a benchmark item go. Mixing repeats or drops documents to
meet the sources' targets; token output writes the shards and describes the documents read back from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, mixing, near_dup, token_output, toxicity
from lodestone.llm._common import read_table, stored
from lodestone.llm.queries import public_tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the pattern grammar, fitted on ``labels``, scores as toxic."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return near_dup.one_of_each_group(docs, shingle=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item within its edit budget."""
    return decontamination.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the sources' targets ask."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token shards and describe their documents: doc_id, start, n_tokens, ids_crc32."""
    return token_output.token_output(docs, public_tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``; what each keeps is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
