"""A corpus pipeline: toxicity, line deduplication, near-duplicates, benchmark decontamination, tokens.

Each stage works on all that the one before kept, which is written as Parquet and read again. Toxic documents go;
duplicate lines are cut out, and documents of which none is left go; of each group of near-duplicates one document stays;
documents that hold a passage of the benchmark go; the rest is encoded. Nulls, repeated rows and empty tables pass as
the operators say: a row of null doc_id or null text stays until the end, where it has null tokens if its text is null; of
rows that repeat doc_id and text one stays; rows of one doc_id with other texts are documents of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixmill.llm import decontaminate, line_dedup, simhash, sp_bpe, toxicity
from helixmill.session import remove, shared_dir, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_duplicate_lines(docs)


def _simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_duplicates(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def _sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _toxicity),
    ("line_dedup", _line_dedup),
    ("simhash", _simhash),
    ("decontaminate", _decontaminate),
    ("sentencepiece", _sentencepiece),
]

#: Trained terms and Viterbi decoding, SimHash groups and BPE merges are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the shared folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:  # what the stage before kept has been read for the last time; the last stage's input stays for its reader
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
