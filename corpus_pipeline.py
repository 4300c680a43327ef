"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, mixing to target weights, SentencePiece.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as the docs of the next one.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from markflow.llm import exact_dedup, mixing, near_copies, quality, sentencepiece
from markflow.llm.common import saved, table

PIECES = os.environ.get("MARKFLOW_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_copies.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: rows repeat by epoch, the last one of a source is cut at its budget."""
    return mixing.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, round_trip of each row."""
    return sentencepiece.encode(docs.select("doc_id", "source", "text"), PIECES).drop("text")


STAGES = [
    ("quality classifier", by_quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("mixing", mixed),
    ("sentencepiece", pieces),
]

#: Logistic regression, fingerprints and Viterbi paths have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
