"""From raw documents to a training mix: five stages over the operators of ``trackengine.llm``.

Every stage takes the documents that its predecessor kept and returns documents with the same columns; the last adds
how much of each document the mix takes. ``run`` writes each stage's result to the shared folder and reads it again, so
a lost executor never reaches back over more than one stage.

Edge cases are those of the operators: documents without a letter go at the first stage; a document without an id
is not linked with others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackengine.llm import decontaminate, language_id, mixing, near_dedup, secret_scan
from trackengine.llm.common import Workspace, lower_words, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.accepted(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_dedup.deduplicated(docs, lower_words, shingle=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redacted(docs)


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes, with mix_size and mix_taken."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("secret_scan", without_secrets),
    ("mix", weighted_mix),
]

#: The first stage learns a model, which SQL can't express; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return docs
