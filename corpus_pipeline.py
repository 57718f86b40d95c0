"""From raw documents to packed sequences: each stage applies one operator to all rows it gets.

Every stage takes an empty table to an empty one and carries further columns along, whatever
their names; rows are judged one by one, so repeated rows stay or go together up to the third stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import langid, nbsvm, ngram_join, packing
from auditloom.llm._common import stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go.

    These are null texts, texts without a letter, and those of which it is likelier that their
    language is none of the learned ones, or another one, than the predicted one. Null languages
    are not learned from.
    """
    return langid.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, learned from the labels of documents that got here; rejected ones go.

    Null and empty texts get the score of a text without n-grams. Without labels of both kinds the
    score is the share of good ones, so all go or all stay.
    """
    return nbsvm.keep_quality(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each linked group the document of least doc_id stays.

    Texts without words link with nothing; of rows with the same doc_id in a group the one of
    least text stays, in different groups each is judged by its own; rows with a null doc_id all stay.
    """
    return ngram_join.keep_one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Harmonic packing of the documents that are left, null texts as empty ones."""
    return packing.harmonic_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", known_language), ("quality", good_quality), ("near_duplicates", one_of_each_group), ("packing", packed)]

#: Trained models, component search and tokenization are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
