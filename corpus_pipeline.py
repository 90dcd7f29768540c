"""A pipeline from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns the documents that go on, with their own columns; the last
one returns the packed pieces.  Stages are written as Parquet in the shared folder and read again, so a lost
executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import mixing, ngram_join, packing, quality_classifier, secret_scan
from tidewire.llm.catalog import TOKENIZER
from tidewire.llm.tables import read
from tidewire.session import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels, does not reject."""
    return quality_classifier.accepted(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return ngram_join.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and lengths counted again."""
    masked = secret_scan.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emitted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    pieces = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", one_of_each),
    ("secret_scan", without_secrets),
    ("source_mixing", mixed_sources),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the packing are beyond SQL; tests hold the rows against plain Python.
ORACLE_SQL = None
