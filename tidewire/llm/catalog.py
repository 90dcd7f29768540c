"""Registered queries of this subpackage and, where SQL can express them, their SQL counterparts.

Each query applies its operator with production settings to the whole of its table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import ann, chat, collocations, decontamination, html_text, lm_scoring, mixing, ngram_join, oracles, packing, quality_classifier, quality_rules, secret_scan, whitening
from tidewire.llm.tables import read, text_of, word_count
from tidewire.session import written

TOKENIZER = "word_bpe_49k.json"


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack_documents(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bound")


def cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    return ann.neighbours(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["rank"] < len(secret_scan.BASE))

    def found(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = (found(rule.kind) for rule in secret_scan.BASE)
    return secret_scan.scan(docs).select(
        "doc_id", *counts, F.sha2(secret_scan.digest(base), 256).alias("base_sha256"), secret_scan.digest(spans).alias("spans")
    )


def distribution_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(read(spark, folder, "documents"))


def systematic_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "source", word_count(text_of("text")).alias("_words"))
    # Sizes are written once; counts, offsets and ranks read them instead of the texts.
    mixed = mixing.mix(written(docs, "sizes"), size=F.col("_words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def line_block_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read(spark, folder, "pages"))


def context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.scored(read(spark, folder, "documents"))


def prefix_tree_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, folder, "documents"))


def rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality_classifier.scored(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def role_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repaired(read(spark, folder, "conversations"))


def tiled_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"))


def wu_manber(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def mixed_precision_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whitened(read(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": best_fit_packing,
    "op2_cross_polytope": cross_polytope,
    "op3_secret_scans": secret_scans,
    "op4_distribution_rules": distribution_rules,
    "op5_systematic_mixing": systematic_mixing,
    "op6_line_block_text": line_block_text,
    "op7_context_mixing": context_mixing,
    "op8_prefix_tree_join": prefix_tree_join,
    "op9_rule_ensemble": rule_ensemble,
    "op10_role_repair": role_repair,
    "op11_tiled_collocations": tiled_collocations,
    "op12_wu_manber": wu_manber,
    "op13_mixed_precision_whitening": mixed_precision_whitening,
}
ORACLES: dict[str, str] = {
    "op3_secret_scans": oracles.SECRETS,
    "op5_systematic_mixing": oracles.MIXING,
    "op11_tiled_collocations": oracles.COLLOCATIONS,
    "op12_wu_manber": oracles.CONTAMINATION,
}
