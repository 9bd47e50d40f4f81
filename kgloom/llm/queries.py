"""Queries of the training-data operators; each takes (spark, folder) and reads whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import canonical, lookalike, mixing, mojibake, overlap, tokenizer, variants
from kgloom.sources import table


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.split_overlaps(table(spark, d, "ner_train"), table(spark, d, "re_train"), table(spark, d, "eval_samples"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs(spark, d).select("train_id", "eval_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(p1_pairs(spark, d), table(spark, d, "eval_samples"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.found(table(spark, d, "kb"), table(spark, d, "linked_mentions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(table(spark, d, "linked_mentions"), table(spark, d, "kb"), table(spark, d, "ref_entries")).select("field", "row_id", "pos", "ref_id")


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched(table(spark, d, "linked_mentions"), table(spark, d, "kb"), table(spark, d, "ref_entries"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(table(spark, d, "kb"), table(spark, d, "input_entities"), table(spark, d, "triples"))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.forms(table(spark, d, "kb"), table(spark, d, "input_entities"), table(spark, d, "triples"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired(table(spark, d, "documents")).select("doc_id")


def p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired(table(spark, d, "documents")).select("doc_id", "text", F.col("restored"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p4_found, p4_unmatched, p6_found, p6_forms, p7_ids, p8_mix, p8_shares, p9_found, p9_repaired)}
ORACLES: dict[str, str] = {}
