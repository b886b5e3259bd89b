"""One query for each operator, over its whole table, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import fingerprint, language_id, mixing, ngram_join, quality, secrets_crf, sentence_dedup, sentencepiece_lattice, toxicity, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(_documents(spark, sf_dir))


def op1_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.all_pairs(ngram_join.ngram_jaccard_join(_documents(spark, sf_dir)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup.remove_repeats(_documents(spark, sf_dir))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_crf.find_secrets(_documents(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(warc.records(warc.render(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode_checked(_documents(spark, sf_dir))


def op7_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the same model as a unigram model's, whose fold is Viterbi."""
    return sentencepiece_lattice.encode_checked(_documents(spark, sf_dir), kind=sentencepiece_lattice.UNIGRAM)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(_documents(spark, sf_dir))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.exact_copies(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard_join, op1_all_pairs, op2_quality_rules, op3_language_id, op4_substring_dedup, op5_secret_scans, op6_warc, op7_sentencepiece, op7_viterbi, op8_toxicity, op9_mixing, op10_document_fingerprints)
}
ORACLE = {"op1_ngram_jaccard_join": ngram_join.ORACLE, "op1_all_pairs": ngram_join.ORACLE_ALL, "op2_quality_rules": quality.ORACLE, "op4_substring_dedup": sentence_dedup.ORACLE, "op10_document_fingerprints": fingerprint.ORACLE}
