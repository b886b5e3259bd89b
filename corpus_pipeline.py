"""A corpus from raw documents to piece ids, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import _spark, mixing, ngram_join, secrets_crf, sentencepiece_lattice, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; rows of a null doc_id, and null, empty and wordless texts, stay, and so do all without labels of both kinds."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays, that of the least doc_id. Rows of a null doc_id or without words stay; of rows that repeat a doc_id all stay or all go."""
    return ngram_join.keep_one_of_each_group(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked. Null texts stay null."""
    return secrets_crf.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are chosen so that sources have their target shares of the tokens. Rows of a null doc_id or without tokens go; of rows that repeat a doc_id all stay or all go."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_chars, same) of each row that is left, same being whether its ids decode to its text; one row for each of repeated ones."""
    return sentencepiece_lattice.encode_checked(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Trained models, the knapsack and the merge rule can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next; what a stage wrote goes when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = _spark.written(stage(spark, docs, sf_dir))
        docs = spark.read.parquet(path)
        if last:
            _spark.discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
