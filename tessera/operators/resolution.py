"""Entities and triples merged over units, and rows merged with overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T

#: Types whose entities differ by their context.
CONTEXTUAL = ("model_variable", "formula", "quality_rule", "classification_rule")


def entities(mentions: DataFrame) -> DataFrame:
    """One entity per (standard_code, entity_type, clean name, context): from (unit_id, seq, standard_code, name, entity_type, context, definition, evidence_span_ids).

    Definitions, units and evidence keep the order of first sight.
    """
    m = mentions.withColumn("name", T.clean_name("name")).where("name <> ''").withColumn("context", F.when(F.col("entity_type").isin(*CONTEXTUAL), F.coalesce("context", F.lit(""))).otherwise(""))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("x")))), lambda s: s["x"])
    g = m.groupBy("standard_code", "entity_type", "name", "context").agg(in_order("definition").alias("definitions"), in_order("unit_id").alias("units"), F.flatten(in_order("evidence_span_ids")).alias("spans"))
    return g.select(T.stable_id("standard_code", "entity_type", "name", "context").alias("entity_id"), "standard_code", "entity_type", "name", "context", T.unique("definitions").alias("definitions"), T.unique("units").alias("source_unit_ids"), T.unique("spans").alias("evidence_span_ids"))


def triples(relations: DataFrame) -> DataFrame:
    """One triple per (head_id, relation_type, tail_id) with its evidence (unit_id, evidence_span_ids) in order of units, repeated evidence once."""
    g = relations.groupBy("head_id", "relation_type", "tail_id").agg(F.array_sort(F.collect_set(F.struct("unit_id", "evidence_span_ids"))).alias("evidence"))
    return g.select(T.stable_id("head_id", "relation_type", "tail_id").alias("triple_id"), "*")


def last_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(o) for o in order)))).where("_n = 1").drop("_n")


def merge_overrides(rows: DataFrame, overrides: DataFrame, key: list[str], replace: str = "replace_existing") -> DataFrame:
    """Rows and overrides (same columns, and a flag): an override comes in where its key is absent, or in place of the row where it says so."""
    forced = overrides.where(replace).select(*key)
    kept = rows.join(forced, key, "left_anti")
    new = overrides.join(kept.select(*key), key, "left_anti").drop(replace)
    return kept.unionByName(new)


def semantic_selection(gold: DataFrame, candidates: DataFrame, key: list[str], unit: str, candidate_id: str) -> DataFrame:
    """Ids of candidates whose semantic key is gold in the same unit, and the coverage of gold by unit."""
    hit = gold.select(unit, *key).distinct().join(candidates.select(unit, *key, candidate_id), [unit, *key], "left")
    return hit.groupBy(unit).agg(F.array_sort(F.collect_set(candidate_id)).alias("selected"), F.countDistinct(F.struct(*key)).alias("gold"), F.countDistinct(F.when(F.col(candidate_id).isNotNull(), F.struct(*key))).alias("covered"))
