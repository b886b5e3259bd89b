"""Predictions against units: reconciliation and failures by unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(units: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """(key, code): missing_prediction, unknown_unit or duplicate_prediction, found in one pass over both sides' keys."""
    u = units.select(key, F.lit(1).alias("u"), F.lit(0).alias("p"))
    p = predictions.select(key, F.lit(0).alias("u"), F.lit(1).alias("p"))
    n = u.union(p).groupBy(key).agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
    codes = F.array_compact(F.array(F.when(F.col("p") == 0, F.lit("missing_prediction")), F.when(F.col("u") == 0, F.lit("unknown_unit")), F.when(F.col("p") > 1, F.lit("duplicate_prediction"))))
    return n.select(key, F.explode(codes).alias("code"))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that raises where keys repeat or are on one side alone."""
    bad = reconcile(left, right, key).union(left.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate_unit")))
    first = bad.orderBy(key, "code").limit(5).collect()
    if first:
        raise ValueError("keys don't match one to one: " + ", ".join(f"{r[0]} {r[1]}" for r in first))
    return left.join(right, key)


def histogram(failures: DataFrame) -> DataFrame:
    return failures.groupBy("code").agg(F.count("*").alias("n")).orderBy("code")


def unresolved_references(texts: DataFrame, inventory: DataFrame, key: str, text: str, number: str) -> DataFrame:
    """References 按式（N） to formulas that the document doesn't have."""
    refs = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"按式\s*[（(]([A-Z]?\.?\d+)[）)]"), F.lit(1))).alias(number)).distinct()
    return refs.join(inventory.select(key, number).distinct(), [key, number], "left_anti")
