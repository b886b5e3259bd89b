"""Strict set-based evaluation of predictions against gold.

Gold and predictions meet in one full outer join per kind; every metric is
an aggregate over the flags of that join, so that one shuffle serves all
dimensions (grouping sets).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched(gold: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys with flags ``in_gold`` and ``in_pred``."""
    g, p = gold.select(*key).withColumn("s", F.lit(1)), predicted.select(*key).withColumn("s", F.lit(2))
    return g.union(p).groupBy(*key).agg(F.bool_or(F.col("s") == 1).alias("in_gold"), F.bool_or(F.col("s") == 2).alias("in_pred"))


def prf(strict_empty: bool = True, digits: int = 6) -> list[Column]:
    """Aggregates gold, predicted, tp, precision, recall, f1 over ``matched`` rows.

    With ``strict_empty`` (second generation) no predictions give precision 1
    if there is no gold and 0 otherwise, and no gold gives recall 1; without
    (first generation) an empty side gives 0.
    """
    g, p, tp = F.count_if("in_gold"), F.count_if("in_pred"), F.count_if(F.col("in_gold") & F.col("in_pred"))
    if strict_empty:
        precision = F.coalesce(F.try_divide(tp, p), F.when(g == 0, 1.0).otherwise(0.0))
        recall = F.coalesce(F.try_divide(tp, g), F.lit(1.0))
    else:
        precision, recall = F.coalesce(F.try_divide(tp, p), F.lit(0.0)), F.coalesce(F.try_divide(tp, g), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return [g.alias("gold"), p.alias("predicted"), tp.alias("tp"), F.round(precision, digits).alias("precision"), F.round(recall, digits).alias("recall"), F.round(f1, digits).alias("f1")]


def micro(gold: DataFrame, predicted: DataFrame, key: list[str], strict_empty: bool = True) -> DataFrame:
    return matched(gold, predicted, key).agg(*prf(strict_empty))


def by_value(gold: DataFrame, predicted: DataFrame, key: list[str], value: str, strict_empty: bool = True) -> DataFrame:
    return matched(gold, predicted, key).groupBy(value).agg(*prf(strict_empty))


def macro_f1(gold: DataFrame, predicted: DataFrame, key: list[str], value: str, strict_empty: bool = True) -> DataFrame:
    """The mean F1 over all values that either side has; 0 where there are none."""
    return by_value(gold, predicted, key, value, strict_empty).agg(F.coalesce(F.round(F.avg("f1"), 6), F.lit(0.0)).alias("macro_f1"))


def by_dimensions(flags: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, metrics): overall and by each dimension, by grouping sets of the counts of all dimensions together."""
    flags = flags.groupBy(*dimensions).agg(F.count_if("in_gold").alias("gold"), F.count_if("in_pred").alias("predicted"), F.count_if(F.col("in_gold") & F.col("in_pred")).alias("tp"))
    gs = ", ".join(["()", *(f"(`{d}`)" for d in dimensions)])
    name = "CASE " + " ".join(f"WHEN grouping(`{d}`) = 0 THEN '{d}'" for d in dimensions) + " ELSE 'all' END"
    value = "coalesce(" + ", ".join(f"CASE WHEN grouping(`{d}`) = 0 THEN cast(`{d}` AS string) END" for d in dimensions) + ", '')"
    counts = flags.sparkSession.sql(f"SELECT {name} AS dimension, {value} AS value, sum(gold) AS gold, sum(predicted) AS predicted, sum(tp) AS tp FROM {{flags}} GROUP BY GROUPING SETS ({gs})", flags=flags)
    precision = F.coalesce(F.try_divide("tp", "predicted"), F.when(F.col("gold") == 0, 1.0).otherwise(0.0))
    recall = F.coalesce(F.try_divide("tp", "gold"), F.lit(1.0))
    return counts.select("*", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), 6).alias("f1"), F.round(F.coalesce(F.try_divide(F.col("predicted") - F.col("tp"), F.col("predicted")), F.lit(0.0)), 6).alias("false_discovery_rate"))


def ranking(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """MRR and hits@k over rows (rank, is_correct) that are correct; zeros where there are none."""
    right = rows.where("is_correct")
    return right.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(1 / F.col("rank")), 6), F.lit(0.0)).alias("mrr"), *(F.coalesce(F.round(F.avg((F.col("rank") <= k).cast("double")), 6), F.lit(0.0)).alias(f"hits_{k}") for k in ks))


def evidence_overlap(gold: DataFrame, predicted: DataFrame, key: list[str], evidence: str) -> DataFrame:
    """Over keys of both sides: how often their evidence sets meet, and how often they are equal; null where no key matches."""
    side = lambda d, name: d.select(*key, F.explode_outer(evidence).alias("e")).withColumn("e", F.col("e").cast("string")).groupBy(*key).agg(F.array_sort(F.collect_set("e")).alias(name))
    both = side(gold, "g").join(side(predicted, "p"), key)
    n = F.count("*")
    return both.agg(n.alias("matched"), F.round(F.try_divide(F.count_if(F.arrays_overlap("g", "p")), n), 6).alias("overlap_rate"), F.round(F.try_divide(F.count_if(F.col("g") == F.col("p")), n), 6).alias("exact_rate"))


def complete_groups(gold: DataFrame, predicted: DataFrame, key: list[str], group: list[str], tasks: int | None = None) -> DataFrame:
    """Relational division: gold groups all of whose edges are predicted (groups, complete, rate).

    Edges of both sides meet in one shuffle by group, in ``tasks`` tasks or as many as the session sets; null keys match nothing.
    """
    side = lambda df, k: df.select(*key, F.lit(k == 0).alias("_g"), F.lit(k == 1).alias("_p"))
    both = side(gold, 0).union(side(predicted, 1))
    both = both.repartition(tasks, *group) if tasks else both.repartition(*group)
    flags = both.groupBy(*key).agg(F.bool_or("_g").alias("_g"), F.bool_or("_p").alias("_p")).where("_g")
    known = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in key))
    per = flags.groupBy(*group).agg(F.bool_and(F.col("_p") & known).alias("whole"))
    return per.agg(F.count("*").alias("groups"), F.count_if("whole").alias("complete"), F.round(F.try_divide(F.count_if("whole"), F.count("*")), 6).alias("rate"))


def edge_recall(gold: DataFrame, predicted: DataFrame, key: list[str], relation: str) -> DataFrame:
    only = F.col("relation_type") == relation
    return micro(gold.where(only), predicted.where(only), key)


def indicator_paths(gold: DataFrame, predicted: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Gold calculated_by edges with each has_indicator edge of the unit that ends at their head, and whether both are predicted."""
    key = [unit, "head_name", "relation_type", "tail_name"]
    g = gold.select(*key).distinct().join(predicted.select(*key).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.col("hit").isNotNull())
    calc = g.where("relation_type = 'calculated_by'").select(unit, F.col("head_name").alias("indicator"), F.col("tail_name").alias("formula"), F.col("hit").alias("h1"))
    has = g.where("relation_type = 'has_indicator'").select(unit, F.col("head_name").alias("subject"), F.col("tail_name").alias("indicator"), F.col("hit").alias("h2"))
    return calc.join(has, [unit, "indicator"], "left").select(unit, "subject", "indicator", "formula", (F.col("h1") & F.coalesce("h2", F.lit(True))).alias("complete"))


def errors(flags: DataFrame, key: list[str], kind: str) -> DataFrame:
    """False negatives and positives as (error_type, key columns)."""
    return flags.where("in_gold <> in_pred").select(F.when(F.col("in_gold"), f"{kind}_false_negative").otherwise(f"{kind}_false_positive").alias("error_type"), *key)


def unit_exact_match(flags: DataFrame, unit: str) -> DataFrame:
    """Units whose gold and predicted sets are equal."""
    per = flags.groupBy(unit).agg(F.bool_and(F.col("in_gold") == F.col("in_pred")).alias("same"))
    return per.agg(F.count("*").alias("units"), F.count_if("same").alias("exact"), F.round(F.try_divide(F.count_if("same"), F.count("*")), 6).alias("rate"))


def agreement(left: DataFrame, right: DataFrame, unit: str, value: str) -> DataFrame:
    """Of two annotators: common items summed over units, precision, recall, F1 and the share of equal units."""
    sets = lambda d, n: d.groupBy(unit).agg(F.collect_set(value).alias(n))
    none = F.array().cast("array<string>")
    both = sets(left, "l").join(sets(right, "r"), unit, "full").select(unit, F.coalesce("l", none).alias("l"), F.coalesce("r", none).alias("r"))
    both = both.select("*", F.size(F.array_intersect("l", "r")).alias("c"))
    tot = both.agg(F.count("*").alias("units"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("common"), F.coalesce(F.sum(F.size("l")), F.lit(0)).cast("long").alias("n_left"), F.coalesce(F.sum(F.size("r")), F.lit(0)).cast("long").alias("n_right"), F.coalesce(F.round(F.avg((F.array_sort("l") == F.array_sort("r")).cast("double")), 6), F.lit(1.0)).alias("exact_unit_rate"))
    p, r = F.coalesce(F.try_divide("common", "n_left"), F.lit(1.0)), F.coalesce(F.try_divide("common", "n_right"), F.lit(1.0))
    return tot.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def disagreements(left: DataFrame, right: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, value, side): items that one annotator alone has."""
    f = matched(left, right, [unit, value])
    return f.where("in_gold <> in_pred").select(unit, value, F.when(F.col("in_gold"), "left").otherwise("right").alias("side"))


def checks(*rows: DataFrame) -> DataFrame:
    """Check rows (check, passed, expected, actual) of several frames, and whether all passed."""
    return reduce(DataFrame.unionByName, rows)


def gate(rows: DataFrame) -> DataFrame:
    """(checks, failed, passed); no checks don't pass."""
    return rows.agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), (F.coalesce(F.bool_and("passed"), F.lit(False))).alias("passed"))
