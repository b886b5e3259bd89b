"""The two generations of the ontology as small tables, and checks against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TYPES_V1 = "indicator formula parameter unit data_source method ecosystem_type spatial_scope temporal_scope quality_requirement standard_clause"
# relation: heads > tails, combined with each other; ; between alternatives
_V1 = {
    "uses_formula": "indicator > formula",
    "depends_on": "formula indicator > parameter; indicator > indicator",
    "sourced_from": "parameter > data_source",
    "has_unit": "parameter indicator > unit",
    "applies_to": "indicator > ecosystem_type spatial_scope temporal_scope; formula method > ecosystem_type",
    "defined_in": f"{_TYPES_V1.replace(' standard_clause', '')} > standard_clause",
    "uses_method": "indicator parameter > method",
    "constrained_by": f"{_TYPES_V1.replace(' quality_requirement standard_clause', '')} > quality_requirement",
    "derived_from": "parameter indicator > parameter; indicator > indicator",
}
_VARIABLE = "model_variable observation_variable"
_V2 = {
    "has_indicator": "assessment_subject > assessment_indicator",
    "calculated_by": "assessment_indicator model_variable > formula",
    "has_input": "formula > model_variable",
    "has_output": "formula > model_variable",
    "obtained_by": f"{_VARIABLE} > method",
    "measured_with": "observation_variable > instrument",
    "sourced_from": f"{_VARIABLE} > data_source",
    "has_unit": f"{_VARIABLE} assessment_indicator > unit",
    "observed_during": "observation_variable > temporal_scope",
    "observed_every": "observation_variable > frequency",
    "applies_to_ecosystem": "assessment_indicator formula method > ecosystem_type",
    "applies_to_space": "assessment_indicator formula method > spatial_scope",
    "constrained_by": f"{_VARIABLE} data_source method > quality_rule",
    "classified_by": "assessment_indicator > classification_rule",
}
#: Paths that questions follow: edges that must be there, then those that may.
PATHS = {
    "assessment_formula_path": ("assessment_subject has_indicator assessment_indicator; assessment_indicator calculated_by formula; formula has_output model_variable; formula has_input model_variable", "model_variable has_unit unit; model_variable sourced_from data_source"),
    "observation_path": ("observation_variable obtained_by method", "observation_variable measured_with instrument; observation_variable observed_during temporal_scope; observation_variable observed_every frequency"),
    "quality_path": ("observation_variable constrained_by quality_rule", ""),
}
#: First-generation values and what they may have become; none is migrated without a person, and provenance is no relation any more.
LEGACY = {
    "indicator": ["assessment_indicator", "observation_variable"],
    "parameter": ["model_variable", "observation_variable"],
    "uses_formula": ["calculated_by"],
    "depends_on": ["has_input", "has_output"],
    "applies_to": ["applies_to_ecosystem", "applies_to_space"],
    "defined_in": [],
}
#: Objects of documents, which take no part in relations.
DOCUMENT_OBJECTS = ["standard", "clause", "table", "formula_block", "evidence_span", "source_unit"]
_LABELS_V1 = dict(zip(_V1, "采用公式 依赖参数 数据来源于 单位为 适用于 定义于条款 采用处理方法 受质量要求约束 由参数派生".split(), strict=True))
#: What the text must say for a relation of the second generation.
EVIDENCE_RULES = {
    "has_indicator": "subject and indicator stand in one system of indicators or one definition",
    "calculated_by": "the indicator or variable and the number of the formula stand together",
    "has_input": "the symbol stands to the right of the formula",
    "has_output": "the symbol stands to the left of the formula",
    "obtained_by": "variable and method stand in one clause",
    "measured_with": "variable and instrument stand in one clause or row",
    "sourced_from": "the text names where the variable's data come from",
    "has_unit": "the unit stands in the variable's definition",
    "observed_during": "variable and time stand in one clause or row",
    "observed_every": "variable and frequency stand in one clause or row",
    "applies_to_ecosystem": "the text limits it to the ecosystem",
    "applies_to_space": "the text limits it to the area",
    "constrained_by": "what is constrained and the threshold, condition or action stand in one clause",
    "classified_by": "indicator and classes stand in one table or clause",
}


def patterns(version: int = 2) -> list[tuple[str, str, str]]:
    """Allowed (head type, relation, tail type)."""
    out = []
    for relation, text in (_V1 if version == 1 else _V2).items():
        for part in text.split(";"):
            heads, tails = (x.split() for x in part.split(">"))
            out += [(h, relation, t) for h in heads for t in tails]
    return out


def schema_rows(spark: SparkSession, version: int = 2, described: bool = False) -> DataFrame:
    """Allowed patterns; ``described`` adds the label of a relation (first generation) or the rule for its evidence (second), and the version."""
    rows = spark.createDataFrame(patterns(version), "head_type string, relation_type string, tail_type string")
    if not described:
        return rows
    name, texts = ("relation_label_zh", _LABELS_V1) if version == 1 else ("evidence_rule", EVIDENCE_RULES)
    return rows.withColumn(name, F.create_map(*(F.lit(x) for kv in texts.items() for x in kv))[F.col("relation_type")]).withColumn("ontology_version", F.lit(version))


def allowed_pairs(spark: SparkSession, relation: str, version: int = 2) -> DataFrame:
    return schema_rows(spark, version).where(F.col("relation_type") == relation).select("head_type", "tail_type")


def path_templates(spark: SparkSession) -> DataFrame:
    rows = [(k, i, need, *e.split()) for k, parts in PATHS.items() for need, text in zip((True, False), parts) for i, e in enumerate(filter(None, text.split(";")))]
    return spark.createDataFrame(rows, "template_id string, position int, required boolean, head_type string, relation_type string, tail_type string")


def checked(relations: DataFrame, version: int = 2, allowed: DataFrame | None = None) -> DataFrame:
    """Adds ``valid`` and ``reason`` ('' where valid): unknown values first, then patterns that aren't allowed.

    The ontology is a literal table of a few dozen rows, hence the broadcast.
    """
    allowed = schema_rows(relations.sparkSession, version) if allowed is None else allowed
    types = [r[0] for r in allowed.select("head_type").union(allowed.select("tail_type")).distinct().collect()]
    kinds = [r[0] for r in allowed.select("relation_type").distinct().collect()]
    known = F.col("head_type").isin(types) & F.col("tail_type").isin(types) & F.col("relation_type").isin(kinds)
    joined = relations.join(F.broadcast(allowed.distinct().withColumn("_ok", F.lit(True))), ["head_type", "relation_type", "tail_type"], "left")
    reason = F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown schema value")).when(F.col("_ok").isNull(), F.concat("head_type", F.lit(" -["), "relation_type", F.lit("]-> "), "tail_type", F.lit(" is not allowed"))).otherwise(F.lit(""))
    return joined.withColumn("reason", reason).withColumn("valid", F.col("reason") == "").drop("_ok")


def quality_report(spark: SparkSession) -> DataFrame:
    """(check, passed, details): the second generation's own consistency; details are what breaks the rule."""
    v2 = patterns(2)
    types, relations = {x for h, _, t in v2 for x in (h, t)}, {r for _, r, _ in v2}
    steps = [tuple(e.split()) for parts in PATHS.values() for text in parts for e in filter(None, text.split(";"))]
    broken = {
        "all_domain_entities_defined": sorted(set(ENTITY_TYPES) ^ types),
        "all_relations_constrained": sorted(set(_V2) ^ relations),
        "no_unbounded_relation": sorted(r for r in _V2 if r not in relations or not EVIDENCE_RULES.get(r)),
        "legacy_ambiguous_values_excluded": sorted({"indicator", "parameter", "defined_in", "applies_to"} & (types | relations)),
        "path_templates_use_allowed_edges": [" ".join(s) for s in steps if s not in v2],
    }
    return spark.createDataFrame([(k, not v, v) for k, v in broken.items()], "check string, passed boolean, details array<string>")


ENTITY_TYPES = (
    "assessment_subject assessment_indicator observation_variable model_variable formula method instrument data_source unit ecosystem_type spatial_scope temporal_scope frequency quality_rule classification_rule".split()
)


def migration_status(legacy: str | Column) -> Column:
    """(status, candidates): manual_review_required for every first-generation value that changed, else not_legacy."""
    x = F.col(legacy) if isinstance(legacy, str) else legacy
    table = F.create_map(*(v for k, c in LEGACY.items() for v in (F.lit(k), F.array(*map(F.lit, c)).cast("array<string>"))))
    found = F.try_element_at(table, x)
    none = F.array().cast("array<string>")
    return F.struct(F.when(found.isNull(), "not_legacy").otherwise("manual_review_required").alias("status"), F.coalesce(found, none).alias("candidates"))
