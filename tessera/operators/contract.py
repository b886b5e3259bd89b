"""Blind packages, predictions checked against units, and their strict evaluation against gold, end to end.

Records whose shape can't be trusted travel as JSON text and are checked one
by one where they lie; everything over all records is a join or an aggregate.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import annotate, evaluation, validation
from tessera.operators.units import by_row, schema_of

BLIND_KEYS = ["gold_annotation", "gold_nature", "review_status", "entities", "relations", "triple_id"]
GOLD_ONLY = frozenset({"gold_annotation", "gold_nature", "review_status", "triple_id"})
ANSWERS = ("gold_annotation", "entities", "relations", "triple_id")
PACKAGE_VERSION, SPLIT_POLICY = "experiment-dataset-v2.1", "document-group-split-v2.0"
FAILURE = "unit_id string, code string, message string, place int, field string, actual string, expected string, found array<string>"
ENTITY_KEY = ["unit_id", "name", "entity_type"]
RELATION_KEY = ["unit_id", "head_name", "head_type", "relation_type", "tail_name", "tail_type"]


def assert_blind(records: DataFrame, column: str = "value") -> None:
    """Raises with the first forbidden paths if any record, as JSON text, has a field that tells the answer."""
    paths = records.select(F.explode(T.forbidden_paths(column, BLIND_KEYS)).alias("p"))
    # a limit would look through one task, then four and so on, where there are none
    if paths.agg(F.count("*")).first()[0]:
        found = paths.limit(20).collect()
        raise ValueError("blind input contains forbidden gold fields: " + ", ".join(r.p for r in found))


# -- validation -------------------------------------------------------------


def _paths(value: object, prefix: str = "$") -> list[str]:
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in ([f"{prefix}.{k}"] if k in GOLD_ONLY else []) + _paths(v, f"{prefix}.{k}")]
    return [p for i, v in enumerate(value) for p in _paths(v, f"{prefix}[{i}]")] if isinstance(value, list) else []


def _leaks(value: object) -> bool:
    """Whether ``_paths`` finds any, without a text for each place."""
    left = [value]
    while left:
        value = left.pop()
        if isinstance(value, dict):
            if not GOLD_ONLY.isdisjoint(value):
                return True
            value = value.values()
        elif not isinstance(value, list):
            continue
        left += [x for x in value if isinstance(x, (dict, list))]
    return False


def _text(value: object) -> str:
    return "" if value is None else str(value)


def check_prediction(unit: dict, prediction: dict) -> list[dict]:
    """Every failure of one prediction against its unit."""
    out: list[dict] = []
    known = set(annotate.all_spans(unit))

    def fail(code: str, message: str, place: int | None = None, **more) -> None:
        out.append({"unit_id": unit["unit_id"], "code": code, "message": message, "place": place, **more})

    def same(code: str, message: str, actual: object, expected: object) -> None:
        if actual != expected:
            fail(code, message, actual=_text(actual), expected=_text(expected))

    def spans(kind: str, item: dict, place: int) -> None:
        ids = item.get("evidence_span_ids")
        if not isinstance(ids, list) or not ids:
            fail(f"missing_{kind}_evidence", "no evidence spans", place)
        elif foreign := sorted(set(map(str, ids)) - known):
            fail(f"invalid_{kind}_evidence", "evidence outside the unit", place, found=foreign)

    for path in _paths(prediction) if _leaks(prediction) else ():
        fail("gold_field_leakage", "a field that only gold has", field=path)
    same("prediction_schema_version", "another schema version", prediction.get("schema_version"), annotate.PREDICTION_VERSION)
    same("ontology_version", "another ontology version", prediction.get("ontology_version"), annotate.ONTOLOGY_VERSION)
    same("extraction_status", "the extraction didn't succeed", prediction.get("status"), "success")
    for name in ("experiment_id", "config_hash", "candidate_hash", "model", "seed"):
        if prediction.get(name) in (None, ""):
            fail("missing_reproducibility_field", "a field that a repetition needs is missing", field=name)
    if prediction.get("backend") == "llm" and not prediction.get("prompt_hash"):
        fail("missing_prompt_hash", "a model's prediction without the digest of its prompt")
    same("standard_code", "another standard than the unit's", prediction.get("standard_code"), unit["provenance"]["standard_code"])
    same("unit_type", "another type than the unit's", prediction.get("unit_type"), unit["unit_type"])

    lists = {}
    for name in ("entities", "relations"):
        lists[name] = prediction.get(name)
        if not isinstance(lists[name], list):
            fail(f"{name}_type", "not a list")
            lists[name] = []
    by_id: dict[str, dict] = {}
    seen: set[tuple] = set()
    for k, e in enumerate(lists["entities"]):
        if not isinstance(e, dict):
            fail("entity_record", "not an object", k)
            continue
        own, name, kind = _text(e.get("entity_id")), _text(e.get("name")).strip(), _text(e.get("entity_type"))
        if not own or own in by_id:
            fail("duplicate_entity_id", "id missing or repeated", k)
        else:
            by_id[own] = e
        if not name:
            fail("empty_entity_name", "no name", k)
        if kind not in annotate._TYPES:
            fail("invalid_entity_type", "no type of the ontology", k, actual=kind)
        if (name, kind) in seen:
            fail("duplicate_entity", "name and type repeated", k)
        seen.add((name, kind))
        spans("entity", e, k)
    ids: set[str] = set()
    seen = set()
    for k, r in enumerate(lists["relations"]):
        if not isinstance(r, dict):
            fail("relation_record", "not an object", k)
            continue
        own = _text(r.get("relation_id"))
        if not own or own in ids:
            fail("duplicate_relation_id", "id missing or repeated", k)
        ids.add(own)
        head, tail = (by_id.get(_text(r.get(f"{side}_id"))) for side in ("head", "tail"))
        if head is None or tail is None:
            fail("missing_relation_endpoint", "an end is no predicted entity", k)
        elif any(r.get(f"{side}_{a}") != e.get(b) for side, e in (("head", head), ("tail", tail)) for a, b in (("name", "name"), ("type", "entity_type"))):
            fail("endpoint_payload_mismatch", "an end differs from its entity", k)
        kind = _text(r.get("relation_type"))
        if kind not in annotate._KINDS:
            fail("invalid_relation_type", "no relation of the ontology", k, actual=kind)
        elif why := annotate.legal(_text(r.get("head_type")), kind, _text(r.get("tail_type"))):
            fail("invalid_relation_direction", why, k)
        key = tuple(_text(r.get(x)) for x in RELATION_KEY[1:])
        if key in seen:
            fail("duplicate_relation", "relation repeated", k)
        seen.add(key)
        spans("relation", r, k)
    return out


VALID = "unit_id string, value string"


def _met(rows: Iterator[tuple[str, bool, str]]) -> Iterator[tuple[str, int, int, str | None, str | None]]:
    """(unit id, units, predictions, the first of each) of sorted rows (unit id, whether a prediction, text)."""
    for own, group in groupby(rows, key=itemgetter(0)):
        n, first = [0, 0], [None, None]
        for _, k, value in group:
            if not n[k]:
                first[k] = value
            n[k] += 1
        yield own, *n, *first


def _judged(own: str, nu: int, np: int, unit: str | None, prediction: str | None) -> list[dict]:
    """FAILURE rows of a unit id: what its numbers of units and predictions say, and of one prediction every failure."""
    codes = {"missing_prediction_units": nu > 0 and np == 0, "extra_prediction_units": nu == 0 and np > 0, "duplicate_prediction_units": np > 1, "duplicate_source_units": nu > 1}
    out = [{"unit_id": own, "code": c, "message": c.replace("_", " ")} for c, found in codes.items() if found]
    return out + (check_prediction(json.loads(unit), json.loads(prediction)) if np == 1 and nu else [])


def _valid(own: str, nu: int, np: int, unit: str | None, prediction: str | None) -> list[dict]:
    return [{"unit_id": own, "value": prediction}] if np == 1 and nu and not check_prediction(json.loads(unit), json.loads(prediction)) else []


def validate_predictions(units: DataFrame, predictions: DataFrame, ontology_version: str | None = annotate.ONTOLOGY_VERSION, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(failures, valid predictions) of units and predictions given as JSON text in ``value``.

    FAILURE rows: of single predictions as in ``check_prediction``; unit ids
    without, with several or unknown predictions (missing_, duplicate_,
    extra_prediction_units), repeated units (duplicate_source_units), and a
    schema of another ontology, with unit_id '' for what concerns no one unit.
    Units with gold fields raise. Of repeated units the least text counts.

    Units and predictions meet in one shuffle, in ``tasks`` tasks or as many as
    the session sets, and are read in the order of their ids, one at a time.
    """
    assert_blind(units)
    key = F.coalesce(F.get_json_object("value", "$.unit_id"), F.lit(""))
    both = units.select(key.alias("unit_id"), F.lit(False).alias("k"), "value").union(predictions.select(key, F.lit(True), "value"))
    met = (both.repartition(tasks, "unit_id") if tasks else both.repartition("unit_id")).sortWithinPartitions("unit_id", "k", "value")

    def judged(f: Callable[..., list[dict]], schema: str) -> DataFrame:
        kind = schema_of(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256))
            made: list[dict] = []
            for met in _met(row for part in parts for row in zip(*(c.to_pylist() for c in part.columns))):
                made += f(*met)
                if len(made) >= 256:
                    yield from pa.Table.from_pylist(made, kind[1]).to_batches()
                    made = []
            yield from pa.Table.from_pylist(made, kind[1]).to_batches()

        return met.mapInArrow(run, kind[0])

    failures = judged(_judged, FAILURE)
    if ontology_version != annotate.ONTOLOGY_VERSION:
        other = [("", "schema_ontology_version", "the schema is of another ontology version", None, None, ontology_version, annotate.ONTOLOGY_VERSION, None)]
        failures = failures.union(units.sparkSession.createDataFrame(other, FAILURE))
    return failures, judged(_valid, VALID)


def validation_report(units: DataFrame, predictions: DataFrame, failures: DataFrame, valid: DataFrame) -> DataFrame:
    """One row: counts, failures by code, and whether all passed."""
    codes = failures.groupBy("code").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("failure_code_counts"), F.coalesce(F.sum("n"), F.lit(0)).alias("failure_count"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    per_unit = failures.where("place IS NOT NULL OR field IS NOT NULL OR actual IS NOT NULL").where("unit_id <> ''").agg(F.countDistinct("unit_id").alias("failed_unit_count"))
    rows = [count(units, "source_unit_count"), count(predictions, "prediction_unit_count"), count(valid, "valid_prediction_unit_count"), per_unit]
    one = reduce(lambda a, b: a.crossJoin(b), rows, codes)  # of one row each
    return one.withColumn("passed", (F.col("failure_count") == 0) & (F.col("valid_prediction_unit_count") == F.col("source_unit_count")))


# -- evaluation -------------------------------------------------------------


def side(rows: DataFrame) -> dict[str, DataFrame]:
    """Rows with unit_id, entities and relations as ``evaluate`` and ``compare_experts`` take them: ``units``, and ``entities`` and ``relations`` with a row for each mention."""
    of = lambda field, key: rows.select("unit_id", F.explode(field).alias("x")).select("unit_id", *(F.col(f"x.{c}").alias(c) for c in (*key[1:], "evidence_span_ids")))
    return {"units": rows, "entities": of("entities", ENTITY_KEY), "relations": of("relations", RELATION_KEY)}


def _mentions(left: DataFrame, right: DataFrame, field: str, tasks: int | None, *also: Column) -> DataFrame:
    """Mentions of both sides (in_gold, in_pred), names with white space folded, a unit's in one task: all that follows within a unit needs no other shuffle."""
    key = ENTITY_KEY if field == "entities" else RELATION_KEY
    named = [T.normalize_space(F.coalesce(F.col(c), F.lit(""))).alias(c) if c.endswith("name") else F.coalesce(F.col(c), F.lit("")).alias(c) for c in key[1:]]
    one = lambda m, k: m.select("unit_id", *named, *also, F.lit(k == 0).alias("in_gold"), F.lit(k == 1).alias("in_pred"))
    both = one(left, 0).union(one(right, 1))
    return both.repartition(tasks, "unit_id") if tasks else both.repartition("unit_id")


def _both() -> list[Column]:
    return [F.bool_or(c).alias(c) for c in ("in_gold", "in_pred")]


def keys_of(left: DataFrame, right: DataFrame, field: str, tasks: int | None = None) -> DataFrame:
    """Distinct semantic keys of the mentions of two sides, with in_gold and in_pred."""
    return _mentions(left, right, field, tasks).groupBy(*(ENTITY_KEY if field == "entities" else RELATION_KEY)).agg(*_both())


def evidence_of(left: DataFrame, right: DataFrame, field: str, tasks: int | None = None) -> DataFrame:
    """``keys_of`` with ``overlap`` and ``same``: whether a key of both sides has evidence in common, and the same evidence. Sides are told of each piece of evidence, so that no sets are collected."""
    key = ENTITY_KEY if field == "entities" else RELATION_KEY
    each = _mentions(left, right, field, tasks, F.explode_outer("evidence_span_ids").alias("e")).groupBy(*key, "e").agg(*_both())
    here, there, known = F.col("in_gold"), F.col("in_pred"), F.col("e").isNotNull()
    sides = F.bool_or("in_gold") & F.bool_or("in_pred")
    return each.groupBy(*key).agg(*_both(), F.bool_or(known & here & there).alias("overlap"), (sides & F.bool_and(~known | (here == there))).alias("same"))


def _checked(units: DataFrame, gold: DataFrame, predictions: DataFrame) -> None:
    """Raises unless the three have the same unit ids, each once, and gold is of this ontology; one pass over the ids finds whether all is well."""
    old = F.coalesce("ontology_version", F.lit("")) != annotate.ONTOLOGY_VERSION
    ids = [df.select("unit_id", *(F.lit(int(k == j)).alias(f"n{j}") for j in range(3)), (old if k == 1 else F.lit(False)).alias("old")) for k, df in enumerate((units, gold, predictions))]
    met = reduce(DataFrame.union, ids).groupBy("unit_id").agg(*(F.sum(f"n{j}").alias(f"n{j}") for j in range(3)), F.bool_or("old").alias("old"))
    if met.where("n0 <> 1 OR n1 <> 1 OR n2 <> 1 OR old").isEmpty():
        return
    for other in (gold, predictions):
        validation.one_to_one(units.select("unit_id"), other.select("unit_id", F.lit(1).alias("_x")), "unit_id")
    raise ValueError("gold annotations use a different ontology version")


def _units_wrong(about: DataFrame, flags: dict[str, DataFrame]) -> DataFrame:
    """``about`` with e and r: whether all entities and all relations of a unit are on both sides."""
    off = [f.where("in_gold <> in_pred").select("unit_id", F.lit(k == "entities").alias("_e"), F.lit(k == "relations").alias("_r")) for k, f in flags.items()]
    off = reduce(DataFrame.union, off).groupBy("unit_id").agg(F.bool_or("_e").alias("_e"), F.bool_or("_r").alias("_r"))
    ok = lambda c: ~F.coalesce(c, F.lit(False))
    return about.join(off, "unit_id", "left").select(*about.columns, ok("_e").alias("e"), ok("_r").alias("r"))


def evaluate(units: DataFrame, gold: DataFrame | dict[str, DataFrame], predictions: DataFrame | dict[str, DataFrame], tasks: int | None = None) -> dict[str, DataFrame]:
    """All figures of predictions against gold over UNIT rows, as small tables; raises unless the three have the same unit ids, each once, and gold is of this ontology.

    Gold and predictions have arrays of entities and relations, or come as
    ``side`` gives them; mentions of other units don't count. ``tasks``: into
    how many tasks the mentions go, as the session sets where not given.

    ``entities`` and ``relations``: counts, precision, recall, F1 and false
    discovery rate overall, by type, standard and unit type. ``macro_f1``: the
    mean over relation types. ``evidence``: of keys on both sides, how many
    have evidence in common or the same. ``exact``: units all of whose entities
    or relations agree. ``paths``: formulas with all inputs and outputs, indicators with their
    formulas, and edges of units, sources and quality rules. ``errors``: every
    key on one side alone.
    """
    g, p = (x if isinstance(x, dict) else side(x) for x in (gold, predictions))
    _checked(units, g["units"], p["units"])
    about = units.select("unit_id", F.col("provenance.standard_code").alias("standard_code"), "unit_type")
    out: dict[str, DataFrame] = {}
    errors, evidence, keys = [], [], {}
    for field, key, kind in (("entities", ENTITY_KEY, "entity_type"), ("relations", RELATION_KEY, "relation_type")):
        keys[field] = keys_of(g[field], p[field], field, tasks)
        flags = keys[field].join(about, "unit_id")
        out[field] = evaluation.by_dimensions(flags, [kind, "standard_code", "unit_type"])
        one = field[:-1] if field == "relations" else "entity"
        errors.append(flags.where("in_gold <> in_pred").select(F.concat(F.lit(f"{one}_false_"), F.when(F.col("in_gold"), "negative").otherwise("positive")).alias("error_type"), F.array(*(F.col(c) for c in key)).alias("key")))
        m, over, same = F.count_if(F.col("in_gold") & F.col("in_pred")), F.count_if("overlap"), F.count_if("same")
        rate = lambda x: F.round(F.try_divide(x, m), 6)  # noqa: B023, E731
        seen = evidence_of(g[field], p[field], field, tasks).join(about.select("unit_id"), "unit_id")
        evidence.append(seen.agg(F.lit(field).alias("field"), m.alias("matched"), over.alias("overlap"), rate(over).alias("overlap_accuracy"), same.alias("exact"), rate(same).alias("exact_rate")))
        if field == "relations":
            out["macro_f1"] = out[field].where("dimension = 'relation_type'").agg(F.coalesce(F.round(F.avg("f1"), 6), F.lit(0.0)).alias("macro_f1"))
            out["paths"] = _paths_report(flags)
    both_ok = F.count_if(F.col("e") & F.col("r"))
    out["exact"] = _units_wrong(about, keys).agg(F.count("*").alias("units"), F.count_if("e").alias("entity_exact"), F.count_if("r").alias("relation_exact"), both_ok.alias("both_exact"), F.round(F.try_divide(both_ok, F.count("*")), 6).alias("both_exact_rate"))
    out["evidence"], out["errors"] = evidence[0].union(evidence[1]), errors[0].union(errors[1])
    return out


def _paths_report(flags: DataFrame) -> DataFrame:
    """(path, applicable, complete, rate): gold groups all of whose edges are predicted; for single edges recall. All paths in one pass: each edge counts at one node of its unit, has_indicator at its tail and the others at their head."""
    g, hit, kind = flags.where("in_gold"), F.col("in_pred"), lambda r: F.col("relation_type") == r
    node = [F.when(kind("has_indicator"), F.col(f"tail_{x}")).otherwise(F.col(f"head_{x}")).alias(f"node_{x}") for x in ("name", "type")]
    n, h = (lambda r: F.count_if(kind(r)).alias(f"n_{r}")), (lambda r: F.count_if(kind(r) & hit).alias(f"h_{r}"))
    kinds = ("has_input", "has_output", "has_indicator", "calculated_by", "has_unit", "sourced_from", "constrained_by")
    per = g.groupBy("unit_id", *node).agg(*(f(r) for r in kinds for f in (n, h)))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    whole = lambda r: (F.count_if(F.col(f"n_{r}") > 0), F.count_if((F.col(f"n_{r}") > 0) & (F.col(f"n_{r}") == F.col(f"h_{r}"))))
    edges = lambda r, ok=F.lit(True): (total(f"n_{r}"), total(F.when(ok, F.col(f"h_{r}"))))
    paths = {
        "formula_input_complete": whole("has_input"), "formula_output_complete": whole("has_output"), "indicator_formula_complete": edges("calculated_by", F.col("n_has_indicator") == F.col("h_has_indicator")),
        "explicit_unit_edges": edges("has_unit"), "explicit_source_edges": edges("sourced_from"), "quality_constraint_edges": edges("constrained_by"),
    }
    row = lambda path, n, whole: F.struct(F.lit(path).alias("path"), n.alias("applicable"), whole.alias("complete"), F.round(F.try_divide(whole, n), 6).alias("rate"))
    return per.agg(F.array(*(row(path, *x) for path, x in paths.items())).alias("x")).select(F.explode("x").alias("x")).select("x.*")


# -- experts ----------------------------------------------------------------

EXPERT_FAILURE = "unit_id string, failure string, detail string"


def check_expert(unit: dict, annotation: dict, annotator: str) -> list[dict]:
    out: list[dict] = []
    fail = lambda failure, detail="": out.append({"unit_id": unit["unit_id"], "failure": failure, "detail": str(detail)})
    name = lambda x: " ".join(str(x).split())
    spans = set(annotate.all_spans(unit))
    bad = lambda x: not x.get("evidence_span_ids") or not set(x["evidence_span_ids"]) <= spans
    if annotation.get("annotator_id") != annotator:
        fail("annotator_id", annotation.get("annotator_id"))
    entities, relations = annotation.get("entities") or [], annotation.get("relations") or []
    keys = {(name(e["name"]), e["entity_type"]) for e in entities}
    if len(keys) != len(entities):
        fail("duplicate_entity")
    for e in entities:
        if e["entity_type"] not in annotate._TYPES:
            fail("invalid_entity_type", e["entity_type"])
        if bad(e):
            fail("invalid_entity_evidence", e["name"])
    links = [(name(r["head_name"]), r["head_type"], r["relation_type"], name(r["tail_name"]), r["tail_type"]) for r in relations]
    if len(set(links)) != len(links):
        fail("duplicate_relation")
    for link, r in zip(links, relations):
        if why := annotate.legal(r["head_type"], r["relation_type"], r["tail_type"]):
            fail("invalid_relation_schema", why)
        if not {link[:2], link[3:]} <= keys:
            fail("relation_endpoint_missing", link)
        if bad(r):
            fail("invalid_relation_evidence", link)
    return out


def validate_experts(units: DataFrame, annotations: DataFrame, annotator: str) -> DataFrame:
    """EXPERT_FAILURE rows of an expert's annotations (unit_id, annotator_id, entities, relations) of UNIT rows, missing and unknown units among them; none if all is well."""
    u, a = units.select("unit_id", F.struct(*units.columns).alias("unit")), annotations.select(F.col("unit_id"), F.struct(*annotations.columns).alias("annotation"))
    rows = u.join(a, "unit_id")
    found = by_row(rows.select("unit", "annotation"), lambda r: check_expert(r["unit"], r["annotation"], annotator), EXPERT_FAILURE)
    lost = validation.reconcile(units, annotations, "unit_id").select("unit_id", F.lit("unit_order_or_inventory").alias("failure"), F.col("code").alias("detail"))
    return found.union(lost)


def compare_experts(units: DataFrame, left: DataFrame | dict[str, DataFrame], right: DataFrame | dict[str, DataFrame], tasks: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of two experts: agreement of entities and relations over all units (also those in which neither found any), agreement by standard, and every key that one alone has. Sides and ``tasks`` are those of ``evaluate``."""
    x, y = (z if isinstance(z, dict) else side(z) for z in (left, right))
    about = units.select("unit_id", F.col("provenance.standard_code").alias("standard_code"))
    rows, off, keys = [], [], {}
    for field, key in (("entities", ENTITY_KEY), ("relations", RELATION_KEY)):
        keys[field] = keys_of(x[field], y[field], field, tasks)
        per = keys[field].groupBy("unit_id").agg(F.count_if("in_gold").alias("a"), F.count_if("in_pred").alias("b"), F.count_if(F.col("in_gold") & F.col("in_pred")).alias("c"))
        per = about.select("unit_id").join(per, "unit_id", "left").na.fill(0)
        same = (F.col("a") == F.col("c")) & (F.col("b") == F.col("c"))
        a, b, c = F.sum("a"), F.sum("b"), F.sum("c")
        p, r = F.coalesce(F.try_divide(c, a), F.lit(1.0)), F.coalesce(F.try_divide(c, b), F.lit(1.0))
        rows.append(per.agg(F.lit(field).alias("field"), c.alias("shared"), a.alias("left_count"), b.alias("right_count"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"), F.count_if(same).alias("exact_units"), F.round(F.try_divide(F.count_if(same), F.count("*")), 6).alias("exact_unit_rate")))
        lone = keys[field].where("in_gold <> in_pred").join(about.select("unit_id"), "unit_id")
        off.append(lone.select("unit_id", F.lit(field).alias("field"), F.when(F.col("in_gold"), "left").otherwise("right").alias("side"), F.array(*(F.col(k) for k in key[1:])).alias("key")))
    each = F.count_if(F.col("e") & F.col("r"))
    by = _units_wrong(about, keys).groupBy("standard_code").agg(F.count("*").alias("units"), F.count_if("e").alias("entity_exact"), F.count_if("r").alias("relation_exact"), each.alias("both_exact"), F.round(F.try_divide(each, F.count("*")), 6).alias("both_exact_rate"))
    return rows[0].union(rows[1]), by, off[0].union(off[1])


# -- packages ---------------------------------------------------------------


def package(units: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blind, gold, removed): UNIT rows as JSON text without what tells the answer, by split; annotations with the split; and the paths taken out.

    Raises for empty input, units with answers in them (columns of BLIND_KEYS
    that are more than a note on review), and unless unit ids match one to one.
    """
    if units.isEmpty() or annotations.isEmpty():
        raise ValueError("source units and annotations must not be empty")
    if bad := [c for c in units.columns if c in ANSWERS]:
        raise ValueError("source unit input contains answer payload fields: " + ", ".join(bad))
    split = annotate.unit_split(units).select("unit_id", "split", F.to_json(F.struct(*units.columns)).alias("raw"))
    rows = validation.one_to_one(split, annotations.drop("split"), "unit_id")
    clean = T.sanitized("raw", BLIND_KEYS)
    blind = rows.select("unit_id", "split", clean.alias("c"))
    removed = blind.select("split", "unit_id", F.explode("c.removed").alias("path"))
    blind = blind.select("unit_id", "split", F.col("c.value").alias("value"))
    assert_blind(blind)
    return blind, rows.select(*annotations.drop("split").columns, "split"), removed


def package_manifest(units: DataFrame, gold: DataFrame, dataset_version: str = "v2.1", gold_nature: str = "ai_expert_pre_gold") -> dict:
    """Counts by split and standard, and an id that follows from them; a handful of rows reach the driver."""
    from tessera.operators.extraction import digest

    counts = {r["split"]: r for r in gold.groupBy("split").agg(F.count("*").alias("units"), F.sum(F.size("entities")).alias("entities"), F.sum(F.size("relations")).alias("relations")).collect()}
    of = lambda k: {s: int(counts[s][k]) if s in counts else 0 for s in ("train", "dev", "test")}
    return {
        "schema_version": PACKAGE_VERSION, "package_id": annotate.stable_id(PACKAGE_VERSION, dataset_version, digest(of("units")), digest(of("relations"))), "dataset_version": dataset_version, "gold_nature": gold_nature,
        "human_expert_review_required_for_publication": gold_nature != "human_expert_gold", "ontology_version": annotate.ONTOLOGY_VERSION, "split_policy_version": SPLIT_POLICY,
        "source_unit_count": sum(of("units").values()), "standard_counts": dict(sorted((r[0], r[1]) for r in units.groupBy("provenance.standard_code").count().collect())),
        "unit_split_counts": of("units"), "entity_split_counts": of("entities"), "relation_split_counts": of("relations"),
    }
