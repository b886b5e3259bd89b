"""What keeps a job's figures in proportion to its input: rows spread over tasks, one pass over documents, expressions worked out once, memory by the shuffle's partitions."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessera import shared
from tessera.operators import annotate as A
from tessera.operators import contract, evaluation, gates, graph, layout, units
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()



def test_rows_of_a_small_file_are_spread(spark, tmp_path):
    spark.range(3000).withColumn("v", F.col("id") % 7).coalesce(1).write.parquet(f"{tmp_path}/x")
    x = spark.read.parquet(f"{tmp_path}/x")
    assert x.rdd.getNumPartitions() == 1
    assert shared.spread(x, "id").rdd.getNumPartitions() == min(12, 3 * spark.sparkContext.defaultParallelism) and shared.spread(x, "id", most=100).rdd.getNumPartitions() >= 30
    assert sorted(map(tuple, shared.spread(x, "id").collect())) == sorted(map(tuple, x.collect())) and shared.spread(x.limit(0), "id").count() == 0
    assert catalog.raw_documents(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > 1
    assert "RepartitionByExpression" in plan(catalog.QUERIES["column_name_dedup"](spark, SF))


def test_documents_are_worked_through_once(spark):
    """Units, annotations and the formulas' rules straight from RAW are those of the single steps, in one pass without a join."""
    raw = catalog.raw_documents(spark, SF).limit(40)
    u = units.source_units(units.layouts(raw))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(units.raw_units(raw)) == rows(u)
    a = A.annotations(u)
    assert rows(A.raw_annotations(raw)) == rows(a)
    assert rows(gates.raw_formula_paths(raw)) == rows(gates.gold_formula_paths(u, a))
    for name in ("layout_tables", "source_units", "gold_formula_rules", "gold_entities", "gold_triples"):
        p = plan(catalog.QUERIES[name](spark, SF))
        assert p.count("MapInArrow") == 1 and "Join" not in p, name


def test_column_names_are_worked_out_once(spark):
    df = spark.createDataFrame([([["a", None, "b", "b"], ["x", "y", "b", None]],), ([["", " "], [None, "q"]],), ([],)], "r array<array<string>>")
    names = df.select(layout.column_names(F.col("r")).alias("n"))
    assert [r.n for r in names.limit(2).collect()] == [["a / x", "a / y", "b", "b_2"], ["column_1", "q"]]
    assert plan(names).count("r#") < 8  # each mention of the rows is worked out in full


def test_evidence_of_a_triple_is_distinct_before_it_is_collected(spark):
    a = A.raw_annotations(catalog.raw_documents(spark, SF).limit(30))
    t = A.gold_triples(a)
    assert "array_distinct(transform(array_sort" not in plan(t.select("evidence"))
    once, twice = ({r.triple_id: r.evidence for r in A.gold_triples(x).collect()} for x in (a, a.union(a)))
    assert once == twice and any(len(e) > 1 for e in once.values())


def test_rows_of_arrow_columns():
    kind = pa.struct([("a", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.string())]))), ("m", pa.map_(pa.string(), pa.list_(pa.int32()))), ("b", pa.bool_())])
    rows = [{"a": [{"x": 1.5, "y": "é"}, None, {"x": None, "y": None}], "m": [("k", [1, None]), ("l", None)], "b": True}, None, {"a": None, "m": None, "b": None}, {"a": [], "m": [], "b": False}, {"a": [{"x": 2.0, "y": ""}], "m": [("z", [7])], "b": None}]
    t = pa.array(rows, kind)
    for part in (t, t.slice(1), t.slice(2, 3), t.slice(0, 0), t.slice(4)):
        assert units.plain(part) == part.to_pylist(maps_as_pydicts="lossy")


def test_figures_of_predictions_without_sets_or_joins_of_keys(spark):
    """Each unit's mentions meet in one task: no evidence is collected to lists, all paths come of one pass, and the only join is that with the units."""
    rows = catalog._order_rows(spark, SF)
    out = contract.evaluate(*rows)
    for name, joins in (("entities", 1), ("relations", 1), ("paths", 1), ("evidence", 2), ("errors", 2), ("exact", 1)):
        p = plan(out[name])
        assert "collect_" not in p and p.count("Join ") == joins, name
    assert plan(contract.compare_experts(*rows)[1]).count("Join ") == 1
    assert shared.tasks(spark.range(10), most=1) == 10 and shared.tasks(spark.range(10)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_evidence_and_paths_of_odd_mentions(spark):
    """Empty evidence of both sides is the same, null pieces count as none; mentions of other units don't count; an indicator's own edges above decide."""
    u = spark.createDataFrame([("a", ("s",), "t"), ("b", ("s",), "t")], "unit_id string, provenance struct<standard_code: string>, unit_type string")
    e = "unit_id string, name string, entity_type string, evidence_span_ids array<string>"
    r = "unit_id string, head_name string, head_type string, relation_type string, tail_name string, tail_type string, evidence_span_ids array<string>"
    ids = u.select("unit_id", F.lit(A.ONTOLOGY_VERSION).alias("ontology_version"))
    edge = lambda h, kind, t, unit="a": (unit, h, "k", kind, t, "k", ["1"])
    calc = [edge("i", "calculated_by", "f"), edge("j", "calculated_by", "f"), edge("s", "has_indicator", "i"), edge("t", "has_indicator", "i"), edge("f", "has_input", "x"), edge("f", "has_input", "y"), edge("f", "has_unit", "m", "other")]
    side = lambda entities, relations: {"units": ids, "entities": spark.createDataFrame(entities, e), "relations": spark.createDataFrame(relations, r)}
    gold = side([("a", "x", "k", []), ("a", "y", "k", ["1", "2"]), ("a", " y ", "k", ["2", None]), ("a", "z", "k", ["1"]), ("b", "w", "k", None), ("other", "x", "k", ["1"])], calc)
    pred = side([("a", "x", "k", None), ("a", "y", "k", ["2"]), ("a", "z", "k", ["1", None]), ("b", "v", "k", []), ("other", "x", "k", ["1"])], [x for x in calc if x[1] != "t" and x[4] != "y"])
    out = contract.evaluate(u, gold, pred)
    assert tuple(out["evidence"].where("field = 'entities'").first()) == ("entities", 3, 2, 0.666667, 2, 0.666667)
    assert {x.path: (x.applicable, x.complete) for x in out["paths"].collect()} == {
        "formula_input_complete": (1, 0), "formula_output_complete": (0, 0), "indicator_formula_complete": (2, 1), "explicit_unit_edges": (0, 0), "explicit_source_edges": (0, 0), "quality_constraint_edges": (0, 0),
    }
    assert tuple(out["exact"].first()) == (2, 1, 1, 0, 0.0) and {tuple(x.key) for x in out["errors"].where("error_type LIKE 'entity%'").collect()} == {("b", "w", "k"), ("b", "v", "k")}


def test_predictions_are_read_in_one_pass_beside_their_units(spark):
    """One shuffle brings units and predictions together, in as many tasks as asked for, and nothing is kept of a task but the group at hand."""
    text = lambda *rows: spark.createDataFrame([(x,) for x in rows], "value string")
    u = text('{"unit_id": "b", "v": 2}', '{"unit_id": "a", "unit_type": "t", "provenance": {"standard_code": "s"}}', '{"unit_id": "b", "v": 1}', "{}")
    p = text('{"unit_id": "b"}', '{"unit_id": "b"}', '{"unit_id": "c"}', '{"unit_id": "a", "x": [{"triple_id": 1}]}')
    failures, valid = contract.validate_predictions(u, p, tasks=3)
    for df in (failures, valid):
        assert plan(df).count("RepartitionByExpression") == 1 and "Join" not in plan(df) and "Aggregate" not in plan(df) and df.rdd.getNumPartitions() == 3
    got = {(x.unit_id, x.code, x.message) for x in failures.where("code LIKE '%_units'").collect()}
    assert got == {("b", "duplicate_source_units", "duplicate source units"), ("b", "duplicate_prediction_units", "duplicate prediction units"), ("c", "extra_prediction_units", "extra prediction units"), ("", "missing_prediction_units", "missing prediction units")}
    assert valid.count() == 0 and [x.field for x in failures.where("code = 'gold_field_leakage'").collect()] == ["$.x[0].triple_id"]
    assert catalog._json_tasks(spark, SF) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_complete_groups_meet_once(spark):
    """Gold and predictions in one shuffle by group, without a join; predicted edges of no gold and null keys are no edges of a group."""
    edges = lambda *rows: spark.createDataFrame(rows, "g int, x int")
    gold, pred = edges((1, 1), (1, 2), (1, 2), (2, 1), (3, None), (4, 1), (4, 2)), edges((1, 1), (1, 2), (1, 9), (2, 2), (3, None), (4, 1), (5, 1))
    out = evaluation.complete_groups(gold, pred, ["g", "x"], ["g"], 2)
    assert tuple(out.first()) == (4, 1, 0.25) and "Join" not in plan(out) and plan(out).count("RepartitionByExpression") == 1
    assert tuple(evaluation.complete_groups(gold.limit(0), pred, ["g", "x"], ["g"]).first()) == (0, 0, None)


def test_texts_are_counted_in_pieces_of_bounded_size():
    """Long texts are counted a few at a time, one over the bound alone; no row is lost, and the pieces' rows are those of all rows together."""
    texts = ["ab " * n for n in (10, 200_000, 5, 60_000, 60_000, 3)] + [None, ""] + ["x y"] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["key", "text"])
    pieces = list(graph._pieces(batch))
    assert [t for p in pieces for t in p.column(1).to_pylist()] == texts and all(p.num_rows <= 128 for p in pieces)
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= graph.PIECE for p in pieces)
    got = sorted((r["key"], r["term"], r["tf"]) for out in graph._counted(["ab", "x"])([batch]) for r in out.to_pylist())
    assert (1, "ab", 400_000) in got and got == sorted((k, t, n) for k, x in enumerate(texts) for t, n in graph.query_terms(x or "").items() if t in ("ab", "x"))
    assert list(graph._pieces(batch.slice(0, 0))) == []
