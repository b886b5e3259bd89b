"""Quality gates: pages that were read by hand, invariants of all pages and units, paths of gold, and splits.

A gate is a table of checks (check, passed, expected, actual, failures); it
passes if there are checks and all do.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import annotate, ontology
from tessera.operators.units import by_row, each_unit, formula_number

CHECK = "check string, passed boolean, expected string, actual string"
CASES = "case_id string, standard_code string, pdf_page int, check string, passed boolean, expected string, actual string"
CODES = [f"HJ {n}-2021" for n in range(1166, 1177)]


def _check(name: str, passed: object, expected: object, actual: object) -> dict:
    show = lambda x: x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True)
    return {"check": name, "passed": bool(passed), "expected": show(expected), "actual": show(actual)}


def valid_box(box: object, page: dict) -> bool:
    """Four numbers, left before right and top before bottom, in the page but for one point."""
    good = isinstance(box, list) and len(box) == 4 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in box)
    return good and 0 <= box[0] < box[2] <= page["width"] + 1 and 0 <= box[1] < box[3] <= page["height"] + 1


def _whole(source: dict) -> bool:
    return all(source.get(k) is not None for k in ("table_id", "page", "row_index", "bbox"))


def page_checks(doc: dict, units: list[dict], case: dict) -> list[dict]:
    """The checks of a page that someone has read: its headings, formulas, tables, fragments and units against ``case``."""
    number = int(case["pdf_page"])
    pages = {p["page"]: p for p in doc["pages"]}
    if (page := pages.get(number)) is None:
        return [_check("page_exists", False, number, "missing")]
    lines, given = page["lines"], lambda k: case.get(k) or []
    text, out = "\n".join(x["text"] for x in lines), []
    exact = lambda name, expected, actual: out.append(_check(name, expected == actual, expected, actual))
    none = lambda name, found: exact(name, [], found)
    exact("heading_sections_exact", given("expected_heading_sections"), [x["section"] for x in lines if x["kind"] == "heading"])
    exact("formula_numbers_exact", given("expected_formula_numbers"), [n for x in lines if x["kind"] == "formula" and (n := formula_number(x["text"]))])
    exact("table_count_exact", int(case.get("expected_table_count") or 0), len(page["tables"]))
    lost = [x for x in given("text_fragments") if x not in text]
    out.append(_check("manual_text_fragments", not lost, given("text_fragments"), {"missing": lost}))
    none("symbol_font_normalized", sorted({f"U+{ord(c):04X}" for c in text if 0xE000 <= ord(c) <= 0xF8FF}))
    order = [x["reading_order"] for x in lines]
    out.append(_check("reading_order_stable", order == sorted(set(order)), "strictly increasing", order))
    none("line_coordinates_valid", [x["line_id"] for x in lines if not valid_box(x["bbox"], page)])

    here = [u for u in units if number in (u["provenance"]["pages"] or [])]
    none("source_unit_coordinates_valid", [s["span_id"] for u in here for s in u["provenance"]["evidence_spans"] if s["page"] == number and not valid_box(s["bbox"], page)])
    packages = [u for u in units if u["unit_type"] == "formula_package" and any(f["evidence_span"]["page"] == number for f in u["formulas"])]
    on_page = [f for u in packages for f in u["formulas"] if f["evidence_span"]["page"] == number]
    exact("formula_anchors_packaged", given("expected_formula_numbers"), [f["formula_number"] for f in on_page])
    kinds = sorted({u["unit_type"] for u in here})
    out.append(_check("required_source_unit_types", set(given("required_unit_types")) <= set(kinds), given("required_unit_types"), kinds))
    if title := case.get("table_title_contains"):
        titles = [t["title"] for t in page["tables"]]
        out.append(_check("table_title_recovered", any(title in t for t in titles), title, titles))
    if case.get("require_continued_table"):
        links = [t["continued_from_table_id"] for t in page["tables"] if t["continued_from_table_id"]]
        out.append(_check("cross_page_table_link", links, "a table goes on", links))
    records = [u for u in units if u["unit_type"] == "table_record" and u["provenance"]["pages"] == [number]]
    none("table_headers_not_emitted_as_records", [r["unit_id"] for r in records if r["cells"] and all(v == k for k, v in r["cells"].items())])
    cells = [(r, c, (r["inherited_from"] or {}).get(c) or {}) for r in records for c, v in r["cells"].items() if v is not None]
    at = lambda s: pages.get(int(s.get("page") or number))
    none("table_cell_coordinates_valid", [f"{r['unit_id']}:{c}" for r, c, s in cells if at(s) is None or not valid_box(r["cell_bboxes"].get(c), at(s))])
    none("merged_cell_sources_recorded", [f"{r['unit_id']}:{c}" for r in records for c, s in (r["inherited_from"] or {}).items() if not _whole(s)])
    for k, a in enumerate(given("table_assertions"), 1):
        matches = [r for r in records if all(r["cells"].get(c) == v for c, v in (a.get("match") or {}).items())]
        fits = lambda r: all(r["cells"].get(c) == v for c, v in (a.get("expect") or {}).items()) and all(v in (r["cells"].get(c) or "") for c, v in (a.get("expect_contains") or {}).items())  # noqa: B023, E731
        out.append(_check(f"table_row_alignment_{k}", any(map(fits, matches)), a, {"matched_records": len(matches)}))
    for k, a in enumerate(given("formula_variable_assertions"), 1):
        found = sorted({v["symbol"] for u in packages if any(f["formula_number"] == a["formula_number"] for f in u["formulas"]) for v in u["variable_definitions"]})
        out.append(_check(f"formula_variables_{k}", set(a.get("required_symbols") or []) <= set(found), a.get("required_symbols") or [], found))
    for k, a in enumerate(given("formula_expression_assertions"), 1):
        said = [f["expression_text"] for f in on_page if f["formula_number"] == a["formula_number"]]
        lost = [x for x in a.get("required_fragments") or [] if x not in "\n".join(said)]
        out.append(_check(f"formula_expression_symbols_{k}", said and not lost, a.get("required_fragments") or [], {"missing": lost}))
    manual = given("expected_manual_formula_numbers")
    if manual:
        typed = sorted(f["formula_number"] for u in units if u.get("manual_transcription") and number in u["provenance"]["pages"] for f in u["formulas"])
        out.append(_check("manual_formula_override_verified", set(manual) <= set(typed), manual, typed))
    return out


def acceptance(layout: DataFrame, units: DataFrame, cases: DataFrame) -> DataFrame:
    """CASES rows: the checks of each case (case_id, standard_code, pdf_page, ``config`` as JSON text) against LAYOUT and UNIT rows of its document.

    Documents and their units meet their cases in joins by standard_code; a
    case of a document that isn't there fails.
    """
    grouped = units.groupBy(F.col("provenance.standard_code").alias("standard_code")).agg(F.collect_list(F.struct(*units.columns)).alias("units"))
    rows = cases.join(layout.select("standard_code", F.struct("pages").alias("doc")), "standard_code", "left").join(grouped, "standard_code", "left")

    def one(r: dict) -> list[dict]:
        of = {k: r[k] for k in ("case_id", "standard_code", "pdf_page")}
        case = json.loads(r["config"]) | of
        units = sorted(r["units"] or [], key=lambda u: u.get("seq") or 0)
        found = page_checks(r["doc"], units, case) if r["doc"] else [_check("document_exists", False, r["standard_code"], "missing")]
        return [{**of, **c} for c in found]

    return by_row(rows, one, CASES)


def case_report(checked: DataFrame) -> DataFrame:
    """One row: whether all cases passed, and counts of cases and checks."""
    per = checked.groupBy("case_id").agg(F.bool_and("passed").alias("ok"), F.count("*").alias("n"), F.count_if("passed").alias("good"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("passed"), F.count("*").alias("case_count"), F.count_if("ok").alias("passed_case_count"), total("n").alias("check_count"), total("good").alias("passed_check_count"))


# -- invariants -------------------------------------------------------------

_FOUND = "kind string, detail string"


def document_faults(doc: dict) -> list[dict]:
    """(kind, detail) of everything wrong with a laid-out document; numbers of pages and lines as kinds of their own."""
    out, ids, code = [], set(), doc["standard_code"]
    fault = lambda kind, detail: out.append({"kind": kind, "detail": detail})
    if [p["page"] for p in doc["pages"]] != list(range(1, len(doc["pages"]) + 1)):
        fault("page_sequence", code)
    for p in doc["pages"]:
        where, lines = f"{code}:p{p['page']}", p["lines"]
        order, own = [x["reading_order"] for x in lines], [x["line_id"] for x in lines]
        if order != sorted(set(order)):
            fault("reading_order", where)
        if len(set(own)) != len(own) or ids & set(own):
            fault("line_id_uniqueness", where)
        ids |= set(own)
        for x in lines:
            if not valid_box(x["bbox"], p):
                fault("coordinates", f"{where}:{x['line_id']}")
            for c in x["text"]:
                if 0xE000 <= ord(c) <= 0xF8FF:
                    fault("private_use", f"U+{ord(c):04X}")
        for t in p["tables"]:
            boxes = t["cell_bboxes"]
            wrong = not valid_box(t["bbox"], p) or len(boxes) != len(t["rows"]) or any(len(b) != len(r) for b, r in zip(boxes, t["rows"]))
            if wrong or any(b is not None and not valid_box(b, p) for row in boxes for b in row):
                fault("coordinates", f"{where}:{t['table_id']}")
    return out


def unit_faults(unit: dict, pages: dict[int, dict] | None) -> list[dict]:
    """(kind, detail): evidence that isn't there, cells without a box, inheritance without a source. ``pages``: of the unit's document, by number, with width, height and line ids."""
    out, who = [], unit["unit_id"]
    fault = lambda kind, detail: out.append({"kind": kind, "detail": detail})
    if pages is None:
        return [{"kind": "evidence", "detail": f"{who}: unknown standard"}]
    spans = annotate.all_spans(unit)
    if not spans:
        fault("evidence", f"{who}: none")
    for s in spans.values():
        page = pages.get(s["page"])
        if page is None or not valid_box(s["bbox"], page) or not set(s.get("line_ids") or []) <= set(page["line_ids"]):
            fault("evidence", f"{who}:{s['span_id']}")
    if unit["unit_type"] == "table_record":
        boxes = unit.get("cell_bboxes") or {}
        for c in [c for c, v in (unit.get("cells") or {}).items() if v is not None and c not in boxes] + [c for c, s in (unit.get("inherited_from") or {}).items() if not _whole(s)]:
            fault("table_record", f"{who}:{c}")
    return out


def _gate(counts: DataFrame, rules: list[tuple[str, object, object, object]]) -> DataFrame:
    """CHECK rows from one row of counts: name, whether it passes, expected, actual."""
    show = lambda x: (x if not isinstance(x, (str, int, list)) else F.lit(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False))).cast("string")
    each = [F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"), show(e).alias("expected"), show(a).alias("actual")) for n, ok, e, a in rules]
    return counts.select(F.explode(F.array(*each)).alias("c")).select("c.*")


def invariants(layout: DataFrame, units: DataFrame, manifest: DataFrame, codes: list[str] = CODES, pages: int | None = None, formulas: int | None = None, unit_count: int | None = None, manual: int | None = None) -> DataFrame:
    """CHECK rows over all documents, pages and units; a number that isn't given is not held against the data.

    ``manifest`` has standard_code, source_sha256, page_count, pages, lines
    and tables of each document. Faults are found by document and by unit, and
    counted; units meet the pages of their documents in a join.
    """
    faults = by_row(layout, document_faults, _FOUND)
    known = layout.select(
        "standard_code",
        F.transform("pages", lambda p: F.struct(p["page"].alias("page"), p["width"].alias("width"), p["height"].alias("height"), F.transform(p["lines"], lambda x: x["line_id"]).alias("line_ids"))).alias("pages"),
    )
    joined = units.select(F.struct(*units.columns).alias("unit")).join(known, F.col("unit.provenance.standard_code") == F.col("standard_code"), "left").select("unit", "pages")
    faults = faults.union(by_row(joined, lambda r: unit_faults(r["unit"], None if r["pages"] is None else {p["page"]: p for p in r["pages"]}), _FOUND))
    n = {k: F.count_if(F.col("kind") == k).alias(f"f_{k}") for k in ("page_sequence", "reading_order", "line_id_uniqueness", "coordinates", "private_use", "evidence", "table_record")}
    found = faults.agg(*n.values())
    size = layout.select(F.size("pages").alias("p"), F.size(F.flatten(F.transform("pages", lambda p: p["lines"]))).alias("l"), F.size(F.flatten(F.transform("pages", lambda p: p["tables"]))).alias("t"), "standard_code")
    held = manifest.select("standard_code", "source_sha256", *(F.col(c).alias(f"m_{c}") for c in ("page_count", "pages", "lines", "tables"))).join(size, "standard_code", "full")
    differs = ~(F.col("m_pages").eqNullSafe(F.col("p")) & F.col("m_lines").eqNullSafe(F.col("l")) & F.col("m_tables").eqNullSafe(F.col("t")))
    docs = held.agg(
        F.array_sort(F.collect_list("standard_code")).alias("codes"), F.countDistinct("source_sha256").alias("hashes"), F.count("*").alias("docs"), F.coalesce(F.sum("p"), F.lit(0)).alias("pages"),
        F.count_if(differs).alias("differs"), F.count_if(~F.col("m_page_count").eqNullSafe(F.col("p"))).alias("lost_pages"),
    )
    f = units.where("unit_type = 'formula_package'").select(F.col("provenance.standard_code").alias("c"), F.col("provenance.section").alias("s"), F.coalesce("manual_transcription", F.lit(False)).alias("m"), F.explode("formulas.formula_number").alias("n"))
    formula = f.agg(F.count("*").alias("formulas"), F.countDistinct("c", F.coalesce("s", F.lit("")), "n").alias("contexts"), F.count_if("m").alias("manual"))
    per = units.agg(F.count("*").alias("units"), F.countDistinct("unit_id").alias("unit_ids"), F.array_sort(F.collect_set("provenance.standard_code")).alias("unit_codes"))
    refs = layout.select("standard_code", F.explode("pages").alias("p")).select("standard_code", F.array_join(F.transform("p.lines", lambda x: x["text"]), "\n").alias("t"))
    refs = refs.select(F.col("standard_code").alias("c"), F.explode(F.regexp_extract_all("t", F.lit(r"按式\s*[（(]([A-Z]?\.?\d+)[）)]"), F.lit(1))).alias("n"))
    open_ = refs.join(f.select("c", "n").distinct().withColumn("_k", F.lit(1)), ["c", "n"], "left").agg(F.count("*").alias("refs"), F.count_if(F.col("_k").isNull()).alias("unresolved"))
    one = found.crossJoin(docs).crossJoin(formula).crossJoin(per).crossJoin(open_)  # one row each
    zero = lambda name, k: (name, F.col(f"f_{k}") == 0, 0, F.col(f"f_{k}"))
    met = lambda given, c: F.lit(True) if given is None else F.col(c) == given
    wanted = lambda x: "any" if x is None else x
    listed = F.array(*map(F.lit, codes)).cast("array<string>")
    return _gate(one, [
        ("standard_inventory", F.col("codes") == listed, codes, F.to_json("codes")),
        ("source_hashes_unique", F.col("hashes") == F.col("docs"), F.col("docs"), F.col("hashes")),
        ("all_pages_present", met(pages, "pages") & (F.col("f_page_sequence") == 0) & (F.col("lost_pages") == 0), wanted(pages), F.col("pages")),
        ("layout_manifest_counts_match", F.col("differs") == 0, 0, F.col("differs")),
        zero("all_page_reading_orders_stable", "reading_order"), zero("all_layout_coordinates_valid", "coordinates"), zero("line_ids_unique_per_document", "line_id_uniqueness"), zero("symbol_font_private_use_removed", "private_use"),
        ("source_unit_count_and_ids", met(unit_count, "units") & (F.col("units") == F.col("unit_ids")), wanted(unit_count), F.col("units")),
        ("every_standard_has_source_units", F.col("unit_codes") == listed, codes, F.to_json("unit_codes")),
        zero("all_source_unit_evidence_traceable", "evidence"), zero("all_table_records_structurally_traceable", "table_record"),
        ("formula_inventory_unique_by_section", met(formulas, "formulas") & (F.col("formulas") == F.col("contexts")), wanted(formulas), F.col("formulas")),
        ("manual_formula_transcriptions_traceable", met(manual, "manual"), wanted(manual), F.col("manual")),
        ("explicit_formula_references_resolved", (F.col("refs") > 0) & (F.col("unresolved") == 0), "all resolve", F.col("unresolved")),
    ])


# -- gold -------------------------------------------------------------------

FORMULA_ROW = (
    "standard_code string, section string, formula_number string, formula_entity_id string, manual_transcription boolean, input_count int, input_passed boolean, output_applicable boolean, output_count int, output_passed boolean, "
    "unit_checks int, unit_passed boolean, explicit_sources array<string>, source_passed boolean, indicator_path_applicable boolean, indicator_path_passed boolean, passed boolean, failure string"
)


def formula_rows(unit: dict, annotation: dict, ids: set[str]) -> list[dict]:
    """For each formula of a unit: whether its inputs, output, units, sources and indicator are in the annotation. ``ids``: the gold entities."""
    code, section = unit["provenance"]["standard_code"], unit["provenance"].get("section") or ""
    variables, roles = annotate.split_variables(unit.get("variable_definitions")), unit.get("manual_variable_roles") or {}
    sources = annotate.found_first(annotate._texts(unit, variables), annotate.SOURCES)
    relations = annotation["relations"] or []
    named = {r["tail_name"] for r in relations if r["relation_type"] == "sourced_from"}
    units_of = {r["head_id"] for r in relations if r["relation_type"] == "has_unit"}
    out = []
    for f in unit.get("formulas") or []:
        number, text = f["formula_number"], f["expression_text"] or ""
        context = f"{section}|{number}"
        own = annotate.stable_id("entity-v2", code, "formula", annotate.clean(f"公式（{number}）"), context)
        row = {"standard_code": code, "section": section, "formula_number": number, "formula_entity_id": own}
        if own not in ids:
            out.append({**row, "passed": False, "failure": "formula_entity_missing"})
            continue
        count = lambda kind, end="head_id": sum(r["relation_type"] == kind and r[end] == own for r in relations)  # noqa: B023, E731
        outputs = annotate.unique(annotate._declared(s, variables) or s for s in annotate.lhs_symbols(text))
        held = {annotate.identity(e["name"]): e["entity_id"] for e in annotation["entities"] or [] if e["entity_type"] == "model_variable" and e.get("context") == context}
        measured = [v["symbol"] for v in variables if v.get("unit") and (annotate.occurs(v["symbol"], text) or v["symbol"] in outputs or roles.get(v["symbol"]))]
        judged = {
            "input_passed": count("has_input") > 0, "output_passed": count("has_output") > 0 or not ("=" in text or outputs), "unit_passed": all(held.get(annotate.identity(s)) in units_of for s in measured),
            "source_passed": set(sources) <= named, "indicator_path_passed": count("calculated_by", "tail_id") > 0 or code not in annotate.SUBJECTS,
        }
        out.append({
            **row, **judged, "manual_transcription": bool(unit.get("manual_transcription")), "input_count": count("has_input"), "output_applicable": bool("=" in text or outputs), "output_count": count("has_output"),
            "unit_checks": len(measured), "explicit_sources": sources, "indicator_path_applicable": code in annotate.SUBJECTS, "passed": all(judged.values()), "failure": "",
        })
    return out


def own_formula_rows(unit: dict) -> list[dict]:
    """``formula_rows`` of a unit and what the gold rules say of it."""
    if unit["unit_type"] != "formula_package":
        return []
    annotation = annotate.annotate_unit(unit)
    return formula_rows(unit, annotation, {e["entity_id"] for e in annotation["entities"]})


def raw_formula_paths(raw: DataFrame) -> DataFrame:
    """As ``gold_formula_paths`` of the units of RAW and their annotations by rule, in one pass and without a join."""
    return each_unit(raw, own_formula_rows, FORMULA_ROW)


def gold_formula_paths(units: DataFrame, annotations: DataFrame) -> DataFrame:
    """FORMULA_ROW of each formula of UNIT rows with the ANNOTATION rows of their units (a join by unit_id)."""
    rows = units.where("unit_type = 'formula_package'").select("unit_id", F.struct(*units.columns).alias("unit")).join(annotations.select("unit_id", F.struct("entities", "relations").alias("annotation")), "unit_id")
    return by_row(rows, lambda r: formula_rows(r["unit"], r["annotation"], {e["entity_id"] for e in r["annotation"]["entities"] or []}), FORMULA_ROW)


def gold_quality_paths(units: DataFrame, annotations: DataFrame) -> DataFrame:
    """(unit_id, page, secondary_indicator, passed): rows of quality tables that state a requirement, and whether a source is constrained by it."""
    need = units.where("unit_type = 'table_record'").where(F.col("provenance.standard_code") == annotate.QUALITY_CODE).where("coalesce(cells['具体要求'], '') <> ''")
    fits = F.exists("relations", lambda r: (r["relation_type"] == "constrained_by") & (r["head_type"] == "data_source") & (r["tail_type"] == "quality_rule"))
    return need.join(annotations.select("unit_id", fits.alias("passed")), "unit_id").select("unit_id", F.col("provenance.pages")[0].alias("page"), F.coalesce(F.col("cells")["二级指标"], F.lit("")).alias("secondary_indicator"), "passed")


def gold_paths(units: DataFrame, annotations: DataFrame, entities: DataFrame, triples: DataFrame, formulas: int | None = None) -> DataFrame:
    """CHECK rows of the gold graph: the ontology, evidence that is there, and the paths that every formula and quality requirement needs."""
    ends = triples.select("triple_id", "head_type", "relation_type", "tail_type", F.explode(F.array("head_id", "tail_id")).alias("entity_id"))
    lost = ends.join(entities.select("entity_id"), "entity_id", "left_anti").select("triple_id")
    wrong = ontology.checked(triples.select("triple_id", "head_type", "relation_type", "tail_type")).where("NOT valid").select("triple_id")
    bad = wrong.union(lost).distinct().agg(F.count("*").alias("bad"))
    e = triples.select("triple_id", F.explode_outer("evidence").alias("e")).select("triple_id", "e.source_unit_id", "e.evidence_span_ids", "e.bboxes")
    spans = by_row(units, lambda u: [{"source_unit_id": u["unit_id"], "ids": list(annotate.all_spans(u))}], "source_unit_id string, ids array<string>")
    e = e.join(spans, "source_unit_id", "left")
    loose = F.col("ids").isNull() | (F.size(F.array_except("evidence_span_ids", "ids")) > 0) | ((F.size("evidence_span_ids") > 0) & (F.coalesce("bboxes", F.lit("{}")) == "{}"))
    untraced = e.agg(F.count_if(loose).alias("untraced"))
    f = gold_formula_paths(units, annotations)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).alias(f"n_{c}")
    kinds = ("input_passed", "output_passed", "unit_passed", "source_passed", "indicator_path_passed")
    per = f.agg(F.count("*").alias("formulas"), *(n(k) for k in kinds))
    q = gold_quality_paths(units, annotations).agg(F.count("*").alias("q"), F.count_if("passed").alias("qp"))
    one = bad.crossJoin(untraced).crossJoin(per).crossJoin(q)  # one row each
    total = F.col("formulas")
    every = lambda k: (F.col(f"n_{k}") == total, total, F.col(f"n_{k}"))
    count = F.lit(True) if formulas is None else total == formulas
    return _gate(one, [
        ("all_triples_schema_valid", F.col("bad") == 0, 0, F.col("bad")), ("all_triples_have_traceable_evidence", F.col("untraced") == 0, 0, F.col("untraced")),
        ("all_formula_inputs_validated", count & every("input_passed")[0], total, F.col("n_input_passed")), ("all_applicable_formula_outputs_validated", *every("output_passed")),
        ("all_explicit_formula_units_validated", *every("unit_passed")), ("all_explicit_formula_sources_validated", *every("source_passed")), ("all_assessment_formula_indicator_paths_validated", *every("indicator_path_passed")),
        ("all_quality_table_constraints_validated", (F.col("q") > 0) & (F.col("q") == F.col("qp")), F.col("q"), F.col("qp")),
    ])


def splits(units: DataFrame, triples: DataFrame) -> DataFrame:
    """CHECK rows of UNIT rows and of triples (triple_id, split): splits share no triple, external standards are the test and nothing else is, groups of the core stay whole, and no split is empty."""
    u = annotate.unit_split(units).select("split", "unit_type", "table_id", F.col("provenance.standard_code").alias("code"), F.col("provenance.section").alias("section"))
    external = F.col("code").isin(*T.EXTERNAL_TEST)
    group = F.concat_ws("|", "code", F.when(F.col("unit_type") == "table_record", F.concat(F.lit("t"), F.coalesce("table_id", F.lit("")))).otherwise(F.concat(F.lit("s"), F.coalesce("section", F.lit("")))))
    parted = u.where(F.col("code").isin(*T.CORE)).groupBy(group).agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("parted"))
    twice = triples.groupBy("triple_id").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice"))
    units_in = u.agg(F.count_if((F.col("split") == "test") != external).alias("misplaced"), F.countDistinct("split").alias("us"))
    one = parted.crossJoin(twice).crossJoin(units_in).crossJoin(triples.agg(F.countDistinct("split").alias("ts")))  # one row each
    return _gate(one, [
        ("triple_splits_disjoint", F.col("twice") == 0, 0, F.col("twice")), ("external_standard_test_policy", F.col("misplaced") == 0, 0, F.col("misplaced")),
        ("core_document_groups_are_atomic", F.col("parted") == 0, 0, F.col("parted")), ("all_three_splits_nonempty", (F.col("us") == 3) & (F.col("ts") == 3), 3, F.least("us", "ts")),
    ])


def foundation(checked_cases: DataFrame, ontology_checks: DataFrame) -> DataFrame:
    """One row: the parser's cases passed, the ontology's checks passed, and both."""
    parser = case_report(checked_cases).select(F.col("passed").alias("document_parser_quality"))
    schema = ontology_checks.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("schema_professionalism"))
    return parser.crossJoin(schema).withColumn("passed", F.col("document_parser_quality") & F.col("schema_professionalism"))
