"""Small units, chunks and pages that several tests share."""

CHUNKS = [
    ("HJ1173-p6-c1", "HJ 1173-2021", "生态系统服务功能评估", 6, "7.1", "paragraph", "7.1 水源涵养量 运用水量平衡方程计算水源涵养量，具体方法详见附录A。", "fixture.pdf", "fixture", "water", None),
    ("HJ1173-p6-c2", "HJ 1173-2021", "生态系统服务功能评估", 6, "7.2", "paragraph", "7.2 土壤保持量 运用修正土壤流失方程（RUSLE）计算土壤保持量，具体方法详见附录A。", "fixture.pdf", "fixture", "soil", None),
    ("HJ1173-p6-c3", "HJ 1173-2021", "生态系统服务功能评估", 6, "7.3", "paragraph", "7.3 防风固沙量 运用修正风力侵蚀模型（REWQ）计算固沙量，具体方法详见附录A。", "fixture.pdf", "fixture", "sand", None),
    ("HJ1172-p6-c1", "HJ 1172-2021", "生态系统质量评估", 6, "6", "formula", "生态系统质量由植被覆盖度、叶面积指数和总初级生产力的相对密度构建，计算公式为EQI。", "fixture.pdf", "fixture", "quality", None),
]


def span(name: str, text: str = "x", page: int = 6) -> dict:
    return {"span_id": name, "page": page, "printed_page": "3", "text": text, "bbox": [10.0, 20.0, 200.0, 40.0], "line_ids": [f"line {name}"]}


def provenance(code: str, title: str, section: str, chain: list[str], spans: list[dict], page: int = 6) -> dict:
    return {"standard_code": code, "document_title": title, "source_file": "f.pdf", "source_sha256": "f" * 64, "section": section, "heading_chain": chain, "pages": [page], "printed_pages": ["3"], "evidence_spans": spans}


def formula_unit(unit_id: str = "unit-1", code: str = "HJ 1171-2021", section: str = "6.1") -> dict:
    f, v = span(f"f {unit_id}", "P_ij = S_ij / TS （1）"), span(f"v {unit_id}")
    variables = [{"symbol": s, "definition": d, "unit": u, "evidence_span": v} for s, d, u in (("P_ij", "构成比例", "量纲一"), ("S_ij", "面积", "km2"), ("TS", "总面积", "km2"))]
    return {
        "unit_id": unit_id, "unit_type": "formula_package", "provenance": provenance(code, "生态系统格局评估", section, [f"{section} 生态系统类型构成比例"], [f, v]),
        "formulas": [{"formula_number": "1", "expression_text": "P_ij = S_ij / TS", "expression_lines": ["P_ij = S_ij / TS"], "evidence_span": f}], "variable_definitions": variables,
        "introduction": "生态系统类型构成比例按公式（1）计算。", "interstitial_text": "", "adjacent_source_text": "评估区",
    }


def table_unit(unit_id: str, code: str, cells: dict, title: str = "", section: str = "7") -> dict:
    return {"unit_id": unit_id, "unit_type": "table_record", "provenance": provenance(code, "生态系统质量评估", section, [f"{section} 指标"], [span(f"t {unit_id}")]), "table_id": f"table {unit_id}", "table_title": title, "cells": cells, "cell_bboxes": {k: [10.0, 20.0, 30.0, 40.0] for k in cells}, "inherited_from": {}}


def clause_unit(unit_id: str, code: str, text: str, kind: str = "procedure_clause", section: str = "7.3.1", page: int = 10, **more) -> dict:
    return {"unit_id": unit_id, "unit_type": kind, "provenance": provenance(code, "生态系统质量评估", section, [f"{section} 叶面积指数"], [span(f"c {unit_id}", text, page)], page), "clause_text": text, **more}
