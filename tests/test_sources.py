"""Rules of chunks, providers, sources and sinks, the stored index, the stream, and expressions of text."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import corpus, evaluation, evidence, extraction, graph, layout, ontology, validation
from tessera.sources import files
from tessera.streaming import postings as stream
from tests.fixtures import CHUNKS


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, files.CHUNK)


def values(spark, column, *rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], f"k int, x {kind}").orderBy("k").select(column).collect()]


def test_rules_of_chunks(spark, chunks):
    accepted, rejected = extraction.extract(chunks)
    got = {(r.head_name, r.relation_type, r.tail_name) for r in accepted.collect()}
    assert got == {("水源涵养量", "uses_formula", "水量平衡方程"), ("土壤保持量", "uses_formula", "修正土壤流失方程（RUSLE）"), ("固沙量", "uses_formula", "修正风力侵蚀模型（REWQ）"), ("生态系统质量", "uses_formula", "EQI"), *(("生态系统质量", "depends_on", x) for x in ("植被覆盖度", "叶面积指数", "总初级生产力"))}
    assert rejected.isEmpty()
    one = accepted.where("head_name = '水源涵养量'").first()
    assert (one.head_id, one.tail_id, one.evidence.evidence_text, one.review_status) == ("a1f2d90d38321e74", "6ca078e4fe104fc0", "运用水量平衡方程计算水源涵养量，", "unreviewed")


def test_evidence_of_pdf_text(spark, chunks):
    spaced = chunks.limit(1).withColumns({"text": F.lit("3.4 总初级生产力 表征植被光合作用能 力强弱。"), "chunk_id": F.lit("c")})
    relation = lambda text, chunk="c", code="HJ 1173-2021", tail="standard_clause": (text, chunk, code, tail)
    rows = [relation("植被光合作用能力强弱"), relation("没有"), relation(" "), relation("x", "no"), relation("x", code="HJ 1166-2021"), relation("x", tail="indicator"), relation("x", tail="thing")]
    r = spark.createDataFrame([(k, "indicator", "defined_in", tail, (code, chunk, text)) for k, (text, chunk, code, tail) in enumerate(rows)], "k int, head_type string, relation_type string, tail_type string, evidence struct<standard_code: string, chunk_id: string, evidence_text: string>")
    got = [x.reason for x in evidence.checked(r, spaced).orderBy("k").collect()]
    assert got[0] == "" and [bool(x) for x in got[1:]] == [True] * 6 and got[3] == "evidence chunk id does not match" and got[4] == "evidence standard code does not match" and got[2] == "evidence text is empty" and "not allowed" in got[5] and "unknown" in got[6]


def test_provenance(spark):
    kind = "struct<standard_code: string, source_sha256: string, source_unit_id: string, evidence_span_ids: array<string>, pages: array<int>, bboxes: map<int, array<array<double>>>>"
    good = ("HJ", "sha", "u", ["s"], [7], {7: [[1.0, 2.0, 3.0, 4.0]]})
    rows = [good, ("", *good[1:]), (*good[:3], [], *good[4:]), (*good[:4], [0], good[5]), (*good[:5], {}), (*good[:5], {7: [[1.0]]}), (None, None, None, None, None, None)]
    got = [tuple(x) for x in values(spark, evidence.provenance_ok("x"), *rows, kind=kind)]
    assert [x[0] for x in got] == [True] + [False] * 6 and len({x[1] for x in got}) == 6


def test_short_items_are_found_in_passes(spark):
    items = spark.createDataFrame([(1, "two words"), (2, "ab"), (3, " "), (4, "one two three four five six seven eight"), (5, "two words")], "i int, t string")
    docs = spark.createDataFrame([("x", "has two  words here"), ("y", "cab"), ("z", "zero one two three four five six seven eight nine"), ("n", None)], "d string, t string")
    want = {(1, "x"), (5, "x"), (2, "y"), (4, "z")}
    for limit in (8 << 20, 20):
        assert {tuple(r) for r in evidence.find(items, docs, "i", "t", "d", "t", short_bytes=limit).collect()} == want


def test_ontology(spark):
    assert all(r.passed for r in ontology.quality_report(spark).collect()) and ontology.schema_rows(spark, 2).count() == len(set(ontology.patterns(2)))
    got = values(spark, ontology.migration_status("x"), "indicator", "uses_formula", "depends_on", "defined_in", "has_unit", "applies_to", None)
    assert [x.status for x in got] == ["manual_review_required"] * 4 + ["not_legacy", "manual_review_required", "not_legacy"] and got[3].candidates == [] and got[0].candidates == ["assessment_indicator", "observation_variable"]
    assert {r.evidence_rule is not None for r in ontology.schema_rows(spark, 2, True).collect()} == {True} and {r.relation_label_zh for r in ontology.schema_rows(spark, 1, True).where("relation_type = 'has_unit'").collect()} == {"单位为"}
    assert {tuple(r) for r in ontology.allowed_pairs(spark, "has_input").collect()} == {("formula", "model_variable")} and ontology.path_templates(spark).where("required").count() == 6


def test_answers_of_a_model(spark, chunks):
    good = {"head_name": "水源涵养量", "head_type": "indicator", "relation_type": "uses_formula", "tail_name": "水量平衡方程", "tail_type": "formula", "evidence_text": "运用水量平衡方程计算水源涵养量", "confidence": 9}
    answer = json.dumps({"relations": [good, good | {"tail_name": ""}, good | {"evidence_text": "没有"}, {"x": 1}, "y"]}, ensure_ascii=False)
    one = chunks.limit(1)
    accepted, rejected = extraction.extract_with_model(one, extraction.MockProvider(f"Here: ```json\n{answer}\n```"), retries=0)
    (a,) = accepted.collect()
    assert (a.extraction_method, a.confidence, a.head_name) == ("llm_schema", 1.0, "水源涵养量")
    assert sorted(r.reason.split(":")[0] for r in rejected.collect()) == ["candidate_error", "candidate_error", "evidence is not a literal part of the chunk"]
    accepted, rejected = extraction.extract_with_model(one, extraction.MockProvider("not-json"), retries=0)
    (r,) = rejected.collect()
    assert accepted.isEmpty() and r.reason.startswith("provider_or_parse_error") and r.response_preview == "not-json" and r.attempts == 1
    accepted, _ = extraction.extract_with_model(one, extraction.MockProvider(json.dumps([good] * 5, ensure_ascii=False)), most=2)
    assert accepted.count() == 2
    with pytest.raises(ValueError, match="list"):
        extraction.parse_answer('{"relations": 1}')
    assert extraction.parse_answer('x {"relations": []} y') == [] and extraction.parse_selection('```json\n{"selected_entity_ids": [1]}\n```') == (["1"], [])


class Fails:
    last_raw_response = {"status": 500}

    def complete(self, system, prompt):
        raise RuntimeError("down")


def test_choice_of_a_model(spark):
    from tessera.operators import annotate, units
    from tests.fixtures import formula_unit

    u = spark.createDataFrame([formula_unit()], units.UNIT)
    found = annotate.predict_unit(formula_unit())
    pick = found["relations"][0]
    p = extraction.predict(u, {"backend": "llm", "model": "m"}, extraction.MockProvider(json.dumps({"selected_relation_ids": [pick["relation_id"], "no"], "selected_entity_ids": ["no"]}))).first()
    assert [r.relation_id for r in p.relations] == [pick["relation_id"]] and {e.entity_id for e in p.entities} == {pick["head_id"], pick["tail_id"]} and p.backend == "llm" and p.prompt_hash and p.candidate_hash
    p = extraction.predict(u, {"backend": "llm"}, Fails()).first()
    assert (p.status, p.error_type, p.error_message, p.no_relation_reason, p.entities) == ("error", "RuntimeError", "down", "extraction_error", []) and p.candidate_hash and p.prompt_hash
    for bad in ({"max_tokens": 0}, {"enable_thinking": "yes"}):
        with pytest.raises(ValueError):
            extraction.predict(u, {"backend": "llm", **bad}, extraction.MockProvider())


def test_http_provider():
    asked, answers = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            code, body = answers.pop(0)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    env = {"TESSERA_LLM_BASE_URL": f"http://127.0.0.1:{server.server_port}/v1/", "TESSERA_LLM_API_KEY": "k", "TESSERA_LLM_MODEL": "m", "TESSERA_LLM_THINKING": "false", "TESSERA_LLM_NO_THINK": "1", "TESSERA_LLM_MAX_TOKENS": "7"}
    p = extraction.HTTPProvider.from_env(env)
    message = lambda finish="stop", **m: (200, {"choices": [{"finish_reason": finish, "message": m}], "usage": {"completion_tokens": 7}})
    answers += [message(content="yes"), message(reasoning_content="thought"), message("length", content="cut"), (503, {"error": "busy"})]
    assert p.complete("s", "q") == "yes" and p.complete("s", "q") == "thought"
    with pytest.raises(extraction.TruncatedError, match="7"):
        p.complete("s", "q")
    with pytest.raises(extraction.HTTPError, match="503"):
        p.complete("s", "q")
    assert p.last_raw_response["http_status"] == 503
    server.shutdown()
    path, key, body = asked[0]
    assert path == "/v1/chat/completions" and key == "Bearer k" and body["max_tokens"] == 7 and body["chat_template_kwargs"] == {"enable_thinking": False} and body["messages"][1]["content"].endswith("/no_think")
    with pytest.raises(ValueError, match="auto, true or false"):
        extraction.HTTPProvider.from_env({"TESSERA_LLM_THINKING": "maybe"})
    assert extraction.HTTPProvider.from_env({}).thinking is None
    with pytest.raises(RuntimeError, match="transformers"):
        extraction.LocalProvider("none")


def test_index_and_questions(spark, chunks, tmp_path):
    """Search from stored postings is that of the texts; a saved index gives its relations back."""
    files.write_jsonl(chunks, str(tmp_path / "processed/chunks.jsonl"))
    k = files.Knowledge.open(spark, str(tmp_path))
    assert k.relations.count() == 7 and [r[0] for r in k.standards().collect()] == ["HJ 1172-2021", "HJ 1173-2021"]
    for query, only in (("水源涵养", None), ("HJ EQI 相对密度", None), ("方程计算", "HJ 1173-2021"), ("", None), ("zzz", None)):
        where = F.col("standard_code") == only if only else None
        want = [tuple(r) for r in graph.search(chunks, query, "chunk_id", "text", only=where).collect()]
        assert [(r.chunk_id, r.score) for r in k.search(query, only or "").collect()] == want
    assert k.evidence("水源涵养").first().section == "7.1" and k.evidence("水源涵养").columns[-1] == "score"
    assert {r.tail for r in k.paths("生态系统质量").collect()} == {"EQI", "植被覆盖度", "叶面积指数", "总初级生产力"} and k.paths("none").isEmpty()
    assert {r.missing for r in k.missing("水源涵养量").collect()} == {"标准条款溯源", "输入参数或依赖指标"}
    again = files.Knowledge.open(spark, str(tmp_path))
    assert again.relations.count() == 7
    read = again.spark.read.parquet(f"{again.path}/postings").where("bucket = 3")
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString()


def test_terms_are_counted_in_documents(spark):
    rows = [("a", "Ab ab aB"), ("b", ""), ("c", None), ("d", "水源 of　of"), ("e", "x")]
    d = spark.createDataFrame([(k, t, 1) for k, t in rows], "k string, text string, term int")
    got = {(r.k, r.term): r.tf for r in graph.postings(d, "k", "text").collect()}
    want = {(k, t): n for k, x in rows for t, n in graph.query_terms(x or "").items()}
    assert got == want and got["a", "ab"] == 6 and got["d", "of"] == 4 and graph.postings(d.limit(0), "k", "text").isEmpty()


def test_paths_end_in_cycles(spark):
    e = spark.createDataFrame([(f"r{a}{b}", a, f"n{a}", "x", b, f"n{b}") for a, b in ("ab", "bc", "ca", "cd", "de", "xy")], "relation_id string, head_id string, head_name string, relation_type string, tail_id string, tail_name string")
    for depth, want in ((1, {"rab", "rca"}), (4, {"rab", "rbc", "rca", "rcd", "rde"})):
        got = graph.entity_path(e.union(e), "na", depth).collect()
        assert {r.relation_id for r in got} >= ({"rab"} if depth == 1 else want) and len(got) == len({r.relation_id for r in got}) and "rxy" not in {r.relation_id for r in got}


def test_stream_of_documents(spark, tmp_path):
    """Batches add up to the postings of all documents; a stream that is started again adds what is new alone."""
    source = tmp_path / "in"
    docs = [("a", "水源 涵养"), ("b", "ab cd"), ("c", "水源 ab")]
    for k, part in enumerate((docs[:2], docs[2:])):
        spark.createDataFrame(part, "k string, text string").coalesce(1).write.mode("append").parquet(str(source))
        read = spark.readStream.schema("k string, text string").option("maxFilesPerTrigger", 1).parquet(str(source))
        stream.append_postings(read, "k", "text", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "term", "tf").collect())
        assert got == sorted(tuple(r) for r in graph.postings(spark.createDataFrame(docs[: 2 + k], "k string, text string"), "k", "text").select("k", "term", "tf").collect())


def test_files(spark, chunks, tmp_path):
    path = str(tmp_path / "c.jsonl")
    m = files.write_with_manifest(chunks.coalesce(1), path)
    (row,) = m.collect()
    assert row.records == 4 and row.bytes > 0 and files.manifest_ok(m, path).first().ok and not files.manifest_ok(m.withColumn("sha256", F.lit("x")), path).first().ok
    assert sorted(files.read_chunks(spark, path).collect()) == sorted(chunks.collect()) and files.read_chunks(spark, str(tmp_path / "no")).isEmpty()
    with pytest.raises(FileNotFoundError):
        files.read_jsonl(spark, str(tmp_path / "no"), files.CHUNK, missing_ok=False)
    (tmp_path / "bad.jsonl").write_text('{"chunk_id": "a"}\n\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_chunks(spark, str(tmp_path / "bad.jsonl")).collect()
    relations = extraction.extract(chunks)[0]
    files.write_jsonl(relations, str(tmp_path / "r.jsonl"))
    assert files.read_relations(spark, str(tmp_path / "r.jsonl")).count() == 7
    sheet = files.annotation_sheet(relations)
    assert sheet.columns[0] == "record_id" and len(sheet.columns) == 21 and sheet.columns[-2:] == ["consensus_decision", "review_status"]
    files.write_csv(sheet, str(tmp_path / "sheet"), [*sheet.columns, "extra"])
    raw = next((tmp_path / "sheet").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfrecord_id,") and raw.split(b"\n")[0].endswith(b",extra")
    assert files.first_of(spark, [str(tmp_path / "no"), path], files.CHUNK).count() == 4
    with pytest.raises(FileNotFoundError):
        files.first_of(spark, [str(tmp_path / "no")], files.CHUNK)
    listed = spark.createDataFrame([("a.pdf", "HJ 1173-2021")], "path string, standard_code string")
    assert files.file_for_code(listed, "HJ 1173-2021").first().path == "a.pdf"
    with pytest.raises(KeyError):
        files.file_for_code(listed, "x")
    assert {r.path.rsplit("/", 1)[1] for r in files.read_files(spark, str(tmp_path), "*.jsonl", "bad").collect()} == set()
    for reader in (files.text_head, lambda p: files.read_pages(spark.createDataFrame([("c", "t", "f", "s", b"x")], "standard_code string, document_title string, source_file string, source_sha256 string, content binary")).collect()):
        with pytest.raises(Exception, match="pdfplumber"):
            reader("x.pdf")
    assert files.raw_tables(type("P", (), {"find_tables": lambda s: [type("T", (), {"bbox": (1, 2, 3, 4), "rows": [type("R", (), {"cells": [(0, 1, 2, 3), None]})()] * 2, "extract": lambda t: [["a", None], ["b", "c"]]})()]})()) == [{"bbox": [1.0, 2.0, 3.0, 4.0], "rows": [["a", None], ["b", "c"]], "cell_bboxes": [[[0.0, 1.0, 2.0, 3.0], None]] * 2}]


def test_manifests(tmp_path):
    (tmp_path / "p/q").mkdir(parents=True)
    (tmp_path / "p/q/units.jsonl").write_text("x")
    sha = files.sha256_path(str(tmp_path / "p/q/units.jsonl"))
    files.write_json({"schema_version": "v", "files": [{"path": "q/units.jsonl", "sha256": sha}]}, str(tmp_path / "p/manifest.json"))
    where, held = files.find_manifest(str(tmp_path / "p/q/units.jsonl"), "v")
    files.assert_manifest_file(where, held, str(tmp_path / "p/q/units.jsonl"))
    (tmp_path / "p/q/units.jsonl").write_text("y")
    with pytest.raises(ValueError, match="hash differs"):
        files.assert_manifest_file(where, held, str(tmp_path / "p/q/units.jsonl"))
    with pytest.raises(ValueError, match="not registered"):
        files.assert_manifest_file(where, held, str(tmp_path / "p/other"))
    assert files.find_manifest(str(tmp_path / "p/q/units.jsonl"), "w") is None and files.read_config(None) == {} and files.now().endswith("+00:00")
    assert files.config_digest({"b": 1, "a": "é"}) == files.config_digest({"a": "é", "b": 1}) == extraction.digest({"a": "é", "b": 1}) and files.layout_filename("HJ 1173-2021") == "HJ_1173_2021.layout.json"


def test_other_tools(spark, chunks, tmp_path):
    assert files.export_for_graph_tool(chunks, str(tmp_path))["status"] == "prepared" and "max_gleanings: 1" in (tmp_path / "settings.yaml").read_text() and json.loads((tmp_path / "adapter_summary.json").read_text())["chunk_count"] == 4
    for call in (lambda: files.export_for_graph_tool(chunks, str(tmp_path), run=True), lambda: files.ask_graph_tool(str(tmp_path), "q")):
        with pytest.raises(RuntimeError, match="isn't installed"):
            call()
    chunks.write.parquet(str(tmp_path / "output/entities.parquet"))
    assert files.map_outputs(spark, str(tmp_path)) == {"entities": 4} and (tmp_path / "mapped/entities.jsonl").exists()
    data = tmp_path / "d.jsonl"
    data.write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3}\n')
    command = files.training_command(str(data), "out", {"precision": "fp16"})
    assert command[:2] == ["swift", "sft"] and command[command.index("--torch_dtype") + 1] == "float16" and command[command.index("--lora_rank") + 1] == "8"
    with pytest.raises(ValueError, match="precision"):
        files.training_command("a", "b", {"precision": "int8"})
    called = []
    run = files.run_training(str(data), str(tmp_path / "run"), smoke_limit=2, runner=lambda c, **k: called.append(c))
    assert run["status"] == "complete" and run["training_records"] == 2 and called and (tmp_path / "run/smoke_training.jsonl").read_text().count("\n") == 2

    def absent(*a, **k):
        raise FileNotFoundError

    with pytest.raises(RuntimeError, match="command"):
        files.run_training(str(data), str(tmp_path / "run"), runner=absent)
    assert json.loads((tmp_path / "run/run_manifest.json").read_text())["status"] == "failed"
    with pytest.raises(RuntimeError, match="two"):
        files.run_training(str(data), str(tmp_path / "run"), smoke_limit=1)
    assert "| rule | 0.5000 |" in files.report({"main_results": {"rule": 0.5, "x": None}}) and "| x | 待实验补充 |" in files.report({"main_results": {"x": None}})
    files.write_ablation_plan(spark, str(tmp_path / "plan.json"))
    plan = json.loads((tmp_path / "plan.json").read_text())
    assert plan["status"] == "not_run" and len(plan["experiments"]) == 16 and plan["experiments"][2] == {"experiment_id": "without_graphrag", "metrics": None, "overrides": {"graphrag": False}}


def test_chunks_of_documents(spark):
    text = "7.1 水源 涵养\n" + "很长。" * 600
    pages = spark.createDataFrame([("HJ 1173-2021", "t", 2, "没有标题", "f", "s"), ("HJ 1173-2021", "t", 1, text, "f", "s"), ("HJ 1173-2021", "t", 3, " ", "f", "s"), ("HJ 1172-2021", "t", 1, "式中 没有", "f", "s")], "standard_code string, document_title string, page int, text string, source_file string, source_sha256 string")
    got = {r.chunk_id: r for r in corpus.document_chunks(pages).collect()}
    assert set(got) == {"HJ1173_2021-p1-c1", "HJ1173_2021-p1-c2", "HJ1173_2021-p2-c1", "HJ1172_2021-p1-c1"} and got["HJ1173_2021-p2-c1"].section == "7.1" and got["HJ1172_2021-p1-c1"].block_type == "formula"
    assert len(got["HJ1173_2021-p1-c1"].text) <= 1400 and got["HJ1173_2021-p1-c1"].text.endswith("。") and got["HJ1173_2021-p1-c2"].text in " ".join(text.split())


def test_text_expressions(spark):
    one = lambda c, *rows: values(spark, c, *rows)
    assert one(T.standard_code("x"), "HJ 1173—2021", "HJ1166-2021", "HJ 1177-2021", "HJ/T 1173-2021", "") == ["HJ 1173-2021", "HJ 1166-2021", "", "", ""]
    assert one(T.role("x"), "HJ 1171-2021", "HJ 1176-2021", "HJ 1173-2021", "x") == ["external_test", "support", "core", "support"]
    assert one(T.title("x", F.lit("a/3.全国生态状况调查评估技术规范（生态问题）.pdf")), "x\n——生态 评估\n", "none") == ["生态 评估", "生态问题"]
    assert one(T.block_kind("x"), "见 表1", "公式A1", "图 3", "表x", "公式（3）", "x表 1") == ["table", "formula", "figure_caption", "paragraph", "formula", "paragraph"]
    assert one(T.normalize_pdf_text("x"), "a \t b ", "") == ["a=∑ b", "−·"]
    assert one(T.is_definition("x"), "S——面积", "S --面积", "z 为距离", "式中", "面积", "，a——b") == [True, True, True, True, False, False]
    assert one(T.is_formula_fragment("x", F.lit(6.0), F.lit(10.0)), "x=1", "说明：", "很小的字", "a") == [True, False, True, True] and one(T.is_formula_fragment("x", F.lit(10.0), F.lit(10.0)), "很大的字", "量 a=b") == [False, True]
    assert one(T.is_header_or_footer("x", F.lit(50.0), F.lit(60.0), F.lit(800.0)), "HJ 1173—2021", "HJ 1173—2021 x", "12") == [True, False, False] and one(T.is_header_or_footer("x", F.lit(700.0), F.lit(760.0), F.lit(800.0)), "12", "- 12 -") == [True, False]
    assert [tuple(x) if x else x for x in one(T.heading_parts("x"), "附录A", "7.1 水源", "31 水", "1 a=b（1）", "A.1 水")] == [("附录 A", ""), ("7.1", "水源"), None, None, ("A.1", "水")]
    assert one(T.unit_of("x"), "面积，km2；", "比例，一般") == ["km2", ""] and one(T.bridges_formula("x"), "如下：", "计算公式如下", "别的") == [True, True, False] and one(T.has_cjk("x"), "a水", "a") == [True, False]
    assert one(T.lhs_symbols("x"), "P_ij = S / T; Q=1", "none") == [["Pij", "Q"], []] and one(T.split_compound("x"), "a、b和c", "ab") == [["a", "b", "c"], ["ab"]] and one(T.output_symbols("x", F.array(F.lit("P_ij"), F.lit("Q_a"))), "P_ij = Q") == [["P_ij"]]
    assert one(T.symbol_occurs("x", F.lit("P′ = S_ij")), "P'", "S", "Z") == [True, True, False] and one(T.clean_formula("x"), "通用水量平衡方程", "通用水量平衡方程A") == ["水量平衡方程", "通用水量平衡方程A"]
    assert one(T.json_digest(F.struct(F.col("x").alias("b"), F.lit(1).alias("a"))), "é") == [extraction.digest({"a": 1, "b": "é"})] and one(T.display(F.lit(None).cast("double")), "x") == ["待实验补充"] and one(T.display(F.lit(0.5)), "x") == ["0.5000"] and one(T.subject_name("x"), "生态问题评估", "别的") == ["生态问题", ""]
    assert values(spark, T.heading_title("x"), ["7 a", "附录 A 水"], [], ["7.1 土"], kind="array<string>") == ["水", "", "土"] and values(spark, T.indicator_heading("x"), ["7.1 指数（EQI）"], kind="array<string>") == ["指数"] and values(spark, T.round_box("x"), [1.23456], kind="array<double>") == [[1.235]]
    assert one(T.gazetteer_first("x", ["遥感影像数据", "遥感影像"]), "遥感影像数据") == [["遥感影像数据"]] and one(F.to_json(T.fenced_json("x")), "```json\n{\"a\":1}\n```", "x {\"a\":2} y", "no") == ['{"a":1}', '{"a":2}', None]


def test_small_pieces(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", True)], "rank int, v string, is_correct boolean")
    assert evaluation.ranking(spark.createDataFrame([(1, True), (4, True)], "rank int, is_correct boolean")).first().hits_1 == 0.5 and evaluation.ranking(rows.limit(0)).first().mrr == 0.0
    first = evaluation.micro(rows.limit(0), rows.limit(0), ["v"], strict_empty=False).first()
    assert (first.precision, first.recall, first.f1) == (0.0, 0.0, 0.0) and evaluation.micro(rows.limit(0), rows.limit(0), ["v"]).first().precision == 1.0
    assert evaluation.edge_recall(rows.withColumn("relation_type", F.col("v")), rows.withColumn("relation_type", F.col("v")).where("rank = 1"), ["rank"], "a").first().recall == 0.5
    ok = spark.createDataFrame([("x", True)], "check string, passed boolean")
    assert evaluation.gate(evaluation.checks(ok, ok)).first().passed and not evaluation.gate(ok.limit(0)).first().passed
    box = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    got = spark.range(1).select(layout.intersects(box(0, 0, 1, 1), box(1, 0, 2, 1)), layout.intersects(box(0, 0, 2, 2), box(1, 1, 3, 3)), evidence.valid_box(box(0, 0, 601, 5), F.lit(600.0), F.lit(5.0)), evidence.valid_box(box(2, 0, 1, 5), F.lit(600.0), F.lit(5.0))).first()
    assert tuple(got) == (False, True, True, False)
    heads = spark.createDataFrame([([["a", None], ["b", "c"], ["1", "2"]],), ([["a", None], ["b", "2"], ["1", "2"]],), ([["a"]],), ([],)], "r array<array<string>>")
    assert [r[0] for r in heads.select(layout.header_rows(F.col("r"))).collect()] == [2, 1, 1, 0]
    with pytest.raises(ValueError, match="duplicate"):
        validation.one_to_one(rows.select("v"), rows.select("v"), "v")
    refs = validation.unresolved_references(spark.createDataFrame([("c", "按式（3）和按式（A.1）")], "c string, t string"), spark.createDataFrame([("c", "3")], "c string, n string"), "c", "t", "n")
    assert [r.n for r in refs.collect()] == ["A.1"]
