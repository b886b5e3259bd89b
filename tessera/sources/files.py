"""Sources and sinks."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import subprocess
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ontology

CHUNK = "chunk_id string, standard_code string, document_title string, page int, section string, block_type string, text string, source_file string, source_sha256 string, path_id string, bbox array<double>"
RELATION = (
    "relation_id string, path_id string, head_id string, head_name string, head_type string, relation_type string, tail_id string, tail_name string, tail_type string, "
    "evidence struct<standard_code:string,page:int,section:string,chunk_id:string,evidence_text:string,source_sha256:string>, extraction_method string, confidence double, review_status string"
)
MANIFEST = "source_file string, source_sha256 string, standard_code string, title string, role string, page_count int"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_files(spark: SparkSession, path: str, glob: str = "*", exclude: str | None = None) -> DataFrame:
    """(path, length, content) of files under a folder, those whose name contains ``exclude`` left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    if exclude:
        df = df.where(~F.contains(F.element_at(F.split("path", "/"), -1), F.lit(exclude)))
    return df.select("path", "length", "content")


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """JSON lines; malformed ones raise, blank ones don't count; a missing file is an empty table or, if not allowed, an error."""
    if not exists(spark, path):
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CHUNK)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, RELATION)


def first_of(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first path that exists: a saved index, processed chunks, fixtures."""
    for p in paths:
        if exists(spark, p):
            return read_jsonl(spark, p, schema)
    raise FileNotFoundError(", ".join(paths))


def file_for_code(files: DataFrame, code: str) -> DataFrame:
    found = files.where(F.col("standard_code") == code).limit(1)
    if found.isEmpty():
        raise KeyError(code)
    return found


def read_any(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables by name under the output folder of another tool, those that are there."""
    return {n: spark.read.parquet(f"{root}/{n}.parquet") for n in names if exists(spark, f"{root}/{n}.parquet")}


_VARIABLE = "struct<symbol: string, definition: string, role: string, unit: string>"
OVERRIDES = (
    "standard_code string, document_title string, printed_page string, section string, formula_number string, expression_text string, transcription_method string, review_status string, "
    f"page int, bbox array<double>, line_ids array<string>, heading_chain array<string>, replace_existing boolean, variables array<{_VARIABLE}>"
)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """OVERRIDES rows: formulas typed in by hand."""
    from pyspark.sql.types import ArrayType, StructType, _parse_datatype_string

    shape = StructType().add("overrides", ArrayType(_parse_datatype_string(OVERRIDES)))
    return spark.read.option("multiLine", True).schema(shape).json(path).select(F.explode("overrides").alias("o")).select("o.*")


def read_cases(spark: SparkSession, *paths: str) -> DataFrame:
    """(case_id, standard_code, pdf_page, config): pages read by hand, of one or several files; config is the case as JSON text."""
    raw = spark.read.text(list(paths), wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.cases"), "array<string>")).alias("config"))
    at = lambda k: F.get_json_object("config", f"$.{k}")
    return raw.select(at("case_id").alias("case_id"), at("standard_code").alias("standard_code"), at("pdf_page").cast("int").alias("pdf_page"), "config")


def read_config(path: str | None) -> dict:
    """Settings from a JSON file; none without one."""
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def text_head(path: str, pages: int = 3) -> tuple[str, int]:
    """The text of the first pages of a PDF file and how many pages it has; needs pdfplumber."""
    with _pdf(path) as pdf:
        return "\n".join(p.extract_text() or "" for p in pdf.pages[:pages]), len(pdf.pages)


def _pdf(path_or_file):
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pdfplumber") from e
    return pdfplumber.open(path_or_file)


def raw_tables(page) -> list[dict]:
    """Tables of a PDF page as RAW has them; those under two rows or columns don't count."""
    out = []
    for table in page.find_tables():
        rows = table.extract()
        if len(rows) >= 2 and max(map(len, rows)) >= 2:
            cells = [[list(map(float, c)) if c else None for c in r.cells] for r in table.rows]
            out.append({"bbox": list(map(float, table.bbox)), "rows": rows, "cell_bboxes": cells})
    return out


def read_pages(files: DataFrame) -> DataFrame:
    """RAW rows of (standard_code, document_title, source_file, source_sha256, content): a PDF file each, opened where its bytes lie; needs pdfplumber."""
    import io

    from tessera.operators.units import RAW, by_row

    def one(row: dict) -> list[dict]:
        with _pdf(io.BytesIO(row.pop("content"))) as pdf:
            pages = [
                {"page": k, "width": float(p.width), "height": float(p.height), "tables": raw_tables(p),
                 "lines": [{"text": x["text"], "bbox": [x["x0"], x["top"], x["x1"], x["bottom"]]} for x in p.extract_text_lines(x_tolerance=1, y_tolerance=3, strip=True, return_chars=False)]}
                for k, p in enumerate(pdf.pages, 1)
            ]
        return [{**row, "pages": pages}]

    return by_row(files, one, RAW)


def write_layouts(layout: DataFrame, path: str) -> None:
    """LAYOUT documents as JSON lines, partitioned by file name."""
    layout.withColumn("layout_file", F.concat(F.translate("standard_code", " -", "__"), F.lit(".layout.json"))).write.mode("overwrite").option("ignoreNullFields", False).partitionBy("layout_file").json(path)


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """LAYOUT documents that ``write_layouts`` wrote; absent versions get this one."""
    from tessera.operators.units import COORDINATES, LAYOUT, LAYOUT_VERSION

    raw = spark.read.schema(LAYOUT).json(path).drop("layout_file")
    return raw.withColumns({"schema_version": F.coalesce("schema_version", F.lit(LAYOUT_VERSION)), "coordinate_system": F.coalesce("coordinate_system", F.lit(COORDINATES))})


def write_json(value: object, path: str) -> None:
    """One JSON document with sorted keys and an indent of two, its folder made where need be."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def sha256_path(path: str) -> str:
    """The digest of a file's bytes, read in blocks."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def now() -> str:
    """The time in UTC, ISO 8601."""
    return datetime.now(UTC).isoformat()


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with columns in alphabetical order, nulls kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Fixed columns, missing ones blank, others left out; a byte order mark before the header of each file."""
    cols = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields]
    out = df.select(*cols)
    first = "﻿" + fields[0]
    out.withColumnRenamed(fields[0], first).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_with_manifest(df: DataFrame, path: str) -> DataFrame:
    """Writes JSON lines and returns (file, records, bytes, sha256) of each file written."""
    write_jsonl(df, path)
    raw = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    lines = F.length(F.col("content").cast("string")) - F.length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")))
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), lines.cast("long").alias("records"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_ok(manifest: DataFrame, path: str) -> DataFrame:
    """(file, ok): registered files whose bytes still have the registered digest; a file that isn't registered isn't ok."""
    raw = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("now"))
    return manifest.join(raw, "file", "full").select("file", F.coalesce(F.col("sha256") == F.col("now"), F.lit(False)).alias("ok"))


def find_manifest(path: str, version: str) -> tuple[str, dict] | None:
    """The manifest.json of that version in the folders above a path, the nearest first."""
    at = os.path.abspath(path)
    while (above := os.path.dirname(at)) != at:
        at = above
        if os.path.exists(found := os.path.join(at, "manifest.json")) and (held := read_config(found)).get("schema_version") == version:
            return found, held
    return None


def assert_manifest_file(manifest_path: str, manifest: dict, path: str) -> None:
    """Raises unless a file is registered in a manifest (files: path, sha256) with the digest that it has."""
    name = os.path.relpath(path, os.path.dirname(manifest_path)).replace(os.sep, "/")
    known = {f["path"]: f["sha256"] for f in manifest.get("files", [])}
    if name not in known:
        raise ValueError(f"file is not registered in dataset manifest: {name}")
    if known[name] != sha256_path(path):
        raise ValueError(f"dataset file hash differs from manifest: {name}")


# -- indexes ----------------------------------------------------------------


def save_index(chunks: DataFrame, relations: DataFrame, path: str) -> dict:
    """Chunks, relations and postings that ``graph.search_index`` reads; without relations those of the rules. Returns a summary, which is written too."""
    from tessera.operators import extraction, graph

    relations = extraction.extract(chunks)[0] if relations.isEmpty() else relations
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    relations.write.mode("overwrite").parquet(f"{path}/relations")
    graph.write_postings(chunks, "chunk_id", "text", path, ["standard_code"])
    spark = chunks.sparkSession
    summary = {"adapter": "native", "chunk_count": spark.read.parquet(f"{path}/chunks").count(), "relation_count": spark.read.parquet(f"{path}/relations").count(), "status": "complete"}
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    return summary


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/relations")


class Knowledge:
    """Questions to a saved index: search, evidence, paths, what is missing, and the standards that there are."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.chunks, self.relations = load_index(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Knowledge:
        """The index under a data folder; where there is none, one made from its processed chunks or, without those, its fixtures, by the rules."""
        path = f"{root}/index/native"
        if not exists(spark, f"{path}/chunks"):
            chunks = first_of(spark, [f"{root}/processed/chunks.jsonl", f"{root}/fixtures/mini_chunks.jsonl"], CHUNK)
            save_index(chunks, spark.createDataFrame([], RELATION), path)
        return cls(spark, path)

    def standards(self) -> DataFrame:
        return self.chunks.select("standard_code").distinct().orderBy("standard_code")

    def search(self, query: str, standard_code: str = "", limit: int = 10) -> DataFrame:
        """The best chunks with all their columns and ``score``."""
        from tessera.operators import graph

        only = F.col("standard_code") == standard_code if standard_code else None
        top = graph.search_index(self.spark, self.path, query, "chunk_id", limit, only)
        return self.chunks.join(F.broadcast(top), "chunk_id").orderBy(F.desc("score"), "chunk_id")  # at most ``limit`` rows

    def evidence(self, query: str, standard_code: str = "") -> DataFrame:
        return self.search(query, standard_code, 5).select("standard_code", "page", "section", "text", "source_sha256", "score")

    def paths(self, name: str, depth: int = 4) -> DataFrame:
        from tessera.operators import graph

        found = graph.entity_path(self.relations, name, depth)
        return found.select(F.col("head_name").alias("head"), F.col("relation_type").alias("relation"), F.col("tail_name").alias("tail"), "evidence.standard_code", F.col("evidence.page").cast("string").alias("page"), "evidence.section")

    def missing(self, indicator: str) -> DataFrame:
        from tessera.operators import graph

        return graph.missing_requirements(self.relations, self.spark.createDataFrame([(indicator,)], "indicator string"))


def export_for_graph_tool(chunks: DataFrame, path: str, run: bool = False) -> dict:
    """The input of another graph tool: a CSV of the chunks, settings and a prompt; with ``run`` its command line is called, if there is one."""
    write_csv(chunks.withColumnRenamed("chunk_id", "id"), f"{path}/input", ["id", "text", "standard_code", "page", "section"])
    os.makedirs(f"{path}/prompts", exist_ok=True)
    types = "\n".join(f"    - {t}" for t in ontology._TYPES_V1.split())
    models = "".join(f"{k}_models:\n  default_{k}_model:\n    model_provider: openai\n    model: ${{TESSERA_{k.upper()}_MODEL}}\n    api_base: ${{TESSERA_LLM_BASE_URL}}\n    api_key: ${{TESSERA_LLM_API_KEY}}\n" for k in ("completion", "embedding"))
    rest = f"chunks:\n  size: 300\n  overlap: 40\nextract_graph:\n  prompt: prompts/extract_graph.txt\n  entity_types:\n{types}\n  max_gleanings: 1\n"
    with open(f"{path}/settings.yaml", "w", encoding="utf-8") as f:
        f.write(models + 'input:\n  type: file\n  file_type: csv\n  base_dir: input\n  file_pattern: ".*\\\\.csv$"\n  text_column: text\n  title_column: id\n' + rest)
    with open(f"{path}/prompts/extract_graph.txt", "w", encoding="utf-8") as f:
        f.write("Extract entities and relations of the given types from the text alone, each with the words that state it.\n")
    if run:
        _graph_tool("index", "--root", path)
    summary = {"adapter": "external_graph_tool", "chunk_count": chunks.count(), "status": "complete" if run else "prepared"}
    write_json(summary, f"{path}/adapter_summary.json")
    return summary


def _graph_tool(*arguments: str) -> str:
    tool = shutil.which("graphrag")
    if not tool:
        raise RuntimeError("the graph tool's command line isn't installed")
    return subprocess.run([tool, *arguments], check=True, capture_output=True, text=True, encoding="utf-8").stdout


def ask_graph_tool(path: str, query: str) -> str:
    """The other tool's answer to a question."""
    return _graph_tool("query", "--root", path, "--method", "local", "--query", query)


def map_outputs(spark: SparkSession, root: str) -> dict[str, int]:
    """The other tool's Parquet tables as JSON lines under ``mapped``, and how many rows each has; those that aren't there are left out."""
    counts = {}
    for name, table in read_any(spark, f"{root}/output", ["entities", "relationships", "text_units", "communities"]).items():
        write_jsonl(table, f"{root}/mapped/{name}.jsonl")
        counts[name] = table.count()
    write_json(counts, f"{root}/mapped/summary.json")
    return counts


# -- reports, plans, training -----------------------------------------------


def report(results: dict) -> str:
    """Results (status, main_results, expert_validation) as Markdown, four decimals, a placeholder where there is no value."""
    show = lambda v: "待实验补充" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    expert = results.get("expert_validation", {})
    lines = ["# Results", "", f"status: {results.get('status', 'unknown')}", "", "| method | result |", "|---|---|", *(f"| {k} | {show(v)} |" for k, v in results.get("main_results", {}).items())]
    lines += ["", "## Expert validation", "", *(f"- {k}: {show(expert.get(k))}" for k in ("sample_size", "reviewer_count", "acceptance_rate", "agreement"))]
    return "\n".join([*lines, "", "> What wasn't run has a placeholder and proves nothing."]) + "\n"


def layout_filename(code: str) -> str:
    return code.replace(" ", "_").replace("-", "_") + ".layout.json"


def config_digest(config: object) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


_REVIEW = [f"reviewer_{k}_{what}" for k in (1, 2) for what in ("decision", "comment")] + ["consensus_decision"]
ANNOTATION = "record_id path_id head_name head_type relation_type tail_name tail_type standard_code page section evidence_text source_chunk_id source_sha256 extraction_method confidence".split() + [*_REVIEW, "review_status"]


def annotation_sheet(relations: DataFrame) -> DataFrame:
    """Relations flattened for two reviewers, all pending, in the order of the sheet's columns."""
    nested = {"standard_code", "page", "section", "evidence_text", "source_sha256"}
    of = {"record_id": F.col("relation_id"), "source_chunk_id": F.col("evidence.chunk_id"), "review_status": F.lit("pending")} | {k: F.lit("") for k in _REVIEW}
    return relations.select(*(of.get(f, F.col(f"evidence.{f}") if f in nested else F.col(f)).alias(f) for f in ANNOTATION))


def ablations(spark: SparkSession) -> DataFrame:
    """The planned runs: the full method, it without each of its parts, three sizes of chunks, four numbers of shots, three thresholds. Overrides as JSON; no metrics yet."""
    parts = {"schema": "schema", "graphrag": "graphrag", "lora": "lora", "few_shot": "few_shot", "evidence": "evidence_validation"}
    plan = [("full_method", {}), *((f"without_{name}", {key: False}) for name, key in parts.items())]
    for label, key, values in (("chunk", "chunk_tokens", (150, 300, 600)), ("shot", "shots", (0, 1, 3, 5)), ("threshold", "candidate_threshold", (0.65, 0.75, 0.85))):
        plan += [(f"{label}_{v}", {key: v}) for v in values]
    return spark.createDataFrame([(n, json.dumps(o), None) for n, o in plan], "experiment_id string, overrides string, metrics string")


def write_ablation_plan(spark: SparkSession, path: str) -> None:
    rows = [{"experiment_id": r.experiment_id, "overrides": json.loads(r.overrides), "metrics": None} for r in ablations(spark).collect()]  # sixteen rows
    write_json({"status": "not_run", "experiments": rows}, path)


TRAINING = {
    "model_name": "Qwen/Qwen3.5-9B", "trainer": "transformers", "precision": "bf16", "rank": 8, "alpha": 16, "dropout": 0.05, "learning_rate": 2e-4, "max_epochs": 5, "early_stopping_patience": 2,
    "max_sequence_length": 4096, "per_device_train_batch_size": 1, "per_device_eval_batch_size": 1, "gradient_accumulation_steps": 16, "seed": 42, "data_seed": 42,
}


def training_command(data: str, out: str, settings: dict | None = None) -> list[str]:
    """The command line of an external trainer for low-rank adapters."""
    s = TRAINING | (settings or {})
    if s["precision"] not in ("bf16", "fp16"):
        raise ValueError("precision must be 'bf16' or 'fp16'")
    options = {
        "model": s["model_name"], "dataset": data, "tuner_type": "lora", "torch_dtype": {"bf16": "bfloat16", "fp16": "float16"}[s["precision"]], "num_train_epochs": s["max_epochs"],
        **{k: s[k] for k in ("per_device_train_batch_size", "per_device_eval_batch_size", "gradient_accumulation_steps", "learning_rate")}, **{f"lora_{k}": s[k] for k in ("rank", "alpha", "dropout")},
        "target_modules": "all-linear", "freeze_vit": "true", "freeze_aligner": "true", "add_non_thinking_prefix": "true", "padding_free": "false", "packing": "false", "sequence_parallel_size": 1, "split_dataset_ratio": 0.1,
        "eval_strategy": "epoch", "save_strategy": "epoch", "load_best_model_at_end": "true", "metric_for_best_model": "loss", "greater_is_better": "false", "early_stop_interval": s["early_stopping_patience"],
        "warmup_ratio": 0.1, "truncation_strategy": "delete", "max_length": s["max_sequence_length"], "seed": s["seed"], "data_seed": s["data_seed"], "save_total_limit": 2, "output_dir": out,
    }
    return ["swift", "sft", *(x for k, v in options.items() for x in (f"--{k}", str(v)))]


def run_training(data: str, out: str, settings: dict | None = None, smoke_limit: int | None = None, runner=subprocess.run) -> dict:
    """Calls the external trainer on a file of examples (JSON lines) and keeps a manifest of the run, whose status is running, complete or failed. Under two examples raise."""
    s = TRAINING | (settings or {})
    with open(data, encoding="utf-8") as f:
        rows = [x for x in f if x.strip()][: smoke_limit or None]
    if len(rows) < 2:
        raise RuntimeError("at least two reviewed training records are required")
    os.makedirs(out, exist_ok=True)
    used = data
    if smoke_limit:
        used = f"{out}/smoke_training.jsonl"
        with open(used, "w", encoding="utf-8") as f:
            f.writelines(rows)
    files = {"source_path": data, "source_sha256": sha256_path(data), "effective_path": used, "effective_sha256": sha256_path(used)}
    run = {"settings": s, "input": files, "training_records": len(rows), "smoke_limit": smoke_limit, "backend": "ms-swift", "command": training_command(used, out, s), "status": "running"}
    write_json(run, f"{out}/run_manifest.json")
    try:
        runner(run["command"], check=True, text=True)
        run["status"] = "complete"
    except FileNotFoundError as e:
        run |= {"status": "failed", "error": "the trainer's command isn't there"}
        raise RuntimeError(run["error"]) from e
    except subprocess.CalledProcessError as e:
        run |= {"status": "failed", "returncode": e.returncode}
        raise
    finally:
        write_json(run, f"{out}/run_manifest.json")
    return run
