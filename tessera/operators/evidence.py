"""Literal evidence: is the cited text in the cited chunk?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ontology


def contained(evidence: Column, source: Column) -> Column:
    """After folding white space, or without any."""
    return F.contains(T.normalize_space(source), T.normalize_space(evidence)) | F.contains(T.compact(source), T.compact(evidence))


def checked(relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Relations with ``valid`` and the first ``reason`` that fails: ontology, chunk, code, empty text, containment. One join on the chunk's id."""
    c = chunks.select(F.col("chunk_id").alias("_chunk"), F.col("standard_code").alias("_code"), F.col("text").alias("_text"))
    r = ontology.checked(relations, 1).join(c, F.col("evidence.chunk_id") == F.col("_chunk"), "left")
    reason = (
        F.when(~F.col("valid"), F.col("reason"))
        .when(F.col("_chunk").isNull(), "evidence chunk id does not match")
        .when(~F.col("evidence.standard_code").eqNullSafe(F.col("_code")), "evidence standard code does not match")
        .when(F.coalesce(T.normalize_space("evidence.evidence_text"), F.lit("")) == "", "evidence text is empty")
        .when(~contained(F.col("evidence.evidence_text"), F.col("_text")), "evidence is not a literal part of the chunk")
        .otherwise("")
    )
    return r.withColumn("reason", reason).withColumn("valid", F.col("reason") == "").drop("_chunk", "_code", "_text")


def provenance_ok(provenance: str) -> Column:
    """(valid, reason) of a struct (standard_code, source_sha256, source_unit_id, evidence_span_ids, pages, bboxes: a map from page to boxes): the first rule that fails."""
    p = F.col(provenance)
    given = lambda c: F.coalesce(p[c], F.lit("")) != ""
    some = lambda c: F.coalesce(F.size(p[c]), F.lit(0)) > 0
    none = F.array().cast("array<array<double>>")
    boxes = lambda n: F.coalesce(F.try_element_at(p["bboxes"], n), none)
    reason = (
        F.when(~(given("standard_code") & given("source_sha256")), "standard_code and source_sha256 are required")
        .when(~(given("source_unit_id") & some("evidence_span_ids")), "source_unit_id and evidence_span_ids are required")
        .when(~some("pages") | F.exists(p["pages"], lambda n: n <= 0), "positive page numbers are required")
        .when(F.exists(p["pages"], lambda n: F.size(boxes(n)) == 0), "a page has no box")
        .when(F.exists(p["pages"], lambda n: F.exists(boxes(n), lambda b: F.size(b) != 4)), "a box isn't four numbers")
        .otherwise("")
    )
    return F.struct((reason == "").alias("valid"), reason.alias("reason"))


def valid_box(box: Column, width: Column, height: Column) -> Column:
    at = lambda k: F.get(box, F.lit(k))
    return (F.size(box) == 4) & (at(0) >= 0) & (at(0) < at(2)) & (at(2) <= width + 1) & (at(1) >= 0) & (at(1) < at(3)) & (at(3) <= height + 1)


def provenance_metrics(checked_relations: DataFrame) -> DataFrame:
    """Traceable relations, accuracy and unsupported rate; repeated relations count."""
    n, ok = F.count("*"), F.count_if("valid")
    return checked_relations.agg(n.alias("relations"), ok.alias("traceable"), F.coalesce(F.round(F.try_divide(ok, n), 6), F.lit(0.0)).alias("accuracy"), F.coalesce(F.round(F.try_divide(n - ok, n), 6), F.lit(0.0)).alias("unsupported_rate"))


def find(items: DataFrame, docs: DataFrame, item: str, item_text: str, doc: str, doc_text: str, words: int = 5, short_bytes: int = 8 << 20) -> DataFrame:
    """(item, doc) where the item's text stands in the document's, white space folded.

    An item's second and following words must be whole words of the document,
    so that hashes of word runs are joined and only their matches compared.
    Items too short for that are searched in one pass over the documents by an
    automaton that holds them all, sent to the executors, as long as they take up to
    ``short_bytes`` together; beyond, they go in as many passes as that needs.
    """
    items = items.select(F.col(item).alias("_i"), T.normalize_space(item_text).alias("_it")).where("_it <> ''")
    items = items.withColumn("_w", F.split("_it", " "))
    docs = docs.select(F.col(doc).alias("_d"), T.normalize_space(doc_text).alias("_dt"))
    long = items.where(F.size("_w") >= words + 2).select("_i", "_it", F.xxhash64(F.array_join(F.slice("_w", 2, words), " ")).alias("_h"))
    w = F.split("_dt", " ")
    n = F.size(w) - words + 1
    runs = docs.select("_d", "_dt", w.alias("_w"), n.alias("_n")).where("_n > 0")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_n")), lambda k: F.xxhash64(F.array_join(F.slice("_w", k, F.lit(words)), " "))))
    near = runs.select("_d", "_dt", F.explode(grams).alias("_h")).join(long, "_h").where(F.contains("_dt", "_it"))
    out = near.select(F.col("_i").alias(item), F.col("_d").alias(doc)).distinct()

    short = items.where(F.size("_w") < words + 2).select("_i", "_it")
    total = short.agg(F.coalesce(F.sum(F.octet_length("_it") + 16), F.lit(0))).first()[0]
    passes = -(-total // short_bytes)
    for k in range(passes):
        part = [tuple(r) for r in short.where(F.pmod(F.xxhash64("_i"), F.lit(passes)) == k).collect()]  # at most about short_bytes
        out = out.union(_containing(docs, part, short.schema["_i"].dataType.simpleString()).toDF(doc, item).select(item, doc))
    return out.distinct()


def _containing(docs: DataFrame, items: list[tuple], kind: str) -> DataFrame:
    """(_d, _i) for each of few items that a document contains."""
    of: dict[str, list] = {}
    for i, text in items:
        of.setdefault(text, []).append(i)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        found = ahocorasick.Automaton()
        for text in of:
            found.add_word(text, text)
        if of:
            found.make_automaton()
        for batch in batches:
            hits = [(k, i) for k, t in enumerate(batch.column(1).to_pylist()) if t and of for text in {x for _, x in found.iter(t)} for i in of[text]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in hits], pa.int64())), pa.array([i for _, i in hits], to_type)], names=["_d", "_i"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    to_type = to_arrow_type(_parse_datatype_string(kind))
    return docs.mapInArrow(run, f"_d {docs.schema['_d'].dataType.simpleString()}, _i {kind}")
