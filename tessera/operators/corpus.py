"""From files or documents to chunks and splits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T

CHUNK_CHARS, OVERLAP = 1400, 150
MARKS = "。；"


def best_copies(files: DataFrame, content: str, key: str, order: list[Column], digest: str = "sha256") -> DataFrame:
    """One row per key: exact copies of a content go first, then of each key the best by ``order``.

    Only digests move through the first shuffle's sort; rows without a key ('' or null) go before, so that their content counts for nothing.
    """
    files = files.withColumn(digest, F.sha2(F.col(content), 256)).where(F.coalesce(F.col(key), F.lit("")) != "")
    first = F.row_number().over(Window.partitionBy(digest).orderBy(*order))
    best = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return files.withColumn("_n", first).where("_n = 1").withColumn("_n", best).where("_n = 1").drop("_n")


def chunk_bounds(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP, marks: str = MARKS) -> Iterator[tuple[int, int]]:
    """Overlapping ranges of a text. A range ends after its last mark, if that lies in its second half."""
    start, n = 0, len(text)
    while start < n:
        end = min(n, start + size)
        if end < n:
            at = max(text.rfind(m, start, end) for m in marks)
            if at > start + size // 2:
                end = at + 1
        yield start, end
        if end >= n:
            return
        start = max(start + 1, end - overlap)


def chunks(docs: DataFrame, key: str, text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP, marks: str = MARKS) -> DataFrame:
    """(key, chunk_no, start, chunk): chunks of each text, whose white space is folded to single spaces before it is cut.

    Each cut depends on the one before, so a chunker runs over Arrow batches; rows need no shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, start, out, held = [], [], [], [], 0
            for row, x in enumerate(batch.column(1).to_pylist()):
                k = 0
                x = " ".join((x or "").split())
                for a, b in chunk_bounds(x, size, overlap, marks):
                    k += 1
                    at.append(row), no.append(k), start.append(a), out.append(x[a:b])
                    held += b - a
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(out, pa.string())], names=[key, "chunk_no", "start", "chunk"])
                    at, no, start, out, held = [], [], [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(out, pa.string())], names=[key, "chunk_no", "start", "chunk"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk_no int, start int, chunk string")


def document_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of (standard_code, document_title, page, text, source_file, source_sha256) with id, section, kind and path.

    The section is that of the last heading seen in the document, across pages.
    """
    cut = chunks(pages.withColumn("_key", F.struct("standard_code", "page").cast("string")), "_key", "text").drop("start")
    cut = cut.join(pages.withColumn("_key", F.struct("standard_code", "page").cast("string")).drop("text"), "_key").drop("_key")
    so_far = Window.partitionBy("standard_code").orderBy("page", "chunk_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.coalesce(F.last(T.first_heading("chunk"), ignorenulls=True).over(so_far), F.lit(""))
    code = F.replace(F.replace("standard_code", F.lit(" "), F.lit("")), F.lit("-"), F.lit("_"))
    return cut.withColumn("section", section).select(
        F.concat(code, F.lit("-p"), "page", F.lit("-c"), "chunk_no").alias("chunk_id"), "standard_code", "document_title", "page", "section", T.block_kind("chunk").alias("block_type"), F.col("chunk").alias("text"), "source_file", "source_sha256",
        T.stable_id("standard_code", F.when(F.col("section") != "", F.col("section")).otherwise(F.concat(F.lit("page-"), "page"))).alias("path_id"), F.lit(None).cast("array<double>").alias("bbox"),
    )


def carry_forward(rows: DataFrame, value: str | Column, partition: list[str], order: list[str], out: str) -> DataFrame:
    """The last value that wasn't null or '', up to the row itself; '' before any."""
    so_far = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    value = F.col(value) if isinstance(value, str) else value
    return rows.withColumn(out, F.coalesce(F.last(F.nullif(value, F.lit("")), ignorenulls=True).over(so_far), F.lit("")))


def group_split(rows: DataFrame, group: str, external: Column, seed: int = 42, out: str = "split") -> DataFrame:
    """Whole groups to external_test (where any row is external), train, validation or test, by a hash of the group."""
    b = T.bucket(F.col(group).cast("string"), seed)
    any_external = F.max(external.cast("int")).over(Window.partitionBy(group)) == 1
    return rows.withColumn(out, F.when(any_external, "external_test").when(b < 0.70, "train").when(b < 0.85, "validation").otherwise("test"))


def unit_split(role: Column, code: Column, group: Column) -> Column:
    """external_test documents to test, others than core to train; of core a fifth of the groups to dev. ``group`` is '|table|id' or '|section|number', as in ``annotate.unit_split``."""
    bucket = F.conv(T.stable_id(F.lit("split-v2"), F.concat(code, group)), 16, 10).cast("decimal(20,0)") % 5
    return F.when(role == "external_test", "test").when(role != "core", "train").when(bucket == 0, "dev").otherwise("train")


def triple_split(evidence: DataFrame, triple: str, split: str = "split") -> DataFrame:
    """The strictest split among a triple's evidence: test before dev before train."""
    rank = F.max(F.when(F.col(split) == "test", 2).when(F.col(split) == "dev", 1).otherwise(0))
    return evidence.groupBy(triple).agg(rank.alias("_r")).select(triple, F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), F.col("_r") + 1).alias(split))


def split_report(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that lie in more than one split."""
    return rows.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")
