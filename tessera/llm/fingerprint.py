"""Exact copies by the digest of a canonical text, checked byte by byte.

The canonical text is normalised (NFC), case-folded (full Unicode folding:
ß is ss, ﬁ is fi), normalised again, with white space folded to single
spaces and none at the ends. Its 128-bit xxh3 digest travels instead of the
text; only texts whose digest another text has too are compared themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _spark

FORM = "NFC"
SPACE = r"[\pZ\s\x0b\x{85}]+"
BROADCAST_BYTES = 64 << 20


def canonical(text: pa.Array, form: str = FORM) -> pa.Array:
    folded = pa.array([x.casefold() for x in pc.utf8_normalize(pc.fill_null(text, ""), form=form).to_pylist()], pa.string())
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_normalize(folded, form=form), SPACE, " "), " ")


def _digests(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(xxhash.xxh3_128_digest(x) for x in text.cast(pa.binary()).to_pylist())
    both = np.frombuffer(raw, ">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0].copy(), both[:, 1].copy()


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _digest(form: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                high, low = _digests(canonical(part.column(1), form))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(high), pa.array(low)], names=["doc_id", "high", "low"])

    return run


def _texts(form: str, wanted):
    """Canonical texts; of those alone whose digest is wanted, where a sorted array of digests is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                text = canonical(part.column(1), form)
                high, low = _digests(text)
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(high), pa.array(low), text], names=["doc_id", "high", "low", "text"])
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted.value, high), len(wanted.value) - 1)
                    out = out.filter(pa.array(wanted.value[at] == high))
                yield out

    return run


def fingerprints(docs: DataFrame, form: str = FORM) -> DataFrame:
    """(doc_id, high, low): the two halves of each canonical text's 128-bit digest.

    Defined results: a null doc_id is left out; null, empty and white texts
    have the digest of the empty text; repeated rows each give a row; no
    documents give no rows; further columns are not looked at. Texts of any
    length are digested whole.
    """
    return _spark.documents(docs, "text").mapInArrow(_digest(form), "doc_id long, high long, low long")


def exact_copies(docs: DataFrame, form: str = FORM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """For each document (doc_id) the least doc_id with the same canonical text (first_doc_id) and how many documents have it (copies).

    Texts of one digest are compared byte by byte, by grouping on the text
    itself, which leaves one row of each in a task before anything moves; no
    group of copies is ever held as a list. Where a digest turns out to have
    one text, its documents get the figures of the digest; where it has
    several, they are joined by text.

    Digests that several documents share are broadcast as an array of numbers while that
    takes up to ``broadcast_bytes``; beyond, the texts are joined to them by doc_id.

    Defined results: a null doc_id is left out; null, empty and white texts
    are copies of each other; rows that repeat a doc_id count once, by each
    text they have; equal digests of different texts stay apart; no documents
    give no rows; further columns are not looked at.
    """
    return _grouped(docs, _digest(form), lambda wanted: _texts(form, wanted), broadcast_bytes)


def _grouped(docs: DataFrame, digest, texts_of, broadcast_bytes: int) -> DataFrame:
    docs = _spark.documents(docs, "text")
    key = ["high", "low"]
    marked = _spark.cut(docs.mapInArrow(digest, "doc_id long, high long, low long").distinct())
    shared = _spark.cut(marked.groupBy(*key).agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies")).where("copies > 1"))
    alone = marked.join(shared, key, "left_anti").select("doc_id", F.col("doc_id").alias("first_doc_id"), F.lit(1).cast("long").alias("copies"))
    buckets = shared.select("high").distinct()
    if (count := buckets.count()) == 0:
        return alone
    kind = "doc_id long, high long, low long, text string"
    if count * 8 <= broadcast_bytes:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(buckets.toPandas()["high"].to_numpy()))
        texts = docs.mapInArrow(texts_of(wanted), kind).join(shared.select(*key), key, "left_semi")
    else:
        ids = marked.join(shared.select(*key), key, "left_semi").select("doc_id").distinct()
        texts = docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(texts_of(None), kind).join(shared.select(*key), key, "left_semi")
    several = texts.groupBy(*key, "text").agg(F.count("*").alias("_")).groupBy(*key).agg(F.count("*").alias("k")).where("k > 1")
    several = _spark.cut(several.select(*key))
    same = marked.join(shared.join(several, key, "left_anti"), key).select("doc_id", "first_doc_id", "copies")
    if several.isEmpty():
        return alone.union(same)
    apart = texts.join(several, key, "left_semi").select("doc_id", "text").distinct()
    apart = apart.join(apart.groupBy("text").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies")), "text")
    return alone.union(same).union(apart.select("doc_id", "first_doc_id", "copies"))


def _sql_fold(x: str) -> str:
    """SQL that folds case: lower() after the characters whose folding isn't their lower case."""
    odd = {c: f for c in map(chr, range(0x1E944)) if not "\ud800" <= c <= "\udfff" and (f := c.casefold()) != c.lower() and (f != c or c.lower() != c)}
    one = {c: f for c, f in odd.items() if len(f) == 1 and c.lower() == c}
    odd["İ"] = "İ".casefold()  # SQL's lower() drops the dot
    x = f"translate({x}, '{''.join(one)}', '{''.join(one.values())}')"
    for c, f in sorted(odd.items()):
        if c not in one:
            x = f"replace({x}, '{c}', '{f}')"
    return f"lower({x})"


ORACLE = rf"""
WITH c AS (SELECT DISTINCT doc_id, trim(regexp_replace(nfc_normalize({_sql_fold("nfc_normalize(coalesce(text, ''))")}), '[\pZ\s\x0b\x{{85}}]+', ' ', 'g'), ' ') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS first_doc_id, count(*) OVER (PARTITION BY t) AS copies FROM c
"""
