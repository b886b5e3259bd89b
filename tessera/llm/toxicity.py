"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

Features are hashed words and word beginnings of 4, 6 and 8 bytes; those
that documents labelled toxic have far more often are selected, and a text
is described by how often it has each. One weight vector serves all ordered
thresholds: P(grade > k) = sigmoid(w.x - b_k), b_0 < b_1 < b_2. The expected
severity is the sum of these over k.

The labels say only toxic or not. Grades of the toxic ones come from the
selected features themselves: thirds by the share of a text's words that
have one give grades 1 to 3; all others are grade 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _spark, _text

GRADES = 4
BITS = 20
BEGINNINGS = (4, 6, 8)
TRAIN_ROWS = 4000
REJECT = 0.5
SEED = 7
#: A feature is selected from as many toxic training documents at least, and the best so many in all; more than ``CAP`` occurrences in a text count as that many.
MIN_DOCS, MOST, CAP = 3, 4000, 3


class Model(NamedTuple):
    buckets: np.ndarray  # selected hash buckets, ascending
    weights: np.ndarray
    bounds: np.ndarray  # ascending
    cap: int


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets (features x words), the words' documents, and the number of words by document."""
    s, e, doc = _text.words(buf, offs)
    mask = np.uint64((1 << BITS) - 1)
    out = [_text.span_hash(buf, s, e) & mask]
    for k in BEGINNINGS:
        h = _text.mix(_text.span_hash(buf, s, np.minimum(e, s + k)) + np.uint64(k))
        out.append(np.where(e - s > k, h & mask, out[0]))
    return np.stack(out).astype(np.int32), doc, np.bincount(doc, minlength=len(offs) - 1)


def _counts(buckets: np.ndarray, doc: np.ndarray, selected: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of selected buckets: document, index of the bucket, count. A word has each bucket once."""
    if not len(selected) or not buckets.size:
        z = np.zeros(0, np.int64)
        return z, z, z
    table = np.full(1 << BITS, -1, np.int32)
    table[selected] = np.arange(len(selected))
    hit = table[buckets]
    for k in range(1, len(hit)):
        hit[k][buckets[k] == buckets[0]] = -1
    row, word = np.nonzero(hit >= 0)
    key, count = np.unique(doc[word] * len(selected) + hit[row, word], return_counts=True)
    return key // len(selected), key % len(selected), count


def _featured(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``features`` of a batch's second column, with the range of its rows that they are of."""
    buf, offs = _text.flat(_text.lowered(batch.column(1)))
    for i, j in _text.chunks(offs):
        yield i, j, *features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, toxic): in how many toxic and how many other texts of all batches each bucket is."""
    found = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        toxic = batch.column(2).to_numpy(zero_copy_only=False) == 1
        for i, _, b, d, _ in _featured(batch):
            pair = np.unique(d.astype(np.int64) << BITS | b)
            y = toxic[i:][pair >> BITS]
            for k in (0, 1):
                found[k] += np.bincount(pair[y == k] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
    at = np.flatnonzero(found.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (at, found[1][at], found[0][at])], names=["bucket", "bad", "good"])


def _used(chosen: np.ndarray):
    """Of (doc_id, text, toxic, h): the number of words, and which chosen buckets each text has how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, d, n_words in _featured(batch):
                row, col, count = _counts(b, d, chosen)
                ends = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (col, count)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(3)[i:j], batch.column(2)[i:j], pa.array(n_words.astype(np.int64)), *lists], names=["doc_id", "h", "toxic", "words", "features", "counts"])

    return run


def _choose(seen: pa.Table, share: float, min_docs: int, ratio: float, most: int) -> np.ndarray:
    """The best buckets, ascending. share: toxic texts for each other one."""
    bucket, bad, good = (seen.sort_by("bucket")[c].to_numpy().astype(np.int64) for c in ("bucket", "bad", "good"))
    # documents' lengths differ between the labels, so rates are per document with as many words
    lift = (bad + 0.1) / (good + 0.5) / share
    chosen = np.flatnonzero((bad >= min_docs) & (lift >= ratio))
    return np.sort(bucket[chosen[np.argsort(-(bad * np.log(lift))[chosen], kind="stable")[:most]]])


def fit(texts: list[str], toxic: list[int], min_docs: int = MIN_DOCS, ratio: float = 4.0, most: int = MOST, epochs: int = 300, cap: int = CAP) -> Model:
    """Trains on labelled texts that are here. Without both labels the model finds nothing toxic."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return _nothing(cap)
    ids = pa.array(np.arange(len(y)))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(y.astype(np.int32)), ids], names=["doc_id", "text", "toxic", "h"])
    chosen = _choose(pa.Table.from_batches(_seen(iter([batch]))), y.sum() / (~y).sum(), min_docs, ratio, most)
    return _learn(pa.Table.from_batches(_used(chosen)(iter([batch]))), chosen, epochs, cap) if len(chosen) else _nothing(cap)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, min_docs: int = MIN_DOCS, ratio: float = 4.0, most: int = MOST, epochs: int = 300, cap: int = CAP) -> Model:
    """The model of ``fit(*sample(docs, labels, rows))``. The texts stay with the executors, which count the
    features; the driver gets the buckets of ``min_docs`` toxic texts or more, which are 2**BITS at most,
    and how often each text has the selected ones."""
    if (found := _labelled(docs, labels, rows)) is None:
        return _nothing(cap)
    found = _spark.cut(found.withColumn("h", F.xxhash64("text")).repartition("doc_id"))
    n = {r["toxic"]: r["count"] for r in found.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return _nothing(cap)
    seen = found.mapInArrow(_text.releasing(_seen), "bucket int, bad int, good int").groupBy("bucket").agg(*(F.sum(c).cast("int").alias(c) for c in ("bad", "good")))
    chosen = _choose(seen.where(F.col("bad") >= min_docs).toArrow(), n[1] / n[0], min_docs, ratio, most)
    if not len(chosen):
        return _nothing(cap)
    used = found.mapInArrow(_text.releasing(_used(chosen)), "doc_id long, h long, toxic int, words long, features array<int>, counts array<int>").toArrow()
    model = _learn(used.sort_by([(c, "ascending") for c in ("doc_id", "h", "toxic")]), chosen, epochs, cap)
    del used
    _text.release()
    return model


def _nothing(cap: int) -> Model:
    """Finds nothing toxic."""
    return Model(np.zeros(0, np.int64), np.zeros(0), np.array([30.0, 31.0, 32.0]), cap)


def _learn(used: pa.Table, chosen: np.ndarray, epochs: int, cap: int) -> Model:
    used = used.combine_chunks()
    y, n_words = used["toxic"].to_numpy() == 1, used["words"].to_numpy()
    n = len(y)
    row = np.repeat(np.arange(n), pc.list_value_length(used["features"]).to_numpy())
    col, count = (pc.list_flatten(used[c]).to_numpy() for c in ("features", "counts"))
    x = np.log1p(np.minimum(count, cap).astype(np.int64))
    density = np.bincount(row, count, n) / np.maximum(n_words, 1)
    grade = np.zeros(n, np.int64)
    cuts = np.quantile(density[y], [1 / 3, 2 / 3])
    grade[y] = 1 + np.searchsorted(cuts, density[y], side="left")

    w = np.zeros(len(chosen))
    theta = np.array([1.0, 0.0, 0.0])  # first bound and logs of the gaps
    m = [np.zeros(len(w) + 3), np.zeros(len(w) + 3)]
    above = np.stack([grade > k for k in range(GRADES - 1)], 1).astype(float)
    for t in range(1, epochs + 1):
        bounds = np.cumsum([theta[0], np.exp(theta[1]), np.exp(theta[2])])
        z = np.bincount(row, w[col] * x, n)[:, None] - bounds
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gz = (p - above) / n
        gw = np.bincount(col, gz.sum(1)[row] * x, len(w)) + 2e-5 * w
        gb = -gz.sum(0)
        g = np.r_[gw, gb.sum(), gb[1:].sum() * np.exp(theta[1]), gb[2] * np.exp(theta[2])]
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.999 * m[1] + 0.001 * g * g
        step = 0.1 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-9)
        w -= step[: len(w)]
        theta -= step[len(w) :]
        theta[1:] = np.clip(theta[1:], -3, 3)
    return Model(chosen, w, np.cumsum([theta[0], np.exp(theta[1]), np.exp(theta[2])]), cap)


def predict(model: Model, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected severity (0 to 3) and probability of any toxicity of each lower-case text."""
    b, d, _ = features(buf, offs)
    row, col, count = _counts(b, d, model.buckets)
    z = np.bincount(row, model.weights[col] * np.log1p(np.minimum(count, model.cap)), len(offs) - 1) if len(row) else np.zeros(len(offs) - 1)
    p = 1 / (1 + np.exp(-np.clip(z[:, None] - model.bounds, -30, 30)))
    return p.sum(1), p[:, 0]


def _labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = SEED) -> DataFrame | None:
    """(doc_id, text, toxic) of at most ``rows`` labels, half of them toxic where there are as many: those with the least seeded hash. None without labels."""
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    ids = [r for k in (0, 1) for r in labels.where(F.col("toxic") == k).orderBy(*order).limit(rows // 2).collect()]
    if not ids:
        return None
    # a table of at most `rows` rows
    wanted = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int"))
    return _spark.documents(docs, "text").join(wanted, "doc_id").select("doc_id", "text", "toxic")


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = SEED) -> tuple[list[str], list[int]]:
    """The texts that ``train`` learns from, and their labels."""
    found = _labelled(docs, labels, rows, seed)
    got = sorted(found.collect(), key=lambda r: (r[0], r[1] or "")) if found is not None else []
    return [r[1] or "" for r in got], [r[2] for r in got]


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = _text.flat(_text.lowered(batch.column(1)))
            for i, j in _text.chunks(offs):
                severity, p = predict(model, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(severity), pa.array(p), pa.array(p >= REJECT)], names=["doc_id", "severity", "p_toxic", "toxic"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, min_docs: int = MIN_DOCS, most: int = MOST, cap: int = CAP) -> DataFrame:
    """(doc_id, severity, p_toxic, toxic): expected severity from 0 to 3, probability of a grade above 0, and whether that reaches 0.5.

    The model is trained on at most ``train_rows`` of the labelled documents,
    with at most ``most`` features from ``min_docs`` toxic ones each; a feature
    counts up to ``cap`` times in a text. All texts are scored whole.

    Defined results: a null doc_id is left out; null, empty and wordless
    texts have no features and get the model's base rate; repeated rows each
    give a row; with no labels of both kinds, or no feature worth selecting, nothing is
    toxic; labels of null or other values, and of unknown documents, don't
    count; no documents give no rows; further columns are not looked at.
    Texts of any length are scored whole.
    """
    model = train(docs, labels, train_rows, min_docs=min_docs, most=most, cap=cap)
    return _spark.documents(docs, "text").mapInArrow(_text.releasing(_score(model)), "doc_id long, severity double, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the documents that the model rejects, all columns as they are.

    Defined results: those of ``toxicity``; rows of a null doc_id, and null, empty
    and wordless texts, stay; repeated rows all stay or all go; without labels of
    both kinds all stay; no documents give no rows; a table without the column text raises.
    """
    model = train(docs, labels, train_rows)
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = _text.flat(_text.lowered(batch.column(at)))
            keep = [predict(model, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[1] < REJECT for i, j in _text.chunks(offs)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(_text.releasing(run), schema)
