"""Language identification by a byte convolutional network, trained in numpy.

A window of 256 bytes is embedded, convolved with filters of widths 2, 3
and 4, rectified, max-pooled over the window and classified by a softmax.
Texts are cut into consecutive windows, all of which count: a document's
log-probabilities are the means over its windows, weighted by their bytes.

For use, embedding and filters are multiplied out into one table per width
and tap, so that a convolution is a sum of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import _spark, _text

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
TRAIN_ROWS = 300
TRAIN_WINDOWS = 4
UNKNOWN = "und"
SEED = 5


class Model(NamedTuple):
    languages: list[str]
    embedding: np.ndarray  # 256 x E
    filters: list[np.ndarray]  # width x E x F
    biases: list[np.ndarray]
    weights: np.ndarray  # languages x all filters
    bias: np.ndarray


def windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (padded with zeros) of each text, their document, and their bytes."""
    size = np.diff(offs)
    n = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = offs[doc] + k * WINDOW
    length = np.minimum(WINDOW, offs[doc + 1] - start)
    out = np.zeros((len(doc), WINDOW), np.uint8)
    # the windows of a text lie side by side, but for what its last one is short of
    to = np.repeat(np.cumsum(n) * WINDOW - (n * WINDOW - size) - np.cumsum(size), size) + np.arange(len(buf)) if len(buf) else np.zeros(0, np.int64)
    out.reshape(-1)[to] = buf
    return out, doc, length


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 12, batch: int = 64, seed: int = SEED) -> Model:
    """Adam on the cross-entropy of windows x (n x 256 bytes) labelled y."""
    rng = np.random.default_rng(seed)
    c = len(languages)
    p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "v": rng.normal(0, 0.1, (c, FILTERS * len(WIDTHS))), "c": np.zeros(c)}
    for w in WIDTHS:
        p[f"k{w}"] = rng.normal(0, (1 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
            n = len(xb)
            emb = p["e"][xb]
            pooled, held = [], []
            for w in WIDTHS:
                t = WINDOW - w + 1
                cols = np.concatenate([emb[:, k : k + t] for k in range(w)], 2)
                z = cols @ p[f"k{w}"] + p[f"b{w}"]
                top = z.argmax(1)
                m = np.take_along_axis(z, top[:, None], 1)[:, 0]
                pooled.append(np.maximum(m, 0))
                held.append((cols, top, m > 0))
            h = np.concatenate(pooled, 1)
            d = _softmax(h @ p["v"].T + p["c"])
            d[np.arange(n), yb] -= 1
            d /= n
            g = {"v": d.T @ h, "c": d.sum(0), "e": np.zeros_like(p["e"])}
            dh = d @ p["v"]
            for k, (w, (cols, top, on)) in enumerate(zip(WIDTHS, held)):
                dz = dh[:, k * FILTERS : (k + 1) * FILTERS] * on
                picked = cols[np.arange(n)[:, None], top]  # n x F x wE
                g[f"k{w}"] = np.einsum("nfe,nf->ef", picked, dz)
                g[f"b{w}"] = dz.sum(0)
                dc = dz[:, :, None] * p[f"k{w}"].T[None]
                for tap in range(w):
                    np.add.at(g["e"], xb[np.arange(n)[:, None], top + tap], dc[:, :, tap * EMBEDDING : (tap + 1) * EMBEDDING])
            step += 1
            for key, grad in g.items():
                first[key] = 0.9 * first[key] + 0.1 * grad
                second[key] = 0.999 * second[key] + 0.001 * grad**2
                p[key] -= 0.01 * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, p["e"], [p[f"k{w}"].reshape(w, EMBEDDING, FILTERS) for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["v"], p["c"])


def _tables(model: Model) -> list[list[np.ndarray]]:
    return [[np.ascontiguousarray(model.embedding @ k[t], np.float32) for t in range(len(k))] for k in model.filters]


def log_probabilities(model: Model, x: np.ndarray, tables: list[list[np.ndarray]] | None = None, block: int = 256) -> np.ndarray:
    """Of each window and language."""
    tables = tables or _tables(model)
    out = np.zeros((len(x), len(model.languages)), np.float32)
    for i in range(0, len(x), block):
        xb = x[i : i + block].T.astype(np.intp)  # bytes x windows, so that pooling runs over whole rows
        pooled = []
        for taps, bias in zip(tables, model.biases):
            t = WINDOW - len(taps) + 1
            m = None
            for a in range(0, t, 32):
                b = min(t, a + 32)
                z = taps[0][xb[a:b]]
                for k in range(1, len(taps)):
                    z += taps[k][xb[a + k : b + k]]
                top = z.max(0)
                m = top if m is None else np.maximum(m, top, out=m)
            pooled.append(np.maximum(m + bias, 0))
        z = np.concatenate(pooled, 1) @ model.weights.T + model.bias
        z -= z.max(1, keepdims=True)
        out[i : i + block] = z - np.log(np.exp(z).sum(1, keepdims=True))
    return out


def classify(model: Model, buf: np.ndarray, offs: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language index (-1 for an empty text), its probability, and the number of windows of each document."""
    n, c = len(offs) - 1, len(model.languages)
    x, doc, size = windows(buf, offs)
    lp = log_probabilities(model, x, tables) * size[:, None]
    total = np.maximum(np.diff(offs), 1)
    mean = np.stack([np.bincount(doc, lp[:, k], n) for k in range(c)], 1) / total[:, None]
    p = _softmax(mean)
    empty = np.diff(offs) == 0
    return np.where(empty, -1, p.argmax(1)), np.where(empty, 0.0, p.max(1)), np.bincount(doc, minlength=n)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, per_text: int = TRAIN_WINDOWS, seed: int = SEED) -> Model:
    """Trains on at most ``rows`` texts of each language, those with the least seeded hash of doc_id, and ``per_text`` windows at random places of each."""
    docs = _spark.documents(docs, "lang", "text").where("lang IS NOT NULL AND text <> ''")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id"))
    ids = docs.select("doc_id", "lang").withColumn("place", place).where(F.col("place") <= rows).select("doc_id").distinct().collect()
    rng = np.random.default_rng(seed)
    if not ids:
        return Model([UNKNOWN], np.zeros((256, EMBEDDING), np.float32), [np.zeros((w, EMBEDDING, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros((1, FILTERS * len(WIDTHS)), np.float32), np.zeros(1, np.float32))
    # a table of at most `rows` rows a language; where windows are drawn depends on the doc_id alone
    wanted = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long"))
    starts = F.transform(F.sequence(F.lit(1), F.lit(per_text)), lambda k: (F.pmod(F.xxhash64("doc_id", F.lit(seed), k), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"))
    cut = docs.join(wanted, "doc_id").select("doc_id", "lang", F.explode(starts).alias("s"), "text").select("doc_id", "lang", "s", F.expr(f"substring(text, s, {WINDOW})").alias("text"))
    got = sorted(map(tuple, cut.collect()))
    languages = sorted({r[1] for r in got})
    texts = [r[3].encode()[:WINDOW].ljust(WINDOW, b"\0") for r in got]
    x = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, WINDOW)
    y = np.array([languages.index(r[1]) for r in got])
    short = rng.random(len(x)) < 0.2  # some windows are short, as texts are
    x = np.where(short[:, None] & (np.arange(WINDOW) >= rng.integers(20, WINDOW, len(x))[:, None]), 0, x).astype(np.uint8)
    return train(x, y, languages)


def _run(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = _tables(model), np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            buf, offs = _text.flat(batch.column(1))
            for i, j in _text.chunks(offs, 1 << 20):
                best, p, n = classify(model, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], tables)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(names[best], pa.string()), pa.array(p), pa.array(n.astype(np.int32))], names=["doc_id", "language", "confidence", "windows"])

    return run


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_windows: int = TRAIN_WINDOWS) -> DataFrame:
    """(doc_id, language, confidence, windows) of each document, by a model trained on at most ``train_rows`` labelled texts (column lang) of each language, ``train_windows`` windows of each.

    Defined results: a null doc_id is left out; null and empty texts are
    'und' with confidence 0.0 and no windows; between equal probabilities the
    first language in alphabetical order wins; without any label all is
    'und'; repeated rows each give a row; no documents give no rows; further
    columns are not looked at. All windows of a text of any length count.
    """
    model = fit(docs, train_rows, train_windows)
    return _spark.documents(docs, "text").mapInArrow(_run(model), "doc_id long, language string, confidence double, windows int")
