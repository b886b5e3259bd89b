"""Exact self-join of documents on the Jaccard similarity of their word n-grams.

Vertical partitioning: the n-grams of all documents have one global order,
cut into fragments. A document's n-grams are spread over the fragments;
each fragment is worked on alone and gives partial figures, which are then
summed, per document at first and per pair in the end:

1. Fragments of all documents count, per document, the n-grams that some
   other document has too. A document of which less than ``threshold`` is
   shared can be in no pair and goes (exact, since the overlap of a pair is
   at least ``threshold`` times the larger set).
2. Documents with equal sets become one; the others of such a set are
   paired with its least doc_id and aren't compared again.
3. Fragments of what is left count the frequency of each n-gram. The order
   is now rarest first; a pair must share an n-gram among the first
   ``size - ceil(threshold * size) + 1`` of both (prefix filter, exact).
4. Documents that share a band of minima of hashed n-grams form blocks, cut
   to what a task can hold. A block's n-gram order is cut into fragments
   in its task; overlaps are counted fragment by fragment (a 0/1 matrix product
   each, rare n-grams spelled out) and summed per pair. Pairs are counted and
   forgotten, so that a dense group of copies sends no pairs anywhere.
5. Pairs of two blocks: prefixes are spread by n-gram, and a document has the
   parities of its whole set with it, some two to four bits for each n-gram. Two
   documents that share an n-gram of both prefixes are told if what they have
   from it on reaches the overlap that the threshold needs, and if their
   parities don't differ in more places than n-grams may be in only one of them
   (both exact). Chance pairs, which share few n-grams, are hardly told. What is
   told is counted over all n-grams.

Blocks decide where a pair is counted and not whether. A phrase that a
million documents share makes no million squared pairs: it is common, hence
last in the order, and in no prefix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _spark, _text

N = 3
THRESHOLD = 0.5
_LOW = 40
_FLUSH = 3 << 20
#: N-grams and documents of a block that one task counts.
_HELD_GRAMS, _HELD_DOCS = 4 << 20, 20_000
#: Bands that link documents to blocks, and minima in each.
_BANDS, _ROWS = 8, 5
#: Bytes of prefixes and parities that one task looks at.
_LOOKED = 128 << 20


def _needed(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(size * threshold - 1e-9).astype(np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    """Bytes of little-endian numbers, all first bytes first: what repeats lies together and compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize)[:, :width].T).tobytes()


def _unplanes(raw: bytes, width: int, dtype: type) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(dtype)


_PACKED = "frag int, ids binary, sizes binary, counts binary, grams binary"
_PACKED_ARROW = pa.schema([("frag", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])
_SHARED = "bucket int, ids binary, sizes binary, counts binary, grams binary, freqs binary"
_SHARED_ARROW = pa.schema([("bucket", pa.int32()), *list(_PACKED_ARROW)[1:], ("freqs", pa.binary())])


def _pack(group: np.ndarray, keys: np.ndarray, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray, width: int, freqs: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row of each group. keys: n-grams, of which the low bytes are kept; at: the document of each as an index of ids and sizes."""
    if not len(keys):
        return
    order = np.argsort(group, kind="stable")
    group, keys, at = group[order], keys[order], at[order]
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    rows: list[tuple] = []
    for a, b in zip(edge[:-1], edge[1:]):
        d = at[a:b]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        k = d[first]
        rows.append((int(group[a]), _planes(np.diff(ids[k], prepend=0), 8), _planes(sizes[k], 4), _planes(np.diff(np.r_[first, b - a]).astype(np.int32), 4), _planes(keys[a:b], width), *([] if freqs is None else [_planes(freqs[order[a:b]], 4)])))
    kind = _PACKED_ARROW if freqs is None else _SHARED_ARROW
    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)


def _unpack(batches: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, ...] | None:
    """keys, at, ids, sizes and, where there are such, frequencies; the group is the upper part of keys that have no 8 bytes."""
    keys, at, ids, sizes, freqs, base = [], [], [], [], [], 0
    for batch in batches:
        for group, i, s, c, g, *f in zip(*(column.to_pylist() for column in batch.columns)):
            ids.append(np.cumsum(_unplanes(i, 8, np.int64)))
            sizes.append(_unplanes(s, 4, np.int32))
            at.append(np.repeat(np.arange(base, base + len(ids[-1]), dtype=np.int32), _unplanes(c, 4, np.int32)))
            keys.append(_unplanes(g, width, np.int64))
            if width < 8:
                keys[-1] |= int(group) << _LOW
            freqs += [_unplanes(x, 4, np.int32) for x in f]
            base += len(ids[-1])
    return tuple(np.concatenate(x) for x in (keys, at, ids, sizes, *[freqs] * bool(freqs))) if keys else None


def gram_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of (doc_id, text) rows: doc_ids, sizes of their n-gram sets, and the sets as (gram, index) sorted by index."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    buf, offs = _text.flat(_text.lowered(batch.column(1)))
    for i, j in _text.chunks(offs):
        b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        s, e, d = _text.words(b, o)
        g, d = _text.ngrams(_text.span_hash(b, s, e), d, n)
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
        keep = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])][: len(g)]
        g, d = g[keep], d[keep]
        yield ids[i:j], np.bincount(d, minlength=j - i).astype(np.int32), g, d.astype(np.int64)


def _spread(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = base = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, sizes, keys, at = (np.concatenate(x) for x in zip(*held))
            yield from _pack(keys >> _LOW, keys, at, ids, sizes, _LOW // 8)

        for batch in batches:
            for ids, sizes, g, d in gram_sets(batch, n):
                held.append((ids, sizes, (g >> np.uint64(64 - bits - _LOW)).astype(np.int64), d + base))
                base += len(ids)
                total += len(g)
                if total > _FLUSH:
                    yield from flush()
                    held, total, base = [], 0, 0
        if held:
            yield from flush()

    return run


def _respread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, size, grams) rows to fragments again."""
    for batch in batches:
        grams = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        if grams:
            keys, at = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(x) for x in grams])
            yield from _pack(keys >> _LOW, keys, at, batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int32), _LOW // 8)


def _shared(buckets: int):
    """Of one fragment: the n-grams that two documents or more have, with their frequencies, packed by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _unpack(batches, _LOW // 8)
        if got is None:
            return
        keys, at, ids, sizes = got
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        freq = np.diff(edge)
        many = np.repeat(freq > 1, freq)
        keys, at, freq = keys[many], at[many], np.repeat(freq, freq)[many].astype(np.int32)
        order = np.argsort(at, kind="stable")
        keys, at, freq = keys[order], at[order], freq[order]
        bucket = (_text.mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        yield from _pack(bucket[at], keys, at, ids, sizes, 8, freq)
        del got, keys, at, ids, sizes, order, edge, freq, many, bucket
        _text.release()

    return run


def _by_document(packed: DataFrame, fragments: int) -> DataFrame:
    """Shared n-grams by bucket of documents, a partition each: as many rows as there are pairs of a fragment and a bucket, and not of a fragment and a document."""
    shared = packed.repartitionById(fragments, F.col("frag")).mapInArrow(_shared(fragments), _SHARED)
    return shared.repartitionById(fragments, F.col("bucket"))


def _gathered(batches: Iterator[pa.RecordBatch], threshold: float, rare: bool) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """doc_ids, sizes and shared n-grams, in ascending order or rarest first, of the documents of a bucket that have enough of these; some 2**19 n-grams at once."""
    got = _unpack(batches, 8)
    if got is None:
        return
    keys, at, ids, sizes, freqs = got
    ids, of = np.unique(ids, return_inverse=True)
    size = np.zeros(len(ids), np.int64)
    size[of] = sizes
    doc = of.astype(np.int32)[at]
    order = np.lexsort((keys, doc))
    keys, doc, freqs = keys[order], doc[order], freqs[order]
    keep = np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]
    keys, doc, freqs = keys[keep], doc[keep], freqs[keep]
    del got, at, of, order, keep
    if rare:
        keys = keys[np.lexsort((keys, freqs, doc))]
    edge = np.searchsorted(doc, np.arange(len(ids) + 1))
    enough = np.flatnonzero(np.diff(edge) >= _needed(size, threshold))
    held = np.cumsum(np.diff(edge)[enough]) >> 19
    for part in np.split(enough, np.flatnonzero(held[1:] != held[:-1]) + 1):
        if len(part):
            yield ids[part].tolist(), size[part].tolist(), [keys[edge[k] : edge[k + 1]] for k in part]


def _covered(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, grams in _gathered(batches, threshold, False):
            same = [xxhash.xxh3_128_hexdigest(g.tobytes()) if len(g) == size else f"alone {doc}" for doc, size, g in zip(ids, sizes, grams)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(same), pa.array([g.tobytes() for g in grams], pa.binary())], names=["doc_id", "size", "same", "grams"])
        _text.release()

    return run


def _ordered(threshold: float):
    """Covered documents with their shared n-grams rarest first and how many of these are in the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, grams in _gathered(batches, threshold, True):
            prefix = np.array([len(g) for g in grams]) - _needed(np.array(sizes, np.int64), threshold) + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefix, pa.int32()), pa.array([g.tobytes() for g in grams], pa.binary())], names=["doc_id", "size", "prefix", "grams"])
        _text.release()

    return run


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands of minima of a document's hashed n-grams: each band of a batch with the least document that has it (gram, a), and the links of the batch's other documents to that one (a, b).

    A hash says which minimum an n-gram counts for. Two documents share a band
    with their similarity to the power of its length: copies hardly miss all
    bands, and documents of chance similarity hardly share one.
    """
    for batch in batches:
        keys, docs = [], []
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = _text.mix(np.frombuffer(raw, np.uint64))
            least = np.full(_BANDS * _ROWS, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, (h % np.uint64(len(least))).astype(np.int64), h)
            bands = least.reshape(_BANDS, _ROWS)
            some = (bands != np.iinfo(np.uint64).max).any(1)
            keys.append((_text.combine(list(bands.T)) ^ _text.mix(np.arange(1, _BANDS + 1, dtype=np.uint64)))[some].view(np.int64))
            docs.append(np.full(int(some.sum()), doc, np.int64))
        if keys:
            g, d, pair = _stars(np.concatenate(keys), np.concatenate(docs))
            none = pa.nulls(len(g), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(d), none], names=["gram", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.nulls(pair.shape[1], pa.int64()), pa.array(pair[0]), pa.array(pair[1])], names=["gram", "a", "b"])


def _stars(g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, the least document of each, and the distinct pairs of the other documents with it."""
    order = np.lexsort((d, g))
    g, d = g[order], d[order]
    edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]) if len(g) else np.zeros(1, np.int64)
    pair = np.stack([d, np.repeat(d[edge[:-1]], np.diff(edge))])
    pair = np.unique(pair[:, pair[0] != pair[1]], axis=1)
    return g[edge[:-1]], d[edge[:-1]], pair


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition by n-gram: each document with the least document that has the n-gram too."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    _, _, pair = _stars(*(np.concatenate(x) for x in zip(*got)))
    if pair.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])


def _least(o: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether an overlap of sets of a and b members gives the Jaccard similarity."""
    return o >= (threshold - 1e-9) * (a + b - o)


def _overlaps(sizes: np.ndarray, at: np.ndarray, grams: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (indices of documents, overlap) of one block that reach the threshold.

    The order of n-grams is cut into fragments, whose partial overlaps are
    summed per pair: those of many documents count by a product of 0/1
    matrices, the others by spelling out their pairs.
    """
    _, gram, freq = np.unique(grams, return_inverse=True, return_counts=True)
    keep = freq[gram] > 1
    gram, at = gram[keep], at[keep]
    order = np.lexsort((at, gram))
    gram, at = gram[order], at[order]
    n, block, step = len(sizes), 1024, 1024
    common = freq[gram] > max(8, n // 16)
    x_common, y_common = at[common], np.unique(gram[common], return_inverse=True)[1]
    width = int(y_common.max()) + 1 if len(y_common) else 0
    at, gram = at[~common], gram[~common]
    edge = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1], True]) if len(gram) else np.zeros(1, np.int64)
    stop = np.repeat(edge[1:], np.diff(edge))
    later = stop - np.arange(len(at)) - 1  # documents after this one that have the n-gram too
    for r in range(0, n, block):
        m = min(block, n - r)
        count = np.zeros((m, n - r), np.float32)
        for k in range(0, width, step):
            i, j = np.searchsorted(y_common, (k, k + step))
            x, y = x_common[i:j], y_common[i:j] - k
            right = np.zeros((n - r, min(step, width - k)), np.float32)
            right[x[x >= r] - r, y[x >= r]] = 1
            count += right[:m] @ right.T
        mine = np.flatnonzero((at >= r) & (at < r + m) & (later > 0))
        flat, bounds = count.reshape(-1), np.cumsum(later[mine])
        i = 0
        while i < len(mine):
            j = max(i + 1, int(np.searchsorted(bounds, (bounds[i - 1] if i else 0) + (1 << 21), side="right")))
            part = mine[i:j]
            first = np.repeat(part, later[part])
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later[part]) - later[part], later[part])
            np.add.at(flat, (at[first] - r) * (n - r) + at[second] - r, np.float32(1))
            i = j
        sa, sb = sizes[r : r + m].astype(np.float64)[:, None], sizes[r:].astype(np.float64)[None, :]
        a, b = np.nonzero(np.triu(_least(count, sa, sb, threshold) & (count > 0), 1))
        yield a + r, b + r, count[a, b].astype(np.int32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (block first, sorted by it) of one block after the other."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != now and held:
                yield held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield held


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least member) of classes after joining those of a and b."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(deeper := labels[labels], labels):
            labels = deeper


def _within(threshold: float, pairs: bool):
    """Of blocks by rows (block, doc_id, size, k, grams): pairs, or each document's class and links; k documents have a document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            rows.sort(key=lambda r: r[1])
            ids, sizes, k = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int32), np.array([r[3] for r in rows], np.int64)
            grams = np.frombuffer(b"".join(r[4] for r in rows), np.int64)
            at = np.repeat(np.arange(len(rows)), [len(r[4]) // 8 for r in rows])
            links, labels = np.zeros(len(rows)), np.arange(len(rows))
            for a, b, o in _overlaps(sizes, at, grams, threshold):
                if pairs and len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(o / (sizes[a] + sizes[b] - o))], names=["doc_id_a", "doc_id_b", "jaccard"])
                elif len(a):
                    links += np.bincount(a, k[b], len(rows)) + np.bincount(b, k[a], len(rows))
                    labels = _joined(labels, a, b)
            if not pairs:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[labels]), pa.array(links.astype(np.int64))], names=["doc_id", "class_id", "links"])
        _text.release()

    return run


_ROUTED = "bucket int, docs binary, bits binary, counts binary, places binary, grams binary"
_ROUTED_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("docs", "bits", "counts", "places", "grams"))])


def _widths(length: np.ndarray) -> np.ndarray:
    """Bits of the parities of sets: a power of 2, two for each n-gram at least."""
    return np.maximum(128, 1 << np.ceil(np.log2(2 * np.maximum(length, 1))).astype(np.int64))


def _parities(h: np.ndarray, width: int) -> bytes:
    """Whether an odd number of hashes is at each place; folded by halves, those of half the width."""
    return np.packbits((np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def _routed(buckets: int):
    """Of rows (doc_id, size, block, prefix, grams) the prefixes by bucket of n-grams, a row each, with the parities of the whole sets of the documents that have one there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(x, np.int64) for x in batch.column(4).to_pylist()]
            if not raw:
                continue
            length = np.array([len(x) for x in raw], np.int64)
            prefix = batch.column(3).to_numpy().astype(np.int64)
            bits = [_parities(_text.mix(x.astype(np.uint64)), w) for x, w in zip(raw, _widths(length).tolist())]
            about = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy(), length])
            at, g = np.repeat(np.arange(len(raw)), prefix), np.concatenate([x[:n] for x, n in zip(raw, prefix.tolist())])
            place = (np.arange(len(g)) - np.repeat(np.cumsum(prefix) - prefix, prefix)).astype(np.int32)
            bucket = ((_text.mix(g.astype(np.uint64)) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at, g, place, bucket = at[order], g[order], place[order], bucket[order]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            rows = []
            for a, b in zip(edge[:-1], edge[1:]):
                first = np.flatnonzero(np.r_[True, at[a + 1 : b] != at[a : b - 1]])
                k = at[a:b][first]
                rows.append((int(bucket[a]), about[:, k].T.tobytes(), b"".join([bits[x] for x in k.tolist()]), np.diff(np.r_[first, b - a]).astype(np.int32).tobytes(), place[a:b].tobytes(), g[a:b].tobytes()))
                if len(rows) == 64 or b == edge[-1]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ROUTED_ARROW)], schema=_ROUTED_ARROW)
                    rows = []

    return run


def _told(threshold: float):
    """Of a bucket: pairs of two blocks (a, b, size_a, size_b) that may reach the threshold, by the places of an n-gram of both prefixes and by the parities of both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, bits, at, place, g, base = [], [], [], [], [], 0
        for batch in batches:
            for d, x, c, p, q in zip(*(batch.column(k).to_pylist() for k in range(1, 6))):
                about.append(np.frombuffer(d, np.int64).reshape(-1, 4))
                bits.append(np.frombuffer(x, np.uint64))
                at.append(np.repeat(np.arange(base, base + len(about[-1]), dtype=np.int32), np.frombuffer(c, np.int32)))
                place.append(np.frombuffer(p, np.int32))
                g.append(np.frombuffer(q, np.int64))
                base += len(about[-1])
        if about:
            about, bits, at, place, g = (np.concatenate(x) for x in (about, bits, at, place, g))
            yield from _pairs_of_bucket(about, bits, at, place, g, threshold)
            del about, bits, at, place, g
            _text.release()

    return run


def _apart(bits: np.ndarray, start: np.ndarray, width: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of n-grams that only one of each two sets has, by their parities."""
    out = np.zeros(len(a), np.int64)
    narrow, wide = np.where(width[a] <= width[b], a, b), np.where(width[a] <= width[b], b, a)
    kind = width[narrow] * (1 << 32) + width[wide]
    for k in np.unique(kind).tolist():
        mine = np.flatnonzero(kind == k)
        few, many = (k >> 32) // 64, (k & ((1 << 32) - 1)) // 64
        step = max(1, (1 << 20) // many)
        for i in range(0, len(mine), step):
            m = mine[i : i + step]
            x = bits[start[narrow[m]][:, None] + np.arange(few)]
            y = bits[start[wide[m]][:, None] + np.arange(many)].reshape(len(m), many // few, few)
            out[m] = np.bitwise_count(x ^ np.bitwise_xor.reduce(y, axis=1)).sum(1)
    return out


def _pairs_of_bucket(about: np.ndarray, bits: np.ndarray, at: np.ndarray, place: np.ndarray, g: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """about: doc_id, size, block and length of each document; at, place, g: document, place and n-gram of each entry."""
    ids, sizes, block, length = about.T.copy()
    width = _widths(length)
    start = np.cumsum(width // 64) - width // 64
    order = np.lexsort((block[at], g))
    at, left, g = at[order], (length[at] - place)[order], g[order]  # left: n-grams from this one on
    edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
    stop = np.repeat(edge[1:], np.diff(edge))
    other = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (block[at[1:]] != block[at[:-1]]), True])
    after = np.repeat(other[1:], np.diff(other))  # where the next block of the n-gram begins
    share = threshold / (1 + threshold)
    order = np.argsort(at, kind="stable")  # what a pair shares is met together, mostly
    later = (stop - after)[order]
    order, later = order[later > 0], later[later > 0]
    bounds, i = np.cumsum(later), 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(bounds, (bounds[i - 1] if i else 0) + (1 << 20), side="right")))
        entry, n = order[i:j], later[i:j]
        i = j
        first = np.repeat(entry, n)
        second = np.repeat(after[entry] - (np.cumsum(n) - n), n) + np.arange(len(first))
        a, b = at[first], at[second]
        x, y = sizes[a], sizes[b]
        near = (np.minimum(left[first], left[second]) >= share * (x + y) - 1e-6) & (np.minimum(x, y) >= np.maximum(x, y) * threshold - 1e-6)
        key = np.unique(a[near].astype(np.int64) * len(ids) + b[near])
        a, b = key // len(ids), key % len(ids)
        good = length[a] + length[b] - _apart(bits, start, width, a, b) >= 2 * share * (sizes[a] + sizes[b]) - 1e-6
        a, b = a[good], b[good]
        if len(a):
            low = ids[a] < ids[b]
            p, q = np.where(low, a, b), np.where(low, b, a)
            yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(ids[q]), pa.array(sizes[p], pa.int32()), pa.array(sizes[q], pa.int32())], names=["a", "b", "size_a", "size_b"])


def _verified(threshold: float):
    """Pairs (a, b, size_a, size_b, grams of a, grams of b) that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c).to_numpy() for c in range(4))
            o = [len(np.intersect1d(np.frombuffer(p, np.int64), np.frombuffer(q, np.int64), assume_unique=True)) for p, q in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            o = np.array(o, np.int64)
            keep = _least(o, x, y, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array((o / (x + y - o))[keep])], names=["doc_id_a", "doc_id_b", "jaccard"])

    return run


_PAIRS = "doc_id_a long, doc_id_b long, jaccard double"
_CLASSES = "doc_id long, class_id long, links long"


def _searched(docs: DataFrame, n: int, threshold: float, held_grams: int, held_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets that can be in a pair (doc_id, rep, k: the least document with its set and how many have it); the blocks (block, doc_id, size, k, grams) to count by a task each; and the pairs of two blocks, kept."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    docs = _spark.one_text(docs)
    bits = max(1, math.ceil(math.log2(_spark.shuffle_partitions(docs))))
    fragments = 1 << bits
    packed = docs.mapInArrow(_spread(n, bits), _PACKED)
    found = _spark.cut(_by_document(packed, fragments).mapInArrow(_covered(threshold), "doc_id long, size int, same string, grams binary"))

    same = found.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k"))
    equal = found.select("same", "doc_id").join(same, "same").select("doc_id", "rep", "k")
    heads = found.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "size", "grams")
    left = _spark.cut(_by_document(heads.mapInArrow(_respread, _PACKED), fragments).mapInArrow(_ordered(threshold), "doc_id long, size int, prefix int, grams binary"))

    stars = left.select("doc_id", "grams").mapInArrow(_minima, "gram long, a long, b long")
    edges = stars.where("gram IS NOT NULL").select("gram", "a").repartition(fragments, "gram").mapInArrow(_links, "a long, b long").union(stars.where("gram IS NULL").select("a", "b"))
    member = _spark.components(edges).withColumnRenamed("id", "doc_id")
    weight = left.select("doc_id", F.length("grams").alias("w")).join(member, "doc_id").groupBy("component")
    cuts = weight.agg(F.ceil(F.greatest(F.sum("w") / (8 * held_grams), F.count("*") / held_docs)).alias("cuts"))
    # a block is a component or, of one that is too large, a slice by hash
    block = F.when(F.col("cuts") > 1, F.xxhash64("component", F.pmod(F.xxhash64("doc_id"), F.col("cuts")))).otherwise(F.col("component"))
    blocks = _spark.cut(member.join(cuts, "component").select("doc_id", block.alias("block")))

    k = same.select(F.col("rep").alias("doc_id"), "k")
    held = left.join(blocks, "doc_id").join(k, "doc_id").select("block", "doc_id", "size", "k", "grams").repartition(fragments, "block").sortWithinPartitions("block")
    alone = F.xxhash64("doc_id", F.lit("alone"))
    # what the documents of a bucket and their entries take at most, as if no document had two entries in one
    weight = left.agg(F.coalesce(F.sum(F.col("prefix") * (F.length("grams") / 16 + 48)), F.lit(0)).alias("bytes")).first()
    buckets = max(1, math.ceil(weight["bytes"] / _LOOKED))
    routed = left.join(blocks, "doc_id", "left").select("doc_id", "size", F.coalesce("block", alone).alias("block"), "prefix", "grams").mapInArrow(_routed(buckets), _ROUTED)
    told = routed.repartitionById(buckets, F.col("bucket")).mapInArrow(_told(threshold), "a long, b long, size_a int, size_b int")
    open_ = _spark.cut(told.distinct())
    wanted = open_.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    grams = left.join(wanted, "doc_id", "left_semi").select("doc_id", "grams")
    both = open_.join(grams.toDF("a", "grams_a"), "a").join(grams.toDF("b", "grams_b"), "b")
    apart = both.select("a", "b", "size_a", "size_b", "grams_a", "grams_b").mapInArrow(_verified(threshold), _PAIRS)
    return equal, held, _spark.cut(apart.join(k.toDF("doc_id_a", "k_a"), "doc_id_a").join(k.toDF("doc_id_b", "k_b"), "doc_id_b"))


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, held_grams: int = _HELD_GRAMS, held_docs: int = _HELD_DOCS) -> DataFrame:
    """For each document (doc_id) the least doc_id that a chain of pairs connects it with (class_id) and in how many pairs it is (links).

    Pairs are those of ``ngram_jaccard_join`` and of ``all_pairs``: every two
    documents whose sets of word n-grams have a Jaccard similarity of at least
    ``threshold``, equal ones included. They are counted, not told, so that the result
    has one row for each document.

    Defined results: as for ``ngram_jaccard_join``; a document in no pair is
    its own class with no links, and so is one without words.
    """
    equal, held, apart = _searched(docs, n, threshold, held_grams, held_docs)
    inside = held.mapInArrow(_within(threshold, False), _CLASSES)
    if apart.isEmpty():
        classes = inside
    else:
        inside = _spark.cut(inside)
        ends = apart.select(F.col("doc_id_a").alias("doc_id"), F.col("k_b").alias("k")).union(apart.select("doc_id_b", "k_a"))
        more = ends.groupBy("doc_id").agg(F.sum("k").alias("more"))
        every = inside.join(more, "doc_id", "full").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("links"))
        every = _spark.cut(every)
        root = every.select("doc_id", "class_id")
        joined = apart.select("doc_id_a", "doc_id_b").join(root.toDF("doc_id_a", "x"), "doc_id_a").join(root.toDF("doc_id_b", "y"), "doc_id_b").select("x", "y")
        roots = _spark.components(joined, "x", "y").toDF("class_id", "root")
        classes = every.join(roots, "class_id", "left").select("doc_id", F.coalesce("root", "class_id").alias("class_id"), "links")
    known = equal.join(classes.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("links"))
    every = _spark.documents(docs).distinct().join(known, "doc_id", "left")
    return every.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, held_grams: int = _HELD_GRAMS, held_docs: int = _HELD_DOCS) -> DataFrame:
    """Pairs (doc_id_a < doc_id_b, jaccard) of documents whose sets of word n-grams have at least that Jaccard similarity.

    Words are runs of ASCII letters, digits and underscores and all
    non-ASCII characters, in lower case. A text of fewer than ``n`` words has
    the list of its words as its only n-gram.

    Documents with equal sets stand for each other: each but the one with
    the least doc_id is paired with that one (jaccard 1.0) and with no other;
    those with the least doc_id are compared among each other. The similarity of any two
    documents is that of their representatives (``all_pairs`` spells it out),
    and the result grows with the input where a thousand equal copies would
    give half a million pairs.

    Defined results: a null doc_id is left out; a null, empty or wordless
    text has no n-grams and is in no pair; rows that repeat a doc_id are one
    document (of different texts the longest counts, then the greatest); no
    documents give no pairs; further columns are not looked at. Texts of any
    length are used whole.
    """
    equal, held, apart = _searched(docs, n, threshold, held_grams, held_docs)
    pairs = held.mapInArrow(_within(threshold, True), _PAIRS).union(apart.select("doc_id_a", "doc_id_b", "jaccard"))
    return pairs.union(equal.where("rep < doc_id").select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.lit(1.0).alias("jaccard")))


def all_pairs(joined: DataFrame) -> DataFrame:
    """Every pair of documents, spelled out from the result of ``ngram_jaccard_join``; quadratic in the size of groups of equal sets.

    Defined results: no pairs give none; repeated rows, which ``ngram_jaccard_join`` doesn't give, give repeated pairs.
    """
    joined = _spark.cut(joined)
    same = joined.where("jaccard = 1.0").select(F.col("doc_id_a").alias("head"), F.col("doc_id_b").alias("doc"))
    heads = joined.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("head")).join(same.select(F.col("doc").alias("head")), "head", "left_anti").distinct()
    member = same.union(heads.select("head", F.col("head").alias("doc")))
    near = joined.where("jaccard < 1.0").union(heads.select("head", "head", F.lit(1.0)))
    x = near.join(member.toDF("doc_id_a", "x"), "doc_id_a").join(member.toDF("doc_id_b", "y"), "doc_id_b")
    return x.where("doc_id_a <> doc_id_b OR x < y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "jaccard")


def keep_one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the near copies: of each group connected by pairs the document with the least doc_id stays, with all its columns.

    Rows whose doc_id is null or whose text has no words stay. Of rows that
    repeat a doc_id all stay or all go.
    """
    gone = near_classes(docs, n, threshold).where("class_id < doc_id").select("doc_id")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


#: Every pair, copies of a document included.
ORACLE_ALL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) < {N} THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - {N - 2}), lambda i: array_to_string(t[i:i + {N - 1}], ' ')) END) AS gram FROM w WHERE len(t) > 0),
s AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT p.a AS doc_id_a, p.b AS doc_id_b, o / (x.size + y.size - o) AS jaccard
FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE o / (x.size + y.size - o) >= {THRESHOLD - 1e-9}
"""

#: Each document's class, by the pairs that ORACLE_ALL has, and in how many of them it is.
ORACLE = f"""
WITH RECURSIVE pairs AS ({ORACLE_ALL}),
near AS (SELECT doc_id_a AS x, doc_id_b AS y FROM pairs UNION ALL SELECT doc_id_b, doc_id_a FROM pairs),
reach AS (SELECT DISTINCT x, y FROM near UNION SELECT reach.x, near.y FROM reach JOIN near ON reach.y = near.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
many AS (SELECT x, count(*) AS links FROM near GROUP BY x)
SELECT DISTINCT d.doc_id, coalesce(least(d.doc_id, least.y), d.doc_id) AS class_id, coalesce(links, 0) AS links
FROM documents d LEFT JOIN least ON least.x = d.doc_id LEFT JOIN many ON many.x = d.doc_id WHERE d.doc_id IS NOT NULL
"""
