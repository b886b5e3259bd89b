"""Vectorised handling of whole Arrow text columns as bytes.

A column becomes one ``uint8`` buffer with offsets; tokens and spans are
found and hashed for all documents of a chunk at once, without a Python
loop over documents or tokens. Texts are never cut: a chunk holds at
least one whole document, however long that is.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 2 << 20
PIECE_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_GRAM = U(0xD6E8FEB86659FD93)


def release() -> None:
    """Gives memory that a Python worker freed back to the system, where there is a way to; workers live on, and others need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and ``release`` once it has ended, so that a worker that waits for its next task holds little."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return both


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE)) | U(1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_LEAD = np.ones(256, np.int64)
_LEAD[128:192] = 0
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base & _MASK, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a text column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def lowered(column: pa.Array | pa.ChunkedArray) -> pa.Array | pa.ChunkedArray:
    return pc.utf8_lower(pc.fill_null(column, ""))


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes, at least one document each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that stay within a document: starts, ends, document."""
    n = len(inside)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offs[:-1][offs[:-1] < n]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ASCII letters, digits, underscores and all non-ASCII characters."""
    return runs(_WORD[buf], offs)


def solids(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs without ASCII white space."""
    return runs(_SOLID[buf], offs)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans given in ascending order that don't overlap.

    Each is a difference of two prefix sums of a polynomial modulo 2**64,
    moved back to position 0 by the inverse of the odd base.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        p = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, p + PIECE_BYTES, side="right")))
        q = int(ends[j - 1])
        power, inverse = _pow(q - p + 1)
        sums = np.empty(q - p + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[buf[p:q]] * power[: q - p], dtype=np.uint64, out=sums[1:])
        s, e = starts[i:j] - p, ends[i:j] - p
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _GRAM)
        i = j
    return out


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of an ordered list of equally long hash arrays."""
    h = mix(parts[0] + U(len(parts)))
    for x in parts[1:]:
        h = mix(h * _GRAM ^ x)
    return h


def ngrams(tokens: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of tokens with their documents; a document of fewer tokens has its whole token list as its one gram."""
    m = len(tokens)
    if not m:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: max(0, m - n + 1)] == doc[n - 1 :]) if m >= n else np.zeros(0, np.int64)
    out, docs = [combine([tokens[at + k] for k in range(n)])], [doc[at]]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    length = np.diff(np.r_[first, m])
    for k in range(1, n):
        s = first[length == k]
        if len(s):
            out.append(combine([tokens[s + x] for x in range(k)]))
            docs.append(doc[s])
    return np.concatenate(out), np.concatenate(docs)


def char_counts(buf: np.ndarray) -> np.ndarray:
    """Characters before each byte position, one more entry than bytes."""
    return np.r_[0, np.cumsum(_LEAD[buf])]


def strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = buf.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
