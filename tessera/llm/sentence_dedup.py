"""Removal of passages that were seen before, by hashes of runs of sentences.

Runs slide over a text sentence by sentence. Each takes as many consecutive
sentences as reach ``min_words``, forwards from its first sentence and
backwards from its last; runs of a fixed number of sentences would miss a
passage of two long ones. Of equal runs the least doc_id is found by an
aggregate, which tasks begin before anything moves; the runs of the corpus
then meet it in one global join on the hash. A document removes the
sentences of its runs that a lesser doc_id has too, and of those that it has
had before itself; it finds their places by hashing its own runs again.

Runs are equal if 96 bits of two independent sums over their words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _spark, _text

MIN_WORDS = 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SECOND = np.uint64(0xA0761D6478BD642F)
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def sentences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words (starts, ends, document) and of each sentence its first word and the word after its last.

    A sentence ends after a word that ends in ``.``, ``!`` or ``?``, at a
    line feed, and at the end of the text.
    """
    s, e, doc = _text.solids(buf, offs)
    if not len(s):
        return s, e, doc, s, s
    feeds = np.r_[0, np.cumsum(buf == 10)][s]
    ends = np.r_[_STOP[buf[e[:-1] - 1]] | (feeds[1:] != feeds[:-1]) | (doc[1:] != doc[:-1]), True]
    last = np.flatnonzero(ends)
    return s, e, doc, np.r_[0, last[:-1] + 1], last + 1


def runs(buf: np.ndarray, offs: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Runs of sentences of folded texts: first and last sentence, document, two hashes, and whether the document has had an equal one; then each sentence's first byte and document."""
    s, e, doc, a, z = sentences(buf, offs)
    if not len(a):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none, none.astype(bool), none, none
    of, n = doc[a], len(a)
    to = np.searchsorted(z, a + min_words)
    k = np.arange(n)
    good = (to < n) & (of[np.minimum(to, n - 1)] == of)
    pairs = k[good] * n + to[good]
    back = np.searchsorted(a, z - min_words, side="right") - 1
    good = (back >= 0) & (of[np.maximum(back, 0)] == of)
    pairs = np.unique(np.r_[pairs, back[good] * n + k[good]])
    x, y = pairs // n, pairs % n
    power, inverse = _text._pow(len(s) + 1)
    words = _text.span_hash(buf, s, e)
    sums = np.r_[np.uint64(0), np.cumsum(words * power[: len(s)], dtype=np.uint64)]
    h = _text.mix((sums[z[y]] - sums[a[x]]) * inverse[a[x]] + (z[y] - a[x]).astype(np.uint64))
    sums = np.r_[np.uint64(0), np.cumsum(_text.mix(words ^ _SECOND), dtype=np.uint64)]
    c = ((sums[z[y]] - sums[a[x]]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    order = np.lexsort((x, c, h, of[x]))
    again = np.zeros(len(x), bool)
    p, q = order[1:], order[:-1]
    again[p] = (h[p] == h[q]) & (c[p] == c[q]) & (of[x[p]] == of[x[q]])
    return x, y, of[x], h, c, again, s[a], of


def _chunked(column: pa.Array, min_words: int) -> Iterator[tuple]:
    buf, offs = _text.flat(column)
    for i, j in _text.chunks(offs):
        b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        yield i, j, b, o, *runs(_FOLD[b], o, min_words)


def _spans(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, _, _, _, _, d, h, c, again, _, _ in _chunked(batch.column(1), min_words):
                keep = ~again
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep]), pa.array(ids[i:j][d[keep]])], names=["h", "c", "doc_id"])

    return run


def _marked(batch: pa.RecordBatch, min_words: int) -> Iterator[tuple]:
    """For chunks of documents: rows i to j, bytes, offsets, the runs to remove, and each sentence's first byte and document."""
    for i, j, b, o, x, y, d, h, _, again, first, of in _chunked(batch.column(1), min_words):
        marks = batch.column(2).slice(i, j - i)
        row = np.repeat(np.arange(j - i), pc.fill_null(pc.list_value_length(marks), 0).to_numpy())
        salt = _text.mix(np.arange(1, j - i + 1, dtype=np.uint64))
        wanted = marks.flatten().to_numpy().view(np.uint64) ^ salt[row]
        gone = again | np.isin(h ^ salt[d], wanted)
        yield i, j, b, o, x[gone], y[gone], d[gone], first, of


def _remove(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, o, x, y, _, first, of in _marked(batch, min_words):
                gone = np.zeros(len(first) + 1, np.int32)
                np.add.at(gone, x, 1)
                np.add.at(gone, y + 1, -1)
                gone = np.cumsum(gone[:-1]) > 0
                # a sentence ends where the next one of its text begins
                end = np.minimum(np.r_[first[1:], len(b)], o[of + 1]) if len(first) else first
                keep = np.zeros(len(b) + 1, np.int32)
                np.add.at(keep, first[gone], 1)
                np.add.at(keep, end[gone], -1)
                keep = np.cumsum(keep[:-1]) == 0
                to = np.r_[0, np.cumsum(keep)][o]
                text = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(b[keep].tobytes())).cast(pa.string())
                text = pc.if_else(pc.is_null(batch.column(1).slice(i, j - i)), pa.scalar(None, pa.string()), text)
                removed = np.bincount(of[gone], minlength=j - i).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], text, pa.array(removed)], names=["doc_id", "text", "removed"])

    return run


def _places(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, _, _, x, y, d, _, of in _marked(batch, min_words):
                start = np.searchsorted(of, d)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][d]), pa.array((x - start).astype(np.int32)), pa.array((y - start).astype(np.int32))], names=["doc_id", "i", "j"])

    return run


def _with_marks(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text, marks): the hashes of a document's runs that a lesser doc_id has too."""
    spans = docs.mapInArrow(_spans(min_words), "h long, c int, doc_id long")
    first = spans.groupBy("h", "c").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    marks = spans.join(first, ["h", "c"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("h").alias("marks"))
    return docs.join(marks.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "marks")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, i, j): runs of sentences i to j that occur before, in a document of lesser doc_id or earlier in the same text.

    Defined results: as for ``remove_repeats``; rows that repeat a doc_id each tell their runs.
    """
    return _with_marks(_spark.documents(docs, "text"), min_words).mapInArrow(_places(min_words), "doc_id long, i int, j int")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, removed): each document without the sentences that repeated runs cover, and how many those were.

    Words are runs without ASCII white space; ASCII letters compare without
    case and white space doesn't count. A removed sentence goes with the
    white space after it; the rest of a text stays as it is.

    Defined results: a null doc_id is left out; a null text stays null and an
    empty one empty; a text of fewer than ``min_words`` words keeps all; rows
    that repeat a doc_id, with whatever texts, don't count as repeats of each
    other (all are returned, each without what lesser doc_ids have); no
    documents give no rows; further columns are not looked at. Texts of any
    length are searched whole.
    """
    return _with_marks(_spark.documents(docs, "text"), min_words).mapInArrow(_remove(min_words), "doc_id long, text string, removed int")


#: The same by splitting texts at the same places and comparing runs as texts.
ORACLE = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT r, doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS k FROM (SELECT r, doc_id, string_split(regexp_replace(text, '([.!?][ \t\n\f\r\x0b]+|[ \t\f\r\x0b]*\n[ \t\n\f\r\x0b]*)', '\1' || chr(1), 'g'), chr(1)) AS x FROM d)),
w AS (SELECT *, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\f\r\x0b]+') AS t FROM p),
s AS (SELECT r, doc_id, k, t, sum(len(t)) OVER q - len(t) AS a, sum(len(t)) OVER q AS z FROM w WHERE len(t) > 0 WINDOW q AS (PARTITION BY r ORDER BY k)),
all_words AS (SELECT r, flatten(list(t ORDER BY k)) AS t FROM s GROUP BY r),
pairs AS (SELECT x.r, x.doc_id, x.k AS i, y.k AS j, x.a, y.z FROM s x ASOF JOIN s y ON x.r = y.r AND x.a + {N} <= y.z UNION SELECT x.r, x.doc_id, y.k, x.k, y.a, x.z FROM s x ASOF JOIN s y ON x.r = y.r AND x.z - {N} >= y.a),
runs AS (SELECT pairs.*, sha256(array_to_string(t[a + 1:z], ' ')) AS g FROM pairs JOIN all_words USING (r)),
marked AS (SELECT * FROM runs QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g) OR row_number() OVER (PARTITION BY r, g ORDER BY i) > 1),
gone AS (SELECT DISTINCT s.r, s.k FROM s JOIN marked m ON s.r = m.r AND s.k BETWEEN m.i AND m.j),
kept AS (SELECT p.r, string_agg(piece, '' ORDER BY p.k) FILTER (WHERE gone.k IS NULL) AS text, count(gone.k) AS removed FROM p LEFT JOIN gone ON gone.r = p.r AND gone.k = p.k GROUP BY p.r)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(removed, 0)::INT AS removed FROM d LEFT JOIN kept USING (r)
""".replace("{N}", str(MIN_WORDS))
