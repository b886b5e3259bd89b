"""Repetition rules: the share of a text's characters inside repeated lines and n-grams.

All documents of a chunk are worked on at once in numpy: rolling hashes of
every n-gram, a sort that finds the repeated ones within a document, and a
running sum that marks the words they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import _spark, _text

LENGTHS = (5, 6, 7, 8, 9, 10)
LINE_LIMIT = 0.20
GRAM_LIMITS = (0.15, 0.14, 0.13, 0.12, 0.11, 0.10)


def _later(key: np.ndarray) -> np.ndarray:
    """Which keys equal one before them."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    out = np.zeros(len(key), bool)
    out[order[1:][k[1:] == k[:-1]]] = True
    return out


def measure(buf: np.ndarray, offs: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: characters in words, those in repeated lines, and those in repeated n-grams by length."""
    n = len(offs) - 1
    s, e, doc = _text.solids(buf, offs)
    before = _text.char_counts(buf)
    chars = before[e] - before[s]
    total = np.bincount(doc, chars, n).astype(np.int64)
    lines = np.zeros(n, np.int64)
    grams = np.zeros((n, len(lengths)), np.int64)
    if not len(s):
        return total, lines, grams
    salt = _text.mix(doc.astype(np.uint64) + np.uint64(1))

    feeds = np.r_[0, np.cumsum(buf == 10)][s]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (feeds[1:] != feeds[:-1])])
    last = np.r_[first[1:], len(s)] - 1
    again = _later(_text.span_hash(buf, s[first], e[last]) ^ salt[first])
    in_line = np.add.reduceat(chars, first)
    lines += np.bincount(doc[first][again], in_line[again], n).astype(np.int64)

    tokens = _text.span_hash(buf, s, e)
    for k, length in enumerate(lengths):
        m = len(tokens) - length + 1
        if m < 1:
            break
        at = np.flatnonzero(doc[:m] == doc[length - 1 :])
        key = _text.combine([tokens[at + x] for x in range(length)]) ^ salt[at]
        at = at[_later(key)]
        mark = np.zeros(len(tokens) + 1, np.int32)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + length, -1)
        covered = np.cumsum(mark[:-1]) > 0
        grams[:, k] = np.bincount(doc[covered], chars[covered], n)
        # a longer repeat has a shorter one inside, so other documents have none
        if k + 1 < len(lengths) and lengths[k + 1] >= length:
            stay = np.isin(doc, np.unique(doc[at]))
            tokens, doc, chars, salt = tokens[stay], doc[stay], chars[stay], salt[stay]
    return total, lines, grams


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = _text.flat(batch.column(1))
        for i, j in _text.chunks(offs):
            total, lines, grams = measure(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            of = np.maximum(total, 1)
            shares = [lines / of, *(grams / of[:, None]).T]
            keep = np.all([x <= limit for x, limit in zip(shares, (LINE_LIMIT, *GRAM_LIMITS))], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(total), *map(pa.array, shares), pa.array(keep)], names=["doc_id", "chars", "dup_lines", *(f"dup_{n}" for n in LENGTHS), "keep"])


def repetition(docs: DataFrame) -> DataFrame:
    """For each document the share of characters in repeated lines and n-grams of 5 to 10 words, and whether it passes the limits.

    Words are runs without ASCII white space, characters are those in words,
    and a line counts without white space at its ends. Of equal lines or
    n-grams of a document all but the first count as repeated; a character
    inside several counts once.

    Defined results: a null doc_id is left out; null and empty texts have
    0 characters, shares of 0.0 and pass; a text of fewer words than an n-gram
    has none of that length; repeated rows each give a row; no documents give
    no rows; further columns are not looked at. Texts of any length are
    measured whole.
    """
    return _spark.documents(docs, "text").mapInArrow(_run, "doc_id long, chars long, dup_lines double, " + ", ".join(f"dup_{n} double" for n in LENGTHS) + ", keep boolean")


def _oracle() -> str:
    solid = "[^ \\t\\n\\f\\r\\x0b]+"
    per = ", ".join(f"coalesce(max(CASE WHEN n = {n} THEN c END), 0) AS c{n}" for n in LENGTHS)
    share = ", ".join(f"c{n} / greatest(chars, 1) AS dup_{n}" for n in LENGTHS)
    keep = " AND ".join(f"c{n} / greatest(chars, 1) <= {limit}" for n, limit in zip(LENGTHS, GRAM_LIMITS))
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '{solid}') AS t FROM documents),
k AS (SELECT doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS word FROM w),
total AS (SELECT doc_id, coalesce(list_sum(list_transform(t, lambda x: length(x))), 0)::BIGINT AS chars FROM w),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM documents),
r AS (SELECT doc_id, length(regexp_replace(line, '[ \\t\\f\\r\\x0b]+', '', 'g')) AS c, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM l WHERE line <> ''),
lines AS (SELECT doc_id, sum(c) AS c FROM r WHERE nth > 1 GROUP BY 1),
g AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY i) AS nth
      FROM (SELECT doc_id, n, unnest(range(1, len(t) - n + 2)) AS i, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS gram
            FROM w, (SELECT unnest([{", ".join(map(str, LENGTHS))}]) AS n) WHERE len(t) >= n)),
cover AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM g WHERE nth > 1),
counted AS (SELECT doc_id, n, sum(length(word)) AS c FROM cover JOIN k USING (doc_id, i) GROUP BY 1, 2),
per AS (SELECT doc_id, {per} FROM counted GROUP BY 1),
x AS (SELECT doc_id, chars, coalesce(lines.c, 0) AS cl, {", ".join(f"coalesce(c{n}, 0) AS c{n}" for n in LENGTHS)} FROM total LEFT JOIN lines USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT doc_id, chars, cl / greatest(chars, 1) AS dup_lines, {share}, cl / greatest(chars, 1) <= {LINE_LIMIT} AND {keep} AS keep FROM x
"""


ORACLE = _oracle()
