"""Secrets in texts, tagged by a linear-chain conditional random field.

Tokens are tagged B (a secret begins), I (it goes on) or O. Emissions sum
learned weights of the token's shape, of the hashed words up to three before
and one after it, and of file features; transitions are learned too. The
model is trained here, by exact gradients of the likelihood, on generated
lines with secrets of common kinds and with things that only look like them.

Decoding is Viterbi over the whole text, made cheap without changing it:
where O leads by more than transitions could ever repay, every best path
has O, so that the chain falls apart there and only the stretches between
such tokens are worked through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm import _spark, _text

LINES = 6000
SEED = 3
MASK = "[SECRET]"
_O, _B, _I = 0, 1, 2
_LEX = 4096
_SHAPES = 9 * 6 * 2 * 2 * 2 * 2 * 2
_FILE = 16

# classes of bytes: 0 white space, 1 part of a token, 2 a mark that is a token with its like
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, 45, 43, 47, 46, *range(128, 256)]] = 1
_DIGIT, _UPPER, _LOWER, _HEX, _OTHER = (np.zeros(256, np.int32) for _ in range(5))
_DIGIT[48:58] = 1
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_HEX[[*range(48, 58), *range(97, 103), *range(65, 71)]] = 1
_OTHER[[43, 45, 46, 47, 95]] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Model(NamedTuple):
    shape: np.ndarray  # shapes x 3
    lex: np.ndarray  # places (0, -1, -2, -3, +1) x buckets x 3
    file: np.ndarray  # file features x 3
    trans: np.ndarray  # 3 x 3, from row to column


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = _KIND[buf]
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offs[:-1][offs[:-1] < n]] = True
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], n]
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def observe(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens (starts, ends, document), shape indices, lexical buckets, and file features by document."""
    s, e, doc = tokens(buf, offs)
    count = lambda table: np.diff(np.r_[0, np.cumsum(table[buf], dtype=np.int32)][np.stack([s, e])], axis=0)[0]
    size = e - s
    digit, upper, lower, hexa, other = (count(t) for t in (_DIGIT, _UPPER, _LOWER, _HEX, _OTHER))
    length = np.searchsorted([1, 3, 6, 10, 15, 19, 31, 63], size)
    share = np.where(digit == 0, 0, 1 + np.minimum(4, digit * 5 // np.maximum(size, 1)))
    shape = length
    for part, width in ((share, 6), (upper > 0, 2), (lower > 0, 2), (hexa == size, 2), (other > 0, 2), (size == digit + upper + lower + other, 2)):
        shape = shape * width + part
    folded = _FOLD[buf]
    lex = (_text.span_hash(folded, s, e) % np.uint64(_LEX)).astype(np.int32)
    head = (_text.mix(_text.span_hash(folded, s, np.minimum(e, s + 4)) + np.uint64(9)) % np.uint64(_LEX)).astype(np.int32)
    per = np.maximum(np.bincount(doc, minlength=len(offs) - 1), 1)
    odd = np.bincount(doc, digit * 2 > size, len(offs) - 1) / per
    marks = np.bincount(doc, _KIND[buf[s]] == 2, len(offs) - 1) / per
    file = np.searchsorted([0.01, 0.05, 0.2], odd) * 4 + np.searchsorted([0.05, 0.2, 0.4], marks)
    return s, e, doc, shape, lex, head, file


def _neighbours(lex: np.ndarray, doc: np.ndarray, by: int) -> np.ndarray:
    """Buckets of the tokens ``by`` places away; bucket 0 beyond the text."""
    out = np.zeros_like(lex)
    if by < 0:
        out[-by:] = np.where(doc[-by:] == doc[:by], lex[:by], 0)
    else:
        out[:-by] = np.where(doc[:-by] == doc[by:], lex[by:], 0)
    return out


_PLACES = (-1, -2, -3, 1)


def emissions(model: Model, doc: np.ndarray, shape: np.ndarray, lex: np.ndarray, head: np.ndarray, file: np.ndarray) -> np.ndarray:
    out = model.shape[shape] + model.lex[0][head] + model.file[file[doc]]
    for k, by in enumerate(_PLACES, 1):
        out += model.lex[k][_neighbours(lex, doc, by) if len(lex) > abs(by) else np.zeros_like(lex)]
    return out


def viterbi(em: np.ndarray, trans: np.ndarray, before: int | None = None, after: int | None = None) -> list[int]:
    """The best tags of one sequence, between given tags where there are any; ties go to O, then B."""
    t = trans.tolist()
    score = [em[0][y] + (t[before][y] if before is not None else 0.0) for y in range(3)]
    back = []
    for row in em[1:].tolist():
        prev = [max(range(3), key=lambda x: (score[x] + t[x][y], -x)) for y in range(3)]
        score = [score[prev[y]] + t[prev[y]][y] + row[y] for y in range(3)]
        back.append(prev)
    if after is not None:
        score = [score[y] + t[y][after] for y in range(3)]
    y = max(range(3), key=lambda x: (score[x], -x))
    out = [y]
    for prev in reversed(back):
        y = prev[y]
        out.append(y)
    return out[::-1]


def decode(model: Model, em: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The best tags of all tokens of all documents."""
    n = len(em)
    tags = np.zeros(n, np.int8)
    trans = model.trans.astype(np.float64)
    sure = em[:, 0] - np.maximum(em[:, 1], em[:, 2]) > 2 * (trans.max() - trans.min()) + 1e-6
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return tags
    cut = np.flatnonzero(np.r_[True, (open_[1:] != open_[:-1] + 1) | (doc[open_[1:]] != doc[open_[:-1]]), True])
    em = em.astype(np.float64)
    for a, b in zip(open_[cut[:-1]].tolist(), (open_[cut[1:] - 1] + 1).tolist()):
        before = _O if a and doc[a - 1] == doc[a] else None
        after = _O if b < n and doc[b] == doc[a] else None
        tags[a:b] = viterbi(em[a:b], trans, before, after)
    return tags


def _generate(n: int, rng: np.random.Generator) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with the places of their secrets."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    many = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    lower, digits, upper = "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hexa, alnum = digits + "abcdef", lower + upper + digits
    vowels = "aeiouéèäöüñóáí"

    def word() -> str:
        w = "".join(pick("bcdfghjlmnprstvwz") + pick(vowels) + pick(["", "", "n", "r", "s"]) for _ in range(int(rng.integers(1, 5))))
        return pick([w, w, w, w.capitalize(), w + pick([",", ".", "!", "?", ";", ":"]), pick(["the", "of", "le", "der", "que", "is", "key", "token", "password", "secret"])])

    def secret() -> str:
        return pick([
            lambda: many(hexa, pick([32, 40, 40, 40, 64])), lambda: "AKIA" + many(upper + digits, 16), lambda: "ghp_" + many(alnum, 36),
            lambda: "sk-" + many(alnum, pick([32, 48])), lambda: "xoxb-" + many(digits, 11) + "-" + many(alnum, 24), lambda: many(alnum + "+/", 40),
            lambda: many(alnum, pick([20, 24, 32])), lambda: "eyJ" + many(alnum, 20) + "." + many(alnum, 30) + "." + many(alnum, 40), lambda: "AIza" + many(alnum + "-_", 35),
            lambda: pick([lower, upper])[:1] + many(alnum, 7) + many(digits, 2) + many(alnum, 3),
        ])()

    def lookalike() -> str:
        return pick([
            lambda: many(digits, pick([4, 5, 8, 10, 12, 16])), lambda: ".".join(str(int(rng.integers(256))) for _ in range(4)), lambda: word().lower().strip(",.!?;:") + "." + many(digits, 2) + "@mail" + many(digits, 1) + ".example.com",
            lambda: f"https://{word().strip(',.!?;:')}.example.com/{many(lower, 8)}/{many(digits, 5)}?id={many(digits, 6)}", lambda: f"20{many(digits, 2)}-0{many('123456789', 1)}-1{many(digits, 1)}", lambda: "+" + many(digits, 2) + "-" + many(digits, 3) + "-" + many(digits, 4),
            lambda: "-".join(many(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "commit " + many(hexa, pick([7, 10, 40])), lambda: f"v{many(digits, 1)}.{many(digits, 1)}.{many(digits, 2)}", lambda: many(upper, 5) + "!!", lambda: word() + pick(["###", "$$$", "&&&", "%%%", "***"]), lambda: "sha256 " + many(hexa, 64), lambda: f"({many(digits, 3)}) {many(digits, 3)}-{many(digits, 4)}", lambda: f"{many(digits, 2)}:{many(digits, 2)}:{many(digits, 2)}", lambda: f"color = \"{pick(['red', 'blue', word()])}\"", lambda: f"{word()} = {many(digits, 3)}",
            lambda: "".join(pick([word().lower().strip(",.!?;:")]) for _ in range(3)),
        ])()

    names = ["token", "api_key", "apikey", "secret", "password", "passwd", "pwd", "client_secret", "access_token", "auth_token", "aws_secret_access_key", "private_key", "key", "API_KEY", "SECRET_KEY", "Token"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 4))):
            text += " ".join(word() for _ in range(int(rng.integers(0, 12)))) + pick([" ", " ", "\n", " | "])
            if (kind := rng.random()) < 0.45:
                q = pick(['"', '"', "'", ""])
                text += pick([lambda: pick(names) + pick([" = ", "=", ": ", " : ", '": ']), lambda: pick(["Authorization: Bearer ", "Bearer ", "export " + pick(names).upper() + "=", "--" + pick(names) + " "])])() + q
                x = secret()
                spans.append((len(text), len(text) + len(x)))
                text += x + q + pick([" ", "\n", "; ", ", ", "### "])
            elif kind < 0.5:
                x = pick(["AKIA" + many(upper + digits, 16), "ghp_" + many(alnum, 36), "xoxb-" + many(digits, 11) + "-" + many(alnum, 24)])
                spans.append((len(text), len(text) + len(x)))
                text += x + " "
            elif kind < 0.53:
                rows = [many(alnum + "+/", 64) for _ in range(int(rng.integers(1, 4)))]
                text += "-----BEGIN PRIVATE KEY-----\n"
                body = "\n".join(rows)
                spans.append((len(text), len(text) + len(body)))
                text += body + "\n-----END PRIVATE KEY-----\n"
            elif kind < 0.9:
                text += lookalike() + " "
        text += " ".join(word() for _ in range(int(rng.integers(0, 8))))
        out.append((text, spans))
    return out


def _labelled(n: int, seed: int):
    made = _generate(n, np.random.default_rng(seed))
    buf, offs = _text.flat(pa.array([t for t, _ in made], pa.string()))
    s, e, doc, *rest = observe(buf, offs)
    tags = np.zeros(len(s), np.int8)
    first = np.r_[np.searchsorted(doc, np.arange(len(made))), len(s)]
    for k, (text, spans) in enumerate(made):
        for a, b in spans:
            a, b = len(text[:a].encode()) + offs[k], len(text[:b].encode()) + offs[k]
            i, j = np.searchsorted(e[first[k] : first[k + 1]], a, side="right") + first[k], np.searchsorted(s[first[k] : first[k + 1]], b) + first[k]
            tags[i:j] = _I
            tags[i] = _B
    return s, e, doc, *rest, tags, first


@functools.lru_cache(maxsize=2)
def fit(lines: int = LINES, seed: int = SEED, epochs: int = 8, batch: int = 200) -> Model:
    """Trains on ``lines`` generated texts with Adagrad on the negative log-likelihood (forward-backward)."""
    _, _, doc, shape, lex, head, file, tags, first = _labelled(lines, seed)
    rng = np.random.default_rng(seed + 1)
    p = {"shape": np.zeros((_SHAPES, 3)), "lex": np.zeros((5, _LEX, 3)), "file": np.zeros((_FILE, 3)), "trans": np.zeros((3, 3))}
    seen = {k: np.full_like(v, 1e-6) for k, v in p.items()}
    near = [head, *(_neighbours(lex, doc, by) for by in _PLACES)]
    for _ in range(epochs):
        order = rng.permutation(lines)
        for i in range(0, lines, batch):
            rows = order[i : i + batch]
            rows = rows[first[rows + 1] > first[rows]]
            size = first[rows + 1] - first[rows]
            longest = int(size.max())
            at = np.minimum(first[rows][:, None] + np.arange(longest), len(tags) - 1)
            on = np.arange(longest) < size[:, None]
            em = p["shape"][shape[at]] + p["file"][file[doc[at]]]
            for k in range(5):
                em += p["lex"][k][near[k][at]]
            trans, n = p["trans"], len(rows)
            alpha = np.zeros((longest, n, 3))
            beta = np.zeros((longest, n, 3))
            alpha[0] = em[:, 0]
            lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
            for t in range(1, longest):
                a = lse(alpha[t - 1][:, :, None] + trans, 1) + em[:, t]
                alpha[t] = np.where(on[:, t, None], a, alpha[t - 1])
            for t in range(longest - 2, -1, -1):
                b = lse(trans + (em[:, t + 1] + beta[t + 1])[:, None, :], 2)
                beta[t] = np.where(on[:, t + 1, None], b, 0)
            z = lse(alpha[-1], 1)
            post = np.exp(np.clip(alpha + beta - z[None, :, None], -60, 0)).transpose(1, 0, 2)
            y = tags[at]
            g = (post - np.eye(3)[y]) * on[:, :, None] / n
            gt = np.zeros((3, 3))
            for t in range(1, longest):
                live = on[:, t]
                pair = np.exp(np.clip(alpha[t - 1][:, :, None] + trans + (em[:, t] + beta[t])[:, None, :] - z[:, None, None], -60, 0))
                gt += pair[live].sum(0)
                np.add.at(gt, (y[live, t - 1], y[live, t]), -1)
            grads = {"trans": gt / n}
            flat = g[on]
            for name, index in (("shape", shape[at][on]), ("file", file[doc[at]][on])):
                grads[name] = np.stack([np.bincount(index, flat[:, c], len(p[name])) for c in range(3)], 1)
            grads["lex"] = np.stack([np.stack([np.bincount(near[k][at][on], flat[:, c], _LEX) for c in range(3)], 1) for k in range(5)])
            for name, grad in grads.items():
                grad = grad + 1e-5 * p[name]
                seen[name] += grad**2
                p[name] -= 0.15 * grad / np.sqrt(seen[name])
    return Model(*(p[k].astype(np.float32) for k in ("shape", "lex", "file", "trans")))


def spans(model: Model, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the secrets of all documents, and their document. An I without a secret before it begins one."""
    s, e, doc, *rest = observe(buf, offs)
    if not len(s):
        return s, e, doc
    tags = decode(model, emissions(model, doc, *rest), doc)
    inside = tags != _O
    begin = inside & ((tags == _B) | ~np.r_[False, inside[:-1]] | np.r_[True, doc[1:] != doc[:-1]])
    a = np.flatnonzero(begin)
    stop = np.r_[~inside[1:] | begin[1:], True] & inside
    return s[a], e[np.flatnonzero(stop)], doc[a]


def _find(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            buf, offs = _text.flat(batch.column(1))
            for i, j in _text.chunks(offs):
                b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                s, e, d = spans(model, b, o)
                if len(s):
                    chars = _text.char_counts(b)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][d]), pa.array(chars[s] - chars[o[d]]), pa.array(chars[e] - chars[o[d]]), pa.array(_text.strings(b, s, e), pa.string())], names=["doc_id", "start", "end", "secret"])

    return run


_FOUND = "doc_id long, start long, end long, secret string"


def find_secrets(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, start, end, secret): every secret, with the places of its first character and of the one after its last.

    Defined results: a null doc_id is left out; null, empty and white texts
    have no secrets; tags of equal score go to O, then B; repeated rows each
    give their secrets; no documents give no rows; further columns are not
    looked at. Texts of any length are tagged whole.
    """
    return _spark.documents(docs, "text").mapInArrow(_find(fit(lines)), _FOUND)


def redact(docs: DataFrame, mask: str = MASK, lines: int = LINES) -> DataFrame:
    """``docs`` with each secret of the text replaced by ``mask`` and, where there is such a column, n_chars counted again.

    Defined results: those of ``find_secrets``; rows without secrets, of a null doc_id
    and of null or empty texts stay as they are, a null doc_id's secrets being masked too;
    repeated rows are masked each; no documents give no rows; further columns stay;
    a table without the column text raises. Texts of any length are masked whole.
    """
    model, schema, at = fit(lines), docs.schema, docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = _text.flat(batch.column(at))
            changed: dict[int, str] = {}
            for i, j in _text.chunks(offs):
                b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                s, e, d = spans(model, b, o)
                for doc in np.unique(d).tolist():
                    raw, out, last = b[o[doc] : o[doc + 1]].tobytes(), [], 0
                    for x, y in zip((s[d == doc] - o[doc]).tolist(), (e[d == doc] - o[doc]).tolist()):
                        out += [raw[last:x].decode(), mask]
                        last = y
                    changed[i + doc] = "".join(out) + raw[last:].decode()
            if changed:
                columns = list(batch.columns)
                rows = np.array(sorted(changed))
                hit = np.zeros(batch.num_rows, bool)
                hit[rows] = True
                texts = pa.array([changed[k] for k in rows.tolist()], columns[at].type)
                columns[at] = pc.replace_with_mask(columns[at], pa.array(hit), texts)
                if size is not None:
                    columns[size] = pc.replace_with_mask(columns[size], pa.array(hit), pc.utf8_length(texts).cast(columns[size].type))
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(_text.releasing(run), schema)
