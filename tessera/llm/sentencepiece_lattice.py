"""SentencePiece encoding and decoding by a relational lattice.

Texts fall into units that no piece can cross (between two characters that
stand together in no piece). The distinct units of the whole corpus are
encoded once:

1. bounded-length substrings of each unit are exploded and equi-joined to
   the piece table; the pieces found are the edges of the unit's lattice;
2. edges are grouped by unit;
3. Spark's ``aggregate`` folds the edges to one path.

For a unigram model the fold is Viterbi: at each place the best score of the
edges that end there. The scores of a BPE model are the negated ranks of its
merges, whose sum means nothing, so that Viterbi gives other pieces than the
model's own encoder. For those the fold is the merge rule over the same
lattice: of the edges that join exactly two present pieces the one of best
score, leftmost first, until there is none. The model file says which it is,
unless ``kind`` does.

Documents are then encoded by looking their units up in a table that lies
sorted in the shared folder and is mapped into memory, not copied, by the
Python workers of a machine. It holds the most frequent units, as many as
``table_bytes`` has room for; the occurrences of the others, few by Zipf's
law, are joined to their ids and put in their places.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _spark, _text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The largest table of units that workers look up; what units there are beyond is joined.
TABLE_BYTES = 256 << 20
#: Paths through longer units don't fit the bits of a number; the same rule encodes those, each once, from a heap.
LATTICE_CHARS = 60
SPACE = "▁"
UNIGRAM, BPE = 1, 2
_FILES = 4  # bits of the hash that say in which file of the table a unit is


class Pieces(NamedTuple):
    kind: int
    text: list[str]
    score: list[float]
    normal: list[bool]
    byte: list[int]  # the byte that a piece stands for, or -1
    unknown: int


@functools.lru_cache(maxsize=4)
def load(path: str = MODEL, kind: int = 0) -> Pieces:
    """The pieces of a model file; ``kind`` (UNIGRAM or BPE) overrides the file's.

    A model that changes texts in another way than to add a space in front,
    that keeps symbols of its user's whole, or that has no byte pieces raises
    ValueError, since its ids would be others than its own encoder's.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kind = model.normalizer_spec, kind or model.trainer_spec.model_type
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: only models that keep texts as they are and add a space in front")
    if kind not in (UNIGRAM, BPE) or any(p.type == p.USER_DEFINED for p in model.pieces) or not any(p.type == p.BYTE for p in model.pieces):
        raise ValueError(f"{path}: only unigram and BPE models with byte pieces and without symbols of the user's")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return Pieces(
        kind,
        [sp.id_to_piece(i) for i in ids],
        [sp.get_score(i) for i in ids],
        [not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids],
        [int(sp.id_to_piece(i)[3:5], 16) if sp.is_byte(i) else -1 for i in ids],
        sp.unk_id(),
    )


class _Table:
    """Adjacent characters inside pieces, as a sorted array and, for common characters, a square of bits."""

    def __init__(self, pieces: Pieces):
        pairs = {(ord(t[k]), ord(t[k + 1])) for t, ok in zip(pieces.text, pieces.normal) if ok for k in range(len(t) - 1)}
        self.keys = np.array(sorted(a << 21 | b for a, b in pairs) or [-1], np.int64)
        self.square = np.zeros((1024, 1024), bool)
        # the mark for a space is kept at the place of the space
        for a, b in pairs:
            a, b = (32 if x == ord(SPACE) else x for x in (a, b))
            if a < 1024 and b < 1024:
                self.square[a, b] = True

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low = (a < 1024) & (b < 1024)
        out = self.square[np.where(low, a, 0), np.where(low, b, 0)] & low
        rare = np.flatnonzero(~low)
        if len(rare):
            x, y = (np.where(z == 32, ord(SPACE), z) for z in (a[rare].astype(np.int64), b[rare].astype(np.int64)))
            key = x << 21 | y
            out[rare] = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        return out


@functools.lru_cache(maxsize=4)
def _table(path: str) -> _Table:
    return _Table(load(path))


def _prepared(column: pa.Array) -> pa.Array:
    """Texts as the model sees them: the mark for a space is a space; null is empty."""
    return pc.replace_substring(pc.fill_null(column, ""), SPACE, " ")


def units(text: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of prepared texts i to j: their bytes, and starts, ends and documents of their units. A text begins with a space added, as the model asks."""
    table = _table(path)
    text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar(" ", text.type), text, pa.scalar("", text.type)))
    buf, offs = _text.flat(text)
    for i, j in _text.chunks(offs, 1 << 20):
        b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        if not len(b):
            yield i, j, b, *(np.zeros(0, np.int64) for _ in range(3))
            continue
        lead = np.flatnonzero((b & 0xC0) != 0x80)
        if len(lead) == len(b):
            code = b.astype(np.int32)
        else:
            code = np.frombuffer(b.tobytes().decode("utf-8").encode("utf-32-le"), np.int32)
        new = np.ones(len(code), bool)
        new[1:] = ~table.together(code[:-1], code[1:])
        new[np.searchsorted(lead, o[:-1][o[:-1] < len(b)])] = True
        starts = lead[new]
        yield i, j, b, starts, np.r_[starts[1:], len(b)], np.searchsorted(o, starts, side="right") - 1


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what is copied of their texts on the way stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


_DISTINCT = "h long, unit string, n long"


def _distinct(path: str, most: int = 1 << 18):
    """Units with how often they occur. A unit is told again once ``most`` others came; the aggregate behind adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _text.release()
        keys, place, count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        told: list[tuple[np.ndarray, pa.Array]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            at = 0
            for h, text in told:
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), text, pa.array(count[at : at + len(h)])], names=["h", "unit", "n"])
                at += len(h)

        for batch in _slices(batches):
            for _, _, b, s, e, _ in units(_prepared(batch.column(0)), path):
                h, first, n = np.unique(_text.span_hash(b, s, e), return_index=True, return_counts=True)
                at = np.searchsorted(keys, h)
                known = keys[np.minimum(at, len(keys) - 1)] == h if len(keys) else np.zeros(len(h), bool)
                count[place[at[known]]] += n[known]
                fresh = ~known
                told.append((h[fresh], pa.array(_text.strings(b, s[first[fresh]], e[first[fresh]]), pa.string())))
                place = np.insert(place, at[fresh], len(count) + np.arange(int(fresh.sum())))
                keys, count = np.insert(keys, at[fresh], h[fresh]), np.r_[count, n[fresh]]
                if len(keys) > most:
                    yield from flush()
                    keys, place, count = keys[:0], place[:0], count[:0]
                    told.clear()
        yield from flush()
        told.clear()
        _text.release()

    return run


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, id, rank, cost) of the pieces that texts can have, equal scores having equal ranks; as large as the model, whatever the input."""
    rank = {s: k for k, s in enumerate(sorted({s for s, ok in zip(pieces.score, pieces.normal) if ok}, reverse=True))}
    rows = [(t.replace(SPACE, " "), k, rank[s], -s) for k, (t, s, ok) in enumerate(zip(pieces.text, pieces.score, pieces.normal)) if ok]
    return spark.createDataFrame(rows, "piece string, id int, rank long, cost double")


def lattice(distinct: DataFrame, table: DataFrame, longest_piece: int, packed: bool) -> DataFrame:
    """(h, unit, n, edges): the lattice of each unit of up to 62 characters, edges of least cost first, then from the left.

    An edge is (cost, s, e, id) or, packed, one number of rank, s, e and id
    from the high bits down. Characters that are no piece have no edge.
    """
    inner = distinct.withColumn("size", F.length("unit")).withColumn("s", F.explode(F.sequence(F.lit(1), F.col("size"))))
    inner = inner.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest_piece), F.col("size") - F.col("s") + 1)))).withColumn("piece", F.substring("unit", F.col("s"), F.col("k")))
    found = inner.join(F.broadcast(table), "piece", "left").where("id IS NOT NULL OR (s = 1 AND k = 1)")
    if packed:
        edge = F.expr("shiftleft(rank, 40) | shiftleft(cast(s - 1 AS long), 34) | shiftleft(cast(s - 1 + k AS long), 28) | id")
    else:
        edge = F.when(F.col("id").isNotNull(), F.struct("cost", (F.col("s") - 1).alias("s"), (F.col("s") - 1 + F.col("k")).alias("e"), "id"))
    # the unit itself goes along with its first edge alone
    own = F.when((F.col("s") == 1) & (F.col("k") == 1), F.struct("unit", "n"))
    return found.groupBy("h").agg(F.max(own).alias("own"), F.sort_array(F.collect_list(edge)).alias("edges")).select("h", "own.unit", "own.n", "edges")


def _unpacked() -> Column:
    return F.expr("transform(edges, x -> named_struct('s', cast(shiftright(x, 34) & 63 AS int), 'e', cast(shiftright(x, 28) & 63 AS int), 'id', cast(x & 268435455 AS int)))")


def merge_fold(found: DataFrame) -> DataFrame:
    """Adds the places between pieces, as bits of a number, by the merge rule of BPE; edges are packed before and structs after.

    The fold starts with every place between characters. Each step takes the
    first edge whose ends are places still there and that has exactly one of
    them inside, and drops that one.
    """
    found = found.withColumn("edges", _unpacked())
    merges = "transform(filter(edges, x -> x.e - x.s > 1), x -> named_struct('ends', shiftleft(1L, x.s) | shiftleft(1L, x.e), 'inner', shiftleft(1L, x.e) - shiftleft(1L, x.s + 1)))"
    found = found.withColumn("merges", F.expr(merges))
    first = "get(filter(merges, x -> (p.places & x.ends) = x.ends AND bit_count(p.places & x.inner) = 1), 0)"
    start = "named_struct('places', shiftleft(2L, length(unit)) - 1L, 'go', true)"
    step = f"CASE WHEN p.go THEN transform(array({first}), m -> named_struct('places', CASE WHEN m IS NULL THEN p.places ELSE p.places & ~m.inner END, 'go', m IS NOT NULL))[0] ELSE p END"
    folded = f"CASE WHEN size(merges) = 0 THEN shiftleft(2L, length(unit)) - 1L ELSE aggregate(sequence(1, length(unit)), {start}, (p, k) -> {step}, p -> p.places) END"
    return found.withColumn("places", F.expr(folded))


def viterbi_fold(found: DataFrame, unknown_cost: float) -> DataFrame:
    """Adds the places between pieces, as bits of a number, of the path of the least total cost.

    The fold goes from place to place; its state has the best cost and the
    bits of the path for every place so far. A character may also stand alone
    for ``unknown_cost``. Between equal sums the edge that starts first wins.
    """
    alone = f"named_struct('cost', p[k - 1].cost + {float(unknown_cost)!r}D, 's', k - 1)"
    best = f"array_min(concat(transform(filter(edges, x -> x.e = k), x -> named_struct('cost', p[x.s].cost + x.cost, 's', x.s)), array({alone})))"
    step = f"concat(p, transform(array({best}), m -> named_struct('cost', m.cost, 'places', p[m.s].places | shiftleft(1L, k))))"
    start = "array(named_struct('cost', 0.0D, 'places', 1L))"
    return found.withColumn("places", F.expr(f"aggregate(sequence(1, length(unit)), {start}, (p, k) -> {step}, p -> element_at(p, -1).places)"))


def _byte_ids(pieces: Pieces) -> list[int]:
    out = [pieces.unknown] * 256
    for k, b in enumerate(pieces.byte):
        if b >= 0:
            out[b] = k
    return out


def path_ids(folded: DataFrame, pieces: Pieces) -> DataFrame:
    """(h, n, ids) from the places between pieces; a character without a piece becomes its bytes' pieces."""
    on_path = "(places & shiftleft(1L, x.s)) <> 0 AND (places & shiftleft(1L, x.e)) <> 0 AND (places & (shiftleft(1L, x.e) - shiftleft(1L, x.s + 1))) = 0"
    table = "array(" + ",".join(map(str, _byte_ids(pieces))) + ")"
    char = "substring(unit, s + 1, 1)"
    as_bytes = f"transform(sequence(1, octet_length({char})), b -> element_at({table}, cast(conv(substring(hex({char}), 2 * b - 1, 2), 16, 10) AS int) + 1))"
    out = folded.withColumn("found", F.expr(f"transform(filter(edges, x -> {on_path}), x -> named_struct('s', x.s, 'ids', array(x.id)))")).withColumn("begun", F.expr("aggregate(found, 0L, (m, x) -> m | shiftleft(1L, x.s))"))
    missing = f"transform(filter(sequence(0, length(unit) - 1), s -> (places & shiftleft(1L, s)) <> 0 AND (begun & shiftleft(1L, s)) = 0), s -> named_struct('s', s, 'ids', {as_bytes}))"
    whole = F.expr(f"CASE WHEN bit_count(begun) = bit_count(places) - 1 THEN found ELSE concat(found, {missing}) END")
    return out.select("h", "n", F.flatten(F.transform(F.array_sort(whole), lambda x: x["ids"])).alias("ids"))


def encode_unit(unit: str, pieces: Pieces) -> list[int]:
    """The same rule without the lattice, for units too long for it, and for tests."""
    index = _index(pieces)
    unit = unit.replace(" ", SPACE)
    n = len(unit)
    if pieces.kind == UNIGRAM:
        longest = max(map(len, index), default=1)
        low = _unknown_cost(pieces)
        cost, back = [0.0], [0]
        for k in range(1, n + 1):
            options = [(cost[s] - pieces.score[index[unit[s:k]]], s) for s in range(max(0, k - longest), k) if unit[s:k] in index]
            c, s = min([*options, (cost[k - 1] + low, k - 1)])
            cost.append(c)
            back.append(s)
        cuts, k = [n], n
        while k:
            k = back[k]
            cuts.append(k)
        parts = [unit[a:b] for a, b in zip(cuts[::-1], cuts[::-1][1:])]
    else:
        import heapq

        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        live, heap = [True] * n, []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (k := index.get(unit[a : end[b]])) is not None:
                heapq.heappush(heap, (-pieces.score[k], a, end[b], b))

        for a in range(n):
            offer(a)
        while heap:
            _, a, e, b = heapq.heappop(heap)
            if live[a] and b < n and live[b] and end[a] == b and end[b] == e:
                live[b] = False
                end[a] = e
                if e < n:
                    prev[e] = a
                offer(a)
                if a:
                    offer(prev[a])
        parts, a = [], 0
        while a < n:
            parts.append(unit[a : end[a]])
            a = end[a]
    byte_ids = _byte_ids(pieces)
    some = any(b >= 0 for b in pieces.byte)
    out: list[int] = []
    for p in parts:
        k = index.get(p)
        out += [k] if k is not None else [byte_ids[b] for b in p.replace(SPACE, " ").encode()] if some else [pieces.unknown]
    return out


_indices: dict[int, dict[str, int]] = {}


def _index(pieces: Pieces) -> dict[str, int]:
    if id(pieces) not in _indices:
        _indices[id(pieces)] = {t: k for k, (t, ok) in enumerate(zip(pieces.text, pieces.normal)) if ok}
    return _indices[id(pieces)]


def _unknown_cost(pieces: Pieces) -> float:
    return 10.0 - min((s for s, ok in zip(pieces.score, pieces.normal) if ok), default=0.0)


def _long_units(path: str, kind: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path, kind)
        for batch in batches:
            ids = [encode_unit(x, pieces) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["h", "n", "ids"])

    return run


def unit_table(docs: DataFrame, path: str = MODEL, kind: int = 0, lattice_chars: int = LATTICE_CHARS) -> DataFrame:
    """(h, n, ids) of every distinct unit, n being how often it occurs."""
    pieces = load(path, kind)
    distinct = docs.select("text").mapInArrow(_distinct(path), _DISTINCT).groupBy("h").agg(F.max("unit").alias("unit"), F.sum("n").alias("n"))
    longest = max(len(t) for t, ok in zip(pieces.text, pieces.normal) if ok)
    found = lattice(distinct.where(F.length("unit") <= lattice_chars), piece_table(docs.sparkSession, pieces), longest, pieces.kind == BPE)
    folded = merge_fold(found) if pieces.kind == BPE else viterbi_fold(found, _unknown_cost(pieces))
    long = distinct.where(F.length("unit") > lattice_chars).select("h", "n", "unit").mapInArrow(_long_units(path, kind), "h long, n long, ids array<int>")
    return path_ids(folded, pieces).union(long)


def _store(folder: str):
    """Writes the units of a partition, sorted by hash, as one uncompressed Arrow file and tells its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        order = np.argsort(whole.column(0).to_numpy().view(np.uint64))
        whole = whole.take(pa.array(order)).combine_chunks()
        part = int(whole.column(0)[0].as_py() >> (64 - _FILES)) & ((1 << _FILES) - 1)
        # each attempt of a task has a file of its own; that of the attempt which counts is told
        uri = f"{folder}/{uuid.uuid4().hex}.arrow"
        system, at = fs.FileSystem.from_uri(uri)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        with system.open_output_stream(at) as out, pa.ipc.new_file(out, whole.schema) as writer:
            writer.write_table(whole)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri])], names=["part", "uri"])

    return run


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+size."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)][:-1], sizes) + np.arange(int(sizes.sum()))


class _Lookup:
    """The files of a unit table, mapped into memory where the shared folder is mounted, else read once in each Python worker."""

    held: dict[tuple, _Lookup] = {}

    def __init__(self, files: tuple[tuple[int, str], ...]):
        from pyarrow import fs

        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * (1 << _FILES)
        for part, uri in files:
            system, at = fs.FileSystem.from_uri(uri)
            source = pa.memory_map(at) if isinstance(system, fs.LocalFileSystem) else pa.BufferReader(system.open_input_file(at).read())
            batch = pa.ipc.open_file(source).read_all().combine_chunks().to_batches()[0]
            self.parts[part] = batch.column(0).to_numpy().view(np.uint64), batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()

    @classmethod
    def get(cls, files: tuple[tuple[int, str], ...]) -> _Lookup:
        if files not in cls.held:
            cls.held.clear()
            cls.held[files] = cls(files)
        return cls.held[files]

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of units in any order: their ids one after the other, how many each has, and which are in the table."""
        u, back = np.unique(h, return_inverse=True)
        size, known, flat = np.zeros(len(u), np.int64), np.zeros(len(u), bool), []
        edge = np.r_[0, np.searchsorted(u, np.arange(1, 1 << _FILES, dtype=np.uint64) << np.uint64(64 - _FILES)), len(u)]
        for part, a, b in zip(self.parts, edge.tolist(), edge[1:].tolist()):
            if part is None or a == b:
                continue
            keys, to, values = part
            at = np.minimum(np.searchsorted(keys, u[a:b]), len(keys) - 1)
            known[a:b] = keys[at] == u[a:b]
            size[a:b] = np.where(known[a:b], to[at + 1].astype(np.int64) - to[at], 0)
            flat.append(values[_ranges(to[at].astype(np.int64), size[a:b])])
        of = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        start = np.cumsum(size) - size
        return of[_ranges(start[back], size[back])], size[back], known[back]


def _checked(text: pa.Array, ids: pa.ListArray, path: str) -> list[pa.Array]:
    decoded = decode_lists(ids, path)
    return [pc.utf8_length(decoded).cast(pa.int64()), pc.equal(decoded, text.cast(pa.string()))]


def _encode(path: str, files: tuple[tuple[int, str], ...], holes: bool):
    """Encodes what the table has. With ``holes`` the text stays, and units that aren't in the table are told with their places among the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _text.release()
        table = _Lookup.get(files)
        for batch in _slices(batches):
            text = _prepared(batch.column(1))
            for i, j, b, s, e, d in units(text, path):
                h = _text.span_hash(b, s, e)
                flat, n, known = table.ids(h)
                per = np.bincount(d, n, j - i).astype(np.int64)
                to = np.r_[0, np.cumsum(per)]
                ids = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(flat, pa.int32()))
                if not holes:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], ids, *_checked(text[i:j], ids, path)], names=["doc_id", "ids", "n_chars", "same"])
                    continue
                lost = np.flatnonzero(~known)
                hole = pa.StructArray.from_arrays([pa.array((np.cumsum(n) - n)[lost] - to[d[lost]]), pa.array(lost), pa.array(h[lost].view(np.int64))], names=["at", "k", "h"])
                hole = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(d[lost], minlength=j - i))].astype(np.int32)), hole)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], text[i:j].cast(pa.string()), ids, hole], names=["doc_id", "text", "ids", "holes"])

    return run


def _fill(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, parts in zip(batch.column(2), batch.column(3).to_pylist()):
                ids = ids.values.to_numpy()
                if parts:
                    where = np.repeat([p["at"] for p in parts], [len(p["ids"]) for p in parts])
                    ids = np.insert(ids, where, np.concatenate([p["ids"] for p in parts]))
                out.append(ids)
            ids = pa.array(out, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, *_checked(batch.column(1), ids, path)], names=["doc_id", "ids", "n_chars", "same"])

    return run


_HOLES = "doc_id long, text string, ids array<int>, holes array<struct<at:long,k:long,h:long>>"
_OUT = "doc_id long, ids array<int>, n_chars long, same boolean"


def encode_checked(docs: DataFrame, path: str = MODEL, table_bytes: int = TABLE_BYTES, kind: int = 0, lattice_chars: int = LATTICE_CHARS) -> DataFrame:
    """(doc_id, ids, n_chars, same): the piece ids of each text, those of the model's own encoder, the
    characters of the text decoded from them, and whether that text is the one that was encoded.

    Defined results: a null doc_id is left out; null and empty texts give an
    empty list, and are the same; a character that is no piece becomes its bytes' pieces;
    equal scores go to the leftmost; the mark U+2581 counts as a space;
    repeated rows each give a row, whatever their texts; no documents give no
    rows; further columns are not looked at. Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    docs = _spark.documents(docs, "text")
    made = _spark.written(unit_table(docs, path, kind, lattice_chars))
    found = spark.read.parquet(made)
    # bytes by powers of two of how often units occur: a row for each power
    weight = found.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.sum(F.size("ids") * 4 + 12).alias("w")).orderBy(F.desc("p")).collect()
    room, least, whole = table_bytes, 64, True
    for p, w in weight:
        room -= w
        if room < 0:
            whole = False
            break
        least = p
    hot, rare = found.where(F.col("n") >= F.lit(2.0) ** least), found.where(F.col("n") < F.lit(2.0) ** least).select("h", "ids")
    folder = f"{_spark.shared_dir(spark)}/{uuid.uuid4().hex}"
    stored = hot.select("h", "ids").repartitionById(1 << _FILES, F.shiftrightunsigned("h", 64 - _FILES).cast("int")).mapInArrow(_store(folder), "part int, uri string")
    files = tuple(sorted(map(tuple, stored.collect())))
    if whole:
        _spark.discard(spark, made)
        return docs.mapInArrow(_encode(path, files, False), _OUT)
    partly = spark.read.parquet(_spark.written(docs.mapInArrow(_encode(path, files, True), _HOLES).withColumn("row", F.monotonically_increasing_id())))
    holes = partly.select("row", F.explode("holes").alias("x")).select("row", "x.at", "x.k", "x.h").join(rare, "h")
    parts = holes.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "k", "ids"))).alias("parts"))
    return partly.join(parts.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "ids", "parts").mapInArrow(_fill(path), _OUT)


def encode(docs: DataFrame, path: str = MODEL, table_bytes: int = TABLE_BYTES, kind: int = 0, lattice_chars: int = LATTICE_CHARS) -> DataFrame:
    """(doc_id, ids): as ``encode_checked``, with the same defined results."""
    return encode_checked(docs, path, table_bytes, kind, lattice_chars).select("doc_id", "ids")


@functools.lru_cache(maxsize=4)
def _decoder(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pieces = load(path)
    raw = [bytes([b]) if b >= 0 else t.replace(SPACE, " ").encode() if ok else " ⁇ ".encode() if k == pieces.unknown else b"" for k, (t, b, ok) in enumerate(zip(pieces.text, pieces.byte, pieces.normal))]
    size = np.array([len(x) for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum(size)][:-1], size


def decode_lists(ids: pa.ListArray, path: str = MODEL) -> pa.Array:
    flat, starts, size = _decoder(path)
    out = []
    for row in range(0, len(ids), 256):
        part = ids.slice(row, 256)
        x = pc.fill_null(part.flatten(), -1).to_numpy().astype(np.int64)
        n = pc.fill_null(pc.list_value_length(part), 0).to_numpy()
        good = np.where((x >= 0) & (x < len(size)), x, 0)
        z = np.where((x >= 0) & (x < len(size)), size[good], 0)
        raw = flat[_ranges(starts[good], z)].tobytes()
        to = np.r_[0, np.cumsum(z)][np.r_[0, np.cumsum(n)]].tolist()
        for a, b in zip(to, to[1:]):
            t = raw[a:b]
            out.append((t[1:] if t[:1] == b" " else t).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), decode_lists(batch.column(1), path)], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Decoding what ``encode`` gave returns the text.

    Defined results: a null doc_id stays; null and empty lists give the empty
    text; null ids, control pieces and ids outside the model give nothing, the
    unknown piece a question mark; bytes that are no UTF-8 give the replacement
    character; repeated rows each give a row; no rows give none; further
    columns are not looked at.
    """
    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(path), "doc_id long, text string")
