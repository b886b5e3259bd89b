"""Mixing sources to target weights by fitting budgets exactly.

Documents are counted by source and exact token length. Each source's
budget is filled proportionally over its lengths, and what remains of it by
a bounded-knapsack dynamic program, which takes documents that are left and
puts back some that were taken. A seeded order then picks that many
documents of each length.

The total is a stated share of all tokens, or more where the weights can be
met with more. A source that has less than its weight asks for gives all it
has, and the others share what it falls short by, so that no small source
decides how much of the corpus is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import _spark, _text

ALPHA = 0.7
#: Of the tokens of all sources with a weight, the least share that is kept where no budget is given.
SHARE = 0.9
#: Tokens by which the dynamic program may go back behind the proportional fill at first; it goes further until the fit can't be better.
RESERVE = 4096
#: The furthest that it goes, in tokens over the greatest common divisor of the lengths.
WINDOW = 1 << 24
#: Documents of one source and length that one task ranks; longer lists are cut by the seeded hash.
ROWS_EACH = 1 << 16
SEED = 11


def _adjust(items: list[tuple[int, int, int]], rest: int, back: int) -> tuple[int, list[int]]:
    """By how much ``rest`` is missed at best, and how often each length is added (or, below 0, put back). items: length, taken, left.

    Sums that can be reached, from ``-back`` to ``rest``, are the bits of one
    integer; a count is split in powers of two. Everything is put back first,
    so that a sum that has passed ``rest`` is of no use.
    """
    reach, goal, steps = 1 << back, back + rest, []
    full = (1 << (goal + 1)) - 1
    for sign in (-1, 1):
        for k, (length, taken, free) in enumerate(items):
            part, left = 1, min(taken, back // length) if sign < 0 else min(free, goal // length)
            while left > 0 and not reach >> goal & 1:
                n = min(part, left)
                steps.append((k, sign * n, reach))
                reach |= (reach << n * length & full) if sign > 0 else reach >> n * length
                left -= n
                part *= 2
    at = reach.bit_length() - 1
    gap, change = goal - at, [0] * len(items)
    for k, n, before in reversed(steps):
        if not before >> at & 1:
            change[k] += n
            at -= n * items[k][0]
    return gap, change


def fit_budget(lengths: dict[int, int], budget: int, seed: int = SEED, reserve: int = RESERVE, window: int = WINDOW) -> dict[int, int]:
    """How many documents of each length to take, so that their tokens come as near to the budget as can be without passing it.

    The proportional fill is mended by the least change: with lengths up to L,
    some best fit puts back no more than (rest + 2 L) L tokens, since in a
    longer chain of changes two sums would be equal and what is between them
    for nothing. The program widens from ``reserve`` until it meets the budget
    or has gone that far; ``window`` stops it before, where that is less.
    """
    lengths = {k: c for k, c in lengths.items() if k > 0 and c > 0}
    total = sum(k * c for k, c in lengths.items())
    if budget >= total:
        return lengths
    unit = math.gcd(*lengths)
    size, budget, total = {k: k // unit for k in lengths}, budget // unit, total // unit
    take = {k: c * budget // total for k, c in lengths.items()}
    rest = budget - sum(size[k] * n for k, n in take.items())
    order = sorted(lengths, key=lambda k: (-(lengths[k] * budget % total), xxhash.xxh64_intdigest(f"{seed} {k}"), k))
    for k in order:
        if take[k] < lengths[k] and size[k] <= rest - reserve:
            take[k] += 1
            rest -= size[k]
    for k in order:
        more = min(lengths[k] - take[k], max(0, rest - reserve) // size[k])
        take[k] += more
        rest -= more * size[k]
    order.sort(key=lambda k: xxhash.xxh64_intdigest(f"{seed} {k}"))
    longest, taken = max(size.values()), sum(size[k] * n for k, n in take.items())
    enough = min((rest + 2 * longest) * longest, taken, window)
    back = min(reserve, enough)
    while True:
        gap, change = _adjust([(size[k], take[k], lengths[k] - take[k]) for k in order], rest, back)
        if not gap or back >= enough:
            break
        back = min(8 * back, enough)
    return {k: take[k] + n for k, n in zip(order, change) if take[k] + n}


def targets(tokens: dict[str, int], weights: dict[str, float] | None, budget: int | None, alpha: float = ALPHA, share: float = SHARE) -> dict[str, int]:
    """Token budgets by source. Without weights these are the sources' tokens to the power ``alpha``;
    without a budget the total is ``share`` of the tokens of the sources with a weight, or the largest
    for which no source falls short, if that is more. A source that falls short gives all it has, and
    the rest of its part goes to the others by their weights."""
    weights = {s: float((weights or {}).get(s, 0.0)) if weights is not None else n**alpha for s, n in tokens.items() if n > 0}
    open_ = {s: w for s, w in weights.items() if w > 0}
    if budget is None and open_:
        even = min(int(tokens[s] / w * sum(open_.values())) for s, w in open_.items())
        budget = max(int(share * sum(tokens[s] for s in open_) + 1e-6), even)
    left = budget or 0
    goal: dict[str, int] = {}
    while open_:
        whole = sum(open_.values())
        short = [s for s, w in open_.items() if left * w / whole >= tokens[s]]
        if not short:
            return goal | {s: int(left * w / whole + 1e-6) for s, w in open_.items()}
        for s in short:
            goal[s] = tokens[s]
            left -= tokens[s]
            del open_[s]
    return goal


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = _text.flat(batch.column(2))
        n = [np.bincount(_text.solids(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[2], minlength=j - i) for i, j in _text.chunks(offs)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64))], names=["doc_id", "source", "tokens"])


def _fit(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for source, budget, counts in zip(*(c.to_pylist() for c in batch.columns)):
                of = {x["tokens"]: x["n"] for x in counts}
                fit = fit_budget(of, budget, seed)
                kept = sum(k * n for k, n in fit.items()) / sum(k * n for k, n in of.items())
                rows += [(source, k, n, kept) for k, n in sorted(fit.items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["source", "tokens", "n", "kept"])

    return run


def select(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, alpha: float = ALPHA, seed: int = SEED, rows_each: int = ROWS_EACH) -> DataFrame:
    """(doc_id, source, tokens, kept) of the documents chosen so that each source's tokens fit its share of the budget; kept is the share of the source's tokens that is chosen.

    Tokens are runs without ASCII white space. The driver gets one row for
    each source; lengths are counted and budgets fitted by the executors.
    Documents of one source and length are ranked by a seeded hash, in ranges
    of it of about ``rows_each``, so that no task ranks all of a hot source.

    Defined results: a null doc_id is left out; a null source counts as ''; documents without tokens
    are never chosen; rows that repeat a doc_id are one document, that of most tokens
    (then of the last source); sources without a weight, or of weight 0, give nothing;
    equal places in the seeded order go to the lesser doc_id; no documents give no rows;
    further columns are not looked at. Texts are counted whole.
    """
    spark = docs.sparkSession
    docs = _spark.documents(docs, "source", "text").withColumn("source", F.coalesce("source", F.lit("")))
    counted = docs.mapInArrow(_text.releasing(_count), "doc_id long, source string, tokens long").groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("x")).select("doc_id", "x.source", "x.tokens").where("tokens > 0")
    counted = _spark.cut(counted.withColumn("h", F.xxhash64("doc_id", F.lit(seed))))
    by_length = _spark.cut(counted.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    totals = by_length.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.max("n").alias("most")).collect()
    goal = targets({r["source"]: r["t"] for r in sorted(totals)}, weights, budget, alpha)
    goals = spark.createDataFrame(sorted(goal.items()), "source string, budget long")
    lists = by_length.groupBy("source").agg(F.collect_list(F.struct("tokens", "n")).alias("counts")).join(goals, "source").select("source", "budget", "counts")
    plan = _spark.cut(lists.mapInArrow(_fit(seed), "source string, tokens long, n long, kept double"))

    key = ["source", "tokens"]
    bits = max(1, math.ceil(math.log2(max([r["most"] for r in totals], default=1) / rows_each + 1)))
    ranged = counted.withColumn("range", F.shiftright("h", 64 - bits))
    ranges = ranged.groupBy(*key, "range").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # ranges of the hash that lie wholly before the place where the number is reached are taken whole; one is ranked
    wanted = ranges.withColumn("before", before).join(plan, key).where("before < n").select(*key, "range", (F.col("n") - F.col("before")).alias("n"), "m", "kept")
    got = ranged.join(wanted, [*key, "range"])
    place = F.row_number().over(Window.partitionBy(*key, "range").orderBy("h", "doc_id"))
    part = got.where("n < m").withColumn("place", place).where("place <= n").drop("place")
    return got.where("n >= m").union(part).select("doc_id", "source", "tokens", "kept")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that ``select`` chooses, with all their columns.

    Defined results: those of ``select``; rows of a null doc_id go; of rows
    that repeat a doc_id all stay or all go; no documents give no rows;
    further columns stay as they are.
    """
    chosen = select(docs, weights, budget, alpha, seed).select("doc_id")
    return docs.join(chosen.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)
