"""Inverted index, TF-IDF search with and without it, paths and requirements."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import shared
from tessera.shared import freed
from tessera.functions import text as T

REQUIRED = [("uses_formula", "计算公式"), ("defined_in", "标准条款溯源")]
ANY_OF, ANY_LABEL = ["depends_on", "derived_from"], "输入参数或依赖指标"
BUCKETS, PIECE = 64, 1 << 18
_LATIN = re.compile(r"[a-z0-9_@.-]+")
_BLANK = np.zeros(0x3001, bool)
_BLANK[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def query_terms(query: str) -> Counter[str]:
    """The terms of a text and how often it has each: pairs of characters in lower case without white space, and Latin tokens."""
    low = query.lower()
    tight = "".join(low.split())
    return Counter([tight[i : i + 2] for i in range(len(tight) - 1)] + _LATIN.findall(low))


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent characters of each text as numbers, and the texts' places."""
    size = [len(t) for t in texts]
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), size)
    solid = ~_BLANK[np.minimum(code, 0x3000)] | (code > 0x3000)
    code, row = code[solid].astype(np.int64), row[solid]
    same = row[1:] == row[:-1]
    return (code[:-1] << 21 | code[1:])[same], row[:-1][same]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most 128 rows and, where they have several rows, ``PIECE`` bytes of text: what is counted takes some 50 times its text."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > start and (held + n > PIECE or k - start == 128):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if len(size) > start:
        yield batch.slice(start)


def _counted(wanted: list[str] | None):
    """Rows (key, term, tf) of batches of (key, text); of the wanted terms alone, where there are any."""
    some = None if wanted is None else np.array(sorted(ord(t[0]) << 21 | ord(t[1]) for t in wanted if len(t) == 2), np.int64)
    tokens = None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                low = [(t or "").lower() for t in part.column(1).to_pylist()]
                pair, row = _pairs(low)
                if some is not None:
                    hit = np.isin(pair, some)
                    pair, row = pair[hit], row[hit]
                distinct, pair = np.unique(pair, return_inverse=True)
                both, tf = np.unique(row * max(len(distinct), 1) + pair, return_counts=True)
                names = pa.array([chr(x >> 21) + chr(x & 0x1FFFFF) for x in distinct.tolist()], pa.string())
                of = Counter((r, t) for r, x in enumerate(low) for t in _LATIN.findall(x) if tokens is None or t in tokens)
                # a Latin token of two characters is a term of its own beside the pair: they add up
                rows = pa.concat_arrays([pa.array(both // max(len(distinct), 1)), pa.array([r for r, _ in of], pa.int64())])
                terms = pa.concat_arrays([names.take(pa.array(both % max(len(distinct), 1))), pa.array([t for _, t in of], pa.string())])
                counts = pa.concat_arrays([pa.array(tf.astype(np.int64)), pa.array(list(of.values()), pa.int64())])
                summed = pa.table({"row": rows, "term": terms, "tf": counts}).group_by(["row", "term"]).aggregate([("tf", "sum")])
                if summed.num_rows:
                    summed = summed.combine_chunks()
                    key = part.column(0).take(summed.column("row").chunk(0))
                    yield pa.RecordBatch.from_arrays([key, summed.column("term").chunk(0), pc.cast(summed.column("tf_sum").chunk(0), pa.int64())], names=["key", "term", "tf"])
            freed()

    return run


def _hits(docs: DataFrame, key: str, text: str, wanted: list[str] | None) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_counted(wanted), f"key {kind}, term string, tf long").withColumnRenamed("key", key)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of each document's distinct terms; terms are counted inside the document, so that none moves more than once.

    Keys are unique; of repeated ones each row has its postings.
    """
    return _hits(docs, key, text, None)


def _ranked(hits: DataFrame, q: Counter[str], n: DataFrame, df: DataFrame, key: str, limit: int) -> DataFrame:
    weights = hits.sparkSession.createDataFrame(list(q.items()), "term string, qtf long")
    # one row for each term of the query
    scored = hits.join(F.broadcast(weights.join(df, "term").crossJoin(n)), "term")
    weight = F.col("qtf") * F.col("tf") * (F.log((F.greatest("n", F.lit(1)) + 1) / (F.col("df") + 1)) + 1)
    return scored.groupBy(key).agg(F.round(F.sum(weight), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def search(docs: DataFrame, query: str, key: str, text: str, limit: int = 10, only: Column | None = None) -> DataFrame:
    """The best documents (key, score) by sum of query tf x tf x (ln((N + 1) / (df + 1)) + 1).

    Document frequencies are those of all documents, also where ``only``
    filters the result. One pass over the texts counts the query's terms
    alone; ``search_index`` answers from stored postings.
    """
    q = query_terms(query)
    if not q:
        return docs.select(key).limit(0).withColumn("score", F.lit(0.0))
    hits = _hits(docs, key, text, list(q))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    if only is not None:
        hits = hits.join(docs.where(only).select(key).hint("shuffle_hash"), key, "left_semi")
    return _ranked(hits, q, docs.agg(F.count("*").alias("n")), df, key, limit)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_postings(docs: DataFrame, key: str, text: str, path: str, attributes: list[str] | None = None) -> None:
    """Postings with document frequencies under a folder for each bucket of terms, sorted by term, and the number of documents; ``attributes`` go along for filters."""
    p = postings(docs, key, text)
    for column in attributes or []:
        p = p.join(docs.select(key, column), key)
    df = F.count("*").over(Window.partitionBy("term"))
    p = p.withColumn("df", df).withColumn("bucket", _bucket(F.col("term")))
    p.repartition("bucket").sortWithinPartitions("bucket", "term", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    docs.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/size")


def search_index(spark: SparkSession, path: str, query: str, key: str, limit: int = 10, only: Column | None = None) -> DataFrame:
    """As ``search``, from stored postings: only the buckets, and in them the row groups, of the query's terms are read."""
    q = query_terms(query)
    stored = spark.read.parquet(f"{path}/postings")
    if not q:
        return stored.select(key).limit(0).withColumn("score", F.lit(0.0))
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in q], "term string").select(_bucket(F.col("term"))).distinct().collect()]
    hits = stored.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(q)))
    df = hits.select("term", "df").distinct()
    hits = hits.where(only) if only is not None else hits
    return _ranked(hits.select(key, "term", "tf"), q, spark.read.parquet(f"{path}/size"), df, key, limit)


def entity_path(edges: DataFrame, name: str, depth: int = 4) -> DataFrame:
    """Edges (head_id, relation_type, tail_id ...) that a walk of at most ``depth`` steps along them takes from every node of a name, each once, with the least step.

    The ends of edges are kept once; each hop joins the frontier alone, and the walk ends when that is empty.
    """
    edges = edges.dropDuplicates(["relation_id"])
    ends = shared.kept(edges.select("head_id", "tail_id").distinct())
    starts = edges.where(F.col("head_name") == name).select(F.col("head_id").alias("node")).union(edges.where(F.col("tail_name") == name).select("tail_id")).distinct()
    frontier = shared.kept(starts)
    reach = frontier.withColumn("depth", F.lit(0))
    for k in range(1, depth):
        step = ends.join(frontier.withColumnRenamed("node", "head_id"), "head_id", "left_semi").select(F.col("tail_id").alias("node")).distinct()
        frontier = shared.kept(step.join(reach, "node", "left_anti"))
        if frontier.isEmpty():
            break
        reach = reach.union(frontier.withColumn("depth", F.lit(k)))
    return edges.join(reach.withColumnRenamed("node", "head_id"), "head_id")


def missing_requirements(relations: DataFrame, indicators: DataFrame, required: list[tuple[str, str]] = REQUIRED, any_of: list[str] = ANY_OF, any_label: str = ANY_LABEL) -> DataFrame:
    """(indicator, position, missing): labels of the relation types that an indicator lacks, in a fixed order."""
    has = relations.select(F.col("head_name").alias("indicator"), "relation_type").join(indicators.select("indicator").distinct(), "indicator", "left_semi")
    labels = [(k, label) for k, (_, label) in enumerate([*required, ("", any_label)])]
    held = lambda k: F.coalesce(F.col(f"h{k}"), F.lit(False))
    flags = [F.bool_or(F.col("relation_type") == r).alias(f"h{k}") for k, (r, _) in enumerate(required)]
    got = has.groupBy("indicator").agg(*flags, F.bool_or(F.col("relation_type").isin(any_of)).alias(f"h{len(required)}"))
    all_ = indicators.select("indicator").distinct().join(got, "indicator", "left")
    absent = F.array_compact(F.array(*(F.when(~held(k), F.struct(F.lit(k).alias("position"), F.lit(label).alias("missing"))) for k, label in labels)))
    return all_.select("indicator", F.explode(absent).alias("m")).select("indicator", "m.*")


def class_distribution(relations: DataFrame) -> DataFrame:
    return relations.groupBy("relation_type").agg(F.count("*").alias("n")).orderBy("relation_type")
