"""Session helpers: the shared folder, cut lineage and sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of this machine only where that isn't set, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and keeps it in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> str:
    """Writes ``df`` as Parquet in the shared folder and returns the path."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of a plan, 0 where it knows none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 58 else 0


def shuffle_partitions(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """As many as the session sets, more where the input would give each over ``bytes_each``."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // bytes_each)


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, doc_id as bigint, without rows whose doc_id is null; what else the input has can't clash."""
    kind = {"doc_id": "bigint"}
    return docs.select(*(F.col(f"`{c}`").cast(kind.get(c, "string")).alias(c) for c in ("doc_id", *columns))).where("doc_id IS NOT NULL")


def one_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text), each doc_id once: of different texts the longest, then the greatest. Only where some doc_id has several do texts move for it."""
    docs = documents(docs, "text")
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y")).where("n > 1 AND x <> y").select("doc_id")
    if odd.isEmpty():
        return docs
    odd = cut(odd)
    one = docs.join(odd.hint("shuffle_hash"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("x")).select("doc_id", "x.text")
    return docs.join(odd.hint("shuffle_hash"), "doc_id", "left_anti").union(one)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (id, component), the component being its least id.

    Alternates large-star and small-star steps, so that the rounds grow with
    the logarithm of the longest path; each round is kept in the shared folder.
    Nodes without an edge to another node are absent; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    by_u, before = Window.partitionBy("u"), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(by_u), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(by_u)).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u > v").distinct()
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
