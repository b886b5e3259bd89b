"""An inverted index kept up to date from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import graph


def append_postings(docs: DataFrame, key: str, text: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the postings of each micro-batch as Parquet under its number, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        graph.postings(batch, key, text).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
