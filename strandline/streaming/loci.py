"""Loci lists that arrive as files: Structured Streaming into Parquet by threshold, or into a store by family."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandline import schemas
from strandline.sources import store


def load(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Takes each new file once, also after a restart with the same checkpoint, and ends when all are in."""
    rows = spark.readStream.schema(schemas.LOCI_LIST).option("sep", "\t").csv(folder)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("threshold").trigger(availableNow=True).start()


def load_by_family(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """As load, into a store of families: each micro-batch is one of its batches, by its number, so one that is repeated after a failure counts once."""
    rows = spark.readStream.schema(schemas.LOCI_LIST).option("sep", "\t").csv(folder)
    keep = lambda df, batch: store.put(df, out, "family", str(batch))
    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
