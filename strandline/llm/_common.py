"""What several operators need: input sizes, pieces of batches, and the library's checkpoints and components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.components import components
from strandline.functions.names import checkpoint, shared_folder

#: Characters that separate words, as a regular expression class for Java and Python alike.
WORD = r"[^\x20\x09-\x0D]+"


__all__ = ["WORD", "bytes_of", "checkpoint", "components", "pieces", "shared_folder", "slices", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(df: DataFrame) -> int:
    """The input's size, which only sets how finely work is split: Spark's estimate, or what strings and rows add up to where it has none."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate < 1 << 50:
        return estimate
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return int(df.agg(F.sum(sum(texts, F.lit(64)))).first()[0] or 0)


def slices(df: DataFrame, mb: float) -> int:
    """How many parts of about mb megabytes of (compressed) input there are; never under the session's setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 20, round(bytes_of(df) / (mb * 1e6))))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch in pieces of about `most` bytes of one column (one value at least), with that column's values as a list."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).to_pylist()
        begin, held = 0, 0
        for k, v in enumerate(values):
            size = len(v) if v else 0
            if held and held + size > most:
                yield batch.slice(begin, k - begin), values[begin:k]
                begin, held = k, 0
            held += size + 16
        if begin < len(values):
            yield batch.slice(begin), values[begin:]
