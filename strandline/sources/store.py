"""Rows kept by key for lookups: Parquet sorted by key, with Bloom filters and a table of each file's lowest and highest key.

A lookup of stated keys opens only files that can hold one. Rows come in batches; a batch counts once its table of files
is written, and is put again in whole, so a writer may be repeated. Nobody should read while a batch is put again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are compared with the ranges of files; with more of them a lookup is a join with all rows.
RANGED = 10_000
#: Keys that are asked of the files' row groups and Bloom filters by value.
PUSHED = 10


def put(df: DataFrame, path: str, key: str, batch: str = "0", files: int | None = None) -> None:
    """df as one batch, in about `files` files (none: as many as its size gives).

    A key of many rows is dealt over several files by the rows' other columns. Rows without a key are kept, and found by no lookup.
    """
    spark = df.sparkSession
    others = [F.col(f"`{c}`") for c, kind in df.dtypes if c != key and "map<" not in kind]
    order = [F.col(key), F.xxhash64(*others)] if others else [F.col(key)]
    rows = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    rows.sortWithinPartitions(key).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/rows/{batch}")
    kept = spark.read.schema(df.schema).parquet(f"{path}/rows/{batch}").where(F.col(key).isNotNull())
    ranges = kept.groupBy(F.concat(F.lit(f"{batch}/"), "_metadata.file_name").alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))
    ranges.write.mode("overwrite").parquet(f"{path}/files/{batch}")


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, low, high, n) of all batches."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/files")


def lookup(keys: DataFrame, path: str, key: str) -> DataFrame:
    """The rows with a key in `keys`, a DataFrame with that column, whose repeats don't matter. Null is no key."""
    spark = keys.sparkSession
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    first = [r[0] for r in wanted.limit(RANGED + 1).collect()]  # which is at most so many
    known = ranges(spark, path)
    if len(first) <= RANGED:
        asked = F.broadcast(spark.createDataFrame([(k,) for k in first], wanted.schema).withColumnRenamed(key, "asked"))
        known = known.join(asked, F.col("asked").between(F.col("low"), F.col("high")), "left_semi")
    paths = [f"{path}/rows/{r['file']}" for r in known.select("file").collect()]
    every = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/rows")
    if not paths:
        return every.limit(0)
    rows = spark.read.schema(every.schema).parquet(*paths)
    if len(first) <= PUSHED:
        return rows.where(F.col(key).isin(first))
    return rows.join(wanted, key, "left_semi").select(*rows.columns)
