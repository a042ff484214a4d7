"""Names, cells of family tables, and numbers in order."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def padded(number: Column, width: int) -> Column:
    """As %0<width>d: longer numbers stay whole, which lpad would cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def genome_name(stem: Column) -> Column:
    """A file's stem with `. , + -` and white space as single underscores."""
    return F.regexp_replace(F.regexp_replace(stem, r"[.,\s+-]", "_"), "_+", "_")


def locus_name(genome: Column, kind: Column, number: Column) -> Column:
    """<genome>_<NNNNN>, with the feature's type before the number unless it is CDS."""
    return F.concat(genome, F.lit("_"), F.when(kind == "CDS", F.lit("")).otherwise(F.concat(kind, F.lit("_"))), padded(number, 5))


def gene_root(gene: Column) -> Column:
    return F.regexp_replace(gene, r"_\d+$", "")


def cell_copies(cell: Column) -> Column:
    """`a;b;(c:d)` as copies of fragments: [[a], [b], [c, d]]; empty or null: no copies."""
    one = lambda c: F.split(F.regexp_replace(c, r"[()]", ""), ":")
    return F.when(F.coalesce(cell, F.lit("")) == "", F.array().cast("array<array<string>>")).otherwise(F.transform(F.split(cell, ";"), one))


def cell_text(copies: Column) -> Column:
    """Fragments in order, in brackets if there are several; copies in order."""
    one = lambda c: F.when(F.size(c) > 1, F.concat(F.lit("("), F.array_join(F.array_sort(c), ":"), F.lit(")"))).otherwise(c[0])
    return F.array_join(F.array_sort(F.transform(copies, one)), ";")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a temporary folder, but in a local session only: on a cluster executors would not share it."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "strandline-checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """df cut off from its lineage, in the folder in spark.checkpoint.dir that all executors share."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


class Turns:
    """Tables written one after the other in the shared folder, each in place of that of `keep` tables before: what a loop leaves behind is bounded."""

    def __init__(self, spark: SparkSession, keep: int) -> None:
        self.at, self.keep, self.n = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}", keep, 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{self.n % self.keep}"
        self.n += 1
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder: for long texts, which a checkpoint writes as they are."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, column: str, *order: Column) -> DataFrame:
    """df with consecutive numbers from 1 in the given order, without a task that sees all rows.

    Rows are sorted into ranges, which are counted; a row's number is its place in its range after the ranges before.
    """
    ranged = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(before.drop("_n")), "_range").withColumn(column, (F.col("_before") + place).cast("long")).drop("_range", "_before")
