"""A pipeline over documents: language ID, near-dedup, secret scan, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import langid, mixing, packing, secrets, simhash
from strandline.llm._common import checkpoint, shared_folder

#: A text whose language is less likely than this goes; so do texts without letters.
LEAST_SCORE = 0.5


#: What a batch of rows on its way to a Python worker holds at most, where the session says nothing else. A task holds
#: several batches at once, on both sides.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def _small_batches(spark: SparkSession) -> None:
    """Sets BATCHES for the session, as a stage's result is written after the stage returns."""
    for name, value in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named by their places, and these names: so no column can clash with an operator's own."""
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(new).alias(c) for c, new in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language; the model learns from four fifths of the labelled ones.

    A null text, an empty one or one without letters goes; so does a text whose best language is less likely than
    LEAST_SCORE. Texts of any length are read whole. Each row is judged by itself, so repeated rows stay or go together,
    and a null doc_id or lang doesn't matter. Without labels there is no model, and all rows stay; an empty table
    stays empty. Columns stay as they are, also those named like the operator's own.
    """
    _small_batches(spark)
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(True))
    model = langid.fit(docs.where(learn))
    if not model.langs:
        return docs
    rows, names = _numbered(docs)
    found = langid.predict(rows, model, names["text"])
    return _named(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: that of the smallest doc_id, then text hash; null ids come last.

    Only rows that are copies themselves go, never others of the same doc_id. Rows that repeat doc_id and text count as
    one: that with the least hash of its other columns stays. Texts without words, null ones included, are copies of
    each other. An empty table stays empty, and columns of any names stay.
    """
    _small_batches(spark)
    copies = checkpoint(simhash.near_copies(docs))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    # Cut off, so that the join deals out copies anew and Spark can split a large component.
    best = checkpoint(copies.groupBy("component").agg(F.min(order).alias("best")))
    gone = copies.join(best, "component").where(order != F.col("best")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows, names = _numbered(docs)
    mine = F.col(names["doc_id"]), F.xxhash64(names["text"])
    at = lambda df: mine[0].eqNullSafe(df["_id"]) & (mine[1] == df["_hash"])
    kept = rows.join(gone, at(gone), "left_anti")
    again = copies.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).count().where("count > 1").drop("count")
    again = checkpoint(again.join(gone.toDF("_i", "_h"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left_anti"))
    if again.isEmpty():
        return _named(kept, names)
    # Of the texts only those that repeat are dealt out: their first rows by a hash, then one of those that are equal in full.
    rest = [c for c, (_, kind) in zip(rows.columns, rows.dtypes, strict=True) if "map<" not in kind and "variant" not in kind]
    twice = kept.join(again, at(again)).withColumn("_row", F.xxhash64(*rest))
    first = twice.groupBy("_id", "_hash").agg(F.min("_row").alias("_first"))
    one = twice.join(first.toDF("_i", "_h", "_first"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")) & (F.col("_row") == F.col("_first")))
    one = one.dropDuplicates(["_id", "_hash"]).select(*rows.columns)
    return _named(kept.join(again, at(again), "left_anti").unionByName(one), names)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by [secret], and sets n_chars, if there is such a column, to the new length; all documents stay.

    A null or empty text stays as it is, and texts of any length are read whole. Repeated rows stay, each with the same
    result; ids, null or not, don't matter. An empty table stays empty, and all other columns stay as they are.
    """
    _small_batches(spark)
    clean = secrets.redact(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return clean.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns) if kind else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents until each source has its share of all words.

    A null source is one, the last. A null or empty text has no words and is in once for each complete epoch of its
    source. Ties are ordered by doc_id, rows repeated in full are taken alike, an empty table stays empty, and columns
    of any names stay.
    """
    return mixing.draw(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes.

    A null or empty text has one row without a bin, a long one several pieces. Repeated rows and null ids are packed
    each by itself, an empty table gives no rows, and other columns are not read.
    """
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mix_sources), ("best_fit_packing", pack)]

#: Language ID, fingerprints and marginal compression are beyond SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what they pass on is written to the folder that all executors share."""
    at = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
