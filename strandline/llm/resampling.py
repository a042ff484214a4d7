"""Importance resampling towards a target's distribution of hashed word n-grams.

Each n-gram of one to three words falls into one of BUCKETS buckets. A bucket's gain says how much likelier the target is to
hold it than the corpus; a document's weight is the sum of its n-grams' gains, looked up in one array. With Gumbel noise
added, the largest scores are a draw without replacement.

Scores are integers. Their histogram, summed up from the largest score down, gives the first rank of each score and the
score at which the draw ends; documents are then ordered by key only within the scores that survive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._common import checkpoint, pieces

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 3, 42, 20, 5
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: A-Z in lower case, and a space for every other ASCII character that is neither letter nor digit.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def features(text: bytes | None, longest: int = LONGEST) -> Iterator[tuple[int, list[int]]]:
    """The number of words and the CRC-32 of all n-grams of one to `longest` words, joined by a space: some at a time."""
    plain, at, before = (text or b"").translate(PLAIN), 0, []
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        words = before + plain[at:end].split()
        more, found = [b" " + w for w in words], []
        last = list(map(crc32, words))
        for n in range(1, longest + 1):  # those that end in one of the new words
            found += last[max(0, len(before) - n + 1) :]
            last = list(map(crc32, more[n:], last))
        yield len(words) - len(before), found
        before, at = words[max(0, len(words) - longest + 1) :] if longest > 1 else [], end


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> dict[int, int]:
    """How many n-grams of all rows fall into each bucket; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in pieces([batch], "_text"):
                for t in texts:
                    for _, found in features(t, longest):
                        held += np.bincount(np.array(found, dtype=np.int64) % buckets, minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["bucket", "n"])

    counted = docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(run, "bucket int, n long")
    return {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # a row a bucket


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket, 1000 times the log of how much likelier the target is to hold it, with one added to every count."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log(((target.get(k, 0) + 1.0) * s_all) / ((source.get(k, 0) + 1.0) * t_all))) for k in range(buckets)], dtype=np.int64)


def noise(key: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel number, drawn by a hash of the key; a null key counts as an empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score): a row for each row of docs; weight is 0 without n-grams."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for part, texts in pieces([batch], "_text"):
                rows = []
                for t in texts:
                    words = n = weight = 0
                    for new, found in features(t, longest):
                        words, n = words + new, n + len(found)
                        weight += int(gain[np.array(found, dtype=np.int64) % len(gain)].sum())
                    rows.append((words, n, weight))
                numbers = np.array(rows, dtype=np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(numbers[:, k]) for k in range(3))], names=["_key", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)[key]
    got = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text")).mapInArrow(run, f"_key {kind}, n_words long, n_features long, weight long")
    return got.select(F.col("_key").alias(key), "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("_key"), seed)).alias("score"))


def offsets(scores: DataFrame) -> DataFrame:
    """(score, n, before): for each score of (score), its rows and those of larger scores, without a task that sees all scores.

    The histogram is sorted into ranges of scores, and sums within a range follow those of the ranges above it.
    """
    histogram = scores.groupBy("score").agg(F.count("*").alias("n"))
    down = F.col("score").desc()
    ranged = checkpoint(histogram.repartitionByRange(down).withColumn("_range", F.spark_partition_id()))
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("_range").agg(F.sum("n").alias("_all")).withColumn("_above", F.coalesce(F.sum("_all").over(above), F.lit(0))).drop("_all")  # a row a partition
    inside = Window.partitionBy("_range").orderBy(down).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(ranges), "_range").select("score", "n", (F.col("_above") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"))


def draw(scored: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """scored (key, score, eligible, ...), and rank: 1, 2, 3... for the `size` eligible rows of the largest scores, null for others.

    Ties go to the smaller key, rows without a key last; rows that share score and key are ranked in the order of their
    other columns' hash. One score may hold any number of rows: its rows are numbered in ranges.
    """
    names = {c: f"_c{k}" for k, c in enumerate(scored.columns)}
    rest = [F.col(n) for n in names.values()]
    rows = checkpoint(scored.toDF(*names.values()).withColumn("_row", F.monotonically_increasing_id()))
    score, least = F.col(names["score"]), F.col(names[key])
    chosen = rows.where(names["eligible"])
    told = checkpoint(offsets(chosen.select(score.alias("score"))))
    cutoff = told.where((F.col("before") < size) & (F.col("before") + F.col("n") >= size)).select("score").first()
    if cutoff is None:  # fewer rows than asked for, or none asked for
        cutoff = [None] if size <= 0 else [told.agg(F.min("score")).first()[0]]
    live = chosen.where(score >= F.lit(cutoff[0])).select("_row", score.alias("_score"), least.isNull().alias("_none"), least.alias("_key"), F.xxhash64(*rest).alias("_tie"))
    order = [F.col("_score").desc(), F.col("_none"), F.col("_key"), F.col("_tie"), F.col("_row")]
    live = checkpoint(live.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # Within a score: the rows of the ranges before, then the place in the own range.
    by_range = live.groupBy("_score", "_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_score").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = checkpoint(by_range.select("_score", "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")).join(told.select(F.col("score").alias("_score"), "before"), "_score"))
    place = F.row_number().over(Window.partitionBy("_range", "_score").orderBy(*order[1:]))
    ranked = live.withColumn("_place", place).join(ahead, ["_score", "_range"]).select("_row", (F.col("before") + F.col("_ahead") + F.col("_place")).cast("long").alias("_rank")).where(F.col("_rank") <= size)
    return rows.join(ranked, "_row", "left").select(*(F.col(n).alias(c) for c, n in names.items()), F.col("_rank").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, eligible, rank): a row for each row of docs.

    Of the rows with `least_words` words at least, `percent` percent (rounded down) are drawn: those of the largest scores.
    A null or empty text has no n-grams, weighs 0 and is never drawn while least_words is over 0. A null key draws its noise
    as an empty string does, and comes last among ties. Repeated rows are all scored and may all be drawn. An empty table
    gives an empty result, and an empty target gives every bucket the same count. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest), buckets)
    scored = checkpoint(weigh(docs, gain, key, text, longest, seed).withColumn("eligible", F.col("n_words") >= least_words))
    size = scored.where("eligible").count() * percent // 100
    return draw(scored, size, key)
