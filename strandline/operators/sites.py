"""Filled columns of aligned sequences as packed bits. What two have in common is a count of bits, and sorted sequences go by one at a time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(aln: Column) -> Column:
    """A bit for each character that is no gap, the first column lowest and zeros at the end left out, and their number. Null is a sequence of gaps."""

    def run(part: pd.Series) -> pd.DataFrame:
        bits = [np.packbits(np.frombuffer((x or "").encode("ascii", "replace"), "u1") != 45, bitorder="little").tobytes().rstrip(b"\0") for x in part]
        return pd.DataFrame({"bits": bits, "n": [int.from_bytes(b, "little").bit_count() for b in bits]})

    return F.pandas_udf(run, "bits binary, n int")(aln)


def length_clusters(sites: DataFrame, overlap: float = 0.9) -> DataFrame:
    """(family, bits, n, length_cluster) of the distinct bits in (family, locus, bits, n): clusters are numbered from 1, from the fewest columns up.

    In order of their number of columns, then of their first locus, bits go to the first cluster whose opener has
    `overlap` of its own columns and of theirs in common with them, or open one. Openers that have become too short for
    all that follows are let go, so a task holds those of about one length and not a family.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, open_, last = None, deque(), 0
        for batch in batches:
            out = []
            for f, bits, n in zip(*(batch.column(c).to_pylist() for c in ("family", "bits", "n")), strict=True):
                if f != family:
                    family, open_, last = f, deque(), 0
                x = int.from_bytes(bits, "little")
                while open_ and open_[0][1] < overlap * n:
                    open_.popleft()
                k = next((k for k, m, y in open_ if (both := (x & y).bit_count()) >= overlap * n and both >= overlap * m), None)
                if k is None:
                    k = last = last + 1
                    open_.append((k, n, x))
                out.append(k)
            yield pa.RecordBatch.from_arrays([batch.column("family"), batch.column("bits"), batch.column("n"), pa.array(out, pa.int32())], names=["family", "bits", "n", "length_cluster"])

    distinct = sites.groupBy("family", "bits").agg(F.first("n").alias("n"), F.min("locus").alias("locus"))
    return distinct.repartition("family").sortWithinPartitions("family", "n", "locus").mapInArrow(run, "family string, bits binary, n int, length_cluster int")


def gene_groups(rows: DataFrame, most: float) -> DataFrame:
    """The column `genes` of rows (family, genome, locus, near, pos, bits, n, length_cluster): the group of a locus among those of its genome, from 1.

    Loci go by in order of `near`, then place and name; the first opens a group. Each next one is compared with the opener:
    of the same length cluster it is another copy, and the group with its number goes on; with more new columns than
    common ones, of which there are at most `most` of either, it is a further fragment of the group; any other opens a
    group itself. A task holds the opener only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x, m, cluster, group = object(), 0, 0, 0, 0
        for batch in batches:
            out = []
            for f, g, bits, n, c in zip(*(batch.column(k).to_pylist() for k in ("family", "genome", "bits", "n", "length_cluster")), strict=True):
                y = int.from_bytes(bits, "little")
                both = (x & y).bit_count()
                if (f, g) != at:
                    at, x, m, cluster, group = (f, g), y, n, c, 1
                elif c == cluster:
                    group += 1
                elif n - both <= both or both > most * m or both > most * n:
                    x, m, cluster, group = y, n, c, group + 1
                out.append(group)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("family", "genome", "locus", "length_cluster")), pa.array(out, pa.int32())], names=["family", "genome", "locus", "length_cluster", "genes"])

    ordered = rows.repartition("family", "genome").sortWithinPartitions("family", "genome", "near", "pos", "locus")
    return ordered.mapInArrow(run, "family string, genome string, locus string, length_cluster int, genes int")
