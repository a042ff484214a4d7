"""Exact dedup by progressive refinement: lengths, then hashes of the first bytes, then hashes of whole texts.

Each step looks only at texts that the step before could not tell apart. A first scan keeps a text's length and the hash of
its first HEAD bytes. Lengths that two texts or more have, and then (length, head) pairs among these, are marked in bitmaps
of a fixed size, which is all that is broadcast. A second scan reads a text in full only if both of its bits are set. A bit
that several values share only means that more texts are read in full: what is equal is settled by SHA-256 alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import checkpoint

HEAD = 256
#: Bits of the two bitmaps: 128 KB for lengths, 16 MB for pairs of length and head.
LENGTHS, HEADS = 1 << 20, 1 << 27
#: Bits in a row of a bitmap, as Spark's bitmap_construct_agg() makes them.
ROW = 1 << 15


def _bitmap(slots: DataFrame, name: str) -> DataFrame:
    """(<name>_row, <name>_bits): the slots (slot) that occur, ROW of them a row."""
    return slots.groupBy(F.expr(f"slot div {ROW}").alias(f"{name}_row")).agg(F.bitmap_construct_agg(F.col("slot") % ROW).alias(f"{name}_bits"))


def _marked(rows: DataFrame, bitmap: DataFrame, name: str, slot: Column) -> DataFrame:
    """rows, and <name>: whether the slot's bit is set. The bitmap has a bounded number of rows, each of 4 KB."""
    at = rows.withColumn("_slot", slot)
    found = at.join(F.broadcast(bitmap), F.expr(f"_slot div {ROW}") == F.col(f"{name}_row"), "left")
    byte = F.conv(F.hex(F.substring(f"{name}_bits", F.expr(f"int((_slot % {ROW}) div 8) + 1"), F.lit(1))), 16, 10).cast("long")
    return found.withColumn(name, F.coalesce(F.getbit(byte, (F.col("_slot") % 8).cast("int")) == 1, F.lit(False))).drop("_slot", f"{name}_row", f"{name}_bits")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), head: int = HEAD, lengths: int = LENGTHS, heads: int = HEADS) -> DataFrame:
    """(key, keep_id, group_size, kept, full_sha256, and the columns in carry): a row for each row of docs.

    Texts are equal if their bytes are; a null text counts as empty. Of equal texts the row with the largest key stays,
    its key is keep_id, and rows without a key come before all others. Of rows that share text and key, one stays.
    full_sha256 is null where a text was not read in full, as its length or its first bytes are its own. carry names
    columns of docs to pass on, which may be computed. An empty table stays empty; other columns are not read, whatever
    their names. lengths and heads, multiples of ROW, are the bitmaps' bits.

    Two scans; only counts by length and head, and a narrow row for each text read in full, are shuffled. A group of
    copies of any size is counted before it is shuffled, and its rows meet their group in a join that Spark can split.
    """
    extra = {c: f"_c{k}" for k, c in enumerate(carry)}
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"), *(F.col(c).alias(n) for c, n in extra.items()))
    rows = rows.withColumn("_n", F.octet_length("_text").cast("long"))
    # One table of counts serves both steps; heads are compared only where lengths could not tell.
    begins = F.xxhash64(F.substring("_text", 1, head))
    counts = checkpoint(rows.groupBy("_n", begins.alias("_head")).agg(F.count("*").alias("_rows")))
    of_length = F.pmod(F.col("_n"), F.lit(lengths))
    lengths_of = counts.groupBy("_n").agg(F.sum("_rows").alias("_rows")).where("_rows > 1")
    by_length = checkpoint(_bitmap(lengths_of.select(of_length.alias("slot")), "_length"))
    of_head = lambda head: F.pmod(F.xxhash64("_n", head), F.lit(heads))
    open_ = _marked(counts, by_length, "_length", of_length).where("_length and _rows > 1")
    by_head = checkpoint(_bitmap(open_.select(of_head(F.col("_head")).alias("slot")), "_heads"))
    again = _marked(rows, by_length, "_length", of_length)
    again = _marked(again, by_head, "_heads", F.when(F.col("_length"), of_head(begins)))
    full = again.select("_key", F.when(F.col("_length") & F.col("_heads"), F.sha2("_text", 256)).alias("_full"), F.monotonically_increasing_id().alias("_row"), *extra.values())
    full = checkpoint(full)
    order = F.struct(F.col("_key"), F.col("_row"))
    # Cut off from the aggregate before it, so that Spark can split a large group's rows in the join.
    groups = checkpoint(full.where("_full is not null").groupBy("_full").agg(F.max(order).alias("_best"), F.count("*").alias("_size")))
    passed = [F.col(n).alias(c) for c, n in extra.items()]
    many = full.where("_full is not null").join(groups, "_full")
    many = many.select(F.col("_key").alias(key), F.col("_best._key").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_row") == F.col("_best._row")).alias("kept"), F.col("_full").alias("full_sha256"), *passed)
    one = full.where("_full is null").select(F.col("_key").alias(key), F.col("_key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_full").alias("full_sha256"), *passed)
    return many.unionByName(one)
