"""Best-fit packing with variable capacity: documents into sequences of several permitted lengths.

A sequence costs FIXED, its length and a share that grows with its square, as attention does. Pieces come longest
first. Each goes where it leaves the least room; if no open sequence has room, one is opened. Which length it gets is
settled against what is still to be placed: each permitted length that holds the piece is filled up in thought with the
longest pieces left that fit, downsized to what is then in it, and the one that costs least a word is opened, the
shortest of those that tie. Pieces that one sequence counts on don't count for the next. So the distribution of lengths decides, and no length is fixed beforehand. At the end every
sequence is downsized to the shortest permitted length that holds what is in it. The same is done with lengths chosen by
their full cost a word alone; of the two, a shard keeps the packing that costs less in all. A document longer than the
longest length is cut into pieces of that length and a rest.

Documents are dealt by hash into shards of about SHARD documents, each packed by itself: a shard wastes a few partly
filled sequences at most, and a task's memory is that of its shard's lengths. The hash takes the row's number in, so
that equal rows don't meet in one shard. Texts are not sent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.mixing import words

CAPACITIES, FIXED, SQUARE, SHARD = (512, 1024, 2048, 4096, 8192), 64, 32_768, 8192


def cost(capacity: int) -> float:
    return FIXED + capacity + capacity * capacity / SQUARE


def _fits(sizes: list[int], words: int) -> int:
    return next(c for c in sizes if c >= words)


def _filled(piece: int, capacity: int, free: dict[int, int], lengths: int) -> tuple[int, list[tuple[int, int]]]:
    """The words of a sequence that begins with a piece and takes the longest free pieces as long as any fits, and these as (length, how many).

    free: how many pieces of each length there are; lengths: those lengths as bits.
    """
    words, took = piece, []
    while fits := lengths & ((2 << (capacity - words)) - 1):
        n = fits.bit_length() - 1
        took.append((n, min(free[n], (capacity - words) // n)))
        words += n * took[-1][1]
        lengths &= (1 << n) - 1  # shorter ones only: of n there is none left, or no room
    return words, took


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, joint: bool = True) -> tuple[list[tuple[int, int]], list[int]]:
    """For each length, none over the largest capacity, (bin, offset); and each bin's capacity. Lengths are packed longest first, ties in order.

    joint: whether what is still to be placed decides which capacity is opened, or its full cost a word alone.
    """
    sizes = sorted(capacities)
    left = Counter(n for n in lengths if n > 0)
    free = left.copy()  # of these, the pieces that no open bin counts on
    waiting = sum(1 << n for n in free)  # bit n: there is a free piece of length n
    where: list[tuple[int, int]] = [(-1, 0)] * len(lengths)
    filled: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # open bins by the room they have
    some = 0  # bit r: a bin with room r is open

    def take(n: int, count: int) -> None:
        nonlocal waiting
        free[n] -= count
        if not free[n]:
            waiting &= ~(1 << n)

    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        if n <= 0:
            break
        left[n] -= 1
        if free[n] > left[n]:
            take(n, 1)
        if fits := some >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some &= ~(1 << room)
        else:
            hold = [c for c in sizes if c >= n]
            if joint:
                plans = {c: _filled(n, c, free, waiting) for c in hold}
                room = min(hold, key=lambda c: (cost(_fits(sizes, plans[c][0])) / plans[c][0], c))
                for x, count in plans[room][1]:
                    take(x, count)
            else:
                room = min(hold, key=lambda c: (cost(c) / c, c))
            b = len(filled)
            filled.append(0)
        where[k] = (b, filled[b])
        filled[b] += n
        room -= n
        if room:
            by_room[room].append(b)
            some |= 1 << room
    return where, [_fits(sizes, x) for x in filled]


def cheapest(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[tuple[int, int]], list[int]]:
    """The packing by best_fit() that costs less in all, of the joint choice of lengths and the fixed one."""
    return min((best_fit(lengths, capacities, joint) for joint in (True, False)), key=lambda x: sum(map(cost, x[1])))


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD, key: str = "doc_id", text: str = "text", length: Column | None = None) -> DataFrame:
    """(key, piece, start, length, bin_id, bin_length, offset): a row for each piece of each row of docs.

    start: the piece's first word in the document; offset: its place in the sequence bin_id, whose final length is
    bin_length. length: a document's size, by default its words. A document of size 0 (a null or empty text) has one row
    with length 0 and no bin. Null keys and repeated rows are packed like others, each row by itself; an empty table
    gives an empty result; other columns are not read.
    """
    if not capacities or min(capacities) <= 0:
        raise ValueError("capacities must be over 0")
    kind, most = dict(docs.dtypes)[key], max(capacities)
    size = F.coalesce((words(F.col(text)) if length is None else length).cast("long"), F.lit(0))
    rows = docs.select(F.col(key).alias("k"), F.greatest(size, F.lit(0)).alias("size"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.monotonically_increasing_id().alias("row"))
    shards = max(1, -(-docs.count() // shard))
    rows = rows.repartitionById(shards, F.pmod(F.xxhash64("h", "row"), F.lit(shards)).cast("int")).sortWithinPartitions(F.desc("size"), "h", "k").select("k", "size", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, number = [], [], 0
        for batch in batches:
            keys += batch.column(0).to_pylist()
            sizes += batch.column(1).to_pylist()
            key_kind, number = batch.schema.field(0).type, batch.column(2)[0].as_py()
        if not keys:
            return
        pieces = [(k, p, p * most, min(most, n - p * most)) for k, n in enumerate(sizes) for p in range(max(1, -(-n // most)))]
        where, made = cheapest([n for *_, n in pieces], capacities)
        for j in range(0, len(pieces), 1 << 15):
            part, at = pieces[j : j + (1 << 15)], where[j : j + (1 << 15)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[k] for k, *_ in part], key_kind),
                    *(pa.array([x[c] for x in part], pa.int64()) for c in (1, 2, 3)),
                    pa.array([(number << 32) + b if b >= 0 else None for b, _ in at], pa.int64()),
                    pa.array([made[b] if b >= 0 else None for b, _ in at], pa.int64()),
                    pa.array([x if b >= 0 else None for b, x in at], pa.int64()),
                ],
                names=[key, "piece", "start", "length", "bin_id", "bin_length", "offset"],
            )

    return rows.mapInArrow(run, f"`{key}` {kind}, piece long, start long, length long, bin_id long, bin_length long, offset long")
