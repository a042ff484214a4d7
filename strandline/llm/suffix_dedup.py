"""Suffix-array dedup: bytes of long strings that stand earlier in the corpus go.

Every byte covered by a string of `length` bytes that also starts earlier (in a document with a smaller key, or in the
same one at an earlier place) is removed. Strings never cross documents and are judged on the input.

How equal strings meet. Each window of `length` bytes picks an anchor, the smallest hash among its grams of length/4
bytes, the leftmost if they tie. Equal windows pick the same anchor, so the anchor's hash deals all windows out without
losing a match. Neighbouring windows mostly share their anchor and form a context, under twice `length` long.

First only the anchors' hashes are dealt out, to find those that occur once: no window there can have a match. Then the
other contexts are. In both rounds what a block of documents holds twice is sent once (contexts are compared byte by
byte), so a passage that stands in a third of all documents reaches its bucket once for each block of BLOCK bytes. Where
there are more than FAN blocks, they meet in groups of about FAN first, and a group sends on once what it holds twice: so
a bucket gets each passage once for each group, and no task holds more than some FAN of one.

The index. A bucket is an index family of logarithmic size: contexts come in batches; each batch gets a suffix array,
which is merge-scanned against the existing levels; what is new becomes a level, and levels of like size merge. First
this is done with the suffixes that begin a context and reach to its end, which settles contexts that are wholly equal.
Then, for anchors that still have several contexts, with all their suffixes of `length` bytes or more (sorted by prefix
doubling, compared to that depth). Each string keeps its earliest place; a place that loses is reported as a span.

Both rounds' results are joined to the documents by key; Spark deals the documents out once and uses that twice.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import bytes_of, checkpoint, slices

LENGTH, BLOCK, BATCH, WINDOWS, FAN = 100, 4 << 20, 1 << 13, 1 << 18, 4096
LAST = (1 << 63) - 1
#: Bits of a window's place in a block, in which ties between gram hashes fall to the leftmost.
PLACE = np.uint64((1 << 24) - 1)
ODD = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1


def _bytes_table() -> np.ndarray:
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD)) ^ np.uint64(0xD1B54A32D192ED03)
    for s in (30, 27, 31):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(0xBF58476D1CE4E5B9)
    return x


TABLE = _bytes_table()


def gram_hashes(text: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n bytes of text, by doubling; n is at most len(text)."""
    h, m, power = TABLE[text], 1, ODD
    found, length = None, 0
    while True:
        if n & m:
            found = h[: len(text) - n + 1].copy() if found is None else found[: len(text) - n + 1] * np.uint64(power) + h[length : length + len(text) - n + 1]
            length += m
        if length == n:
            break
        h = h[:-m] * np.uint64(power) + h[m:]
        m, power = 2 * m, power * power & M64
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(29)
    return found


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... size[0] numbers, then from begin[1], and so on."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order by (doc, start), ends rising within a doc: those that touch become one."""
    if not len(doc):
        return doc, start, end
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], end[np.append(first[1:], len(doc)) - 1]


class Contexts:
    """Arrays of contexts: document (k, h), start, size, place of the anchor; data: their bytes, end to end."""

    HEAD = struct.Struct("<I")
    FIELDS = (("k", "<i8"), ("h", "<i8"), ("start", "<i8"), ("size", "<u2"), ("at", "<u2"))

    @staticmethod
    def pack(columns: list[np.ndarray], data: np.ndarray, squeeze) -> bytes:
        parts = [Contexts.HEAD.pack(len(columns[0]))]
        parts += [c.astype(t).tobytes() for c, (_, t) in zip(columns, Contexts.FIELDS, strict=True)]
        return squeeze.compress(b"".join((*parts, data.tobytes())))

    @staticmethod
    def unpack(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        got: dict[str, list] = {name: [] for name, _ in Contexts.FIELDS}
        data, wide = [], zstandard.ZstdDecompressor()
        for blob in blobs:
            raw = wide.decompress(blob)
            (n,), at = Contexts.HEAD.unpack_from(raw), Contexts.HEAD.size
            for name, kind in Contexts.FIELDS:
                got[name].append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
            data.append(np.frombuffer(raw, "u1", offset=at))
        return {name: np.concatenate(x) for name, x in got.items()}, np.concatenate(data)


class Block:
    """The contexts of segments (k, h, base, bytes, ...) in order: place p in the block, size, anchor's place at, and whose they are."""

    def __init__(self, segments: list[tuple], length: int) -> None:
        gram = length // 4
        self.length = length
        self.text = text = np.frombuffer(b"".join(s[3] for s in segments), "u1")
        sizes = np.array([len(s[3]) for s in segments])
        ends = np.cumsum(sizes)
        self.hashes = hashes = gram_hashes(text, gram)
        low = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
        wide, m = length - gram + 1, 1
        while 2 * m <= wide:
            low = np.minimum(low[:-m], low[m:])
            m *= 2
        if m < wide:
            low = np.minimum(low[: len(text) - length + 1], low[wide - m :])
        anchor = (low & PLACE).astype(np.int32)
        for e, size in zip(ends, sizes, strict=True):  # windows that would cross into the next segment
            anchor[max(e - length + 1, e - size) : e] = -1
        turn = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        p = np.concatenate(([0], turn))
        q = np.concatenate((turn, [len(anchor)])) - 1
        real = anchor[p] >= 0
        self.p, q = p[real], q[real]
        self.at, self.size = anchor[self.p] - self.p, q - self.p + length
        doc = np.searchsorted(ends, self.p, side="right")
        self.k, self.h, base = (np.array([s[c] for s in segments], dtype=np.int64)[doc] for c in range(3))
        self.start = base + self.p - (ends - sizes)[doc]
        new = np.ones(len(self.p), dtype=bool)
        new[1:] = (self.k[1:] != self.k[:-1]) | (self.h[1:] != self.h[:-1]) | (self.start[1:] <= self.start[:-1])
        self.doc = np.cumsum(new)  # segments of a document are one; a repeated row is another

    def anchors(self) -> np.ndarray:
        return self.hashes[self.p + self.at]

    def only(self, keep: np.ndarray) -> None:
        for name in ("p", "at", "size", "k", "h", "start", "doc"):
            setattr(self, name, getattr(self, name)[keep])

    def collapse(self) -> tuple[np.ndarray, ...]:
        """Keeps the first of contexts that are equal; returns the spans (k, h, start, end) of the others."""
        p, at, size, text, gram = self.p, self.at, self.size, self.text, self.length // 4
        key = (size * 4096 + at).astype(np.uint64) * np.uint64(ODD)
        for j in range(-(-(2 * self.length - gram) // (2 * gram))):  # grams from both ends cover the whole context
            for place in (p + j * gram, p + size - (j + 1) * gram):
                key = (key ^ self.hashes[place]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(31)
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(p), dtype=bool)
        same[1:] = key[order[1:]] == key[order[:-1]]
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(p))))] if len(p) else order
        twin, of = order[same], head[same]
        equal = (size[twin] == size[of]) & (at[twin] == at[of])
        steps, last = np.arange(2 * self.length - gram), len(text) - 1
        for j in range(0, len(twin), 1 << 15):
            a, b, n = (x[j : j + (1 << 15), None] for x in (p[twin], p[of], size[twin]))
            equal[j : j + (1 << 15)] &= ((text[np.minimum(a + steps, last)] == text[np.minimum(b + steps, last)]) | (steps >= n)).all(axis=1)
        twin, of = twin[equal], of[equal]
        later = (self.k[twin] != self.k[of]) | (self.h[twin] != self.h[of]) | (self.start[twin] != self.start[of])  # not the same place of a repeated row
        lost = np.sort(twin[later])
        code = (self.doc[lost] << 40) | self.start[lost]
        number, s, e = _merged(self.doc[lost], self.start[lost], self.start[lost] + size[lost])
        first = lost[np.searchsorted(code, (number << 40) | s)]
        spans = (self.k[first], self.h[first], s, e)
        keep = np.ones(len(p), dtype=bool)
        keep[twin] = False
        self.only(keep)
        return spans


def _grouped(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    turn = np.flatnonzero(bucket[order][1:] != bucket[order][:-1]) + 1
    for a, b in pairwise([0, *turn, len(order)] if len(order) else []):
        yield int(bucket[order[a]]), order[a:b]


#: An anchor's hash within its bucket, document (k, h), start; its own block has it twice.
ANCHOR = (("hash", "<u4"), ("k", "<i8"), ("h", "<i8"), ("start", "<i8"), ("twice", "?"))


def pack_anchors(block: Block, buckets: int, squeeze) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, blob): each anchor hash of the block once (kind 0), and places whose anchor it has twice (kind 1)."""
    anchor = block.anchors()
    _, first, number, count = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
    twice = count[number] > 1
    bucket = (anchor % np.uint64(buckets)).astype(np.int64)
    columns = ((anchor // np.uint64(buckets)).astype("<u4"), block.k, block.h, block.start, twice)
    for b, own in _grouped(bucket[np.sort(first)]):
        own = np.sort(first)[own]
        yield b, 0, squeeze.compress(b"".join(c[own].astype(t).tobytes() for c, (_, t) in zip(columns, ANCHOR, strict=True)))
    if twice.any():
        yield int(bucket[np.argmax(twice)]), 1, np.stack((block.k[twice], block.h[twice], block.start[twice])).astype("<i8").tobytes()


def _anchors(blobs: list[bytes]) -> dict[str, np.ndarray]:
    wide, width = zstandard.ZstdDecompressor(), sum(np.dtype(t).itemsize for _, t in ANCHOR)
    got: dict[str, list] = {name: [] for name, _ in ANCHOR}
    for blob in blobs:
        raw, at = wide.decompress(blob), 0
        n = len(raw) // width
        for name, kind in ANCHOR:
            got[name].append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(x) for name, x in got.items()}


def repeated_anchors(blobs: list[bytes]) -> np.ndarray:
    """(k, h, start) of a bucket's anchors that occur more than once, but for those that their block reports itself."""
    c = _anchors(blobs)
    pick = _shared(c["hash"]) & ~c["twice"]
    return np.stack([c[x][pick] for x in ("k", "h", "start")])


def joined_anchors(blobs: list[bytes], squeeze) -> tuple[bytes, np.ndarray]:
    """Of a group of blocks: each anchor hash once, as a block sends it, and (k, h, start) as repeated_anchors() gives them."""
    c = _anchors(blobs)
    found = repeated_anchors(blobs)
    _, first, number, count = np.unique(c["hash"], return_index=True, return_inverse=True, return_counts=True)
    twice = np.zeros(len(first), dtype=bool)
    np.logical_or.at(twice, number, c["twice"])
    c = {name: x[first] for name, x in c.items()} | {"twice": twice | (count > 1)}
    return squeeze.compress(b"".join(c[name].astype(t).tobytes() for name, t in ANCHOR)), found


class Levels:
    """Sorted distinct strings with their earliest places, in levels that merge when they are of like size."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings in order, each once. Returns places that lose, and which of `keys` each is a place of."""
        lost, whose = [], []
        number = np.arange(len(keys))
        for level, places in self.levels:
            if not len(keys):
                break
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            hit = level[at] == keys
            if hit.any():
                old, new = places[at[hit]], place[hit]
                lost.append(np.maximum(old, new)[old != new])
                whose.append(number[hit][old != new])
                places[at[hit]] = np.minimum(old, new)
                keys, place, number = keys[~hit], place[~hit], number[~hit]
        if len(keys):
            self.levels.append((keys, place.copy()))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            both, places = np.concatenate((b, a)), np.concatenate((y, x))
            order = np.argsort(both, kind="stable")  # of two sorted runs: one merge
            self.levels.append((both[order], places[order]))
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(lost), np.concatenate(whose)) if lost else (none, none)

    def places(self) -> np.ndarray:
        return np.concatenate([x for _, x in self.levels]) if self.levels else np.zeros(0, dtype=np.int64)


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    got = key[order]
    rank = np.empty(len(key), dtype=np.uint64)
    rank[order] = np.concatenate(([0], np.cumsum(got[1:] != got[:-1]))).astype(np.uint64)
    return rank


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix of text, by its first `depth` bytes, by prefix doubling."""
    if depth >= 8:
        padded = np.concatenate((text, np.zeros(8, dtype="u1")))
        key = np.zeros(len(text), dtype=np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | padded[j : j + len(text)]
        m = 8
    else:
        key, m = text.astype(np.uint64), 1
    rank = _ranked(key)
    while m < depth:
        step = min(m, depth - m)
        after = np.concatenate((rank[step:] + np.uint64(1), np.zeros(min(step, len(rank)), dtype=np.uint64)))
        rank, m = _ranked((rank << np.uint64(32)) | after), m + step
    return rank


def _firsts(rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In order by rank: the item with each rank's least place, and for each item the number of its rank."""
    order = np.lexsort((place, rank))
    new = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
    group = np.empty(len(rank), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def _shared(anchor: np.ndarray) -> np.ndarray:
    """Which items have an anchor that others have too."""
    _, number, count = np.unique(anchor, return_inverse=True, return_counts=True)
    return count[number] > 1


def joined_contexts(blobs: list[bytes], length: int, squeeze) -> tuple[bytes, np.ndarray]:
    """Of a group of blocks: contexts that are wholly equal once, the earliest, as a block sends them, and the spans (k, h, start, end) of the others."""
    c, data = Contexts.unpack(blobs)
    size = c["size"].astype(np.int64)
    begin = np.cumsum(size) - size
    rows = np.zeros((len(size), 2 * length - length // 4 + 2), dtype="u1")
    rows[:, 0], rows[:, 1] = c["at"] >> 8, c["at"] & 255
    rows[np.repeat(np.arange(len(size)), size), _ragged(np.full(len(size), 2), size)] = data[_ragged(begin, size)]
    keys = rows.view(f"S{rows.shape[1]}").ravel()  # zeros at the end don't count, so sizes are compared as well
    order = np.lexsort((c["start"], c["h"], c["k"], size, keys))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (size[order][1:] != size[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    same_place = np.logical_and.reduce([c[x][order] == c[x][first] for x in ("k", "h", "start")])
    lost, kept = order[~same_place], np.sort(order[new])
    spans = np.stack([c["k"][lost], c["h"][lost], c["start"][lost], c["start"][lost] + size[lost]])
    blob = Contexts.pack([c[name][kept] for name, _ in Contexts.FIELDS], data[_ragged(begin[kept], size[kept])], squeeze)
    return blob, spans


def bucket_spans(blobs: list[bytes], length: int, batch: int = BATCH, windows: int = WINDOWS) -> tuple[np.ndarray, ...]:
    """(k, h, start, end) of what is not the earliest of its string, among the contexts of one bucket."""
    c, data = Contexts.unpack(blobs)
    size, gram = c["size"].astype(np.int64), length // 4
    begin = np.cumsum(size) - size
    anchor = data[(begin + c["at"])[:, None] + np.arange(gram)].view(f"S{gram}").ravel()
    pick = np.flatnonzero(_shared(anchor))
    if not len(pick):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    anchor, k, h, start, size, at, begin = (x[pick] for x in (anchor, c["k"], c["h"], c["start"], size, c["at"], begin))
    order = np.lexsort((h, k))
    new = np.concatenate(([False], (k[order][1:] != k[order][:-1]) | (h[order][1:] != h[order][:-1])))
    doc = np.empty(len(k), dtype=np.int64)
    doc[order] = np.cumsum(new)
    docs = order[np.concatenate(([0], np.flatnonzero(new)))]
    place = (doc << 40) | start
    most = 2 * length - length // 4
    lost_at, lost_size = [], []

    whole = Levels()
    for j in range(0, len(pick), batch):
        n = size[j : j + batch]
        rows = np.zeros((len(n), most + 4), dtype="u1")
        rows[:, :4] = np.stack((n >> 8, n & 255, at[j : j + batch] >> 8, at[j : j + batch] & 255), axis=1)
        rows[np.repeat(np.arange(len(n)), n), _ragged(np.full(len(n), 4), n)] = data[_ragged(begin[j : j + batch], n)]
        keys = rows.view(f"S{most + 4}").ravel()
        array = np.argsort(keys, kind="stable")
        rank = np.empty(len(n), dtype=np.int64)
        rank[array] = np.concatenate(([0], np.cumsum(keys[array][1:] != keys[array][:-1])))
        first, group = _firsts(rank, place[j : j + batch])
        here = place[j : j + batch]
        worse = here != here[first][group]
        more, whose = whole.add(keys[first], here[first])
        lost_at += [here[worse], more]
        lost_size += [n[worse], n[first][whose]]

    pick = np.flatnonzero(np.isin(place, whole.places()))
    _, once = np.unique(place[pick], return_index=True)  # a repeated row's contexts have the same places
    pick = pick[once]
    pick = pick[_shared(anchor[pick])] if len(pick) else pick
    each = np.cumsum(size[pick] - length + 1)
    cuts = np.searchsorted(each, np.arange(0, each[-1] if len(each) else 0, windows), side="left").tolist()
    dense = Levels()
    for a, b in pairwise([*cuts, len(pick)]):
        own = pick[a:b]
        if not len(own):
            continue
        n = size[own]
        text = data[_ragged(begin[own], n)]
        here = _ragged(np.cumsum(n) - n, n - length + 1)
        where = _ragged(place[own], n - length + 1)
        first, group = _firsts(suffix_ranks(text, length)[here], where)
        keys = np.lib.stride_tricks.sliding_window_view(text, length)[here[first]].copy().view(f"S{length}").ravel()
        worse = where != where[first][group]
        more, _ = dense.add(keys, where[first])
        lost_at += [where[worse], more]
        lost_size += [np.full(worse.sum() + len(more), length)]

    at, n = np.concatenate(lost_at), np.concatenate(lost_size)
    order = np.lexsort((n, at))
    at, n = at[order], n[order]
    end = np.maximum.accumulate(at + n)  # within a document: its number is in the high bits of both
    number, s, e = _merged(at >> 40, at, end)
    doc = docs[number]
    return k[doc], h[doc], s & ((1 << 40) - 1), e & ((1 << 40) - 1)


SPANS = "k long, h long, s long, e long"


def _segments(text: bytes, length: int, block: int) -> Iterator[tuple[int, bytes]]:
    """(base, bytes): every window of the text is in just one."""
    for base in range(0, len(text) - length + 1, block):
        yield base, text[base : base + block + length - 1]


def _blobs(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for j in range(0, len(rows), 256):
        n, kind, blob = zip(*rows[j : j + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["bucket", "kind", "blob"])


def _by_bucket(dealt: DataFrame, parts: int, names: list[str], make) -> DataFrame:
    """Longs by `names`: what make gives for each bucket's blobs of kind 0, and what blobs of kind 1 hold as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        told = lambda x: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in x], names=names)
        for rows in batches:
            for bucket, kind, blob in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if kind:
                    yield told(np.frombuffer(blob, "<i8").reshape(len(names), -1))
                    continue
                if bucket != at and blobs:
                    yield told(make(blobs))
                    blobs.clear()
                at = bucket
                blobs.append(blob)
        if blobs:
            yield told(make(blobs))

    dealt = dealt.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _joined(dealt: DataFrame, parts: int, groups: int, join) -> DataFrame:
    """Blobs of kind 0 joined within groups of blocks, bucket by bucket; what join(blobs, squeeze) reports goes on as kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        at, blobs = None, []

        def told() -> pa.RecordBatch:
            blob, found = join(blobs, squeeze)
            rows = [(at[0], 0, blob)] + ([(at[0], 1, found.astype("<i8").tobytes())] if found.size else [])
            blobs.clear()
            return next(_blobs(rows))

        for rows in batches:
            for bucket, group, blob in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if (bucket, group) != at and blobs:
                    yield told()
                at = (bucket, group)
                blobs.append(blob)
        if blobs:
            yield told()

    kind = "bucket long, kind int, blob binary"
    mine = dealt.where("kind = 0").select("bucket", F.pmod(F.xxhash64("blob"), F.lit(groups)).alias("group"), "blob")
    return mine.repartition(parts, "bucket", "group").sortWithinPartitions("bucket", "group").mapInArrow(run, kind).unionByName(dealt.where("kind = 1"))


def _spans(docs: DataFrame, length: int, block: int, batch: int, windows: int, parts: int, buckets: int, groups: int) -> DataFrame:
    """(k, h, s, e): removed spans of documents (id, k, h, text as bytes); they may overlap."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        """Of columns k, h, text and perhaps starts: then only contexts that begin there."""
        held: list[tuple] = []
        full = 0

        def out() -> Block:
            held.sort(key=lambda x: x[:3])
            made = Block(held, length)
            if len(held[0]) > 4:
                size = [len(x[4]) for x in held]
                wanted = np.concatenate([x[4] for x in held])
                number = {x: n for n, x in enumerate(dict.fromkeys((x[0], x[1]) for x in held))}
                of = np.repeat([number[x[0], x[1]] for x in held], size)
                mine = np.array([number[x] for x in zip(made.k.tolist(), made.h.tolist(), strict=True)], dtype=np.int64)
                made.only(np.isin((mine << 40) | made.start, (of << 40) | wanted))
            held.clear()
            return made

        for rows in batches:
            names = rows.schema.names
            starts = rows.column(names.index("starts")) if "starts" in names else None
            for n, (k, h, text) in enumerate(zip(rows.column(names.index("k")).to_pylist(), rows.column(names.index("h")).to_pylist(), rows.column(names.index("text")), strict=True)):
                more = () if starts is None else (np.array(starts[n].as_py(), dtype=np.int64),)
                for base, segment in _segments(text.as_py() or b"", length, block):
                    held.append((k, h, base, segment, *more))
                    full += len(segment)
                    if full >= block:
                        yield out()
                        full = 0
        if held:
            yield out()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for made in blocks(batches):
            yield from _blobs(list(pack_anchors(made, buckets, squeeze)))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for made in blocks(batches):
            spans = made.collapse()
            rows = []
            for b, own in _grouped((made.anchors() % np.uint64(buckets)).astype(np.int64)):
                data = made.text[_ragged(made.p[own], made.size[own])]
                rows.append((b, 0, Contexts.pack([c[own] for c in (made.k, made.h, made.start, made.size, made.at)], data, squeeze)))
            if len(spans[0]):
                rows.append((int(spans[2][0] + spans[0][0]) % buckets, 1, np.stack(spans).astype("<i8").tobytes()))
            yield from _blobs(rows)

    blob = "bucket long, kind int, blob binary"
    once = docs.select("k", "h", "text").mapInArrow(anchors, blob)
    if groups > 1:
        once = _joined(checkpoint(once), parts, groups, joined_anchors)
    twice = _by_bucket(once, parts, ["k", "h", "start"], repeated_anchors)
    wanted = twice.groupBy("k", "h").agg(F.collect_list("start").alias("starts"))
    again = docs.join(wanted, ["k", "h"]).select("id", "k", "h", "text", "starts").mapInArrow(contexts, blob)
    if groups > 1:
        again = _joined(checkpoint(again), parts, groups, lambda blobs, squeeze: joined_contexts(blobs, length, squeeze))
    return _by_bucket(again, parts, ["k", "h", "s", "e"], lambda blobs: bucket_spans(blobs, length, batch, windows))


def repeated_strings(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", block: int = BLOCK, batch: int = BATCH, windows: int = WINDOWS, fan: int = FAN) -> DataFrame:
    """(key, n_bytes, spans, kept): a row for each row of docs.

    spans: the maximal removed runs, as (start, end) in bytes of UTF-8, end exclusive; kept: the remaining bytes, which
    need not be valid UTF-8. A null text counts as empty, and a text shorter than `length` stays whole. A null key
    counts as larger than all others. Rows with the same key and different texts are ordered by the text's hash; rows
    repeated in full count as one document, and each gets its result. An empty table gives an empty result; other
    columns are not read. length is a multiple of four.
    """
    if length < 4 or length % 4:
        raise ValueError("length must be a multiple of four")
    if 2 * (block + length) >= 1 << 24 or 2 * length >= 1 << 12:
        raise ValueError("block is over 8 MB, or length over 2000")  # places in a block have 24 bits, sizes and anchors 12
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    k = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    # Texts' hashes cost more to send than all else but the texts, and tell rows apart only if keys don't.
    unique = docs.groupBy(k).count().where("count > 1").isEmpty()
    h = F.lit(0).cast("long") if unique else F.xxhash64(data)
    rows = docs.select(F.col(key).alias("id"), k.alias("k"), h.alias("h"), data.alias("text"))
    parts = slices(docs, 4)
    buckets = max(2 * parts, min(1 << 24, bytes_of(docs) // 1_000_000))
    groups = -(-bytes_of(docs) // (block * fan))
    found = _spans(rows, length, block, batch, windows, parts, buckets, groups).groupBy("k", "h").agg(F.collect_list(F.struct("s", "e")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for rows_ in batches:
            sizes, spans, kept = [], [], []
            for data, got in zip(rows_.column(1), rows_.column(2).to_pylist(), strict=True):
                data = data.as_py()
                runs: list[dict] = []
                for x in sorted(got or (), key=lambda x: x["s"]):
                    if runs and x["s"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], x["e"])
                    else:
                        runs.append({"start": x["s"], "end": x["e"]})
                sizes.append(len(data))
                spans.append(runs)
                kept.append(b"".join(data[a:b] for a, b in zip([0, *(r["end"] for r in runs)], [*(r["start"] for r in runs), len(data)], strict=True)) if runs else data)
            yield pa.RecordBatch.from_arrays([rows_.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=[key, "n_bytes", "spans", "kept"])

    kind = dict(docs.dtypes)[key]
    # All columns go on in both joins, so that Spark sees that they deal out the same rows.
    joined = rows.join(found, ["k", "h"], "left").select("id", "text", "found", "k", "h")
    return joined.mapInArrow(cut, f"`{key}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
