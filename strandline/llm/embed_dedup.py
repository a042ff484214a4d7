"""Embedding near-dedup by int8 tile products with error bounds.

Vectors that are equal are one from the start. The others are dealt into tiles of TILE vectors, near ones together: by
their nearest of some pivots, which are vectors of the table themselves. A tile keeps its mean direction and the largest
angle from it; two tiles whose angles show that no pair can reach the threshold are not compared, which loses nothing.

In a tile each vector is quantised to int8 with its own step, and only these codes are sent to be compared: one product
of small integers, exact in single precision, estimates all cosines of two tiles. A vector's quantisation error is
measured, not assumed: with x = a + e and y = b + f, x.y differs from a.b by at most |e| |y| + |a| |f|, so pairs that
stay below the threshold by that bound are settled. Vectors that have another pair left in some pair of tiles follow
there in full, and those pairs are computed again in double precision from the given components.

A pair of tiles returns counts of links by vector and a star for each group that links connect, never the pairs.
Comparing all tiles takes time with the square of the number of distinct vectors, less what the angles rule out; the
links are whole, and the memory of a task is that of two tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import checkpoint, components

#: PIVOTS: the most pivots, and so the most vectors that reach the driver. HEADS: tiles whose angles are held against each
#: other at once.
THRESHOLD, TILE, PIVOTS, HEADS = 0.95, 4096, 1024, 256
EXACT = 1000  # products of so many pairs of int8 add up to less than 2 ** 24
MARGIN = 1e-6  # for rounding in the estimate's own arithmetic, far above it


def unit(x: np.ndarray) -> np.ndarray:
    """Rows by their norms; first by their largest components, whose squares may be beyond the range of a double."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: int8 components, each vector's step, and the norm of what that misses."""
    step = np.abs(x).max(axis=1) / 127
    q = np.rint(x / step[:, None]).astype(np.int8)
    miss = x - q * step[:, None]
    return q, step, np.sqrt(np.einsum("ij,ij->i", miss, miss))


def _products(q: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of int8 rows and columns of whole numbers in single precision: exact."""
    if q.shape[1] <= EXACT:
        return q.astype(np.float32) @ other
    return sum((q[:, k : k + EXACT].astype(np.float32) @ other[k : k + EXACT]).astype(np.float64) for k in range(0, q.shape[1], EXACT))


def _open(x: tuple, y: tuple, threshold: float, rows: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """For each `rows` vectors of x, by the first one's place: which pairs with vectors of y the bounds leave open. x, y: as quantised() gives them."""
    (qx, sx, ex), (qy, sy, ey) = x, y
    other = np.ascontiguousarray(qy.astype(np.float32).T)
    for k in range(0, len(qx), rows):
        part = slice(k, k + rows)
        about = _products(qx[part], other) * sx[part, None] * sy
        yield k, about + (ex[part, None] + (1 + ex[part, None]) * ey + MARGIN) >= threshold


def asked(x: tuple, y: tuple, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and in y of vectors that have an open pair; same: x is y, and a vector no pair with itself."""
    left, right = np.zeros(len(x[0]), dtype=bool), np.zeros(len(y[0]), dtype=bool)
    for k, pairs in _open(x, y, threshold):
        if same:
            pairs[np.arange(len(pairs)), np.arange(k, k + len(pairs))] = False
        left[k : k + len(pairs)] = pairs.any(axis=1)
        right |= pairs.any(axis=0)
    return np.flatnonzero(left), np.flatnonzero(right)


def linked(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of all pairs with cosine >= threshold. x, y: double, not zero."""
    ux, uy = unit(x), unit(y)
    left, right = [], []
    for k, pairs in _open(quantised(ux), quantised(uy), threshold):
        a, b = np.nonzero(pairs)
        for j in range(0, len(a), 1 << 17):
            p, q = a[j : j + (1 << 17)] + k, b[j : j + (1 << 17)]
            sure = np.einsum("ij,ij->i", ux[p], uy[q]) >= threshold
            left.append(p[sure])
            right.append(q[sure])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the least that it is connected to."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, pivots: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept): a row for each row of vectors.

    n_links: other rows whose cosine, in double precision, is at least threshold; component_id: the smallest key among
    the rows that links reach, itself included; kept: whether that is its own. A vector that is null, empty, zero or
    holds null or non-finite components links with nothing, nor does one of another length: it is alone, and kept.
    Rows with equal vectors link with each other, rows repeated in full as well, and a row without key links but names no
    component; its own kept is false unless it is alone. An empty table gives an empty result; other columns are
    not read.
    """
    kind = dict(vectors.dtypes)[key]
    v = F.col("v")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    whole = F.coalesce(v.isNotNull() & ~odd & some, F.lit(False))
    good, rest = rows.where(whole), rows.where(~whole)
    # 0.0 + x makes -0.0 and 0.0 one
    good = good.withColumn("v", F.transform(v, lambda x: x + F.lit(0.0)))
    distinct = good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    count = (distinct := checkpoint(distinct)).count()
    alone = rest.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not count:
        return alone

    # A vector's number is a hash of it. Should two vectors share one, another salt is tried.
    for salt in range(64):
        number = F.xxhash64(F.lit(salt), v)
        if distinct.agg(F.count_distinct(number).alias("n")).first()["n"] == count:
            break
    else:
        raise ValueError(f"{count} vectors are too many for 64-bit numbers")
    numbered = distinct.select(number.alias("node"), "v", "copies")
    pivots = pivots or min(PIVOTS, max(8, -(-count // tile)))
    drawn: dict[int, list] = {}
    for r in numbered.orderBy("node").limit(pivots).collect():
        drawn.setdefault(len(r["v"]), []).append(r["v"])
    centres = {size: unit(np.array(x)) for size, x in drawn.items()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its length, its nearest pivot and its components as bytes."""
        for batch in batches:
            data = [np.array(x, dtype="<f8") for x in batch.column(1).to_pylist()]
            near = [int(np.argmax(centres[len(x)] @ unit(x[None])[0])) if len(x) in centres else 0 for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int32()), pa.array(near, pa.int32()), pa.array([x.tobytes() for x in data], pa.binary()), batch.column(2)], names=["node", "size", "near", "data", "copies"])

    held = checkpoint(numbered.mapInArrow(dealt, "node long, size int, near int, data binary, copies long"))
    # Tiles: near vectors stand together. Cells of more than one tile are cut by the node's hash.
    cells = held.groupBy("size", "near").agg(F.count("*").alias("n"))
    cut = held.join(cells, ["size", "near"]).withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / tile)).cast("int"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, data = None, [], []

        def out() -> pa.RecordBatch:
            x = unit(np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1))
            mean = x.mean(axis=0)
            norm = np.sqrt(mean @ mean)
            mean = mean / norm if norm > 0 else x[0]
            wide = float(np.arccos(np.clip((x @ mean).min(), -1, 1)))
            codes, step, miss = quantised(x)
            one = [*at, np.array(nodes, "<i8").tobytes(), codes.tobytes(), step.astype("<f8").tobytes(), miss.astype("<f8").tobytes(), mean.tolist(), wide]
            nodes.clear(), data.clear()
            return pa.RecordBatch.from_pylist([dict(zip(TILES.names, one, strict=True))], schema=TILES)

        for batch in batches:
            for size, near, part, node, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and (size, near, part) != at:
                    yield out()
                at = (size, near, part)
                nodes.append(node)
                data.append(x)
        if at is not None:
            yield out()

    cut = cut.select("size", "near", "part", "node", "data").repartition("size", "near", "part").sortWithinPartitions("size", "near", "part", "node")
    tiles = checkpoint(cut.mapInArrow(packed, "size int, near int, part int, nodes binary, codes binary, steps binary, misses binary, mean array<double>, wide double"))
    # Tiles' angles meet in groups of HEADS by HEADS, so that no task holds all of them.
    place = F.struct("near", "part")
    groups = max(1, -(-tiles.count() // HEADS))
    heads = tiles.select("size", place.alias("at"), "mean", "wide", F.pmod(F.xxhash64("size", place), F.lit(groups)).cast("int").alias("own"))
    sides = heads.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    a = sides.where("own <= other").select("size", F.col("own").alias("p"), F.col("other").alias("q"), F.col("at").alias("a"), F.col("mean").alias("mean_a"), F.col("wide").alias("wide_a"))
    b = sides.where("other <= own").select("size", F.col("other").alias("p"), F.col("own").alias("q"), F.col("at").alias("b"), F.col("mean").alias("mean_b"), F.col("wide").alias("wide_b"))
    cosine = F.aggregate(F.zip_with("mean_a", "mean_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) - F.col("wide_a") - F.col("wide_b")
    pairs = a.join(b, ["size", "p", "q"]).where(((F.col("p") < F.col("q")) | (F.col("a") <= F.col("b"))) & (apart <= float(np.arccos(threshold) + 1e-6))).select("size", "a", "b")
    pairs = checkpoint(pairs)
    side = lambda x: tiles.select("size", place.alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("nodes", "codes", "steps", "misses")))
    work = pairs.join(side("a"), ["size", "a"]).join(side("b"), ["size", "b"])
    pair = ["size", "near_a", "part_a", "near_b", "part_b"]
    work = work.select("size", *(F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("near", "part")), *(f"{c}_{x}" for x in "ab" for c in ("nodes", "codes", "steps", "misses"))).repartition(*pair)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which vectors of each pair of tiles have an open pair."""
        for batch in batches:
            for k in range(batch.num_rows):
                size, *at = (c[k].as_py() for c in batch.columns[:5])
                na, *ta, nb = (c[k].as_py() for c in batch.columns[5:10])
                tb = [c[k].as_py() for c in batch.columns[10:]]
                same = at[:2] == at[2:]
                x, y = ((np.frombuffer(t[0], "i1").reshape(-1, size), np.frombuffer(t[1], "<f8"), np.frombuffer(t[2], "<f8")) for t in (ta, tb))
                left, right = asked(x, y, threshold, same)
                na, nb = np.frombuffer(na, "<i8")[left], np.frombuffer(nb, "<i8")[[] if same else right]
                n = len(na) + len(nb)
                yield pa.RecordBatch.from_arrays([*(pa.array([c] * n, pa.int32()) for c in (size, *at)), pa.array([True] * len(na) + [False] * len(nb), pa.bool_()), pa.array(np.concatenate((na, nb)))], names=[*pair, "own", "node"])

    again = work.mapInArrow(estimate, ", ".join(f"{c} int" for c in pair) + ", own boolean, node long").join(held.select("node", "data", "copies"), "node")
    again = again.select(*pair, "own", "node", "copies", "data").repartition(*pair).sortWithinPartitions(*pair, "own", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def out() -> pa.RecordBatch:
            size, same = at[0], at[1:3] == at[3:]
            (na, ca, x), (nb, cb, y) = ((np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<i8"), np.frombuffer(b"".join(r[2] for r in rows), "<f8").reshape(-1, size)) for rows in (sides[0], sides[0] if same else sides[1]))
            sides[0].clear(), sides[1].clear()
            p, q = linked(x, y, threshold) if len(x) and len(y) else (np.zeros(0, dtype=np.int64),) * 2
            if same:
                p, q = p[p != q], q[p != q]
                nodes, links = na, np.bincount(p, cb[q], len(na)).astype(np.int64)
            else:
                nodes = np.concatenate((na, nb))
                links = np.concatenate((np.bincount(p, cb[q], len(na)), np.bincount(q, ca[p], len(nb)))).astype(np.int64)
                q = q + len(na)
            some = links > 0
            top = nodes[_stars(len(nodes), p, q)]
            return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(top[some])], names=["node", "links", "top"])

        for batch in batches:
            for *here, own, node, copies, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and here != at:
                    yield out()
                at = here
                sides[not own].append((node, copies, data))
        if at is not None:
            yield out()

    found = checkpoint(again.mapInArrow(compare, "node long, links long, top long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("top").alias("b")))
    named = distinct.select(number.alias("node"), "least", "copies").join(links, "node", "left").join(groups, "node", "left")
    named = checkpoint(named.withColumn("component", F.coalesce("component", "node")))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = checkpoint(named.join(first, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    each = checkpoint(good.select("id", number.alias("node"))).join(of, "node")
    each = each.select(F.col("id").alias(key), "n_links", F.col("component_id").cast(kind).alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return each.unionByName(alone)


TILES = pa.schema([("size", pa.int32()), ("near", pa.int32()), ("part", pa.int32()), ("nodes", pa.binary()), ("codes", pa.binary()), ("steps", pa.binary()), ("misses", pa.binary()), ("mean", pa.list_(pa.float64())), ("wide", pa.float64())])
