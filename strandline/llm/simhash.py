"""SimHash near-dedup with BK-trees.

A text's fingerprint has a bit for each of 64 places: 1 if it is set in over half of the XXH64 values of the text's
word shingles. Fingerprints link if few bits differ; a component is what links connect.

Distinct fingerprints, not documents, are compared: copies fall together before anything is dealt out. Two
fingerprints that differ in r bits or fewer agree wholly on all but r of any r + k bands, so each choice of bands to
leave out gives blocks that no link escapes (5 bands for r = 2: ten choices, 38 bits in common or more; 6 for r = 3:
twenty, 32 bits). Each block is searched with a BK-tree: a child hangs at its integer Hamming distance from its parent, and a search follows only the
edges within the radius. Blocks of more than SHARD fingerprints are cut into shards, and each pair of shards is a task:
one shard's tree, asked by the other's members. A tree thus holds SHARD fingerprints at most, which bounds what is
sent to a task; trees over the whole corpus would have no such bound, so they are dealt by shuffle and not broadcast.
Tasks return a star for each group that their links connect, never the pairs.

A small radius misses near copies that chance puts a bit further apart, and blocks for a large one would be few and grow
with the corpus. So there can be several tables, each with fingerprints of its own from remixed hashes, and two texts
link if they do in any table.

SimHash alone can't ask for a Jaccard similarity of 0.8, which leaves about 10 of 64 bits apart. near_copies() therefore
takes SimHash links as candidates only, adds those of MinHash bands, and compares the shingle sets of what candidates
connect: texts link if and only if the Jaccard similarity of these sets is LIKENESS or more. A candidate is lost if no
band and no fingerprint tells of it: at 0.8 about 1 pair in 13,000. As the bands see to that, it takes one SimHash table.
What candidates connect is compared in one task if that can hold it. Else each text is first compared with one other, that
which most of its bands name, then with the others that they name where the two are not connected yet; this alone settles
a group of copies of any size, row by row. Only texts that share a band with one they are not connected with are then
compared all with all, in shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import checkpoint, components

#: With 3 of 64 bits in any of 4 tables, texts whose shingles have a Jaccard similarity of 0.97 link in about 93 of 100
#: cases, of 0.93 in 61, of 0.8 in a few. What has to find all from 0.8 takes near_copies().
SHINGLE, RADIUS, BANDS, TABLES, SHARD = 5, 3, 6, 4, 4096
SEED = 42
#: near_copies(): the similarity from which texts link; MinHash bands and the values in each; the most texts and shingles
#: of a shard; the most of 192 bits apart at which sets of over SMALL shingles are compared (at 0.8: 29 expected, 5.0 the
#: standard deviation).
LIKENESS, MIN_BANDS, MIN_ROWS, TEXTS, SHINGLES, SMALL, APART = 0.8, 24, 5, 4096, 4 << 20, 64, 59
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, MIN_BANDS * MIN_ROWS, 1), dtype=np.uint64) | np.array([[[0]], [[1]]], dtype=np.uint64)


def _remixed(h: np.ndarray, table: int) -> np.ndarray:
    """Other 64-bit hashes from these; table 0 keeps them."""
    if not table:
        return h
    x = (h ^ np.uint64(0x9E3779B97F4A7C15 * table & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of UTF-8 bytes; A-Z count as a-z."""
    words = text.lower().split() if text else []
    if len(words) <= shingle:
        found = [b" ".join(words)] if words else []
    else:
        found = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in found), dtype=np.uint64)


def _fingerprints(h: np.ndarray, tables: int) -> list[int]:
    if not len(h):
        return [0] * tables
    out = []
    for table in range(tables):
        ones = np.zeros(64, dtype=np.int64)
        for k in range(0, len(h), 1 << 15):
            part = _remixed(h[k : k + (1 << 15)], table).astype(">u8")
            ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big"))
    return out


def fingerprints_of(text: bytes | None, shingle: int = SHINGLE, tables: int = 1) -> list[int]:
    """A fingerprint for each table, of UTF-8 bytes; A-Z count as a-z. Without words: 0."""
    return _fingerprints(_hashes(text, shingle), tables)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    return fingerprints_of(text, shingle)[0]


class BKTree:
    """Integers by Hamming distance: each child's key is its distance from its parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        at = self.root
        while d := (at[0] ^ x).bit_count():
            if d not in at[1]:
                at[1][d] = (x, {})
                return
            at = at[1][d]

    def within(self, x: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            y, children = todo.pop()
            d = (x ^ y).bit_count()
            if d <= radius:
                yield y
            todo += [c for k, c in children.items() if d - radius <= k <= d + radius]


def masks(radius: int, bands: int) -> list[int]:
    """For each choice of `radius` bands to leave out, the bits that stay."""
    ends = [round(64 * k / bands) for k in range(bands + 1)]
    band = [((1 << ends[k + 1]) - 1) ^ ((1 << ends[k]) - 1) for k in range(bands)]
    return [sum(band[k] for k in range(bands) if k not in out) for out in combinations(range(bands), radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(own: list[int], others: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within `own`, or if there are others between the two; each group that they connect becomes a star."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    tree = BKTree()
    for x in own:
        if not others:
            for y in tree.within(x, radius):
                up[top(x)] = top(y)
        tree.add(x)
    for x in others:
        for y in tree.within(x, radius):
            up[top(x)] = top(y)
    return [(x, top(x)) for x in list(up) if top(x) != x]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, tables: int = 1, text: str = "text") -> DataFrame:
    """docs without its text, and fps: a fingerprint for each table, as signed longs."""
    rest = [c for c in docs.columns if c not in (text, "fps")]
    given = docs.select(*rest, F.col(text).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            fps = pa.array([[_signed(x) for x in fingerprints_of(t.as_py(), shingle, tables)] for t in batch.column(at)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), fps], names=[*(n for n in batch.schema.names if n != "_text"), "fps"])

    schema = given.drop("_text").withColumn("fps", F.lit(None).cast("array<long>")).schema
    for f in schema:
        f.nullable = True
    return given.mapInArrow(run, schema)


def links(fps: DataFrame, radius: int = RADIUS, bands: int = BANDS, shard: int = SHARD) -> DataFrame:
    """Stars (t, a, b) that connect just those of the distinct (t, fp) that links connect, table by table."""
    keys = F.array(*(F.struct(F.lit(k).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks(radius, bands))))
    rows = fps.select("t", "fp", F.explode(keys).alias("k")).select("t", "fp", "k.i", "k.key")
    size = checkpoint(rows.groupBy("t", "i", "key").agg(F.count("*").alias("n")).where("n > 1"))
    cut = rows.join(size, ["t", "i", "key"]).withColumn("s", F.ceil(F.col("n") / F.lit(shard)).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    group = ["t", "i", "key", "p", "q"]
    cut = cut.select("t", "i", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "fp")
    cut = cut.repartition(*group).sortWithinPartitions(*group, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, others = None, [], []
        done: list[tuple[int, int, int]] = []

        def finish() -> None:
            if at is not None and (at[3] == at[4] or others):
                done.extend((at[0], x, y) for x, y in _stars(own, others, radius))

        def out() -> pa.RecordBatch:
            t, a, b = ([x[k] for x in done] for k in range(3))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(map(_signed, a), pa.int64()), pa.array(map(_signed, b), pa.int64())], names=["t", "a", "b"])

        for batch in batches:
            for t, i, key, p, q, mine, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (t, i, key, p, q) != at:
                    finish()
                    at, own, others = (t, i, key, p, q), [], []
                    if len(done) > 50_000:
                        yield out()
                (own if mine == p else others).append(fp & ((1 << 64) - 1))
        finish()
        yield out()

    return cut.mapInArrow(run, "t int, a long, b long")


def _edges(flat: DataFrame, radius: int, bands: int, shard: int, equal: bool) -> DataFrame:
    """Edges (a, b) that connect the nodes fp of (fp, t, x) whose fingerprints x link, or if asked are equal, in a table t."""
    first = checkpoint(flat.groupBy("t", "x").agg(F.min("fp").alias("rep")))
    stars = checkpoint(links(first.select("t", F.col("x").alias("fp")), radius, bands, shard))
    of = lambda c: first.select("t", F.col("x").alias(c), F.col("rep").alias(f"rep_{c}"))
    edges = stars.join(of("a"), ["t", "a"]).join(of("b"), ["t", "b"]).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    if not equal:
        return edges
    return edges.unionByName(flat.join(first, ["t", "x"]).where("fp != rep").select(F.col("fp").alias("a"), F.col("rep").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bands: int = BANDS, tables: int = TABLES, shard: int = SHARD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): a row for each row of docs.

    fp: the first table's fingerprint; component_id: the smallest key among the documents that links reach. A null text
    has no words: its fingerprints are 0, linked like any other, as are all texts without words. A row without key takes
    part in links but names no component; component_id is null if no row of the component has a key. Repeated rows stay,
    each with the same result. An empty table gives an empty result; other columns of docs are not read.
    """
    each = checkpoint(fingerprints(docs.select(F.col(key).alias(key), F.col(text).alias(text)), shingle, tables, text))
    # Texts that share the first fingerprint are linked by it, so it stands for all of them.
    distinct = checkpoint(each.groupBy("fps").agg(F.min(key).alias("least")).withColumn("fp", F.col("fps")[0]))
    edges = _edges(distinct.select("fp", F.posexplode("fps").alias("t", "x")), radius, bands, shard, tables > 1)
    found = components(edges)
    named = distinct.groupBy("fp").agg(F.min("least").alias("least")).join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = checkpoint(named)
    least = checkpoint(named.groupBy("component").agg(F.min("least").alias("component_id")))
    of_fp = checkpoint(named.join(least, "component").select("fp", "component_id"))
    return each.select(key, F.col("fps")[0].alias("fp")).join(of_fp, "fp").select(key, "fp", "component_id")


def _min_bands(h: np.ndarray) -> list[int]:
    """A key for each MinHash band; none without shingles."""
    if not len(h):
        return []
    least = np.full(MIN_BANDS * MIN_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(h), 4096):
        np.minimum(least, ((h[k : k + 4096] ^ _MIX[0]) * _MIX[1]).min(axis=1), out=least)
    return [_signed(xxhash.xxh64_intdigest(x.tobytes(), k)) for k, x in enumerate(least.reshape(MIN_BANDS, MIN_ROWS))]


def _signature(unique: np.ndarray) -> list[int]:
    """Three fingerprints of a set, from remixed hashes: 192 bits that tell at a glance how far two sets are apart."""
    return [_fingerprints(_remixed(unique, k), 1)[0] for k in range(1, 4)]


def _mapped(docs: DataFrame, schema: str, begin) -> DataFrame:
    """Columns of docs but its last, a text, and those that make(text's bytes) gives as a tuple, by schema; begin() gives each task its make."""
    given = docs.withColumn(docs.columns[-1], F.col(docs.columns[-1]).cast("binary"))
    more = docs.sparkSession.createDataFrame([], schema).schema
    kinds = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.list_(pa.int64()) for f in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = begin()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = [make(t.as_py()) for t in part.columns[-1]]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array([m[j] for m in made], kind) for j, kind in enumerate(kinds))], names=names)

    names = [*docs.columns[:-1], *more.names]
    whole = given.select(*docs.columns[:-1]).schema
    for f in [*whole]:
        f.nullable = True
    for f in more:
        whole = whole.add(f)
    return given.mapInArrow(run, whole)


def _shingle_set(h: np.ndarray) -> tuple[int, np.ndarray]:
    """A name for the set (64 bits), and the set in order."""
    unique = np.unique(h)
    return _signed(xxhash.xxh3_64_intdigest(unique.tobytes(), SEED)), unique


def _linked(x: np.ndarray, y: np.ndarray, likeness: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= likeness * (len(x) + len(y) - both)


def _alike(ids: list[int], sets: list[np.ndarray], fps: np.ndarray, groups: list[int], split: int, likeness: float) -> list[tuple[int, int]]:
    """Stars of links between the first `split` sets and the others, or within them if there are no others; sets of a group are linked already."""
    n = len(ids)
    sizes = np.array([len(x) for x in sets])
    _, first, number = np.unique(groups, return_index=True, return_inverse=True)
    root = first[number]
    for i in range(split if split < n else 1, n):
        end = split if split < n else i
        small = np.minimum(sizes[:end], sizes[i])
        apart = np.bitwise_count(fps[:end] ^ fps[i]).sum(axis=1, dtype=np.int64)
        ask = np.flatnonzero((small >= likeness * np.maximum(sizes[:end], sizes[i])) & ((apart <= APART) | (small <= SMALL)) & (root[:end] != root[i]))
        ask = ask[np.argsort(apart[ask], kind="stable")]
        while len(ask):
            j, ask = ask[0], ask[1:]
            if _linked(sets[i], sets[j], likeness):
                root[root == root[i]] = root[j]
                ask = ask[root[ask] != root[i]]  # what is connected already needs no comparison
    return [(ids[k], ids[root[k]]) for k in range(n) if root[k] != k]


def _confirmed(cut: DataFrame, likeness: float) -> DataFrame:
    """(a, b): stars of links in each group of (component, p, q), whose rows have own, id, fps, shingles and grp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def finish() -> list[tuple[int, int]]:
            own, others = held
            if at is None or (at[1] != at[2] and not (own and others)):
                return []
            rows = own + others
            return _alike([x[0] for x in rows], [x[2] for x in rows], np.array([x[1][1:] for x in rows], dtype=np.int64).view(np.uint64), [x[3] for x in rows], len(own), likeness)

        def out(done: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            sets = batch.column(batch.schema.get_field_index("shingles"))
            rest = [batch.column(n).to_pylist() for n in ("component", "p", "q", "own", "id", "fps", "grp")]
            for k, (component, p, q, own, i, fps, grp) in enumerate(zip(*rest, strict=True)):
                if (component, p, q) != at:
                    yield out(finish())
                    at, held = (component, p, q), ([], [])
                held[own != p].append((i, fps, sets[k].values.to_numpy(zero_copy_only=False).copy(), grp))
        yield out(finish())

    return cut.mapInArrow(run, "a long, b long")


def _compared(edges: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """Those of edges (a, b) whose sets (id, shingles) are alike: an edge at a time."""
    of = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            value = lambda c, k: c[k].values.to_numpy(zero_copy_only=False)
            yield batch.select([0, 1]).filter(pa.array([_linked(value(x, k), value(y, k), likeness) for k in range(batch.num_rows)], pa.bool_()))

    return edges.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _sharded(rows: DataFrame) -> DataFrame:
    """Rows (component, id, fps, shingles, grp, s) dealt out to pairs of their component's s shards."""
    cut = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("s")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    cut = cut.select("component", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "fps", "shingles", "grp")
    return cut.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q")


def _shards(members: DataFrame) -> DataFrame:
    """(component, s): how many shards the members (component, size, ...) of each component take."""
    return members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / F.lit(TEXTS)), F.ceil(F.sum("size") / F.lit(SHINGLES))).cast("int").alias("s"))


def _groups(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, grp): what links (a, b) connect, of all nodes (id)."""
    found = components(links).withColumnRenamed("node", "id")
    return checkpoint(nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("grp")))


def _large(held: DataFrame, keys: DataFrame, named: DataFrame, edges: DataFrame, likeness: float) -> DataFrame:
    """(a, b): links that connect what is alike among held (id, fps, size, shingles), of components too large for a task.

    keys: (id, band); named: (a, b, n), how many of a's bands name b; edges: (a, b), all candidates.
    """
    nodes = held.select("id")
    mine = lambda df: df.join(nodes.withColumnRenamed("id", "a"), "a", "left_semi")
    most = mine(named).groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("m"), "b")).alias("x")).select("a", "x.b")
    links = checkpoint(_compared(most, held, likeness))
    grp = _groups(links, nodes)
    of = lambda c: grp.select(F.col("id").alias(c), F.col("grp").alias(f"grp_{c}"))
    open_ = checkpoint(mine(edges).join(most, ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b").where("grp_a != grp_b").select("a", "b"))
    links = checkpoint(links.unionByName(_compared(open_, held, likeness)))
    grp = _groups(links, nodes)
    shared = keys.join(grp, "id")
    several = checkpoint(shared.groupBy("band").agg(F.min("id").alias("least"), F.min("grp").alias("x"), F.max("grp").alias("y")).where("x != y").select("band", "least"))
    met = checkpoint(keys.join(nodes, "id", "left_semi").join(several, "band").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct())
    rest = _groups(met, met.select(F.col("a").alias("id")).distinct()).withColumnRenamed("grp", "component")
    rows = held.drop("component", "s").join(rest, "id").join(grp, "id")
    return links.unionByName(_confirmed(_sharded(rows.join(checkpoint(_shards(rows.select("component", "size"))), "component")), likeness))


def _bitmap(nodes: DataFrame, bits: int = 1 << 22) -> np.ndarray:
    """For each remainder by `bits` whether a node has it; the size is fixed, whatever the number of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.zeros(bits, dtype=bool)
        for batch in batches:
            has[batch.column(0).to_numpy() % bits] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(has).tobytes()])], names=["has"])

    has = np.zeros(bits, dtype=bool)
    for r in nodes.coalesce(8).mapInArrow(run, "has binary").collect():
        has |= np.unpackbits(np.frombuffer(r["has"], dtype=np.uint8)).view(bool)
    return has


def near_copies(docs: DataFrame, likeness: float = LIKENESS, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, component): a row for each row of docs; component is the same where links connect two texts.

    Texts link if the Jaccard similarity of their sets of shingles is `likeness` or more, and all texts without words
    do, null ones included. text_hash is Spark's xxhash64 of the text. Null keys and repeated rows
    stay, each with its text's component; an empty table gives an empty result; other columns of docs are not read.
    """

    def sketch() -> Callable:
        def make(t: bytes | None) -> tuple:
            h = _hashes(t, shingle)
            name, unique = _shingle_set(h)
            return name, [_signed(x) for x in (*_fingerprints(h, 1), *_signature(unique))], _min_bands(unique), len(unique)

        return make

    def shingles() -> Callable:
        told: set[int] = set()  # a task gives each set once, however many copies it meets

        def make(t: bytes | None) -> tuple:
            name, unique = _shingle_set(_hashes(t, shingle))
            if not asked[name % len(asked)] or name in told:
                return None, None
            told.add(name)
            return name, unique.view(np.int64)

        return make

    each = checkpoint(_mapped(docs.select(F.col(key).alias(key), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text")), "id long, fps array<long>, bands array<long>, size long", sketch))
    # Texts of one set can repeat its shingles differently; one of their fingerprints speaks for all.
    distinct = checkpoint(each.groupBy("id").agg(F.min(F.struct("fps", "bands", "size")).alias("s")).select("id", "s.*"))
    keys = distinct.select("id", F.explode("bands").alias("band"))
    shared = checkpoint(keys.groupBy("band").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    named = checkpoint(keys.join(shared, "band").where("id != least").groupBy(F.col("id").alias("a"), F.col("least").alias("b")).agg(F.count("*").alias("n")))
    edges = named.select("a", "b").unionByName(_edges(distinct.where("size > 0").select(F.col("id").alias("fp"), F.lit(0).alias("t"), F.col("fps")[0].alias("x")), RADIUS, BANDS, SHARD, True)).distinct()
    edges = checkpoint(edges)
    group = checkpoint(components(edges).join(distinct.select(F.col("id").alias("node"), "fps", "size"), "node").withColumnRenamed("node", "id"))
    cuts = checkpoint(_shards(group))
    asked = _bitmap(group.select("id"))  # texts without candidates need not be dealt out; the join below is exact
    sets = _mapped(docs.select(F.col(text).alias("_text")), "id long, shingles array<long>", shingles).where("id is not null").groupBy("id").agg(F.first("shingles").alias("shingles"))
    held = sets.join(group.join(cuts, "component"), "id")
    if cuts.where("s > 1").isEmpty():
        links = _confirmed(_sharded(held.withColumn("grp", F.col("id"))), likeness)
    else:
        held = checkpoint(held)
        large = held.where("s > 1")
        links = _confirmed(_sharded(held.where("s = 1").withColumn("grp", F.col("id"))), likeness).unionByName(_large(large, keys, named, edges, likeness))
    found = components(checkpoint(links)).withColumnRenamed("node", "id")
    return each.join(checkpoint(found), "id", "left").select(key, "text_hash", F.coalesce("component", "id").alias("component"))
