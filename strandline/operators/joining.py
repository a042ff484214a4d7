"""Trees of any number of genomes from their distances: neighbour joining of some, least-squares places for the rest, and the same again on each edge.

A problem is a set of genomes that belong on one edge of the tree so far (the first: all, on none). A small one is
joined whole. In a large one LANDMARKS genomes, drawn by a hash, are joined; every other one gets the edge that its
distances to them fit best, and those of one edge are a problem of the next round, in which a landmark on either side
stands for what lies there. Distances along a tree are given back exactly. Of other distances, a place fits those to the
landmarks only, so a tree of over WHOLE genomes fits the noise in them less closely than joining all of them would.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import Turns, checkpoint, numbered

#: Genomes of a problem that are joined in one task; landmarks of a larger one; other genomes that a task finds places for.
WHOLE, LANDMARKS, PART = 1000, 512, 2000
#: Edges whose fit is worked out again without rounding.
CLOSE = 8
PROBLEM = "problem string, u string, v string, a string, b string, off_a double, off_b double"
EDGE = "kind string, problem string, genome string, x string, y string, length double, a string, b string, off_a double, off_b double"


def joined(m: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges (node, node, length) of the neighbour-joining tree of a matrix of distances; its rows are the first nodes."""
    n = len(m)
    m, ids, edges, size = m.astype(np.float64), list(range(n)), [], n
    while size > 2:
        d = m[:size, :size]
        total = d.sum(axis=1)
        score = (size - 2) * d - total[:, None] - total
        np.fill_diagonal(score, np.inf)
        a, b = sorted(divmod(int(score.argmin()), size))
        to_a = min(max(0.0, d[a, b] / 2 + (total[a] - total[b]) / (2 * (size - 2))), d[a, b])
        new = 2 * n - size
        edges += [(new, ids[a], float(to_a)), (new, ids[b], float(d[a, b] - to_a))]
        far = (d[a] + d[b] - d[a, b]) / 2
        m[a, :size], m[:size, a], m[a, a], ids[a] = far, far, 0.0, new
        size -= 1
        if b != size:  # the last row takes the place of b
            m[b, : size + 1], m[: size + 1, b], ids[b] = m[size, : size + 1], m[: size + 1, size], ids[size]
            m[b, b] = 0.0
    return [*edges, (ids[0], ids[1], float(m[0, 1]))] if n > 1 else []


class Paths:
    """Edges as (upper, lower, length) from leaf 0 down, distances of all nodes along them, and the leaves below each edge."""

    def __init__(self, edges: list[tuple[int, int, float]], leaves: int) -> None:
        near: dict[int, list[tuple[int, float]]] = {}
        for x, y, c in edges:
            near.setdefault(x, []).append((y, c))
            near.setdefault(y, []).append((x, c))
        self.edges, seen, k = [], [0], 0
        self.far = np.zeros((len(edges) + 1, len(edges) + 1))
        place = {0}
        while k < len(seen):
            x = seen[k]
            k += 1
            for y, c in near.get(x, []):
                if y not in place:
                    self.far[y, seen] = self.far[seen, y] = self.far[x, seen] + c
                    place.add(y)
                    seen.append(y)
                    self.edges.append((x, y, c))
        self.below = np.zeros((len(edges), leaves), dtype=bool)
        under = {y: e for e, (_, y, _) in enumerate(self.edges)}
        for e in range(len(edges) - 1, -1, -1):
            x, y, _ = self.edges[e]
            if y < leaves:
                self.below[e, y] = True
            if x in under:
                self.below[under[x]] |= self.below[e]

    def places(self, x: np.ndarray) -> np.ndarray:
        """The edge that fits each row of distances to the leaves best in the least squares, the first of equal ones."""
        upper, lower, length = (np.array(k) for k in zip(*self.edges, strict=True))
        leaves = self.below.shape[1]
        own = np.where(self.below, self.far[lower, :leaves], self.far[upper, :leaves])
        under = self.below.sum(axis=1)

        def fit(low: np.ndarray, high: np.ndarray, squares: np.ndarray, e) -> np.ndarray:
            n, c = under[e], length[e]
            stem = np.maximum(0.0, (low / n + high / (leaves - n) - c) / 2)
            at = np.clip((low / n - high / (leaves - n) + c) / 2, 0.0, c)
            p, q = at + stem, c - at + stem
            return squares - 2 * p * low + n * p * p - 2 * q * high + (leaves - n) * q * q

        mask = self.below.astype(np.float64)
        low = x @ mask.T - (own * mask).sum(axis=1)
        high = x @ (1 - mask).T - (own * (1 - mask)).sum(axis=1)
        rough = fit(low, high, (x * x).sum(axis=1)[:, None] - 2 * x @ own.T + (own * own).sum(axis=1), slice(None))
        best = np.sort(np.argsort(rough, axis=1, kind="stable")[:, :CLOSE], axis=1)
        out = np.zeros(len(x), dtype=np.int64)
        for k, row in enumerate(x):
            e = best[k]
            rest = row - own[e]
            out[k] = e[fit((rest * mask[e]).sum(axis=1), (rest * (1 - mask[e])).sum(axis=1), (rest * rest).sum(axis=1), e).argmin()]
        return out


def solved(part: pd.DataFrame) -> pd.DataFrame:
    """Of one part of a problem: its tree's edges, if it is the first, and the problem of each genome that is no landmark."""
    marks = part[part["mark"]].sort_values("genome")
    names = marks["genome"].tolist()
    at = {g: k for k, g in enumerate(names)}

    def matrix(rows: pd.DataFrame) -> np.ndarray:
        m = np.zeros((len(rows), len(names)))
        for k, (to, far) in enumerate(zip(rows["to"], rows["far"], strict=True)):
            m[k, [at[g] for g in to]] = far
        return m

    m = matrix(marks)
    head = part.iloc[0]
    paths = Paths(joined((m + m.T) / 2), len(names))
    stands = {head["a"]: (head["u"], head["off_a"]), head["b"]: (head["v"], head["off_b"])} if pd.notna(head["a"]) else {}
    node = lambda x: stands[names[x]][0] if x < len(names) and names[x] in stands else f"={names[x]}" if x < len(names) else f"{head["problem"]}/{x}"
    off = lambda x: stands[names[x]][1] if x < len(names) and names[x] in stands else 0.0
    out = []
    if head["part"] == 0:
        for e, (x, y, c) in enumerate(paths.edges):
            ends = []
            for end, side in ((x, ~paths.below[e]), (y, paths.below[e])):
                leaf = int(np.flatnonzero(side)[paths.far[end, : len(names)][side].argmin()])
                ends.append((names[leaf], float(paths.far[end, leaf]) + (off(end) if end < len(names) else 0.0)))
            out.append(("edge", f"{head["problem"]}.{e}", None, node(x), node(y), max(0.0, c - off(x) - off(y)), ends[0][0], ends[1][0], ends[0][1], ends[1][1]))
    others = part[~part["mark"]]
    if len(others):
        for g, e in zip(others["genome"], paths.places(matrix(others)), strict=True):
            out.append(("genome", f"{head["problem"]}.{e}", g, *[None] * 7))
    return pd.DataFrame(out, columns=[c.split()[0] for c in EDGE.split(", ")])


def tree_edges(distance_rows: DataFrame, whole: int = WHOLE, landmarks: int = LANDMARKS) -> DataFrame:
    """(x, y, length) of the tree of (g1, g2, d), in which every pair of genomes stands both ways round; a genome's node is = and its name.

    Genomes at no distance from one with a smaller name, itself at none from a smaller, are joined to it by an edge of no
    length. One genome gives no edge. A task holds at most `whole` genomes and their distances, or `landmarks` and PART.
    """
    far = checkpoint(distance_rows.select("g1", "g2", F.col("d").cast("double").alias("d")).where("g1 != g2"))
    least = far.groupBy("g1").agg(F.least(F.first("g1"), F.min(F.when(F.col("d") <= 0, F.col("g2")))).alias("same"))
    firsts = least.where("g1 = same").select(F.col("g1").alias("same"))
    same = checkpoint(least.join(firsts.withColumn("is_first", F.lit(True)), "same", "left").select(F.col("g1").alias("genome"), F.when(F.col("is_first"), F.col("same")).otherwise(F.col("g1")).alias("same")))

    def known(rows: DataFrame, marks: DataFrame) -> DataFrame:
        wanted = rows.join(marks.withColumnRenamed("genome", "g2"), "problem").where("genome != g2").withColumnRenamed("genome", "g1")
        # A lone genome has no distances, and no edges.
        each = wanted.join(far, ["g1", "g2"]).groupBy("problem", F.col("g1").alias("genome"), "mark").agg(F.collect_list(F.struct("g2", "d")).alias("far"))
        return each.select("problem", "genome", "mark", F.col("far.g2").alias("to"), F.col("far.d").alias("far"))

    return _rounds(same, known, solved, whole, landmarks)


def tree_of(present: DataFrame, whole: int = WHOLE, landmarks: int = LANDMARKS) -> DataFrame:
    """The tree_edges() of tools.distances(present) for present (genome, threshold, allele), without the table of all pairs.

    Genomes with equal alleles are those at no distance. Each task counts what its genomes and landmarks differ by.
    """
    rows = present.select("genome", F.concat_ws("|", F.col("threshold").cast("string"), "allele").alias("a")).distinct()
    ids = numbered(rows.select("a").distinct(), "n", F.col("a"))
    sets = checkpoint(rows.join(ids, "a").groupBy("genome").agg(F.array_sort(F.collect_list("n")).alias("ids")))
    least = sets.groupBy("ids").agg(F.min("genome").alias("same"))
    same = checkpoint(sets.join(least, "ids").select("genome", "same"))

    def known(rows: DataFrame, marks: DataFrame) -> DataFrame:
        alone = marks.groupBy("problem").count().where("count > 1").select("problem")
        return rows.join(alone, "problem", "left_semi").join(sets, "genome").select("problem", "genome", "mark", "ids")

    return _rounds(same, known, _solved_sets, whole, landmarks)


def _solved_sets(part: pd.DataFrame) -> pd.DataFrame:
    """solved() of sets of alleles (ids): the distance of two is how many alleles just one of them has."""
    marks = part[part["mark"]]
    names = marks["genome"].to_numpy()
    sizes = marks["ids"].str.len().to_numpy()
    # The landmarks' alleles in order, and which landmark each is of.
    held = np.concatenate(marks["ids"].to_list())
    whose = np.repeat(np.arange(len(names)), sizes)
    order = np.argsort(held, kind="stable")
    held, whose = held[order], whose[order]
    to, far = [], []
    for g, ids in zip(part["genome"], part["ids"], strict=True):
        a, b = np.searchsorted(held, ids, "left"), np.searchsorted(held, ids, "right")
        n = b - a
        at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        d = len(ids) + sizes - 2 * np.bincount(whose[at], minlength=len(names))
        others = names != g
        to.append(names[others])
        far.append(d[others].astype(float))
    return solved(part.drop(columns="ids").assign(to=to, far=far))


def _rounds(same: DataFrame, known: Callable, solve: Callable, whole: int, landmarks: int) -> DataFrame:
    """The edges of genomes (genome, same), with same the one at no distance that stands for it; known(rows, marks) gives what solve() takes of each."""
    spark = same.sparkSession
    twins = same.where("genome != same").select(F.concat(F.lit("="), "same").alias("x"), F.concat(F.lit("="), "genome").alias("y"), F.lit(0.0).alias("length"))
    members = same.where("genome = same").select(F.lit("t").alias("problem"), "genome")
    problems = spark.createDataFrame([("t", *[None] * 6)], PROBLEM)
    turns, done = Turns(spark, 1 << 30), [twins]
    while not members.isEmpty():
        sizes = members.groupBy("problem").agg(F.count("*").alias("n"))
        drawn = members.withColumn("_r", F.row_number().over(Window.partitionBy("problem").orderBy(F.xxhash64("genome"), "genome")))
        limit = F.when(F.col("n") <= whole, F.lit(whole)).otherwise(F.lit(landmarks))
        drawn = drawn.where(F.col("_r") <= whole).join(sizes, "problem").where(F.col("_r") <= limit).select("problem", "genome")
        ends = problems.where("a is not null").select("problem", F.explode(F.array("a", "b")).alias("genome"))
        marks = turns.put(drawn.unionByName(ends))
        others = members.join(marks, ["problem", "genome"], "left_anti").withColumn("mark", F.lit(False))
        rows = others.unionByName(marks.withColumn("mark", F.lit(True)))
        last = F.floor((F.greatest(F.col("n"), F.lit(1)) - 1) / F.lit(PART)).cast("int")
        parts = known(rows, marks).join(sizes.withColumn("last", last).drop("n"), "problem")
        parts = parts.withColumn("part", F.explode(F.when(F.col("mark"), F.sequence(F.lit(0), F.col("last"))).otherwise(F.array(F.pmod(F.xxhash64("genome", F.lit("part")), F.col("last") + 1).cast("int")))))
        made = turns.put(parts.drop("last").join(problems, "problem").groupBy("problem", "part").applyInPandas(solve, EDGE))
        edges, members = made.where("kind = 'edge'"), made.where("kind = 'genome'").select("problem", "genome")
        full = members.select("problem").distinct()
        done.append(edges.join(full, "problem", "left_anti").select("x", "y", "length"))
        problems = turns.put(edges.join(full, "problem", "left_semi").select("problem", F.col("x").alias("u"), F.col("y").alias("v"), "a", "b", "off_a", "off_b"))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def newick(edges: DataFrame, genomes: DataFrame) -> DataFrame:
    """(newick), one row: the text of a tree_edges() of the column genome of `genomes`. A text is one cell, so its edges meet in one task, which takes linear time."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[tuple[str, float]]] = {}
        for x, y, c in zip(part["x"], part["y"], part["length"], strict=True):
            if pd.isna(y):
                near.setdefault(x, [])
                continue
            near.setdefault(x, []).append((y, c))
            near.setdefault(y, []).append((x, c))
        inner = sorted(x for x in near if x[0] != "=")
        root = inner[-1] if inner else min(near)
        text: dict[str, str] = {}
        stack = [(root, "", False)]
        below: dict[str, list[str]] = {x: [] for x in near}
        while stack:
            x, above, ready = stack.pop()
            if not ready:
                stack.append((x, above, True))
                stack += [(y, x, False) for y, _ in sorted(near[x], reverse=True) if y != above]
                continue
            kids = below.pop(x)
            name = x[1:] if x[0] == "=" else ""
            if name and any(c in name for c in " '(),:;[]\t\n"):
                name = "'" + name.replace("'", "''") + "'"
            # A genome with others on it is a leaf beside them.
            inside = [*([f"{name}:0"] if name and kids else []), *kids]
            text[x] = f"({','.join(inside)})" if inside else name
            if above:
                length = next(c for y, c in near[x] if y == above)
                below[above].append(f"{text.pop(x)}:{length:.6g}")
        return pd.DataFrame({"newick": [text[root] + ";"]})

    alone = genomes.select(F.concat(F.lit("="), "genome").alias("x"), F.lit(None).cast("string").alias("y"), F.lit(0.0).alias("length")).distinct()
    return edges.unionByName(alone).groupBy().applyInPandas(run, "newick string")
