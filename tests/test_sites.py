"""Aligned paralogs against a plain version with sets of columns, and what a task holds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import paralogs, sites


def plain(rows, places, overlap=0.9, most=0.75):
    """{locus: (mc, ff, ff_group, length_cluster)} of rows (family, locus, genome, aln), as the rules say it."""
    out = {}
    for family in {r[0] for r in rows}:
        own = {x: (g, {k for k, c in enumerate(aln or "") if c != "-"}) for f, x, g, aln in rows if f == family}
        order = sorted(own, key=lambda x: (len(own[x][1]), x))
        cluster = {}
        for x in order:
            if x not in cluster:
                n = max(cluster.values(), default=0) + 1
                cluster |= {y: n for y in order if y not in cluster and (len(own[x][1] & own[y][1]) >= overlap * max(len(own[x][1]), len(own[y][1])))}
        flush = len({len(s) for _, s in own.values()}) == 1 or max(cluster.values()) == 1
        for genome in {g for g, _ in own.values()}:
            genes = sorted(x for x in own if own[x][0] == genome)
            if flush:
                out |= {x: (1, 0, k + 1 if len(genes) > 1 else 0, 1) for k, x in enumerate(genes)}
                continue
            at = {x: places.get(x, 0) for x in genes}
            left = sorted(genes, key=lambda x: (min((abs(at[x] - at[y]) for y in genes if y != x), default=0), at[x], x))
            group, got = 0, {}
            while left:
                group += 1
                first = left.pop(0)
                got[first] = group
                while left:
                    a, b = own[first][1], own[left[0]][1]
                    both = len(a & b)
                    if cluster[first] == cluster[left[0]]:
                        group += 1
                    elif len(b) - both <= both or both > most * len(a) or both > most * len(b):
                        break
                    got[left.pop(0)] = group
            n = list(got.values())
            out |= {x: (int(len(set(n)) > 1), int(n.count(g) > 1), g, cluster[x]) for x, g in got.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_as_the_plain_version(spark, seed):
    """Whole genes, halves, thirds and ragged ends, ties of places, null and empty sequences, a null family and genome."""
    r = random.Random(seed)
    rows, places = [], {}
    for f in [*(f"g{k}" for k in range(12)), None]:
        width = r.choice([0, 7, 40, 90])
        for k in range(r.choice([1, 5, 60])):
            a, b = sorted(r.choice([0, width // 3, width // 2, 2 * width // 3, width]) for _ in range(2))
            aln = "-" * a + "".join(r.choice("ACGT" if r.random() < 0.95 else "-") for _ in range(b - a)) + "-" * (width - b)
            rows.append((f, f"{f}_{k:02}", r.choice(["x", "y", "z", None]), r.choice([aln, aln, aln, aln, None, ""]) if k % 9 == 0 else aln))
            if k % 7:
                places[f"{f}_{k:02}"] = r.randrange(40)
    aligned = spark.createDataFrame(rows, "family string, locus string, genome string, aln string").repartition(5)
    at = spark.createDataFrame(list(places.items()), "locus string, pos long")
    got = [(x.locus, (x.mc, x.ff, x.ff_group, x.length_cluster)) for x in paralogs.classify_aligned(aligned, at).collect()]
    want = plain(rows, places)
    assert len(got) == len(want) and dict(got) == want
    kinds = {v[:2] for v in want.values()}
    assert {(0, 0), (0, 1), (1, 0), (1, 1)} <= kinds


def test_empty(spark):
    none = spark.createDataFrame([], "family string, locus string, genome string, aln string")
    assert paralogs.classify_aligned(none, spark.createDataFrame([], "locus string, pos long")).collect() == []


def test_five_thousand_forms_of_a_family(spark):
    """Bits, not letters, are dealt out: an eighth of the alignment; nested lengths give the clusters that a ratio of 0.9 does."""
    width = 5000
    rows = spark.range(1, width + 1).selectExpr("'f' family", "concat('l', id) locus", "'x' genome", f"rpad(repeat('A', cast(id as int)), {width}, '-') aln").repartition(6)
    s = rows.select("family", "locus", sites.packed(F.col("aln")).alias("s")).select("family", "locus", "s.bits", "s.n")
    got = {x.n: x.length_cluster for x in sites.length_clusters(s).select("n", "length_cluster").collect()}
    want, opener, number = {}, 0, 0
    for n in range(1, width + 1):
        if not opener or opener < 0.9 * n:
            opener, number = n, number + 1
        want[n] = number
    assert got == want
