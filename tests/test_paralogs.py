"""Paralog and split rules on cases worked out by hand, and their search against plain enumeration."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from strandline.operators import paralogs


def family(loci):
    """(locus, genome) -> rows in which each locus stands for itself."""
    return pd.DataFrame([(x, g, x) for x, g in loci], columns=["locus", "genome", "rep"])


def both(hits):
    """(a, b): (start, end, cover of a, cover of b on a), where the second direction covers b from 1 on."""
    out = {}
    for (a, b), (start, end, there, back) in hits.items():
        out[a, b] = (start, end, there)
        out[b, a] = (1, 1, back)
    return out


@pytest.mark.parametrize("covers, fragments", [((8, 11), True), ((8, 9), True), ((10, 11), False)])
def test_the_smaller_coverage_tells_whether_two_overlap(covers, fragments):
    rows = family([("x_1", "x"), ("y_1", "y"), ("y_2", "y")])
    hits = both({("y_1", "x_1"): (1, 260, 100, 52), ("y_2", "x_1"): (241, 500, 100, 52), ("y_1", "y_2"): (1, 20, *covers)})
    got = {x: v for x, *v in paralogs.classify_family(rows, hits, {"x_1": 500, "y_1": 260, "y_2": 260})}
    assert got["x_1"] == [1, 0, 0]
    assert got["y_1"] == got["y_2"] == ([0, 1, 1] if fragments else [1, 0, 0])


def test_neighbours_by_number_are_parts_of_one_gene():
    """Two first and two second halves: the parts whose loci stand next to each other go together."""
    rows = family([("x_00001", "x"), *((f"y_{n}", "y") for n in ("00001", "00010", "00011", "00002"))])
    first, second = ("y_00001", "y_00011"), ("y_00010", "y_00002")
    hits = {(a, "x_00001"): (1, 250, 100, 50) for a in first} | {(a, "x_00001"): (251, 500, 100, 50) for a in second}
    hits |= {first: (1, 250, 100, 100), second: (1, 250, 100, 100)}
    got = {x: v for x, *v in paralogs.classify_family(rows, both(hits), dict.fromkeys(rows["locus"], 250) | {"x_00001": 500})}
    assert [got[x][:2] for x in (*first, *second)] == [[0, 1]] * 4
    assert got["y_00001"][2] == got["y_00002"][2] != got["y_00010"][2] == got["y_00011"][2]


def test_a_part_alone_is_a_copy():
    rows = family([("x_1", "x"), ("y_1", "y")])
    got = paralogs.classify_family(rows, both({("y_1", "x_1"): (1, 100, 100, 20)}), {"x_1": 500, "y_1": 100})
    assert [v for _, *v in got] == [[1, 0, 0], [1, 0, 0]]


def test_combinations_are_those_of_plain_enumeration():
    for seed in range(40):
        r = random.Random(seed)
        size, n, most = 300, r.randint(2, 9), r.choice((2, 3, 4))
        start = np.array([r.randint(1, 250) for _ in range(n)])
        end = np.array([min(size, s + r.randint(-5, 200)) for s in start])
        length = np.array([r.randint(20, 250) for _ in range(n)])
        number = np.array([r.randint(1, 12) for _ in range(n)])
        want = {}
        for m in range(2, most + 1):
            for combo in combinations(range(n), m):
                taken, total = set(), 0.0
                for k, x in enumerate(combo):
                    new = set(range(start[x], end[x] + 1)) - taken
                    taken |= new
                    total -= abs(len(new) - length[x])
                    total += 0.2 * size if k and abs(number[x] - number[combo[k - 1]]) <= 2 else 0
                if total >= -0.25 * size:
                    want[combo] = total - (size - len(taken))
        got = {c: s for s, c in paralogs._combinations(start, end, length, number, size, most)}
        assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


def alleles(spec):
    """{allele: {genome: loci}} at threshold 70 under one family at 50; every locus a copy of its own."""
    rows = []
    for allele, by_genome in spec.items():
        for g, n in by_genome.items():
            for k in range(n):
                x = f"{allele}{g}{k}"
                rows += [(x, 50, "f", g, x), (x, 70, allele, g, x)]
    return pd.DataFrame(rows, columns=["locus", "threshold", "allele", "genome", "copy"])


def groups(rows, **more):
    out = {}
    for x, g in paralogs.split_family(rows, **more).items():
        out.setdefault(x[0], set()).add(g)
    return out


def test_split_begins_again_at_the_top_with_any_number_of_copies():
    """An allele of all eight genomes with ten copies goes before one of six genomes."""
    eight = {g: 2 if g in "ab" else 1 for g in "abcdefgh"}
    assert groups(alleles({"A": eight, "B": dict.fromkeys("abcdef", 1)})) == {"A": {1}, "B": {2}}


def test_split_takes_all_alleles_of_the_best_score():
    assert groups(alleles({"A": dict.fromkeys("abcd", 1), "B": dict.fromkeys("abcd", 1)})) == {"A": {1}, "B": {2}}


def test_split_begins_anew_when_genomes_are_gone():
    """After the allele of all six genomes five are left, of which four are over the cut-off; after those two, of which both are."""
    spec = {"A": dict.fromkeys("abcdef", 1), "B": dict.fromkeys("abcd", 1), "C": {"a": 1, "e": 2}}
    assert groups(alleles(spec)) == {"A": {1}, "B": {2}, "C": {3}}
    spec = {"A": dict.fromkeys("abcdef", 1), "B": dict.fromkeys("abc", 1), "C": {"a": 1, "d": 2}}
    assert groups(alleles(spec)) == {"A": {1}, "B": {2}, "C": {2}}  # three of four are not over the cut-off


def test_split_leaves_what_has_no_paralogs_or_one_genome():
    assert groups(alleles({"A": dict.fromkeys("abc", 1)})) == {"A": {1}}
    assert groups(alleles({"A": {"a": 2}, "B": {"a": 1}})) == {"A": {1}, "B": {1}}


def test_split_names_keep_the_allele_number(spark):
    rows = alleles({"A": dict.fromkeys("abcd", 1), "B": dict.fromkeys("abcd", 1)}).replace({"f": "g00001", "A": "g00001_0003", "B": "g00001_0007"}).assign(family="g00001")
    loci = spark.createDataFrame(rows[["locus", "family", "threshold", "allele", "genome"]])
    got = {(r["threshold"], r["locus"][0]): (r["family"], r["allele"]) for r in paralogs.split(loci).collect()}
    assert got == {(50, "A"): ("g00001_1", "g00001_1"), (70, "A"): ("g00001_1", "g00001_1_0003"), (50, "B"): ("g00001_2", "g00001_2"), (70, "B"): ("g00001_2", "g00001_2_0007")}
    assert [r["line"] for r in paralogs.split_log(paralogs.split(loci)).collect()] == ["g00001\tg00001_1(4/4/4)\tg00001_2(4/4/4)"]


@pytest.mark.parametrize("strict", [False, True])
def test_split_of_families_that_no_task_holds(spark, strict):
    """By rounds over all tasks or in one task: the same rows. Alleles are nested or not, loci are fragments or not."""
    loci, fragments, parts = [], [], 0
    for f in range(14):
        r = random.Random(100 * f + strict)
        for n in range(r.randint(1, 60)):
            x, g, k = f"x{f}_{n}", f"u{r.randint(0, r.choice((0, 5, 5)))}", r.randint(0, 6)
            names = (f"f{f}", f"f{f}_{k:04d}", f"f{f}_{10 * (k if f % 3 else r.randint(0, 6)) + r.randint(0, 3):04d}")
            loci += [(x, f"f{f}", t, a, g) for t, a in zip((50, 70, 90), names, strict=True)]
            fragments += [(x, r.randint(1, 2))] if r.random() < 0.3 else []
        # Two alleles of all genomes, as copies of the family.
        loci += [(f"x{f}_{a}{g}", f"f{f}", t, n, f"u{g}") for a in "ab" for g in range(6) for t, n in ((50, f"f{f}"), (70, f"f{f}_{a}"), (90, f"f{f}_{a}_{7 + g // 3:04d}"))] if f % 2 else []
    loci = spark.createDataFrame(loci, "locus string, family string, threshold int, allele string, genome string")
    categories = spark.createDataFrame(fragments, "locus string, ff_group int")
    rows = lambda most: sorted(tuple(r) for r in paralogs.split(loci, categories, 0.75, strict, most).collect())
    want = rows(10**9)
    assert len({x[1] for x in want}) > 20
    assert rows(60) == want


def test_demands_end_at_any_cut_off():
    """Under a cut-off that whole numbers never reach, the search ends after any number of copies was allowed."""
    assert groups(alleles({"A": {"a": 2}, "B": {"b": 2}}), cut_off=0.1) == {"A": {1}, "B": {1}}


def test_aligned_fragments_and_copies(spark):
    """Two halves are one gene, a third sequence of the whole length ends the search, copies of one length are copies."""
    whole, left, right = "ACGTACGTACGTACGTACGT", "ACGTACGTAC----------", "----------GTACGTACGT"
    rows = [("f", "x1", "x", whole), ("f", "y1", "y", left), ("f", "y2", "y", right), ("f", "z1", "z", whole), ("f", "z2", "z", whole), ("g", "x3", "x", whole), ("g", "x4", "x", whole), ("g", "y3", "y", whole)]
    aligned = spark.createDataFrame(rows, "family string, locus string, genome string, aln string")
    places = spark.createDataFrame([(x, 100 * k) for k, (_, x, *_) in enumerate(rows)], "locus string, pos long")
    got = {r["locus"]: (r["mc"], r["ff"], r["ff_group"]) for r in paralogs.classify_aligned(aligned, places).collect()}
    assert got["x1"] == (0, 0, 1) and got["y1"] == got["y2"] == (0, 1, 1)
    assert got["z1"] == (1, 0, 1) and got["z2"] == (1, 0, 2)
    assert got["x3"] == (1, 0, 1) and got["x4"] == (1, 0, 2) and got["y3"] == (1, 0, 0)
