"""Aligned families: over many tasks as in one, and long pairs as in a full matrix."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import alignment


def score(a: str, b: str) -> int:
    """The best global score, by the full matrix."""
    row = [-2 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [-2 * i]
        for j, y in enumerate(b, 1):
            new.append(max(row[j - 1] + (2 if x == y else -1), row[j] - 2, new[-1] - 2))
        row = new
    return row[-1]


def gained(p: str, q: str) -> int:
    return sum(-2 if "-" in (x, y) else 2 if x == y else -1 for x, y in zip(p, q, strict=True))


def mutant(rng: random.Random, seq: str) -> str:
    out = [rng.choice("ACGT") if rng.random() < 0.1 else x for x in seq if rng.random() > 0.05]
    at = rng.randrange(len(out) + 1)
    return "".join(out[:at]) + "".join(rng.choices("ACGT", k=rng.choice((0, 1, 7, 30)))) + "".join(out[at:])


@pytest.mark.parametrize("cells", [1, 64, 1 << 22])
def test_pairs_reach_the_best_score_in_any_number_of_cells(cells):
    rng = random.Random(5)
    pairs = [("", ""), ("", "ACG"), ("A", "C"), ("AAAA", "AA"), ("ACGT", "ACGT"), ("éyx", "éx")]
    pairs += [(s := "".join(rng.choices("ACGT", k=rng.randrange(1, 90))), mutant(rng, s)) for _ in range(40)]
    for a, b in pairs:
        p, q = alignment.pair_gaps(a, b, cells)
        assert (p.replace("-", ""), q.replace("-", "")) == (a, b)
        assert gained(p, q) == score(a, b)


@pytest.fixture
def families(spark):
    """Families of 1 to 60 sequences with repeats, an empty and a null one, one of equal sequences, and rows without a family; columns that clash."""
    rng, rows = random.Random(9), []
    for f, n in enumerate((1, 2, 5, 60)):
        root = "".join(rng.choices("ACGT", k=50))
        some = [mutant(rng, root) for _ in range(n)]
        rows += [(f"f{f}", f"f{f}_{k:02}", f"g{k % 7}", rng.choice(some)) for k in range(n)]
    rows += [("same", f"s{k}", "g1", "ACGT") for k in range(3)] + [("odd", "o1", "g1", ""), ("odd", "o2", "g2", None), ("odd", "o3", "g3", "ACG")]
    rows += [(None, "n1", "g1", "ACGGT"), (None, "n2", None, "ACGT")]
    return rows, spark.createDataFrame(rows, "family string, locus string, genome string, seq string").withColumns({"aln": F.lit(1), "_text": F.lit(2), "_parts": F.lit("x")})


def test_families_over_many_tasks_are_as_in_one(families, monkeypatch):
    rows, df = families
    monkeypatch.setattr(alignment, "ROWS", 4)
    got = {r.locus: r.aln for r in alignment.align_families(df).collect()}
    assert len(got) == len(rows)
    for f in {r[0] for r in rows}:
        want = alignment.center_star({r[1]: r[3] or "" for r in rows if r[0] == f})
        assert {x: got[x] for x in want} == want
    assert alignment.align_families(df.limit(0)).count() == 0


def test_a_kernel_takes_families_whole(families):
    _, df = families
    df = df.where("family like 'f%'")
    key = lambda r: (r.family, r.locus, r.genome, r.aln)
    assert sorted(map(key, alignment.align_families(df, alignment.center_star).collect())) == sorted(map(key, alignment.align_families(df).collect()))


def test_codons_follow_proteins(spark):
    rows = [("f", "a", "g1", "ATGGCTAAATAA", "MAK*"), ("f", "b", "g2", "ATGAAATAA", "MK*"), ("f", "c", "g3", None, None), ("e", "d", "g1", "ATGTAA", "M*")]
    df = spark.createDataFrame(rows, "family string, locus string, genome string, seq string, protein string")
    got = {r.locus: r.aln for r in alignment.back_translate(df).collect()}
    assert got == {"a": "ATGGCTAAATAA", "b": "ATG---AAATAA", "c": "", "d": "ATGTAA"}
    assert {r.locus: r.aln for r in alignment.back_translate(df.where("locus != 'c'"), alignment.center_star).collect()} == {k: v for k, v in got.items() if k != "c"}


def test_gaps_at_the_end_are_not_dealt_out(spark):
    rows = [("f", "l1", "g1", "AC-"), ("f", "l2", "g1", "A-C"), ("f", "l3", "g1", "ACG"), ("f", "l4", None, "---"), ("f", "l5", "g2", "A C"), ("f", "l6", "g2", "A- "), ("e", "l7", "g2", ""), ("f", "l8", "g3", "AC-")]
    df = spark.createDataFrame(rows, "family string, locus string, genome string, aln string")
    slim = {r["locus"]: (r["aln"], r["_width"]) for r in alignment.slim(df).collect()}
    assert slim == {"l1": ("AC", 3), "l2": ("A-C", 3), "l3": ("ACG", 3), "l4": ("", 3), "l5": ("A C", 3), "l6": ("A- ", 3), "l7": ("", 0), "l8": ("AC", 3)}
    assert {r["locus"]: r["aln"] for r in alignment.full(alignment.slim(df)).collect()} == {r[1]: r[3] for r in rows}
    best = {(r["family"], r["genome"]): (r["locus"], r["aln"], r["n"]) for r in alignment.longest_per_genome(df).collect()}
    assert best == {("f", "g1"): ("l3", "ACG", 3), ("f", None): ("l4", "---", 1), ("f", "g2"): ("l5", "A C", 2), ("e", "g2"): ("l7", "", 1), ("f", "g3"): ("l8", "AC-", 1)}
    unique = {(r["family"], r["seq_id"], r["aln"], r["genome"]) for r in alignment.unique_sequences(df.where("genome is not null")).collect()}
    assert unique == {("f", 1, "AC-", "g1"), ("f", 1, "AC-", "g3"), ("f", 2, "A-C", "g1"), ("f", 3, "ACG", "g1"), ("f", 4, "A C", "g2"), ("f", 5, "A- ", "g2"), ("e", 1, "", "g2")}


def test_no_task_numbers_a_family_of_distinct_sequences(spark):
    rng = random.Random(5)
    rows = [(f"f{rng.randint(0, 2)}", f"u{rng.randint(0, 3)}", f"x{k:03d}", f"{rng.randint(0, 40):06b}".replace("0", "-")) for k in range(200)]
    got = alignment.unique_sequences(spark.createDataFrame(rows, "family string, genome string, locus string, aln string"))
    assert "windowspecdefinition(family" not in got._jdf.queryExecution().toString()
    want = set()
    for f in {x[0] for x in rows}:
        own = sorted((x[2], x[1], x[3]) for x in rows if x[0] == f)
        order = list(dict.fromkeys(aln for _, _, aln in own))
        want |= {(f, order.index(aln) + 1, aln, g) for _, g, aln in own}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_overlaps_past_the_first_columns(spark):
    """Columns in several steps, sequences that end before them, and blocks of a family."""
    rng = np.random.default_rng(3)
    rows = [("f", f"l{k:04}", "".join(rng.choice(list("A-"), int(n)))) for k, n in enumerate(rng.integers(0, 20_000, 40))]
    width = max(len(x) for *_, x in rows)
    df = spark.createDataFrame([(f, x, a.ljust(width, "-")) for f, x, a in rows], "family string, locus string, aln string")
    held = {x: {i for i, c in enumerate(a) if c != "-"} for _, x, a in rows}
    got = {(r["a"], r["b"]): r["both"] for r in alignment.column_overlaps(df).collect()}
    assert got == {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b}
