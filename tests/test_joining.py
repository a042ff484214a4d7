"""Trees of many genomes: distances along a random tree are given back, whatever is joined in one task."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strandline.operators import joining, tools, trees


def random_tree(n, shape, seed):
    """Distances between the leaves of a tree with edges from 0.001 to 10."""
    r = random.Random(seed)
    far, groups = np.zeros((n, n)), [[k] for k in range(n)]
    while len(groups) > 1:
        a, b = r.sample(range(len(groups)), 2) if shape == "bushy" else (0, 1)
        for g in (groups[a], groups[b]):
            rest = [k for k in range(n) if k not in set(g)]
            far[np.ix_(g, rest)] += (c := r.choice([0.001, 0.1, 1, 10]) * (0.5 + r.random()))
            far[np.ix_(rest, g)] += c
        both = groups[a] + groups[b]
        groups = [both, *(g for k, g in enumerate(groups) if k not in (a, b))]
    return far


def along(edges, names):
    """The distances between genomes along edges (x, y, length), and that they are one tree."""
    near = {}
    for x, y, c in edges:
        near.setdefault(x, []).append((y, c))
        near.setdefault(y, []).append((x, c))
    assert len(edges) == len(near) - 1 and all(c >= 0 for _, _, c in edges)
    out = np.full((len(names), len(names)), np.nan)
    at = {f"={g}": k for k, g in enumerate(names)}
    for g, k in at.items():
        stack = [(g, "", 0.0)]
        while stack:
            x, above, d = stack.pop()
            if x in at:
                out[k, at[x]] = d
            stack += [(y, x, d + c) for y, c in near[x] if y != above]
    return out


def table(spark, far, names):
    return spark.createDataFrame([(a, b, float(far[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "g1 string, g2 string, d double")


@pytest.mark.parametrize("shape", ["bushy", "comb"])
def test_matrix_of_a_tree(shape):
    far = random_tree(60, shape, 3)
    names = [str(k) for k in range(60)]
    edges = [(f"={x}" if x < 60 else str(x), f"={y}" if y < 60 else str(y), c) for x, y, c in joining.joined(far)]
    assert np.allclose(along(edges, names), far, atol=1e-9)
    assert joining.joined(np.zeros((1, 1))) == [] and joining.joined(np.array([[0, 3.0], [3.0, 0]])) == [(0, 1, 3.0)]


@pytest.mark.parametrize(("shape", "whole", "landmarks"), [("bushy", 20, 8), ("comb", 20, 8), ("bushy", 1000, 256)])
def test_distances_are_given_back(spark, shape, whole, landmarks, monkeypatch):
    """300 genomes in several rounds and parts, or whole; some are the same as others."""
    monkeypatch.setattr(joining, "PART", 40)
    far = random_tree(300, shape, 5)
    for k in range(0, 30, 3):  # three of a kind
        for twin in (k + 1, k + 2):
            far[twin], far[:, twin] = far[k], far[:, k]
            far[twin, k : k + 3] = far[k : k + 3, twin] = 0
    names = [f"x{k:03}" for k in range(300)]
    edges = [tuple(r) for r in joining.tree_edges(table(spark, far, names), whole, landmarks).collect()]
    assert np.allclose(along(edges, names), far, atol=1e-6)


def test_text(spark):
    """The text's tree has the same distances; names are quoted; a genome with equals is a leaf."""
    far = random_tree(12, "bushy", 8)
    far[1], far[:, 1] = far[0], far[:, 0]
    far[0, 1] = far[1, 0] = far[1, 1] = far[0, 0] = 0
    names = ["it's (a)", *(f"x{k}" for k in range(11))]
    rows = table(spark, far, names)
    text = joining.newick(joining.tree_edges(rows, 6, 4), rows.selectExpr("g1 genome")).first()[0]
    got = trees.nodes(spark.createDataFrame([("t", text)], "tree string, text string")).collect()
    assert sorted(r["name"] for r in got if r["leaf"]) == sorted(names)
    edges = [(f"={r['name']}" if r["leaf"] else str(r["node"]), str(r["parent"]), r["length"]) for r in got if r["parent"] is not None]
    assert np.allclose(along(edges, names), far, atol=1e-3)


def test_few(spark):
    one = spark.createDataFrame([("a", "a", 0.0)], "g1 string, g2 string, d double")
    assert joining.tree_edges(one).collect() == [] and joining.newick(joining.tree_edges(one), one.selectExpr("g1 genome")).first()[0] == "a;"
    none = one.where("false")
    assert joining.tree_edges(none).collect() == [] and joining.newick(joining.tree_edges(none), none.selectExpr("g1 genome")).collect() == []
    two = table(spark, np.array([[0, 2.0], [2.0, 0]]), ["a", "b"])
    assert [r["length"] for r in joining.tree_edges(two).collect()] == [2.0]
    same = table(spark, np.zeros((4, 4)), list("abcd"))
    assert sorted((r["x"], r["y"]) for r in joining.tree_edges(same).collect()) == [("=a", "=b"), ("=a", "=c"), ("=a", "=d")]
    assert joining.newick(joining.tree_edges(same), same.selectExpr("g1 genome")).first()[0].count(",") == 3


def test_noise(spark):
    """A tree's distances with an error of a tenth, whole and with few landmarks; and distances of random sets, which no tree has: still one tree of all."""
    far = random_tree(150, "bushy", 12)
    error = np.triu(np.random.default_rng(12).normal(1, 0.1, far.shape), 1)
    names = [f"x{k:03}" for k in range(150)]
    for whole, landmarks, least in ((1000, 256, 0.99), (60, 40, 0.98), (20, 8, 0.9)):
        got = along([tuple(e) for e in joining.tree_edges(table(spark, far * (error + error.T), names), whole, landmarks).collect()], names)
        assert np.corrcoef(got.ravel(), far.ravel())[0, 1] > least
    x = np.random.default_rng(4).random((150, 40)) < 0.3
    sets = (x[:, None] ^ x[None]).sum(axis=2)
    got = along([tuple(e) for e in joining.tree_edges(table(spark, sets, names), 20, 8).collect()], names)
    assert not np.isnan(got).any()


def test_trees_of_sets_without_all_pairs(spark, monkeypatch):
    """As from the distances of all pairs, over several rounds, with equal genomes; that table is not asked for."""
    rng = random.Random(8)
    sets = {f"g{k:02}": {rng.randrange(40) for _ in range(15)} for k in range(60)}
    sets |= {"g90": sets["g07"], "g91": sets["g07"]}
    df = spark.createDataFrame([(g, 50 + a % 2, f"a{a // 2}") for g, x in sets.items() for a in x], "genome string, threshold int, allele string")
    pairs = spark.createDataFrame([(g, h, len(sets[g] ^ sets[h])) for g in sets for h in sets], "g1 string, g2 string, d long")
    monkeypatch.setattr(joining, "PART", 20)
    want = {tuple(r) for r in joining.tree_edges(pairs, 30, 12).collect()}
    monkeypatch.setattr(tools, "distances", None)
    assert {tuple(r) for r in joining.tree_of(df, 30, 12).collect()} == want
    one = df.where("genome = 'g01'")
    assert joining.tree_of(one).count() == 0
    assert joining.newick(joining.tree_of(one), one).first()[0] == "g01;"
