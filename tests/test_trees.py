"""Tables of trees against a plain reader, and roots in the middle against all paths."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from strandline.operators import trees


def drawn(rng: random.Random, n: int, kind: str):
    """A tree as (name, length, children) of n leaves: bushy, a comb, or a star."""
    count = iter(range(10**6))
    leaf = lambda: (f"x{next(count)}", rng.choice((None, rng.randrange(9))), [])
    join = lambda kids: (rng.choice((None, f"i{next(count)}")), rng.randrange(9), kids)
    if kind == "star":
        return join([leaf() for _ in range(n)])
    rows = [leaf() for _ in range(n)]
    while len(rows) > 1:
        k = min(len(rows), 2 if kind == "comb" else rng.choice((2, 2, 3)))
        picked = [rows.pop(0 if kind == "comb" else rng.randrange(len(rows))) for _ in range(k)]
        rng.shuffle(picked)
        rows.insert(0, join(picked))
    return rows[0]


def written(tree, rng: random.Random) -> str:
    name, length, kids = tree
    text = "(" + rng.choice((",", " ,\n ")).join(written(k, rng) for k in kids) + ")" if kids else ""
    label = "" if name is None else rng.choice((name, f"'{name}'", f" {name} [a (remark]"))
    return text + label + ("" if length is None else f":{rng.choice(('', '-'))}{length}")


def plain(tree, above=None, out=None):
    """Names of leaves under each node, its own name, and its length."""
    out = [] if out is None else out
    name, length, kids = tree
    under = frozenset([name]) if not kids else frozenset().union(*(plain(k, tree, out)[0] for k in kids))
    out.append((under, name, length, bool(kids)))
    return under, out


def below(rows):
    kids = defaultdict(list)
    for r in rows:
        kids[r["parent"]].append(r)

    def walk(r):
        return frozenset([r["name"]]) if r["leaf"] else frozenset().union(*(walk(k) for k in kids[r["node"]]))

    return {r["node"]: walk(r) for r in rows}


def ways(rows):
    """The length of the way between all leaves, and from the root to each."""
    at = {r["node"]: r for r in rows}

    def up(r):
        out, d = {}, 0.0
        while r is not None:
            out[r["node"]] = d
            d += r["length"] or 0.0 if r["parent"] is not None else 0.0
            r = at.get(r["parent"])
        return out

    paths = {r["name"]: up(r) for r in rows if r["leaf"]}
    between = {(a, b): min(p[n] + q[n] for n in p if n in q) for a, p in paths.items() for b, q in paths.items() if a < b}
    return between, {a: max(p.values()) for a, p in paths.items()}


@pytest.mark.parametrize("stretch", [3, 1 << 16])
def test_nodes_and_middles(spark, monkeypatch, stretch):
    from strandline.sources import tables

    monkeypatch.setattr(trees, "STRETCH", stretch)
    monkeypatch.setattr(tables, "STRETCH", stretch)
    rng = random.Random(3)
    all_ = {k: drawn(rng, rng.randrange(1, 14) if k < 36 else 40, ("bushy", "comb", "star")[k % 3]) for k in range(39)}
    df = spark.createDataFrame([(k, written(t, rng) + rng.choice(("", ";"))) for k, t in all_.items()], "tree long, text string")
    found = trees.nodes(df).cache()
    rooted = trees.midpoint_rooted(found)
    got, turned = defaultdict(list), defaultdict(list)
    for r in found.collect():
        got[r["tree"]].append(r)
    for r in rooted.collect():
        turned[r["tree"]].append(r)
    for k, t in all_.items():
        under = below(got[k])
        key = lambda x: tuple(map(str, (sorted(x[0]), *x[1:])))
        assert sorted(((under[r["node"]], r["name"], r["length"], not r["leaf"]) for r in got[k]), key=key) == sorted(((a, b, None if c is None else float(c), d) for a, b, c, d in plain(t)[1]), key=key)
        was, now = ways(got[k])[0], ways(turned[k])
        assert now[0] == was
        assert len([r for r in turned[k] if r["parent"] is None]) == 1 and len({r["node"] for r in turned[k]}) == len(turned[k])
        if was:
            assert max(now[1].values()) == max(was.values()) / 2
        inner = {r["parent"] for r in turned[k]}
        assert all(r["leaf"] or r["node"] in inner for r in turned[k])


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " ;"), (4, "only:2;"), (5, "('it''s (a;b)':1e1,,[x]b:zz)'r,'"), (6, "((a:1)x:2,b:3);")], "tree long, text string")
    got = sorted((r["tree"], r["name"] or "", r["length"] or 0.0, r["leaf"]) for r in trees.nodes(df).collect())
    assert got == [(4, "only", 2.0, True), (5, "", 0.0, True), (5, "b", 0.0, True), (5, "it's (a;b)", 10.0, True), (5, "r,", 0.0, False), (6, "", 0.0, False), (6, "a", 1.0, True), (6, "b", 3.0, True), (6, "x", 2.0, False)]
    assert trees.midpoint_rooted(trees.nodes(df.where("tree = 4"))).count() == 1
    assert trees.nodes(df.limit(0)).count() == 0 and trees.midpoint_rooted(trees.nodes(df.limit(0))).count() == 0
    for bad in ("(a,b;", "a)(b;"):
        with pytest.raises(Exception, match="brackets"):
            trees.nodes(spark.createDataFrame([(1, bad)], "tree long, text string")).count()
