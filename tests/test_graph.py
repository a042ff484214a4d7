"""Links and blocks on small graphs worked out by hand."""

from __future__ import annotations

import random

from strandline.operators import families, graph


def features(spark, *contigs):
    """Contigs as (genome, 'A B- C'): genes in order, a - on the reverse strand."""
    rows = []
    for n, (genome, genes) in enumerate(contigs):
        for k, x in enumerate(genes.split()):
            rows.append((genome, f"{genome}{n}", k, x.rstrip("-"), "-" if x.endswith("-") else "+", f"{n}_{k}"))
    return spark.createDataFrame(rows, "genome string, contig string, pos int, family string, strand string, locus string")


def links(df):
    return {(r["n1"], r["n2"]): r["weight"] for r in df.collect()}


def test_links_keep_their_direction(spark):
    f = features(spark, ("w", "B A"), ("x", "A B"), ("y", "A C-"), ("z", "A- C"))
    assert links(graph.canonical_links(f)) == {("B", "A"): 1, ("A", "B"): 1, ("A", "C-"): 1, ("A-", "C"): 1}


def test_two_spellings_of_a_link_are_one(spark):
    f = features(spark, ("w", "A B"), ("x", "B- A-"), ("y", "A C-"), ("z", "C A-"), ("v", "A A A D"))
    assert links(graph.canonical_links(f)) == {("A", "B"): 2, ("A", "C-"): 2, ("A", "D"): 1}
    lines = {r["line"] for r in graph.gfa(graph.node_weights(f), graph.canonical_links(f)).collect()}
    assert lines == {"S\tA\tA\tRC:i:5", "S\tB\tA\tRC:i:2", "S\tC\tA\tRC:i:2", "S\tD\tA\tRC:i:1", "L\tA\t+\tB\t+\t0M", "L\tA\t+\tC\t-\t0M", "L\tA\t+\tD\t+\t0M"}
    edges = {(r["src"], r["src_side"], r["dst"], r["dst_side"]): r["weight"] for r in graph.edges(f).collect()}
    assert edges["A", "D", "B", "U"] == edges["B", "U", "A", "D"] == 2 and edges["A", "D", "C", "D"] == 2 and not any(a == b for a, _, b, _ in edges)


def whole(spark, *contigs):
    f = features(spark, *contigs)
    e, n = graph.edges(f), graph.node_weights(f)
    return e, n, graph.checkpointed(graph.block_paths(e, n))


def paths_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["ord"]):
        out.setdefault(r["block"], []).append(r["family"] + ("-" if r["reversed"] else ""))
    return sorted(out.values())


def test_an_insertion_splits_blocks_that_join_again(spark):
    """Three of four genomes have I between C and D: blocks A-C and D-F name each other as the only ones of four genomes."""
    rows = [(g, "A B C I D E F" if g != "w" else "A B C D E F") for g in "wxyz"]
    e, n, p = whole(spark, *rows)
    assert paths_of(p) == [["A", "B", "C"], ["D", "E", "F"], ["I"]]
    assert {r["block"]: r["joined"] for r in graph.joined_blocks(e, n, p).collect()} == {"A": "A", "D": "A", "I": "I"}
    c = graph.checkpointed(graph.connected_paths(e, n, p))
    assert paths_of(c) == [["A", "B", "C", "D", "E", "F"], ["I"]]
    kinds = {r["block"]: r["kind"] for r in graph.classify_blocks(e, p).collect()}
    assert kinds == {"A": "multiconnector", "D": "multiconnector", "I": "insertion"}
    assert {r["block"]: r["kind"] for r in graph.classify_blocks(e, c).collect()}["I"] == "insertion(loop)"
    assert sorted((r["block"], r["ord"], r["family"]) for r in graph.order(c, n).collect()) == [*((1, k + 1, x) for k, x in enumerate("ABCDEF")), (2, 1, "I")]


def test_connected_paths_turn_blocks_round(spark):
    """C and D stand reversed in all genomes, with an insertion of some before them: the joined path goes through them backwards."""
    rows = [(g, "A B I D- C- E" if g != "w" else "A B D- C- E") for g in "wxyz"]
    e, n, p = whole(spark, *rows)
    c = graph.connected_paths(e, n, p)
    assert paths_of(c) == [["A", "B", "D-", "C-", "E"], ["I"]]


def test_loops_and_connectors(spark):
    """A block twice over loops back; one family between many others is a superconnector."""
    e, n, p = whole(spark, ("x", "A B C A B C Z"), ("y", "A B C Z"), *((f"t{k}", f"L{k} T R{k}") for k in range(6)))
    assert [r["block"] for r in graph.reversed_loops(e, p).collect()] == ["A"]
    kinds = {r["block"]: r["kind"] for r in graph.classify_blocks(e, p).collect()}
    assert kinds["T"] == "superconnector" and kinds["A"].startswith("self-loop;")


def walked(links, sizes):
    """laid() of links ((a, side), (b, side)) by walking from node to node."""
    step = {**dict(links), **{y: x for x, y in links}}
    out, seen = {}, set()
    free = sorted(x for x in sizes if not {(x, 0), (x, 1)} <= step.keys())
    for start in [*free, *sorted(sizes)]:
        at, side, before, row = start, 0 if start in free and (start, 0) in step else 1, 0, []
        if start in seen:
            continue
        while at not in seen:
            seen.add(at)
            row.append((at, before, side == 0))
            before += sizes[at]
            if (at, side) not in step:
                break
            at, entered = step[at, side]
            side = 1 - entered
        out |= {x: (min(y[0] for y in row), n, turned) for x, n, turned in row}
    return out


def test_paths_and_rings_of_any_length(spark):
    """Paths and rings of 1 to 60 nodes, turned and named at random; no task may see one, so no plan has a step by group."""
    r = random.Random(8)
    names = [f"x{k:03}" for k in range(400)]
    r.shuffle(names)
    sizes, links, at = {x: r.randint(1, 5) for x in names}, [], 0
    while at < len(names):
        row = names[at : at + r.choice([1, 2, 3, 5, 8, 17, 60])]
        at += len(row)
        side = {x: r.randint(0, 1) for x in row}
        links += [((a, 1 - side[a]), (b, side[b])) for a, b in zip(row, row[1:])]
        if len(row) > 1 and r.random() < 0.5:
            links.append(((row[-1], 1 - side[row[-1]]), (row[0], side[row[0]])))
    ends = spark.createDataFrame([(*x, *y) for x, y in [*links, *((y, x) for x, y in links)]], "a string, a_side int, b string, b_side int")
    got = graph.laid(ends, spark.createDataFrame(list(sizes.items()), "node string, n int"))
    assert {x["node"]: (x["path"], x["before"], x["turned"]) for x in got.collect()} == walked(links, sizes)
    e, n, p = whole(spark, ("w", "A B C"), ("x", "C- B- A-"))
    assert {(x["src"], x["src_side"], x["dst"], x["dst_side"]): x["weight"] for x in e.collect()} == {("A", "D", "B", "U"): 2, ("B", "U", "A", "D"): 2, ("B", "D", "C", "U"): 2, ("C", "U", "B", "D"): 2}
    assert not any("FlatMapGroupsInPandas" in df._jdf.queryExecution().toString() for df in (graph.block_paths(e, n), graph.connected_paths(e, n, p)))


def test_families_without_a_place_stay_in_the_ordered_table(spark):
    table = spark.createDataFrame([("g1", 3), ("g2", 9), ("g3", 5)], "gene_family string, number_genomes int")
    order = spark.createDataFrame([("g1", 2, 1), ("g3", 1, 1)], "family string, block int, ord int")
    assert [(r["gene_family"], r["cluster"]) for r in graph.sort_families(table, order).collect()] == [("g3", 1), ("g1", 2), ("g2", None)]


def test_fragments_that_alleles_separate_are_no_fission(spark):
    """x has two fragments and a copy: one copy and a fission at 50; at 70 the fragments are in alleles of their own."""
    rows = [("x1", 50, "g1", "x"), ("x2", 50, "g1", "x"), ("x3", 50, "g1", "x"), ("y1", 50, "g1", "y"), ("x1", 70, "g1_1", "x"), ("x2", 70, "g1_2", "x"), ("x3", 70, "g1_2", "x"), ("y1", 70, "g1_1", "y")]
    loci = spark.createDataFrame([(a, "g1", t, b, g) for a, t, b, g in rows], "locus string, family string, threshold int, allele string, genome string")
    categories = spark.createDataFrame([("x1", 1), ("x2", 1), ("x3", 0), ("y1", 0)], "locus string, ff_group int")
    got = {r["allele"]: r for r in families.allele_stats(loci, categories).collect()}
    columns = ("number_genomes", "genomes_containing_fissions", "number_fission_loci", "genomes_containing_duplications", "number_duplicated_loci", "no_loci", "n_true_loci")
    assert [got["g1"][c] for c in columns] == [2, 1, 1, 1, 1, 3, 4]
    assert [got["g1_1"][c] for c in columns] == [2, 0, 0, 0, 0, 2, 2]
    assert [got["g1_2"][c] for c in columns] == [1, 0, 0, 1, 1, 2, 2]
