from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import sequences as seq
from strandline.functions.names import cell_copies, cell_text, genome_name, padded
from strandline.operators import trees, alignment, clustering, graph, pairwise, tools
from strandline.sources import gff, sinks, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sequence_functions(spark):
    assert one(spark, seq.clean(F.lit("ac gt\nRYn-"))) == "ACGTNNNN"
    assert one(spark, seq.reverse_complement(F.lit("ATGCN"))) == "NGCAT"
    assert one(spark, seq.translated(F.lit("ATGGCNNNNTAAG"))) == "MAX*"
    assert one(spark, seq.translated(F.lit("AT"))) == ""
    assert one(spark, seq.wrapped(F.lit("AAAA"), 2)) == "AA\nAA"
    assert one(spark, padded(F.lit(12345678), 7)) == "12345678"
    assert one(spark, genome_name(F.lit("a.b, c+-d"))) == "a_b_c_d"
    assert one(spark, cell_text(cell_copies(F.lit("b;(d:c);a")))) == "(c:d);a;b"


@pytest.mark.parametrize(("s", "ok"), [("ATG" + "GCT" * 40 + "TAA", True), ("ATG" + "GCT" * 40 + "TAAG", False), ("CTG" + "GCT" * 40 + "TAA", False), ("ATG" + "GCT" * 41, False), ("ATG" + "NNN" * 3 + "GCT" * 40 + "TAA", False), ("ATG" + "GCT" * 38 + "TAA", False)])
def test_quality(spark, s, ok):
    assert one(spark, seq.passes(F.lit(s))) is ok


def make_gff(path, name, contigs, features, fasta=True):
    text = "##gff-version 3\n" + "".join(f"{c}\tsrc\t{t}\t{a}\t{b}\t.\t{s}\t0\t{x}\n" for c, t, a, b, s, x in features)
    if fasta:
        text += "##FASTA\n" + "".join(f">{c} extra\n" + "\n".join(v[k : k + 10] for k in range(0, len(v), 10)) + "\n" for c, v in contigs.items())
    (path / f"{name}.gff").write_text(text)


def test_gff(spark, tmp_path):
    body = "ATG" + "GCT" * 42 + "TAA"
    back = body[::-1].translate(str.maketrans("ACGT", "TGCA"))
    make_gff(tmp_path, "g.1", {"c1": "cc" + body.lower() + "rr", "c2": back}, [("c1", "gene", 3, 134, "+", "ID=q"), ("c1", "CDS", 3, 134, "+", "ID=q1;gene=a/b_2;product=p"), ("c2", "CDS", 1, 132, "-", "xID=no;ID=q2"), ("c2", "rRNA", 1, 999, "+", "ID=r")])
    make_gff(tmp_path, "bad", {}, [("c9", "CDS", 1, 9, "+", "ID=b")], fasta=False)
    files = gff.scan_dir(spark, str(tmp_path))
    lines = gff.lines(files)
    contigs = gff.contigs(lines)
    feats = gff.matching(gff.features(lines), contigs)
    assert {r["genome"] for r in feats.collect()} == {"g_1"}
    std = gff.standardised(gff.of_types(feats, ("CDS", "rRNA")))
    attrs = {r["locus"]: r["attrs"] for r in std.collect()}
    assert attrs["g_1_00001"] == "ID=g_1_00001;locus_tag=g_1_00001;prev_ID=q1;gene=a_b_2;product=p"
    assert set(attrs) == {"g_1_00001", "g_1_00002", "g_1_rRNA_00001"}
    coords = gff.coords(std)
    assert {(r["Name"], r["Gene"], r["Strand"], r["Length"]) for r in coords.collect()} == {("g_1_00001", "a_b", "Forward", 132), ("g_1_00002", "", "Reverse", 132), ("g_1_rRNA_00001", "", "Forward", 999)}
    seqs = gff.feature_sequences(coords, contigs)
    assert {(r["Name"], r["seq"]) for r in seqs.collect()} == {("g_1_00001", body), ("g_1_00002", body)}
    assert {r["protein"] for r in gff.checked_sequences(seqs).collect()} == {"M" + "A" * 42 + "*"}
    again = gff.lines(gff.gff_text(std, contigs))
    assert sorted(r["seq"] for r in gff.contigs(again).collect()) == sorted(r["seq"] for r in contigs.collect())
    twice = gff.standardised(gff.features(again))
    assert {r["locus"] for r in twice.collect()} == set(attrs)


def test_readers_and_sinks(spark, tmp_path):
    sinks.fasta(spark.createDataFrame([("a", "ACGT" * 30), ("b", "")], "locus string, seq string"), str(tmp_path / "fa"), width=80)
    assert {(r["locus"], r["seq"]) for r in tables.fasta(spark, str(tmp_path / "fa")).collect()} == {("a", "ACGT" * 30), ("b", "")}
    (tmp_path / "x.clstr").write_text(">Cluster 0\n0\t12aa, >a... *\n1\t10aa, >b... at 99%\n>Cluster 1\n0\t9aa, >c... *\n")
    assert sorted((r["cluster"], r["locus"], r["length"], r["is_rep"]) for r in tables.clstr(spark, str(tmp_path / "x.clstr")).collect()) == [(1, "a", 12, True), (1, "b", 10, False), (2, "c", 9, True)]
    (tmp_path / "lines").write_text("a\tb\nc\n")
    assert sorted((r["cluster_ord"], r["locus"]) for r in tables.cluster_lines(spark, str(tmp_path / "lines"), 50).collect()) == [(1, "a"), (1, "b"), (2, "c")]
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\nc\t5\nc\t9\n")
    assert sorted((r["record"], r["pos"]) for r in tables.vcf_positions(spark, str(tmp_path / "v.vcf")).collect()) == [(1, 5), (2, 9)]
    (tmp_path / "s").write_text("a b\n\n c\n")
    assert sorted(r["genome"] for r in tables.sample_list(spark, str(tmp_path / "s")).collect()) == ["a", "c"]
    assert [tables.meta_width(h) for h in (["x"], ["no_loci"], ["no_loci", "cluster", "cluster_order"])] == [19, 20, 22]
    (tmp_path / "n.nwk").write_text("(a:1,b:-2.5);\n(c\n:3,d);\n")
    got = trees.nodes(tables.trees(spark, str(tmp_path / "n.nwk"))).where("leaf").collect()
    assert sorted((r["tree"], r["name"], r["length"]) for r in got) == [(1, "a", 1.0), (1, "b", 2.5), (2, "c", 3.0), (2, "d", None)]


def graph_of(spark, genomes):
    rows = [(f"{g}{k}", g, "c", k, s, f) for g, fs in genomes.items() for k, (f, s) in enumerate(fs)]
    return spark.createDataFrame(rows, "locus string, genome string, contig string, pos int, strand string, family string")


def test_graph_blocks_and_paths(spark):
    forward = [(f, "+") for f in "ABCD"]
    backward = [(f, "-") for f in "DCBA"]
    f = graph_of(spark, {"x": forward, "y": backward, "z": [("A", "+"), ("E", "+"), ("D", "+")]})
    e, n = graph.edges(f), graph.node_weights(f)
    weights = {(r["src"], r["src_side"], r["dst"], r["dst_side"]): r["weight"] for r in e.collect()}
    assert weights["A", "D", "B", "U"] == 2 and weights["B", "U", "A", "D"] == 2
    assert {r["n2"] for r in graph.canonical_links(f).where("n1 = 'A'").collect()} == {"B", "E"}
    assert {(r["family"], r["block"]) for r in graph.blocks(e, n).collect()} == {("A", "A"), ("B", "B"), ("C", "B"), ("D", "D"), ("E", "E")}
    paths = graph.checkpointed(graph.block_paths(e, n))
    assert {(r["family"], r["ord"]) for r in paths.where("block = 'B'").collect()} == {("B", 1), ("C", 2)}
    order = graph.order(paths, n).collect()
    assert sorted(r["family"] for r in order) == list("ABCDE")
    kinds = {r["block"]: r["kind"] for r in graph.classify_blocks(e, paths).collect()}
    assert kinds["B"] == "insertion" and kinds["E"] == "insertion"


def mutated(r, s, n):
    s = list(s)
    for k in r.sample(range(len(s)), n):
        s[k] = r.choice("ACGT")
    return "".join(s)


def test_clustering_ladder_keeps_every_locus(spark):
    r = random.Random(3)
    base = ["".join(r.choice("ACGT") for _ in range(300)) for _ in range(3)]
    rows = [(f"{g}{k}", g, s if k == 0 else mutated(r, s, 6 * k)) for g in "abc" for k, s in enumerate(base)]
    seqs = spark.createDataFrame(rows, "locus string, genome string, seq string")
    hits = clustering.checkpoint(clustering.homology(seqs, 12, 2))
    assert hits.where("q = s").count() == len(rows)
    cores, rest = clustering.core_rounds(seqs, hits, [100.0, 98.0])
    assert {x["locus"] for x in cores.collect()} >= {"a0", "b0", "c0"}
    assert cores.count() + rest.count() == len(rows)
    ladder = clustering.cluster_ladder(seqs, (50, 80, 95), [100.0, 98.0], k=12).collect()
    per = {}
    for x in ladder:
        per.setdefault(x["threshold"], {}).setdefault(x["cluster"], set()).add(x["locus"])
    for t in (50, 80, 95):
        assert sorted(x for c in per[t].values() for x in c) == sorted(x[0] for x in rows)
    for low, high in ((50, 80), (80, 95)):
        assert all(any(c <= p for p in per[low].values()) for c in per[high].values())
    assert len(per[50]) == 3


def test_alignments():
    got = alignment.center_star({"a": "ACGTACGT", "b": "ACGACGT", "c": "TACGTACGT"})
    assert len({len(x) for x in got.values()}) == 1
    assert {k: v.replace("-", "") for k, v in got.items()} == {"a": "ACGTACGT", "b": "ACGACGT", "c": "TACGTACGT"}
    assert clustering.aligned_identity("ACGTTGCA" * 10, "ACGTTGCA" * 10)[0] == 100.0
    assert alignment.thread_codons("A-", "ATGGCTTAA") == "ATGGCT---TAA"


def test_gaps_and_n_become_the_gap_character(spark):
    """Which sequence is longest depends on its letters alone."""
    rows = [("f", "x1", "x", "AC-N"), ("g", "x2", "x", "A---"), ("g", "y2", "y", "ANNN"), ("g", "y3", "y", "AC--")]
    aligned = spark.createDataFrame(rows, "family string, locus string, genome string, aln string")
    order = spark.createDataFrame([("f", 1, 1), ("g", 1, 2)], "family string, block int, ord int")
    genomes = spark.createDataFrame([("x",), ("y",)], "genome string")
    of = lambda **more: {r["genome"]: r["aln"] for r in alignment.concatenate(aligned, order, genomes, **more).collect()}
    assert of() == {"x": "ACNNANNN", "y": "NNNN----"}
    assert of(gap="?", several=True) == {"x": "AC??A???", "y": "????AC??"}
    assert of(gap="X", amino=True)["x"] == "ACXNAXXX"


def test_columns_in_common(spark):
    r = random.Random(5)
    rows = [("f" if k % 3 else "g", f"l{k:02}", "".join(r.choice("AC--") for _ in range(30))) for k in range(40)]
    aligned = spark.createDataFrame(rows, "family string, locus string, aln string")
    want = {(a[1], b[1]): sum(x != "-" != y for x, y in zip(a[2], b[2], strict=True)) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]}
    alignment.PAIRS, was = 7, alignment.PAIRS
    got = {(x["a"], x["b"]): x["both"] for x in alignment.column_overlaps(aligned).collect()}
    alignment.PAIRS = was
    assert got == want


def test_markov_clusters_split_weak_bridges():
    edges = [(a, b, 1.0) for g in ("abc", "xyz") for a in g for b in g if a < b] + [("c", "x", 0.05)]
    got = clustering.markov_clusters(list("abcxyz"), edges, 2.0)
    assert len(set(got.values())) == 2


def test_markov_clusters_are_those_of_a_dense_matrix(monkeypatch):
    def dense(names, edges, inflation):
        at = {x: k for k, x in enumerate(sorted(names))}
        m = np.zeros((len(at), len(at)))
        for a, b, w in edges:
            m[at[a], at[b]] = m[at[b], at[a]] = max(m[at[a], at[b]], w)
        np.fill_diagonal(m, np.maximum(m.max(axis=0), 1e-12))
        m /= m.sum(axis=0)
        for _ in range(100):
            new = (m @ m) ** inflation
            new[new < 1e-6] = 0
            new /= new.sum(axis=0)
            done = np.abs(new - m).max() < 1e-8
            m = new
            if done:
                break
        least = list(range(len(at)))
        for a, b in zip(*np.nonzero(m > 1e-5), strict=True):
            x, y = sorted((least[a], least[b]))
            least = [x if v == y else v for v in least]
        return {x: sorted(at)[least[k]] for x, k in at.items()}

    for seed in range(25):
        r = random.Random(seed)
        monkeypatch.setattr(clustering, "PRODUCTS", r.choice((1, 50, 1 << 22)))
        names = [f"n{k:02}" for k in range(r.randint(1, 25))]
        edges = [(a, b, r.random()) for a in names for b in names if a < b and r.random() < (0.6 if a[1] == b[1] else 0.08)]
        inflation = r.choice((1.5, 2.0, 4.0))
        assert clustering.markov_clusters(names, edges, inflation) == dense(names, edges, inflation)


def test_greedy_rounds_are_the_pandas_step(spark):
    """Large components, settled in joins, come out as small ones do."""
    r = random.Random(8)
    names = [f"s{k:02}" for k in range(40)]
    size = {x: r.randint(50, 60) for x in names}
    seqs = spark.createDataFrame([(x, "A" * n) for x, n in size.items()], "locus string, seq string")
    pairs = [(a, b, float(r.randint(90, 99))) for a in names for b in names if a < b and r.random() < 0.12]
    rows = [(a, b, p, 60, size[a], size[b]) for x, y, p in pairs for a, b in ((x, y), (y, x))]
    hits = spark.createDataFrame(rows, "q string, s string, pident double, length int, qlen int, slen int")
    of = lambda most: sorted(map(tuple, clustering.greedy_clusters(seqs, hits, 92.0, most=most).collect()))
    assert of(10**6) == of(0) and len(of(0)) == 40
    shorter = dict(map(tuple, clustering.greedy_clusters(seqs, hits, 92.0, least_length=0.99).collect()))
    assert all(min(size[x], size[c]) >= 0.99 * max(size[x], size[c]) for x, c in shorter.items())


def test_diagonals_count_all_places():
    """Repeats of one line, with a base changed in some: the shift is 0 although every k-mer has many places."""
    r = random.Random(1)
    line = "".join(r.choice("ACGT") for _ in range(50))
    a = line * 60
    b = "".join(line[:25] + ("A" if line[25] != "A" else "C") + line[26:] if k < 9 else line for k in range(60))
    numbers = lambda x, k=12: pairwise._packed(pairwise.codes(x), k)
    assert pairwise.diagonal(numbers(a), numbers(b)) == 0
    assert clustering.aligned_identity(a, b)[0] > 99 and clustering.aligned_identity(a, b)[1] == 3000
    assert pairwise.diagonal(numbers("A" * 3000), numbers("A" * 3000)) == 0 and pairwise.diagonal(numbers("ACGT" * 5), numbers("T" * 20)) is None


def test_places_of_alignments():
    r = random.Random(2)
    core = "".join(r.choice("ACGT") for _ in range(200))
    got = clustering.aligned_identity("T" * 30 + core, core[:100] + core[103:] + "G" * 40)
    assert got[3] == 31 and got[5] == 1 and got[4] == 230 and got[6] == 197 and got[0] > 97
    amino = "ACDEFGHIKLMNPQRSTVWY"
    found = 0
    for _ in range(40):
        p = [r.choice(amino) for _ in range(200)]
        q = "".join(r.choice(amino) for _ in range(40)) + "".join(x if r.random() < 0.65 else r.choice(amino) for x in p)
        found += clustering.aligned_identity("".join(p), q, 5, pairwise.PROTEIN)[1] > 150
    assert found >= 38


def test_distances_are_those_of_sets(spark):
    r = random.Random(4)
    has = {f"g{k}": {f"a{j}" for j in range(30) if r.random() < 0.4} | {"a0"} for k in range(17)}
    present = spark.createDataFrame([(g, 50, a) for g, s in has.items() for a in s], "genome string, threshold int, allele string")
    for tile in (512, 4):
        assert {(x["g1"], x["g2"]): x["d"] for x in tools.distances(present, tile=tile).collect()} == {(a, b): len(has[a] ^ has[b]) for a in has for b in has}
        assert {(x["g1"], x["g2"]): x["d"] for x in tools.distances(present, True, tile).collect()} == {(a, b): len(has[a] & has[b]) for a in has for b in has}
    assert tools.distances(present.limit(0)).count() == 0


def test_distances_of_many_genomes(spark, tmp_path, monkeypatch):
    """Tiles grow, so that a genome is sent to few tasks, each product has its own; lines hold the same without a row for a pair."""
    r = random.Random(5)
    has = {f"g{k:02}": {f"a{j}" for j in range(30) if r.random() < 0.4} | {"a0"} for k in range(17)}
    present = spark.createDataFrame([(g, 50, a) for g, s in has.items() for a in s], "genome string, threshold int, allele string")
    monkeypatch.setattr(tools, "TILES", 4)
    rows = tools.distances(present, tile=1)
    assert rows.rdd.getNumPartitions() == 4 * 5 // 2
    far = {(a, b): len(has[a] ^ has[b]) for a in has for b in has}
    assert {(x["g1"], x["g2"]): x["d"] for x in rows.collect()} == far
    monkeypatch.setattr(tools, "TILE", 5)
    for cells in (1, 17 * 3, 1 << 20):
        assert {x["genome"]: x["line"] for x in tools.distance_lines(present, cells).collect()} == {a: "\t".join(str(far[a, b]) for b in sorted(has)) for a in has}
    assert tools.distance_lines(present.limit(0)).count() == 0
    sinks.distances(present, at := str(tmp_path / "d"))
    assert {(x["g1"], x["g2"], x["n"]) for x in tables.matrix(spark, at, 1, "g2").collect()} == {(a, b, str(d)) for (a, b), d in far.items()}


def test_consistency(spark):
    c = spark.createDataFrame([(50, "1", "a"), (50, "2", "b"), (50, "3", "c"), (90, "m", "a"), (90, "m", "b"), (90, "n", "c")], "threshold int, cluster string, locus string")
    got = [(r["cluster"], r["kind"], r["error_group"]) for r in clustering.check_consistency(c).collect()]
    assert got == [("m", "mixed", "1")]


def test_identity_of_columns_is_that_of_pairs(spark):
    r = random.Random(7)
    rows = [(f"f{k % 3}", f"l{k}", "".join(r.choice("AACGT-n") for _ in range(20)) + "GG") for k in range(25)] + [("one", "x", "ACG"), ("gaps", "y", "--"), ("gaps", "z", "--")]
    got = {x["family"]: x for x in alignment.percent_identity(spark.createDataFrame(rows, "family string, locus string, aln string")).collect()}
    for f in {x[0] for x in rows}:
        own = [x[2].upper() for x in rows if x[0] == f]
        pairs = [(a, b) for k, x in enumerate(own) for y in own[:k] for a, b in zip(x, y, strict=True) if a.isalpha() and b.isalpha()]
        assert got[f]["average"] == pytest.approx(100 * sum(a == b for a, b in pairs) / len(pairs) if pairs else 0)
        whole = sum(len(set(c)) == 1 and c[0].isalpha() for c in zip(*own, strict=True))
        assert got[f]["overall"] == pytest.approx(100 * whole / len(own[0])) and got[f]["sequences"] == len(own)


def test_lines_keep_their_order_over_splits(spark, tmp_path, monkeypatch):
    """Files cut into many splits: numbers and headlines are those of the whole files."""
    monkeypatch.setattr(tables, "STRETCH", 7)
    names = [[f"l{f}_{k}" for k in range(r)] for f, r in ((0, 400), (1, 3), (2, 250))]
    for f, x in enumerate(names):
        (tmp_path / f"part-{f}.tsv").write_text("".join(f"{n}\t{n}b\n{'' if k % 5 else chr(10)}" for k, n in enumerate(x)))
    (tmp_path / "c.clstr").write_text("".join(f">Cluster {c}\n" + "".join(f"{k}\t{c + k}aa, >s{c}_{k}... {'*' if k == 0 else 'at 98%'}\n" for k in range(1 + c * 7 % 30)) for c in range(60)))
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        assert spark.read.text(str(tmp_path / "c.clstr")).rdd.getNumPartitions() > 10
        got = {r["locus"]: r["cluster_ord"] for r in tables.cluster_lines(spark, str(tmp_path / "*.tsv"), 50).collect()}
        found = sorted((r["cluster"], r["locus"], r["length"], r["is_rep"]) for r in tables.clstr(spark, str(tmp_path / "c.clstr")).collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    flat = [n for x in names for n in x]
    assert got == {m: k + 1 for k, n in enumerate(flat) for m in (n, n + "b")}
    assert found == sorted((c + 1, f"s{c}_{k}", c + k, k == 0) for c in range(60) for k in range(1 + c * 7 % 30))


def test_fillings_of_an_alignment_take_no_room(spark, tmp_path):
    """Sequences filled up to the longest are read as they were written, from files that don't grow with the filling."""
    rows = [(f"s{k}", ("ACGT" * k).ljust(20_000, "-")) for k in range(1, 101)]
    sinks.fasta(spark.createDataFrame(rows, "locus string, aln string"), at := str(tmp_path / "aln"), "locus", "aln", 60, pressed=True)
    assert sorted(map(tuple, tables.alignment(spark, at).collect())) == sorted(rows)
    assert sum(f.stat().st_size for f in (tmp_path / "aln").iterdir()) < 100 * 20_000 / 20


def test_tiles_of_genomes_meet_where_they_lie(spark, tmp_path, monkeypatch):
    """No genome is dealt out once for each tile, and lines of distances are written compressed."""
    r = random.Random(7)
    has = {f"g{k:02}": {f"a{j}" for j in range(30) if r.random() < 0.4} | {"a0"} for k in range(23)}
    present = spark.createDataFrame([(g, 50, a) for g, s in has.items() for a in s], "genome string, threshold int, allele string")
    monkeypatch.setattr(tools, "TILE", 4)
    for rows in (tools.distances(present, tile=4), tools.distance_lines(present, 23 * 4)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan and "Exchange" not in plan
    sinks.distances(present, at := str(tmp_path / "d"), pressed=True)
    assert all(f.name.endswith(".gz") for f in (tmp_path / "d").glob("part-*"))
    assert {(x["g1"], x["g2"], int(x["n"])) for x in tables.matrix(spark, at, 1, "g2").collect()} == {(a, b, len(has[a] ^ has[b])) for a in has for b in has}


def test_columns_in_common_of_blocks(spark, monkeypatch):
    """A small family makes several products too, each with its own partition; names in any order, gaps only, and null."""
    r = random.Random(6)
    rows = [("f" if k % 4 else "g", f"l{r.random()}", "".join(r.choice("AC--") for _ in range(r.randint(0, 90)))) for k in range(40)] + [("f", "x", None), ("f", "gaps", "---")]
    aligned = spark.createDataFrame(rows, "family string, locus string, aln string")
    common = lambda a, b: sum(x != "-" != y for x, y in zip(a or "", b or "", strict=False))
    want = {(a[0], a[1], b[1]): common(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]}
    filled = {x[1]: common(x[2], x[2]) for x in rows}
    monkeypatch.setattr(alignment, "COLUMNS", 16)
    monkeypatch.setattr(alignment, "FEW_PAIRS", 5)
    for most, pairs in ((7, 64), (2048, 1)):
        monkeypatch.setattr(alignment, "PAIRS", most)
        monkeypatch.setattr(alignment, "OVERLAPS", pairs)
        got = alignment.column_overlaps(aligned)
        assert got.rdd.getNumPartitions() == 2 * 3 // 2 + 7 * 8 // 2
        got = {(x["family"], x["a"], x["b"]): (x["both"], x["similar"]) for x in got.collect()}
        assert got == {k: (n, n >= 0.9 * filled[k[1]] and n >= 0.9 * filled[k[2]]) for k, n in want.items()}


def test_concatenation_of_sequences_without_their_fillings(spark):
    """Rows of slim() are placed and concatenated as the filled ones are."""
    rows = [("f1", "a", "x", "AC--"), ("f1", "b", "y", "AC-G"), ("f1", "c", "y", "----"), ("f2", "d", "x", "A-T---"), ("f2", "e", None, "------"), ("f2", "g", "z", "NNNNN-")]
    aligned = spark.createDataFrame(rows, "family string, locus string, genome string, aln string")
    order = spark.createDataFrame([("f1", 1, 2), ("f2", 1, 1)], "family string, block int, ord int")
    rows_of = lambda df: sorted(map(str, df.collect()))
    slim = alignment.slim(aligned)
    assert rows_of(alignment.offsets(slim, order)) == rows_of(alignment.offsets(aligned, order))
    assert rows_of(alignment.longest_per_genome(slim)) == rows_of(alignment.longest_per_genome(aligned))
    for several in (False, True):
        assert rows_of(alignment.concatenate(slim, order, aligned, several=several)) == rows_of(alignment.concatenate(aligned, order, aligned, several=several))
