"""A whole run over three small genomes, and streaming of loci lists."""

from __future__ import annotations

import random

from strandline.config import Config
from strandline.plans import pangenome
from strandline.sources import tables
from strandline.streaming.loci import load


def test_run(spark, tmp_path):
    r = random.Random(7)
    codons = ["GCT", "GAT", "TTC", "GGA", "CAC", "ATC", "AAA", "CTG", "ATG", "AAC", "CCG", "CAG", "CGT", "AGC", "ACC", "GTG", "TGG", "TAC"]
    genes = ["ATG" + "".join(r.choice(codons) for _ in range(60)) + "TAA" for _ in range(4)]
    for g in ("x", "y", "z"):
        seq = "".join(genes)
        size = len(genes[0])
        lines = "".join(f"c{g}\ts\tCDS\t{k * size + 1}\t{(k + 1) * size}\t.\t+\t0\tID=q{k};gene=n{k};product=p\n" for k in range(4) if not (g == "z" and k == 3))
        (tmp_path / f"{g}.gff").write_text(f"##gff-version 3\n{lines}##FASTA\n>c{g}\n{seq}\n")
    got = pangenome.run(spark, str(tmp_path), Config(thresholds=(50, 90), cd_low=98.0, cd_step=2.0))
    table = {t["consensus_gene_name"]: (t["number_genomes"], t["threshold"]) for t in got["family_table"].collect()}
    assert table == {"n0": (3, 90), "n1": (3, 90), "n2": (3, 90), "n3": (2, 90)}
    assert got["order"].count() == 4
    assert got["loci_list"].count() == 11 * 2
    assert got["links"].count() == 3
    size = sum(map(len, genes))
    assert {r["genome"]: len(r["aln"]) for r in got["pangenome_alignment"].collect()} == dict.fromkeys("xyz", size)
    assert {r["genome"]: len(r["aln"]) for r in got["core_alignment"].collect()} == dict.fromkeys("xyz", size - len(genes[3]))
    every = Config(thresholds=(50, 90), cd_low=98.0, cd_step=2.0, retain=2)
    names = pangenome.write(got, str(tmp_path / "out"), every)
    assert sorted([*names, "finished"]) == sorted(x.name for x in (tmp_path / "out").iterdir()) and "clusters" in names
    text = lambda *parts: "".join(sorted(f.read_text() for f in (tmp_path / "out").joinpath(*parts).glob("part-*")))
    assert text("gfa").count("S\t") == 4 and text("gfa").count("L\t") == 3
    assert text("representatives", "ffn").count(">") == 4 and "number_genomes=2" in text("representatives", "faa")
    assert text("alignments", "core", "fasta").count(">") == 3 and text("order").count("\n") == 4 and text("tree").endswith(";\n")
    meta, cells = tables.family_table(spark, str(tmp_path / "out" / "ordered_table"))
    assert meta.columns[-2:] == ["cluster", "cluster_order"] and cells.count() == 11
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("part-*")}
    pangenome.write(got, str(tmp_path / "out"), every)  # what is there stays
    assert before == {f: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("part-*")}
    assert "loci_list" not in pangenome.write(got, str(tmp_path / "few"), Config(thresholds=(50, 90), cd_low=98.0, retain=0))


def test_run_with_fragments_and_copies(spark, tmp_path):
    """A gene in two parts in one genome, and twice in another; own kernels are asked."""
    r = random.Random(9)
    codons = ["GCT", "GAT", "TTC", "GGA", "CAC", "ATC", "AAA", "CTG", "AAC", "CCG", "CAG", "CGT", "AGC", "ACC", "GTG", "TGG", "TAC"]
    inner = [r.choice(codons) for _ in range(200)]
    gene = lambda part: "ATG" + "".join(part) + "TAA"
    other = [r.choice(codons) for _ in range(200)]
    genomes = {"v": [inner, other], "w": [inner, other], "x": [inner[:100], inner[100:], other], "y": [inner, inner, other]}
    for g, parts in genomes.items():
        seq, lines = "", ""
        for k, part in enumerate(parts):
            lines += f"c{g}\ts\tCDS\t{len(seq) + 1}\t{len(seq) + len(gene(part))}\t.\t+\t0\tID=q{k};gene=n;product=p\n"
            seq += gene(part)
        (tmp_path / f"{g}.gff").write_text(f"##gff-version 3\n{lines}##FASTA\n>c{g}\n{seq}\n")

    def clustered(names, edges, inflation):
        return dict.fromkeys(names, min(names))

    cfg = Config(thresholds=(50, 60), cd_low=98.0, cd_step=2.0, hsp_length=0.0, cluster_kernel=clustered)
    got = pangenome.run(spark, str(tmp_path), cfg)
    kinds = {c["locus"]: (c["mc"], c["ff"]) for c in got["categories"].collect()}
    assert kinds["x_00001"] == kinds["x_00002"] == (0, 1) and kinds["y_00001"] == kinds["y_00002"] == kinds["v_00001"] == (1, 0)
    cells = {(c["genome"], c["threshold"]): c["cell"] for c in got["cells"].collect() if "_00001" in c["cell"]}
    assert cells["x", 50] == "(x_00001:x_00002)" and cells["y", 50] == "y_00001;y_00002"


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.tsv").write_text(f"l{k}\tg1\t50\tg1\ta\n")
        q = load(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert sorted(x["locus"] for x in spark.read.parquet(str(tmp_path / "out")).collect()) == ["l0", "l1"]
