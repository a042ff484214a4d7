"""A whole run: from a folder of annotated genomes to families, graph, alignments and tables, and their files."""

from __future__ import annotations

from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import Config
from strandline.functions.names import checkpoint
from strandline.operators import alignment, clustering, families, filters, graph, joining, paralogs, summary, tools
from strandline.sources import gff, sinks

#: What a run's files are kept for: 0 only results, 1 also what the families were made from, 2 everything.
FILES = {
    0: ("family_tables", "binary_fasta", "rtab", "summary", "representatives", "alignments", "order", "edges", "gfa", "ordered_table", "tree"),
    1: ("loci_list", "categories", "coords", "blocks"),
    2: ("gff", "sequences", "clusters"),
}

#: The largest evalue of a hit between sequences of a family.
PARALOG_EVALUE = 1e-2


def _categories(loci: DataFrame, several: DataFrame, used: DataFrame, cfg: Config, k: int) -> DataFrame:
    """Paralog categories of the families (family) with several loci of a genome.

    Within each family sequences of like length and of the lowest threshold's identity are one, and their
    representatives are compared.
    """
    low = min(cfg.thresholds)
    base = loci.where(F.col("threshold") == low).join(several, "family", "left_semi").select("family", "locus", "genome")
    mine = checkpoint(used.select("locus", "seq").join(base.select("locus", "family"), "locus"))
    first = clustering.same_sequences(mine.withColumn("seq", F.concat_ws("|", "family", "seq")))
    reps = mine.join(first.where("locus = rep").select("locus"), "locus", "left_semi")
    hits = checkpoint(clustering.homology(reps, k, kernel=cfg.similarity_kernel, by="family", protein=not cfg.nucleotide, evalue=PARALOG_EVALUE))
    alike = clustering.greedy_clusters(reps, hits, low, least_length=cfg.paralog_length).withColumnsRenamed({"locus": "rep", "cluster": "top"})
    members = base.join(first, "locus").join(alike, "rep").select("family", "locus", "genome", F.col("top").alias("rep"))
    tops = members.select("rep").distinct()
    among = hits.join(tops.toDF("q"), "q", "left_semi").join(tops.toDF("s"), "s", "left_semi")
    near = among.select("q", "s", "qlen", "slen", "length", (100.0 * (F.col("qend") - F.col("qstart") + 1) / F.col("qlen")).alias("qcovs"), "pident", "sstart", "send")
    return paralogs.classify(members, near, mine.select("locus", F.length("seq").alias("length")), low, cfg.paralog_max)


def run(spark: SparkSession, folder: str, cfg: Config | None = None) -> dict[str, DataFrame]:
    """Tables by name, from the *.gff files of a folder. Under two genomes are an error."""
    cfg = cfg or Config()
    lines = gff.lines(gff.scan_dir(spark, folder))
    contigs = gff.contigs(lines)
    features = gff.standardised(gff.of_types(gff.matching(gff.features(lines), contigs), cfg.features))
    coords = checkpoint(gff.coords(features))
    cut = gff.feature_sequences(coords, contigs)
    checked = gff.checked_sequences(cut, cfg.min_length) if cfg.checks_sequences else cut.select(F.col("Name").alias("locus"), "genome", "seq", F.lit(None).cast("string").alias("protein"))
    seqs = checkpoint(checked)
    if seqs.select("genome").distinct().limit(2).count() < 2:
        raise ValueError("under two genomes are left")
    k = 12 if cfg.nucleotide else 5
    used = seqs.select("locus", "genome", F.col("seq") if cfg.nucleotide else F.regexp_replace("protein", r"\*$", "").alias("seq"))
    clusters = checkpoint(clustering.cluster_ladder(
        used, cfg.thresholds, cfg.identities(), cfg.inflation, k, coverage=cfg.cd_coverage, cores=cfg.cd_cores, normalise=partial(_normalised, cfg=cfg), similarity=cfg.similarity_kernel, clustered=cfg.cluster_kernel, protein=not cfg.nucleotide, evalue=cfg.evalue))
    loci = checkpoint(families.name_clusters(clusters))
    low = min(cfg.thresholds)
    info = coords.select(F.col("Name").alias("locus"), F.col("Gene").alias("gene"), F.col("Product").alias("product"), F.col("Length").alias("length"))
    categories, log = None, None
    if cfg.paralogs:
        several = checkpoint(families.paralog_families(loci))
        categories = checkpoint(_categories(loci, several, used, cfg, k))
        divided = checkpoint(paralogs.split(loci.join(several, "family", "left_semi"), categories, cfg.split_cut_off, cfg.split_strict))
        log = paralogs.split_log(divided, categories)
        loci = checkpoint(paralogs.replaced(loci, divided, several))
    table = checkpoint(families.family_table(loci, info, categories))
    cells = families.cells(loci, categories)
    root = checkpoint(loci.where(F.col("threshold") == low).select("locus", "family", "genome"))
    weights = graph.node_weights(root)
    single = weights.where(F.col("dosage") <= cfg.graph_dosage) if cfg.graph_dosage else weights
    placed = coords.select(F.col("Name").alias("locus"), F.col("Contig").alias("contig"), F.col("Start").alias("pos"), F.when(F.col("Strand") == "Reverse", "-").otherwise("+").alias("strand"))
    nodes = checkpoint(placed.join(root, "locus").join(single.select("family"), "family", "left_semi"))
    edges, weights = graph.checkpointed(graph.edges(nodes)), graph.node_weights(nodes)
    paths = graph.checkpointed(graph.block_paths(edges, weights))
    connected = graph.checkpointed(graph.connected_paths(edges, weights, paths))
    order = checkpoint(graph.order(connected, weights))
    out = {
        "coords": coords, "features": features, "contigs": contigs, "sequences": seqs, "clusters": clusters, "loci_list": loci, "categories": categories, "split_log": log, "family_table": table, "cells": cells,
        "edges": edges, "nodes": weights, "links": graph.canonical_links(nodes), "paths": paths, "connected": connected, "order": order, "ordered_table": graph.sort_families(table, order),
        "summary": summary.buckets(table, cfg.summary_cutoffs), "representatives": _representatives(loci, info, seqs, table), "presence": families.presence(loci)}
    return {**out, **_alignments(out, root, seqs, cfg)}


def _normalised(hits: DataFrame, representatives: DataFrame, cfg: Config) -> DataFrame:
    return filters.normalise_hits(hits, representatives, cfg.hsp_length, cfg.hsp_proportion)


def _representatives(loci: DataFrame, info: DataFrame, seqs: DataFrame, table: DataFrame) -> DataFrame:
    named = table.select(F.col("gene_family").alias("family"), F.col("consensus_gene_name").alias("gene"), F.col("consensus_product").alias("product"), "number_genomes")
    return tools.representatives(loci, info).join(named, "family").join(seqs.select("locus", "seq", "protein"), "locus", "left")


def _alignments(made: dict[str, DataFrame], root: DataFrame, seqs: DataFrame, cfg: Config) -> dict[str, DataFrame]:
    """Aligned families of a dosage up to the limit, end to end in graph order: all of them, and the core's."""
    weights = graph.node_weights(root)
    chosen = weights.where(F.col("dosage") <= cfg.align_dosage) if cfg.align_dosage else weights
    rows = root.join(chosen.select("family"), "family", "left_semi").join(seqs.select("locus", "seq", "protein"), "locus")
    align = alignment.align_families if cfg.nucleotide else alignment.back_translate
    aligned = checkpoint(align(rows, cfg.msa_kernel))
    genomes = seqs.select("genome").distinct()
    n = genomes.count()
    core = made["order"].join(filters.by_prevalence(weights.withColumnRenamed("n_genomes", "number_genomes"), n, cfg.core_percent).select("family"), "family", "left_semi")
    out = {"aligned": aligned}
    for name, order in (("pangenome", made["order"]), ("core", core)):
        out[f"{name}_alignment"] = alignment.concatenate(aligned, order, genomes)
        out[f"{name}_features"] = alignment.offsets_gff(alignment.offsets(aligned, order))
    return out


def write(made: dict[str, DataFrame], path: str, cfg: Config | None = None) -> list[str]:
    """The files of a run under path, each in its folder; cfg.retain says which. What was written whole before is kept, so that a run goes on where it stopped."""
    cfg = cfg or Config()
    spark = made["loci_list"].sparkSession
    loci, cells, table = made["loci_list"], made["cells"], made["family_table"]
    info = made["coords"].select(F.col("Name").alias("locus"), F.col("Gene").alias("gene"), F.col("Product").alias("product"), F.col("Length").alias("length"))
    genomes = [r[0] for r in loci.select("genome").distinct().orderBy("genome").collect()]  # as many as there are files

    def tables(at: str) -> None:
        unique, every = families.unique_alleles(loci), loci.select("family", "allele", "threshold").distinct()
        of = lambda rows: families.family_table(loci, info, made["categories"], rows)
        sinks.family_tables(table, of(unique), of(every), families.genomes_per_allele(loci), cells, at, genomes)

    def blocks(at: str) -> None:
        sinks.blocks(*graph.block_files(made["edges"], made["nodes"], made["paths"], made["connected"]), made["order"], at)

    def alignments(at: str) -> None:
        for name in ("pangenome", "core"):
            sinks.alignment(made[f"{name}_alignment"], made[f"{name}_features"], f"{at}/{name}")

    present = made["presence"]
    by_family = present.where(F.col("threshold") == F.lit(min(cfg.thresholds)))
    writers = {
        "family_tables": tables, "blocks": blocks, "alignments": alignments,
        "binary_fasta": lambda at: sinks.binary_fasta(tools.binary_sequences(by_family, present), at),
        "rtab": lambda at: sinks.matrix(tools.rtab(loci, categories=made["categories"]).withColumnRenamed("allele", "Gene"), ["Gene"], "genome", at, names=genomes),
        "summary": lambda at: sinks.summary(made["summary"], at),
        "representatives": lambda at: sinks.representatives(made["representatives"], at),
        "order": lambda at: sinks.order(made["order"], at),
        "edges": lambda at: sinks.tsv(graph.edge_lines(made["edges"]), at, header=False),
        "gfa": lambda at: sinks.text(graph.gfa(made["nodes"], made["links"]).orderBy("part", "name"), F.col("line"), at),
        "ordered_table": lambda at: sinks.family_table(made["ordered_table"], cells, at, genomes),
        "tree": lambda at: sinks.text(joining.newick(joining.tree_of(by_family), by_family), F.col("newick"), at),
        "loci_list": lambda at: sinks.loci_list(loci, at),
        "categories": lambda at: made["categories"] is not None and sinks.paralog_categories(made["categories"], made["categories"].select("family").distinct(), at),
        "coords": lambda at: sinks.coords(made["coords"], at),
        "gff": lambda at: sinks.gff(gff.gff_text(made["features"], made["contigs"]), at),
        "sequences": lambda at: sinks.fasta(made["sequences"].select("genome", "locus", "seq"), at, "locus", "seq", 0, "genome"),
        "clusters": lambda at: sinks.clusters(made["clusters"], at),
    }
    wanted = [name for level in range(min(2, cfg.retain) + 1) for name in FILES[level]]
    for name in wanted:
        if not _there(spark, done := f"{path}/finished/{name}"):
            writers[name](f"{path}/{name}")
            sinks.text(spark.createDataFrame([(name,)], "name string"), F.col("name"), done)
    return wanted


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a folder has files, in whatever store it is."""
    try:
        return not spark.read.text(path).isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
