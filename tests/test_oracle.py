"""Queries against their SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from strandline.plans import registry

DIR = "/root/testdata/sf0.001"
NAMES = ["name_clusters", "link_alleles", "agg_allele_stats", "agg_consensus", "gene_families", "family_cells", "agg_summary_buckets", "tool_rtab", "tool_paralog_rtab", "tool_distmat", "tool_variants_treewas", "graph_edges", "sink_gfa1", "graph_canonical_links", "graph_connect_blocks", "graph_classify_blocks", "graph_reversed_loops", "graph_order", "sink_blocks", "sink_block_files", "hits_normalise", "scan_gff_raw", "scan_family_table", "sink_family_tables", "scan_cluster_lines", "line_index_lookup", "sink_split_loci", "sink_representatives", "sink_summary", "scan_roary_csv", "tool_pan_alignment_aa", "top1_best_score", "agg_cluster_alleles", "attr_rewrite", "seq_translate", "aln_concat", "classify_paralogs_aligned", "range_join_pos_feature", "homology_all_vs_all", "cluster_greedy", "planted_alignment", "scan_newick", "newick_nodes", "newick_midpoint"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
