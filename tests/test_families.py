from __future__ import annotations

import pytest

from strandline.config import Config
from strandline.functions.names import numbered
from strandline.operators import families as fam
from strandline.operators import filters, paralogs, summary, tools


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def clusters(spark):
    """Three families: one stable, one that splits at 70, one that splits only at 90."""
    out = []
    for g in "abc":
        out += [(50, "1", f"{g}1", g), (70, "1", f"{g}1", g), (90, "1", f"{g}1", g)]
        out += [(50, "2", f"{g}2", g), (70, "2x" if g == "a" else "2y", f"{g}2", g), (90, "2x" if g == "a" else "2y", f"{g}2", g)]
        out += [(50, "3", f"{g}3", g), (70, "3", f"{g}3", g), (90, "3x" if g == "a" else "3y", f"{g}3", g)]
    return spark.createDataFrame(out, "threshold int, cluster string, locus string, genome string")


def test_names_and_unique_alleles(clusters):
    loci = fam.name_clusters(clusters)
    assert rows(loci.where("locus = 'a2'"), "threshold", "allele") == [(50, "g00002"), (70, "g00002_0001"), (90, "g00002_0003")]
    unique = rows(fam.unique_alleles(loci), "family", "allele", "threshold")
    assert unique == [
        ("g00001", "g00001_0002", 90), ("g00002", "g00002", 50), ("g00002", "g00002_0003", 90), ("g00002", "g00002_0004", 90),
        ("g00003", "g00003_0001", 70), ("g00003", "g00003_0002", 90), ("g00003", "g00003_0003", 90)]
    assert rows(fam.family_rows(fam.unique_alleles(loci)), "family", "threshold") == [("g00001", 90), ("g00002", 50), ("g00003", 70)]


def test_order_of_rows_does_not_matter(clusters):
    a, b = fam.name_clusters(clusters), fam.name_clusters(clusters.orderBy("locus", "threshold"))
    assert rows(a, *a.columns) == rows(b, *a.columns)


def test_numbers_are_consecutive(spark):
    got = numbered(spark.range(50, 0, -1), "n", __import__("pyspark").sql.functions.col("id"))
    assert rows(got, "id", "n") == [(k, k) for k in range(1, 51)]


def test_dose_counts_a_fission_group_once(spark):
    loci = spark.createDataFrame([("a1", "f", 50, "f", "a"), ("a2", "f", 50, "f", "a"), ("a3", "f", 50, "f", "a"), ("b1", "f", 50, "f", "b")], "locus string, family string, threshold int, allele string, genome string")
    cats = spark.createDataFrame([("a1", 1), ("a2", 1), ("a3", 0)], "locus string, ff_group int")
    assert rows(fam.doses(loci, cats), "genome", "dose", "n_loci") == [("a", 2, 3), ("b", 1, 1)]
    assert rows(fam.cells(loci, cats), "genome", "cell") == [("a", "(a1:a2);a3"), ("b", "b1")]


def test_consensus_breaks_ties_by_name_and_ignores_missing(spark):
    loci = spark.createDataFrame([(f"l{k}", "f", 50, "f", "a") for k in range(5)], "locus string, family string, threshold int, allele string, genome string")
    info = spark.createDataFrame([("l0", "b"), ("l1", "a"), ("l2", ""), ("l3", None), ("l4", "")], "locus string, gene string")
    assert rows(fam.consensus(loci, info, "gene"), "consensus") == [("a",)]
    assert rows(fam.counted_list(loci, info, "gene"), "counted") == [("NA(3):a(1):b(1)",)]


def test_buckets_hold_their_upper_bound(spark):
    t = spark.createDataFrame([(n, 1, 0, 0) for n in (10, 11, 25, 100)], "number_genomes int, alleles_at_maximum_threshold int, genomes_containing_fissions int, genomes_containing_duplications int")
    assert rows(summary.buckets(t).where("n_families > 0"), "bucket_top", "n_families") == [(10, 1), (25, 2), (100, 1)]


def test_hits(spark):
    h = spark.createDataFrame([("a", "a", 90.0, 5, 0, 0, 1, 5, 1, 5, 0.0, 9.0, 10, 10), ("a", "b", 80.0, 7, 0, 0, 1, 7, 1, 7, 0.0, 9.0, 10, 10)], "q string, s string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qlen int, slen int")
    reps = spark.createDataFrame([("a", 10), ("b", 10)], "locus string, length int")
    got = filters.normalise_hits(h, reps, hsp_length=0.7)
    assert rows(got, "q", "s", "pident", "bitscore") == [("a", "a", 100.0, 9.0), ("b", "b", 100.0, 2335.0)]


def test_positions_take_the_last_feature(spark):
    f = spark.createDataFrame([("x", 1, 10), ("y", 5, 9000)], "name string, start long, end long")
    p = spark.createDataFrame([(3,), (7,), (8999,), (9001,)], "pos long")
    assert sorted(((r["pos"], r["name"]) for r in tools.position_features(p, f).collect())) == [(3, "x"), (7, "y"), (8999, "y"), (9001, None)]


def test_split_takes_single_copy_alleles_apart(spark):
    """Two interleaved alleles, each in four genomes; and a family of one genome, which stays."""
    out = []
    for g in "abcd":
        for x in "12":
            out += [(f"{g}{x}", "f", 50, "f", g), (f"{g}{x}", "f", 90, f"f_{x}", g)]
    out += [("z1", "h", 50, "h", "z"), ("z2", "h", 50, "h", "z"), ("z1", "h", 90, "h_1", "z"), ("z2", "h", 90, "h_1", "z")]
    got = paralogs.split(spark.createDataFrame(out, "locus string, family string, threshold int, allele string, genome string"))
    assert rows(got.where("threshold = 50").groupBy("family").count(), "family", "count") == [("f_1", 4), ("f_2", 4), ("h", 2)]
    assert got.count() == len(out)


def test_classify_pairs_fragments_and_copies(spark):
    members = spark.createDataFrame([("f", "a1", "a", "L"), ("f", "b1", "b", "P"), ("f", "b2", "b", "Q"), ("f", "c1", "c", "L"), ("f", "c2", "c", "L")], "family string, locus string, genome string, rep string")
    lengths = spark.createDataFrame([("L", 100), ("P", 50), ("Q", 50)], "locus string, length int")
    hits = spark.createDataFrame([("P", "L", 50, 100, 50, 90.0, 99.0, 1, 50), ("Q", "L", 50, 100, 50, 90.0, 99.0, 51, 100)], "q string, s string, qlen int, slen int, length int, qcovs double, pident double, sstart int, send int")
    got = rows(paralogs.classify(members, hits, lengths), "locus", "mc", "ff", "ff_group")
    assert got == [("a1", 1, 0, 0), ("b1", 0, 1, 1), ("b2", 0, 1, 1), ("c1", 1, 0, 0), ("c2", 1, 0, 0)]


def test_config_checks():
    assert Config(thresholds=(90, 50)).thresholds == (50, 90)
    assert Config(features=("rRNA",)).nucleotide
    for bad in ({"thresholds": (50,)}, {"thresholds": (50, 101)}, {"cd_low": 90.0}):
        with pytest.raises(ValueError):
            Config(**bad)
