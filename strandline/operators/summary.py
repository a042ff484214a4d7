"""Counts for reports and plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTOFFS = (10, 25, 50, 75, 90, 95)


def buckets(table: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(bucket_top, n_families, ...) of the family table: by percent of the largest number of genomes seen.

    A bucket includes its upper bound, so that a family on a bound falls into the lower one. Empty buckets stay.
    """
    tops = [*cutoffs, 100]
    most = F.broadcast(table.agg(F.max("number_genomes").alias("most")))
    percent = F.lit(100.0) * F.col("number_genomes") / F.col("most")
    top = F.coalesce(*(F.when(percent <= c, F.lit(c)) for c in tops))
    flag = lambda c, n: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n)
    counts = table.crossJoin(most).groupBy(top.alias("bucket_top")).agg(
        F.count("*").alias("n_families"), flag(F.col("alleles_at_maximum_threshold") > 1, "n_multi_allele"),
        flag(F.col("genomes_containing_fissions") > 0, "n_fission"), flag(F.col("genomes_containing_duplications") > 0, "n_duplication"))
    all_ = table.sparkSession.createDataFrame([(c,) for c in tops], "bucket_top int")
    return all_.join(counts, "bucket_top", "left").na.fill(0)


def families_per_genome(loci: DataFrame) -> DataFrame:
    return loci.groupBy("genome").agg(F.count_distinct("family").alias("n_families"))


def clusters_per_threshold(loci: DataFrame) -> DataFrame:
    return loci.groupBy("threshold").agg(F.count_distinct("allele").alias("n_clusters"))


def core_accessory(loci: DataFrame, share: float = 0.95) -> DataFrame:
    """(threshold, kind, n_clusters): core clusters are in over `share` of the genomes of the most frequent one."""
    n = loci.groupBy("threshold", "allele").agg(F.count_distinct("genome").alias("n"))
    kind = F.when(F.col("n") / F.col("most") > share, "core").otherwise("accessory")
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("most")))).groupBy("threshold", kind.alias("kind")).agg(F.count("*").alias("n_clusters"))


def prevalence_histogram(table: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, kind, n_families): families by share of genomes, with one allele at the top threshold (stable) or several."""
    most = F.broadcast(table.agg(F.max("number_genomes").alias("most")))
    place = F.least(F.lit(bins - 1), F.floor(F.col("number_genomes") * bins / F.col("most"))).cast("long")
    kind = F.when(F.col("alleles_at_maximum_threshold") > 1, "diverged").otherwise("stable")
    return table.crossJoin(most).groupBy(place.alias("bin"), kind.alias("kind")).agg(F.count("*").alias("n_families"))


def copy_kinds(stats: DataFrame) -> DataFrame:
    ff, mc = F.col("genomes_containing_fissions") > 0, F.col("genomes_containing_duplications") > 0
    return stats.groupBy("threshold", F.when(ff & mc, "both").when(ff, "ff").when(mc, "multicopy").otherwise("single").alias("kind")).agg(F.count("*").alias("n_alleles"))


def allele_histogram(at_maximum: DataFrame) -> DataFrame:
    n = F.col("alleles_at_maximum_threshold").alias("n_alleles")
    rows = lambda df, kind: df.groupBy(n).agg(F.count("*").alias("n_families")).select(F.lit(kind).alias("kind"), "n_alleles", "n_families")
    return rows(at_maximum, "all").unionByName(rows(at_maximum.where("alleles_at_maximum_threshold > 1"), "several"))


def unique_per_threshold(unique: DataFrame) -> DataFrame:
    return unique.groupBy("threshold").agg(F.count("*").alias("n_unique"))
