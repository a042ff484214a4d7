"""Filters on hits, families and alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SELF_BITSCORE = 2335.0  # Fixed value: what a placeholder self hit scores


def folded(x: Column) -> Column:
    """A ratio with what is over 1 mirrored below it."""
    return F.when(x > 1, 2 - x).otherwise(x)


def force_self_identity(hits: DataFrame) -> DataFrame:
    return hits.withColumn("pident", F.when(F.col("q") == F.col("s"), F.lit(100.0)).otherwise(F.col("pident")))


def by_identity(hits: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """Hits by each threshold that they reach: a row for each, without a join."""
    steps = F.array(*(F.lit(int(t)) for t in thresholds))
    return hits.withColumn("threshold", F.explode(F.filter(steps, lambda t: F.col("pident") >= t)))


def by_hsp_length(hits: DataFrame, least: float) -> DataFrame:
    """What the alignment covers of the query, folded, over `least`; self hits stay."""
    cover = folded((F.col("qend") - F.col("qstart") + 1) / F.col("qlen"))
    return hits.where((F.col("q") == F.col("s")) | (cover > least))


def by_hsp_proportion(hits: DataFrame, least: float) -> DataFrame:
    """Query length and query alignment by subject alignment, both folded, over `least`; self hits stay."""
    subject = F.abs(F.col("send") - F.col("sstart")) + 1
    ok = (folded(F.col("qlen") / subject) > least) & (folded((F.col("qend") - F.col("qstart") + 1) / subject) > least)
    return hits.where((F.col("q") == F.col("s")) | ok)


def add_missing_self(hits: DataFrame, representatives: DataFrame) -> DataFrame:
    """Representatives (locus, length) without a hit on themselves get one."""
    found = hits.where("q = s").select(F.col("q").alias("locus"))
    missing = representatives.join(found, "locus", "left_anti")
    n, one = F.col("length").cast("int"), F.lit(1)
    made = {"q": F.col("locus"), "s": F.col("locus"), "pident": F.lit(100.0), "length": n, "mismatch": F.lit(0), "gapopen": F.lit(0), "qstart": one, "qend": n, "sstart": one, "send": n, "evalue": F.lit(0.0), "bitscore": F.lit(SELF_BITSCORE), "qlen": n, "slen": n}
    return hits.unionByName(missing.select(*(made[c].cast(t).alias(c) for c, t in hits.dtypes)))


def normalise_hits(hits: DataFrame, representatives: DataFrame, hsp_length: float = 0.0, hsp_proportion: float = 0.0) -> DataFrame:
    """Self hits at 100 percent, one of the two alignment filters, and a self hit for each representative."""
    hits = force_self_identity(hits)
    if hsp_length:
        hits = by_hsp_length(hits, hsp_length)
    elif hsp_proportion:
        hits = by_hsp_proportion(hits, hsp_proportion)
    return add_missing_self(hits, representatives)


def pair_coverage(hits: DataFrame) -> DataFrame:
    """(a, b, coverage, pident) of each two names: the least percent of the query that any hit covers, and that hit's identity."""
    cover = F.lit(100.0) * F.col("length") / F.col("qlen")
    best = F.min_by(F.struct(cover.alias("coverage"), "pident"), F.struct(cover.alias("c"), "pident"))
    return hits.groupBy(F.least("q", "s").alias("a"), F.greatest("q", "s").alias("b")).agg(best.alias("m")).select("a", "b", "m.coverage", "m.pident")


def in_same_cluster(hits: DataFrame, clusters: DataFrame) -> DataFrame:
    """Hits whose two ends share a cluster (cluster, locus), with it."""
    a = clusters.select(F.col("locus").alias("q"), F.col("cluster").alias("cluster"))
    b = clusters.select(F.col("locus").alias("s"), F.col("cluster").alias("_other"))
    return hits.join(a, "q").join(b, "s").where("cluster = _other").drop("_other")


def by_dosage(table: DataFrame, most: float) -> DataFrame:
    """Average dose at most `most`; 0 lets all through."""
    return table.where(F.col("average_dose") <= most) if most else table


def by_prevalence(table: DataFrame, n_genomes: int, low: float = 0, high: float = 100) -> DataFrame:
    return table.where((100.0 * F.col("number_genomes") / n_genomes).between(low, high))


def by_allele_frequency(table: DataFrame, n_genomes: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    return table.where((F.col("number_genomes") / n_genomes).between(low, high))


def by_family_frequency(table: DataFrame, n_genomes: int, low: float = 0, high: float = 1, keep_all: bool = False) -> DataFrame:
    """Rows of families whose row at their lowest threshold is in range; that row goes if there are others, unless all are kept."""
    w = Window.partitionBy("family")
    rows = table.withColumn("_first", F.min("threshold").over(w)).withColumn("_last", F.max("threshold").over(w))
    share = F.max(F.when(F.col("threshold") == F.col("_first"), F.col("number_genomes") / n_genomes)).over(w)
    rows = rows.withColumn("_share", share).where(F.col("_share").between(low, high))
    return (rows if keep_all else rows.where("threshold > _first or _first = _last")).drop("_first", "_last", "_share")


def by_family_pattern(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.where(F.col("family").rlike(pattern))


def by_samples(rows: DataFrame, samples: DataFrame) -> DataFrame:
    return rows.join(samples.select("genome"), "genome", "left_semi")


def by_p_value(results: DataFrame, most: float) -> DataFrame:
    return results.where(F.col("pvalue") <= most)


def missing_samples(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """(genome, found): each wanted sample, and whether the table has it."""
    return wanted.select("genome").distinct().join(there.select("genome", F.lit(True).alias("_f")).distinct(), "genome", "left").select("genome", F.coalesce("_f", F.lit(False)).alias("found"))
