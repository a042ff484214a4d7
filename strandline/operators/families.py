"""Families and alleles: naming across thresholds, dosage, statistics, consensus and the family table.

All of it works on the long loci list (locus, family, threshold, allele, genome): no step needs its rows in an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import cell_text, checkpoint, numbered, padded

FAMILY_WIDTH, ALLELE_WIDTH = 5, 4


def root_clusters(clusters: DataFrame) -> DataFrame:
    """(threshold, cluster, root): each cluster with the lowest threshold's cluster that its loci are in."""
    by_locus = Window.partitionBy("locus").orderBy("threshold")
    rooted = clusters.withColumn("root", F.first("cluster").over(by_locus))
    return rooted.groupBy("threshold", "cluster").agg(F.min("root").alias("root"))


def name_clusters(clusters: DataFrame) -> DataFrame:
    """The loci list of clusters (threshold, cluster, locus, genome), nested from the lowest threshold up.

    Families are numbered in the order of the lowest threshold's clusters, alleles within a family by threshold, then
    cluster. At the lowest threshold the allele is the family itself.
    """
    rooted = root_clusters(clusters)
    families = numbered(rooted.select("root").distinct(), "n", F.col("root")).select("root", F.concat(F.lit("g"), padded(F.col("n"), FAMILY_WIDTH)).alias("family"))
    first = F.min("threshold").over(Window.partitionBy("root"))
    place = F.row_number().over(Window.partitionBy("root", "lowest").orderBy("threshold", "cluster"))
    named = rooted.withColumn("lowest", F.col("threshold") == first).withColumn("place", place).join(families, "root")
    allele = F.when(F.col("lowest"), F.col("family")).otherwise(F.concat("family", F.lit("_"), padded(F.col("place"), ALLELE_WIDTH)))
    named = named.select("threshold", "cluster", "family", allele.alias("allele"))
    return clusters.join(named, ["threshold", "cluster"]).select("locus", "family", "threshold", "allele", "genome")


def with_genomes(rows: DataFrame, genomes: DataFrame) -> DataFrame:
    """rows (locus, ...) with the genome that genome2loci (locus, genome) gives; loci that it lacks have no row."""
    return rows.join(genomes.select("locus", "genome"), "locus")


def with_info(rows: DataFrame, info: DataFrame, *columns: str) -> DataFrame:
    """rows (locus, ...) with columns of info (locus, gene, product, length); null for loci that it lacks."""
    return rows.join(info.select("locus", *columns), "locus", "left")


def first_rows(loci: DataFrame) -> DataFrame:
    """(family, threshold, allele): each family's first allele by threshold, then name."""
    return loci.groupBy("family").agg(F.min(F.struct("threshold", "allele")).alias("m")).select("family", "m.threshold", "m.allele")


def paralog_families(loci: DataFrame) -> DataFrame:
    """(family): those with two loci of a genome in some allele."""
    return loci.groupBy("family", "threshold", "allele", "genome").agg(F.count("*").alias("n")).where("n > 1").select("family").distinct()


def paralog_clusters_per_threshold(loci: DataFrame) -> DataFrame:
    """(threshold, n_paralog_clusters)."""
    each = loci.groupBy("threshold", "allele", "genome").agg(F.count("*").alias("n")).groupBy("threshold", "allele").agg(F.max("n").alias("most"))
    return each.groupBy("threshold").agg(F.sum(F.when(F.col("most") > 1, 1).otherwise(0)).cast("long").alias("n_paralog_clusters"))


def core_clusters(clusters: DataFrame, n_genomes: int) -> DataFrame:
    """(cluster): one locus in every genome."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("n_loci"), F.count_distinct("genome").alias("n_genomes")).where((F.col("n_loci") == n_genomes) & (F.col("n_genomes") == n_genomes)).select("cluster")


def cluster_alleles(loci: DataFrame) -> DataFrame:
    """(family, threshold, allele, genome, loci, n_loci): cells of families without paralogs, loci in order."""
    clean = loci.join(paralog_families(loci), "family", "left_anti")
    return clean.groupBy("family", "threshold", "allele", "genome").agg(F.array_join(F.array_sort(F.collect_list("locus")), " ").alias("loci"), F.count("*").alias("n_loci"))


def next_alleles(loci: DataFrame) -> DataFrame:
    """The loci list with next_allele: the locus' allele at the next threshold."""
    return loci.withColumn("next_allele", F.lead("allele").over(Window.partitionBy("locus").orderBy("threshold")))


def split_signature(loci: DataFrame) -> DataFrame:
    """(family, threshold, n_children): clusters of the next threshold that the family's clusters fall into."""
    return next_alleles(loci).where("next_allele is not null").groupBy("family", "threshold").agg(F.count_distinct("next_allele").alias("n_children"))


def unique_alleles(loci: DataFrame) -> DataFrame:
    """(family, allele, threshold): alleles that split at the next threshold, and the ends of the last transition.

    A cluster with several clusters at the next threshold is unique, and so is every cluster at the top. A family with
    one cluster at the top has that one only.
    """
    top = F.broadcast(loci.agg(F.max("threshold").alias("top")))
    children = next_alleles(loci).groupBy("family", "threshold", "allele").agg(F.count_distinct("next_allele").alias("children"))
    return children.crossJoin(top).where("children > 1 or threshold = top").select("family", "allele", "threshold")


def with_categories(loci: DataFrame, categories: DataFrame | None) -> DataFrame:
    """The loci list with ff_group, null for a locus that is no fragment."""
    if categories is None:
        return loci.withColumn("ff_group", F.lit(None).cast("int"))
    known = categories.select("locus", F.when(F.col("ff_group") > 0, F.col("ff_group")).cast("int").alias("ff_group"))
    return loci.join(known, "locus", "left")


def copy_id() -> Column:
    """What counts as one gene copy of a genome: a locus, or all fragments of a group."""
    return F.coalesce(F.concat(F.lit("ff"), F.col("ff_group")), F.col("locus"))


def doses(loci: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """(family, threshold, allele, genome, dose, n_loci, n_groups): gene copies, loci, and copies of several fragments, of each genome.

    A fission group counts in an allele only if two of its loci or more are in that allele.
    """
    keys = ["family", "threshold", "allele", "genome"]
    copies = with_categories(loci, categories).groupBy(*keys, copy_id().alias("copy")).agg(F.count("*").alias("n"))
    return copies.groupBy(*keys).agg(F.count("*").alias("dose"), F.sum("n").alias("n_loci"), F.sum((F.col("n") > 1).cast("long")).alias("n_groups"))


def allele_stats(loci: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """A row for each allele: genomes, average, least and largest dose, and what is split or duplicated.

    number_fission_loci counts copies of several fragments, number_duplicated_loci the copies that genomes have beyond
    their first, and no_loci copies; n_true_loci counts loci.
    """
    d = doses(loci, categories)
    return d.groupBy("family", "threshold", "allele").agg(
        F.count("*").alias("number_genomes"),
        F.avg("dose").alias("average_dose"),
        F.min("dose").alias("min_dose"),
        F.max("dose").alias("max_dose"),
        F.sum(F.when(F.col("n_groups") > 0, 1).otherwise(0)).cast("long").alias("genomes_containing_fissions"),
        F.sum(F.when(F.col("dose") > 1, 1).otherwise(0)).cast("long").alias("genomes_containing_duplications"),
        F.sum("n_groups").alias("number_fission_loci"),
        F.sum(F.col("dose") - 1).alias("number_duplicated_loci"),
        F.sum("dose").alias("no_loci"),
        F.sum("n_loci").alias("n_true_loci"),
    )


def lengths(loci: DataFrame, info: DataFrame) -> DataFrame:
    """(allele, threshold, min_length, max_length, average_length) over loci (locus, length)."""
    return loci.join(info.select("locus", "length"), "locus").groupBy("threshold", "allele").agg(
        F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.avg("length").alias("average_length"))


def name_counts(loci: DataFrame, info: DataFrame, column: str) -> DataFrame:
    """(threshold, allele, name, n): how often each value of info's column occurs; null for what is missing or empty."""
    name = F.when(F.col(column) != "", F.col(column))
    return with_info(loci, info, column).groupBy("threshold", "allele", name.alias("name")).agg(F.count("*").alias("n"))


def named(loci: DataFrame, info: DataFrame, column: str) -> DataFrame:
    """(threshold, allele, consensus, counted) by names' counts.

    consensus: the most frequent name, the first by name of ties; null if none is known. counted: `name(n):name(n)` by
    falling count, then name; missing ones as NA.
    """
    counts = name_counts(loci, info, column).select("threshold", "allele", F.struct((-F.col("n")).alias("m"), F.coalesce("name", F.lit("NA")).alias("name"), F.col("name").isNull().alias("none")).alias("x"))
    items = counts.groupBy("threshold", "allele").agg(F.array_sort(F.collect_list("x")).alias("items"))
    text = F.array_join(F.transform("items", lambda x: F.concat(x["name"], F.lit("("), (-x["m"]).cast("string"), F.lit(")"))), ":")
    return items.select("threshold", "allele", F.get(F.filter("items", lambda x: ~x["none"]), F.lit(0))["name"].alias("consensus"), text.alias("counted"))


def consensus(loci: DataFrame, info: DataFrame, column: str) -> DataFrame:
    """(threshold, allele, consensus)."""
    return named(loci, info, column).drop("counted")


def counted_list(loci: DataFrame, info: DataFrame, column: str) -> DataFrame:
    """(threshold, allele, counted)."""
    return named(loci, info, column).drop("consensus")


def alleles_at_maximum(loci: DataFrame) -> DataFrame:
    """(family, alleles_at_maximum_threshold)."""
    top = F.broadcast(loci.agg(F.max("threshold").alias("top")))
    at = F.when(F.col("threshold") == F.col("top"), F.col("allele"))
    return loci.crossJoin(top).groupBy("family").agg(F.count_distinct(at).alias("alleles_at_maximum_threshold"))


def genomes_per_allele(loci: DataFrame) -> DataFrame:
    return loci.groupBy("allele", "family", "threshold").agg(F.count_distinct("genome").alias("n_genomes"))


def presence(loci: DataFrame) -> DataFrame:
    """(family, threshold, allele, genome): each allele that a genome has."""
    return loci.select("family", "threshold", "allele", "genome").distinct()


def family_rows(unique: DataFrame) -> DataFrame:
    """(family, allele, threshold): each family's first unique allele, by number and not by text."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(allele, '_([0-9]+)$', 1) AS BIGINT)"), F.lit(0))
    order = Window.partitionBy("family").orderBy("threshold", number, "allele")
    return unique.withColumn("r", F.row_number().over(order)).where("r = 1").select("family", "allele", "threshold")


def cells(loci: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """(family, threshold, allele, genome, cell): `a;b;(c:d)`."""
    rows = with_categories(loci, categories)
    copies = rows.groupBy("family", "threshold", "allele", "genome", copy_id().alias("copy")).agg(F.collect_list("locus").alias("fragments"))
    return copies.groupBy("family", "threshold", "allele", "genome").agg(cell_text(F.collect_list("fragments")).alias("cell"))


def family_table(loci: DataFrame, info: DataFrame, categories: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """A row with the metadata of each of `rows` (family, allele, threshold), by default each family's own.

    info: (locus, gene, product, length). Genomes' cells stay apart, in cells(): a pivot belongs into the sink.
    """
    rows = family_rows(unique_alleles(loci)) if rows is None else rows
    mine = checkpoint(loci.join(rows.select("allele", "threshold"), ["allele", "threshold"], "left_semi"))
    keys = ["threshold", "allele"]
    out = allele_stats(mine, categories).join(lengths(mine, info), keys, "left").join(alleles_at_maximum(loci), "family")
    for column, one, many in (("gene", "consensus_gene_name", "gene_names"), ("product", "consensus_product", "products")):
        out = out.join(named(mine, info, column).withColumnsRenamed({"consensus": one, "counted": many}), keys, "left")
    return out.select(
        F.col("allele").alias("allele_name"), F.col("family").alias("gene_family"), "consensus_gene_name", "consensus_product", "threshold", "alleles_at_maximum_threshold",
        "number_genomes", "average_dose", "min_dose", "max_dose", "genomes_containing_fissions", "genomes_containing_duplications", "number_fission_loci",
        "number_duplicated_loci", "no_loci", "n_true_loci", "products", "gene_names", "min_length", "max_length", "average_length")
