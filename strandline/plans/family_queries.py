"""Queries on families and alleles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import families as fam
from strandline.operators import summary
from strandline.plans.projections import LIST, categories, clusters, info, loci, loci_list, sql

QUERIES, SQL = {}, {}


def query(name: str, parts: list[str], select: str | None, recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if select is not None:
            SQL[name] = sql(parts, select, recursive) if parts else select
        return f

    return keep


STATS = [*LIST, "categories", "doses", "stats"]
LINKED = [*LIST, "children", "unique_alleles"]
TABLE = [*STATS, "children", "unique_alleles", "family_rows", "names", "lengths", "at_top", "table"]

query("join_locus_genome", ["loci"], "SELECT locus, genome, f AS family FROM loci")(lambda s, d: fam.with_genomes(loci(s, d).select("locus", F.col("f").alias("family")), loci(s, d)))
query("join_locus_info", LIST, "SELECT l.locus, l.allele, gene, product, length FROM loci_list l LEFT JOIN loci USING (locus) WHERE threshold = 90")(
    lambda s, d: fam.with_info(loci_list(s, d).where("threshold = 90").select("locus", "allele"), info(s, d), "gene", "product", "length"))
query("distinct_genomes", ["loci"], "SELECT DISTINCT genome FROM loci")(lambda s, d: loci(s, d).select("genome").distinct())
query("name_clusters", LIST, "SELECT * FROM loci_list")(loci_list)
query("win_family_number", LIST, "SELECT DISTINCT cluster, family FROM clusters JOIN numbered USING (threshold, cluster) WHERE threshold = 50")(
    lambda s, d: clusters(s, d).join(loci_list(s, d).select("locus", "family", "threshold"), ["locus", "threshold"]).where("threshold = 50").select("cluster", "family").distinct())
query("win_allele_number", LIST, "SELECT DISTINCT family, threshold, allele, place AS number FROM (SELECT family, threshold, family || '_' || lpad(CAST(place AS VARCHAR), 4, '0') AS allele, place FROM numbered WHERE threshold > 50)")(
    lambda s, d: loci_list(s, d).where("threshold > 50").select("family", "threshold", "allele", F.regexp_extract("allele", r"_(\d+)$", 1).cast("long").alias("number")).distinct())
query("join_root_family", ["loci", "clusters"], "SELECT threshold, cluster, min(root) AS root FROM (SELECT *, first_value(cluster) OVER (PARTITION BY locus ORDER BY threshold) AS root FROM clusters) GROUP BY ALL")(
    lambda s, d: fam.root_clusters(clusters(s, d)))
query("agg_paralog_families", LIST, "SELECT DISTINCT family FROM (SELECT family FROM loci_list GROUP BY family, threshold, allele, genome HAVING count(*) > 1)")(lambda s, d: fam.paralog_families(loci_list(s, d)))
query("agg_paralog_count_per_threshold", LIST, "SELECT threshold, count(*) FILTER (most > 1) AS n_paralog_clusters FROM (SELECT threshold, allele, max(n) AS most FROM (SELECT threshold, allele, genome, count(*) AS n FROM loci_list GROUP BY ALL) GROUP BY ALL) GROUP BY ALL")(
    lambda s, d: fam.paralog_clusters_per_threshold(loci_list(s, d)))


@query("agg_core_clusters", ["loci"], """, c AS (SELECT f // 10 AS cluster, genome FROM loci QUALIFY row_number() OVER (PARTITION BY f // 10, genome ORDER BY locus) = 1)
SELECT CAST(cluster AS VARCHAR) AS cluster FROM c GROUP BY cluster HAVING count(*) = (SELECT count(DISTINCT genome) FROM loci) AND count(DISTINCT genome) = (SELECT count(DISTINCT genome) FROM loci)""")  # fmt: skip
def agg_core_clusters(s, d):
    rows = loci(s, d)
    n = rows.select("genome").distinct().count()
    one = rows.withColumn("cluster", F.expr("f div 10")).groupBy("cluster", "genome").agg(F.min("locus").alias("locus"))
    return fam.core_clusters(one, n).select(F.col("cluster").cast("string").alias("cluster"))


def single_copies(s, d):
    """The loci list where every second family has one locus of each genome only."""
    rows = loci_list(s, d)
    first = rows.where("threshold = 50").groupBy("family", "genome").agg(F.min("locus").alias("locus"))
    odd = F.expr("cast(substring(family, 2) as int) % 2 = 1")
    return rows.where(odd).unionByName(rows.where(~odd).join(first.select("locus"), "locus", "left_semi").select(*rows.columns))


SINGLE = """, single AS (SELECT * FROM loci_list WHERE CAST(substr(family, 2) AS INT) % 2 = 1 OR locus IN (SELECT min(locus) FROM loci_list WHERE threshold = 50 GROUP BY family, genome))"""
query("agg_cluster_alleles", LIST, SINGLE + """ SELECT family, threshold, allele, genome, string_agg(locus, ' ' ORDER BY locus) AS loci, count(*) AS n_loci FROM single
WHERE family NOT IN (SELECT family FROM single GROUP BY family, threshold, allele, genome HAVING count(*) > 1) GROUP BY ALL""")(lambda s, d: fam.cluster_alleles(single_copies(s, d)))  # fmt: skip
query("join_threshold_next", [*LIST, "children"], "SELECT locus, family, threshold, allele, genome, next_allele FROM linked")(lambda s, d: fam.next_alleles(loci_list(s, d)))
query("agg_split_signature", [*LIST, "children"], "SELECT family, threshold, count(DISTINCT next_allele) AS n_children FROM linked WHERE next_allele IS NOT NULL GROUP BY ALL")(lambda s, d: fam.split_signature(loci_list(s, d)))
query("link_alleles", LINKED, "SELECT * FROM unique_alleles")(lambda s, d: fam.unique_alleles(loci_list(s, d)))
query("top1_family_row", [*LINKED, "family_rows"], "SELECT * FROM family_rows")(lambda s, d: fam.family_rows(fam.unique_alleles(loci_list(s, d))))
query("agg_dose", STATS, "SELECT * FROM doses")(lambda s, d: fam.doses(loci_list(s, d), categories(s, d)))
query("agg_allele_stats", STATS, "SELECT * FROM stats")(lambda s, d: fam.allele_stats(loci_list(s, d), categories(s, d)))
query("agg_lengths", [*LIST, "lengths"], "SELECT * FROM lengths")(lambda s, d: fam.lengths(loci_list(s, d), info(s, d)))
query("agg_consensus", [*LIST, "names"], "SELECT threshold, allele, name AS consensus FROM gene_best")(lambda s, d: fam.consensus(loci_list(s, d), info(s, d), "gene"))
query("agg_counted_list", [*LIST, "names"], "SELECT * FROM product_lists")(lambda s, d: fam.counted_list(loci_list(s, d), info(s, d), "product"))
query("agg_alleles_at_max", [*LIST, "at_top"], "SELECT * FROM at_top")(lambda s, d: fam.alleles_at_maximum(loci_list(s, d)))
query("agg_genomes_per_allele", LIST, "SELECT allele, family, threshold, count(DISTINCT genome) AS n_genomes FROM loci_list GROUP BY ALL")(lambda s, d: fam.genomes_per_allele(loci_list(s, d)))
query("agg_presence", LIST, "SELECT DISTINCT family, threshold, allele, genome FROM loci_list")(lambda s, d: fam.presence(loci_list(s, d)))
query("gene_families", TABLE, "SELECT allele AS allele_name, family AS gene_family, * EXCLUDE (allele, family) FROM family_table")(lambda s, d: fam.family_table(loci_list(s, d), info(s, d), categories(s, d)))
query("family_cells", [*LIST, "categories"], """, copies AS (SELECT family, threshold, allele, genome, coalesce('ff' || ff_group, locus) AS copy, string_agg(locus, ':' ORDER BY locus) AS x, count(*) AS n FROM loci_list LEFT JOIN categories USING (locus) GROUP BY ALL)
SELECT family, threshold, allele, genome, string_agg(CASE WHEN n > 1 THEN '(' || x || ')' ELSE x END, ';' ORDER BY CASE WHEN n > 1 THEN '(' || x || ')' ELSE x END) AS cell FROM copies GROUP BY ALL""")(
    lambda s, d: fam.cells(loci_list(s, d), categories(s, d)))

BUCKETS = """, most AS (SELECT max(number_genomes) AS m FROM family_table), bucketed AS (
    SELECT t.*, list_filter([10, 25, 50, 75, 90, 95, 100], lambda c: 100.0 * number_genomes / m <= c)[1] AS top FROM family_table t, most)
SELECT top AS bucket_top, count(family) AS n_families, count(*) FILTER (alleles_at_maximum_threshold > 1) AS n_multi_allele, count(*) FILTER (genomes_containing_fissions > 0) AS n_fission, count(*) FILTER (genomes_containing_duplications > 0) AS n_duplication
FROM (SELECT unnest([10, 25, 50, 75, 90, 95, 100]) AS top) LEFT JOIN (SELECT * FROM bucketed) b USING (top) GROUP BY top"""


def _table(s, d):
    return fam.family_table(loci_list(s, d), info(s, d), categories(s, d))


query("agg_summary_buckets", TABLE, BUCKETS)(lambda s, d: summary.buckets(_table(s, d)))
query("agg_sample_counts", LIST, "SELECT genome, count(DISTINCT family) AS n_families FROM loci_list GROUP BY genome")(lambda s, d: summary.families_per_genome(loci_list(s, d)))
query("agg_clusters_per_threshold", LIST, "SELECT threshold, count(DISTINCT allele) AS n_clusters FROM loci_list GROUP BY threshold")(lambda s, d: summary.clusters_per_threshold(loci_list(s, d)))
query("agg_core_accessory", LIST, """, n AS (SELECT threshold, allele, count(DISTINCT genome) AS n FROM loci_list GROUP BY ALL)
SELECT threshold, CASE WHEN n / (SELECT max(n) FROM n) > 0.95 THEN 'core' ELSE 'accessory' END AS kind, count(*) AS n_clusters FROM n GROUP BY ALL""")(lambda s, d: summary.core_accessory(loci_list(s, d)))  # fmt: skip
query("agg_prop_histogram", TABLE, """, m AS (SELECT max(number_genomes) AS m FROM family_table)
SELECT CAST(least(19, floor(number_genomes * 20 / m)) AS BIGINT) AS bin, CASE WHEN alleles_at_maximum_threshold > 1 THEN 'diverged' ELSE 'stable' END AS kind, count(*) AS n_families FROM family_table, m GROUP BY ALL""")(
    lambda s, d: summary.prevalence_histogram(_table(s, d)))
query("agg_ffm_types", STATS, """SELECT threshold, CASE WHEN genomes_containing_fissions > 0 AND genomes_containing_duplications > 0 THEN 'both' WHEN genomes_containing_fissions > 0 THEN 'ff'
    WHEN genomes_containing_duplications > 0 THEN 'multicopy' ELSE 'single' END AS kind, count(*) AS n_alleles FROM stats GROUP BY ALL""")(lambda s, d: summary.copy_kinds(fam.allele_stats(loci_list(s, d), categories(s, d))))  # fmt: skip
query("agg_allele_hist", [*LIST, "at_top"], """SELECT 'all' AS kind, alleles_at_maximum_threshold AS n_alleles, count(*) AS n_families FROM at_top GROUP BY ALL
UNION ALL SELECT 'several', alleles_at_maximum_threshold, count(*) FROM at_top WHERE alleles_at_maximum_threshold > 1 GROUP BY ALL""")(lambda s, d: summary.allele_histogram(fam.alleles_at_maximum(loci_list(s, d))))  # fmt: skip
query("agg_unique_per_threshold", LINKED, "SELECT threshold, count(*) AS n_unique FROM unique_alleles GROUP BY threshold")(lambda s, d: summary.unique_per_threshold(fam.unique_alleles(loci_list(s, d))))
