"""Queries on filters, joins and tables for other programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.names import numbered
from strandline.operators import families as fam
from strandline.operators import clustering, filters, paralogs, tools
from strandline.plans.projections import LIST, categories, clusters, hits, info, loci, loci_list, representatives, sql, table

QUERIES, SQL = {}, {}


def query(name: str, parts: list[str], select: str | None, recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if select is not None:
            SQL[name] = sql(parts, select, recursive)
        return f

    return keep


STATS = [*LIST, "categories", "doses", "stats"]
TABLE = [*STATS, "children", "unique_alleles", "family_rows", "names", "lengths", "at_top", "table"]
N = ", n AS (SELECT count(DISTINCT genome) AS n FROM loci_list)"
FREQUENT = N + """, framed AS (
    SELECT *, min(threshold) OVER (PARTITION BY family) AS lo, max(threshold) OVER (PARTITION BY family) AS hi, max(CASE WHEN threshold = 50 THEN number_genomes / n END) OVER (PARTITION BY family) AS share FROM stats, n
), by_family AS (SELECT * EXCLUDE (n, lo, hi, share) FROM framed WHERE share BETWEEN 0.4 AND 1 AND (threshold > lo OR lo = hi))"""


def stats(s, d):
    return fam.allele_stats(loci_list(s, d), categories(s, d))


def genomes(s, d):
    return loci(s, d).select("genome").distinct().count()


def _table(s, d):
    return fam.family_table(loci_list(s, d), info(s, d), categories(s, d))


query("filter_pident", ["hits"], "SELECT hits.*, threshold FROM hits JOIN (SELECT unnest([50, 70, 90]) AS threshold) ON pident >= threshold")(lambda s, d: filters.by_identity(hits(s, d), (50, 70, 90)))
query("force_self_identity", ["hits"], "SELECT * REPLACE (CASE WHEN q = s THEN 100 ELSE pident END AS pident) FROM hits")(lambda s, d: filters.force_self_identity(hits(s, d)))
FOLD = "CASE WHEN {0} > 1 THEN 2 - {0} ELSE {0} END"
query("filter_hsp_length", ["hits"], f"SELECT * FROM hits WHERE q = s OR {FOLD.format('((qend - qstart + 1) / qlen)')} > 0.7")(lambda s, d: filters.by_hsp_length(hits(s, d), 0.7))
PROP = f"SELECT * FROM hits WHERE q = s OR ({FOLD.format('(qlen / (abs(send - sstart) + 1))')} > 0.7 AND {FOLD.format('((qend - qstart + 1) / (abs(send - sstart) + 1))')} > 0.7)"
query("filter_hsp_prop", ["hits"], PROP)(lambda s, d: filters.by_hsp_proportion(hits(s, d), 0.7))
MISSING = "SELECT locus, locus, 100, length, 0, 0, 1, length, 1, length, 0, 2335, length, length FROM reps WHERE locus NOT IN (SELECT q FROM hits WHERE q = s)"
query("anti_missing_self", ["hits", "reps"], f"SELECT * FROM hits UNION ALL {MISSING}")(lambda s, d: filters.add_missing_self(hits(s, d), representatives(s, d)))
query("union_self_hits", ["hits", "reps"], f"SELECT q, s, pident FROM hits WHERE q = s UNION ALL SELECT a, a, 100 FROM ({MISSING}) m(a, b, c, e, f, g, h, i, j, k, l, m, n, o)")(
    lambda s, d: filters.add_missing_self(hits(s, d), representatives(s, d)).where("q = s").select("q", "s", "pident"))
query("hits_normalise", ["hits", "reps"], f"SELECT * REPLACE (CASE WHEN q = s THEN 100 ELSE pident END AS pident) FROM ({PROP.replace('SELECT *', 'SELECT *')}) UNION ALL {MISSING}")(
    lambda s, d: filters.normalise_hits(hits(s, d), representatives(s, d), hsp_proportion=0.7))


def hit_clusters(s, d):
    return representatives(s, d).select("locus", F.expr("cast(substring(locus, 2) as int) div 10").alias("cluster"))


query("semi_both_endpoints_same_cluster", ["hits", "reps"], "SELECT h.*, CAST(substr(a.locus, 2) AS INT) // 10 AS cluster FROM hits h JOIN reps a ON a.locus = q JOIN reps b ON b.locus = s WHERE CAST(substr(a.locus, 2) AS INT) // 10 = CAST(substr(b.locus, 2) AS INT) // 10")(
    lambda s, d: filters.in_same_cluster(hits(s, d), hit_clusters(s, d)))
query("agg_min_pair_coverage", ["hits"], """SELECT least(q, s) AS a, greatest(q, s) AS b, min(100.0::DOUBLE * length / qlen) AS coverage, arg_min(pident, struct_pack(c := 100.0::DOUBLE * length / qlen, p := pident)) AS pident FROM hits GROUP BY ALL""")(
    lambda s, d: filters.pair_coverage(hits(s, d)))
query("cross_rep_pairs", ["hits", "reps"], """, c AS (SELECT least(q, s) AS a, greatest(q, s) AS b, min(100.0::DOUBLE * length / qlen) AS coverage FROM hits WHERE length < 20 GROUP BY ALL)
SELECT x.locus AS a, y.locus AS b, coalesce(coverage < 10, true) AS apart FROM reps x JOIN reps y ON x.locus < y.locus AND CAST(substr(x.locus, 2) AS INT) // 10 = CAST(substr(y.locus, 2) AS INT) // 10 LEFT JOIN c ON c.a = x.locus AND c.b = y.locus""")(
    lambda s, d: paralogs.apart(hit_clusters(s, d), hits(s, d).where("length < 20")))
query("filter_dosage", STATS, "SELECT * FROM stats WHERE average_dose <= 1.1")(lambda s, d: filters.by_dosage(stats(s, d), 1.1))
query("filter_prevalence", STATS, N + "SELECT * EXCLUDE n FROM stats, n WHERE 100.0 * number_genomes / n BETWEEN 20 AND 60")(lambda s, d: filters.by_prevalence(stats(s, d), genomes(s, d), 20, 60))
query("filter_allele_freq", STATS, N + "SELECT * EXCLUDE n FROM stats, n WHERE number_genomes / n BETWEEN 0.05 AND 0.95")(lambda s, d: filters.by_allele_frequency(stats(s, d), genomes(s, d)))
query("filter_family_freq", STATS, FREQUENT + "SELECT * FROM by_family")(lambda s, d: filters.by_family_frequency(stats(s, d), genomes(s, d), 0.4, 1))
query("filter_family_regex", LIST, "SELECT * FROM loci_list WHERE regexp_matches(family, '^g0000[1-3]$')")(lambda s, d: filters.by_family_pattern(loci_list(s, d), "^g0000[1-3]$"))
query("filter_samples", LIST, "SELECT * FROM loci_list WHERE genome IN (SELECT DISTINCT genome FROM loci WHERE event_id % 97 = 0)")(lambda s, d: filters.by_samples(loci_list(s, d), loci(s, d).where("event_id % 97 = 0")))
query("intersect_samples", ["loci"], "SELECT w AS genome, w IN (SELECT genome FROM loci) AS found FROM (SELECT unnest(['u00001', 'u00002', 'none']) AS w)")(
    lambda s, d: filters.missing_samples(s.createDataFrame([("u00001",), ("u00002",), ("none",)], "genome string"), loci(s, d)))


def results(s, d):
    return loci_list(s, d).groupBy(F.col("allele").alias("locus")).agg((F.count("*") % 100 / 100).alias("pvalue"))


RESULTS = ", results AS (SELECT allele AS locus, count(*) % 100 / 100 AS pvalue FROM loci_list GROUP BY allele)"
query("filter_pvalue", LIST, RESULTS + "SELECT * FROM results WHERE pvalue <= 0.05")(lambda s, d: filters.by_p_value(results(s, d), 0.05))
query("join_annotate", TABLE, RESULTS + "SELECT r.*, gene_family, consensus_gene_name, consensus_product FROM results r LEFT JOIN (SELECT allele AS locus, family AS gene_family, consensus_gene_name, consensus_product FROM family_table) USING (locus)")(
    lambda s, d: tools.annotate(results(s, d), _table(s, d)))
query("tool_annotate", TABLE, RESULTS + "SELECT r.*, gene_family, consensus_gene_name, consensus_product FROM results r LEFT JOIN (SELECT allele AS locus, family AS gene_family, consensus_gene_name, consensus_product FROM family_table) USING (locus) WHERE pvalue <= 0.5")(
    lambda s, d: tools.annotate(filters.by_p_value(results(s, d), 0.5), _table(s, d)))
RTAB = FREQUENT.replace("share BETWEEN 0.4 AND 1", "share BETWEEN 0 AND 1") + ", chosen AS (SELECT threshold, allele FROM by_family, n WHERE number_genomes / n BETWEEN 0.05 AND 0.95)"
query("tool_rtab", STATS, RTAB + "SELECT DISTINCT family, threshold, allele, genome FROM loci_list JOIN chosen USING (threshold, allele)")(lambda s, d: tools.rtab(loci_list(s, d), categories=categories(s, d)))
query("tool_paralog_rtab", [*LIST, "categories"], """, g AS (SELECT family, threshold, allele, genome, ff_group, count(*) - 1 AS m FROM loci_list JOIN categories USING (locus) WHERE ff_group IS NOT NULL GROUP BY ALL)
SELECT family, threshold, allele, genome, CAST(sum(m) AS BIGINT) AS n FROM g GROUP BY ALL HAVING sum(m) > 0""")(lambda s, d: tools.paralog_rtab(loci_list(s, d), categories(s, d)))
SQL["agg_ff_count"], QUERIES["agg_ff_count"] = SQL["tool_paralog_rtab"], QUERIES["tool_paralog_rtab"]
query("agg_dup_count", [*LIST, "categories", "doses"], "SELECT family, threshold, allele, genome, dose - 1 AS n FROM doses WHERE dose > 1")(lambda s, d: tools.paralog_rtab(loci_list(s, d), categories(s, d), "d"))
DISTANCE = """, a AS (SELECT DISTINCT genome, threshold, allele FROM loci_list), b AS (SELECT x.genome AS g1, y.genome AS g2, count(*) AS n_both FROM a x JOIN a y USING (threshold, allele) GROUP BY ALL), c AS (SELECT genome, count(*) AS n FROM a GROUP BY genome)
SELECT x.genome AS g1, y.genome AS g2, """
query("tool_distmat", LIST, DISTANCE + "x.n + y.n - 2 * coalesce(n_both, 0) AS d FROM c x CROSS JOIN c y LEFT JOIN b ON g1 = x.genome AND g2 = y.genome")(lambda s, d: tools.distances(loci_list(s, d)))
query("tool_distmat_sim", LIST, DISTANCE + "coalesce(n_both, 0) AS d FROM c x CROSS JOIN c y LEFT JOIN b ON g1 = x.genome AND g2 = y.genome")(lambda s, d: tools.distances(loci_list(s, d), True))
query("cross_genome_pairs", LIST, DISTANCE.replace("FROM loci_list)", "FROM loci_list WHERE threshold = 50)") + "x.n + y.n - 2 * coalesce(n_both, 0) AS d FROM c x CROSS JOIN c y LEFT JOIN b ON g1 = x.genome AND g2 = y.genome")(
    lambda s, d: tools.distances(loci_list(s, d).where("threshold = 50"), tile=100))
query("tool_roary", TABLE, """SELECT allele || '__' || family AS gene, coalesce(consensus_gene_name, '') AS non_unique_gene_name, coalesce(consensus_product, '') AS annotation, number_genomes AS n_isolates, no_loci AS n_sequences, average_dose AS average_per_isolate,
    min_length, max_length, average_length FROM family_table""")(lambda s, d: tools.roary(_table(s, d)))
query("tool_treewas", LIST, """, p AS (SELECT DISTINCT genome, allele FROM loci_list WHERE threshold = 50) SELECT genome, allele, CASE WHEN p.allele IS NULL THEN 0 ELSE 1 END AS value
FROM (SELECT DISTINCT genome FROM loci) CROSS JOIN (SELECT DISTINCT allele FROM p) LEFT JOIN p USING (genome, allele)""")(lambda s, d: tools.treewas(fam.presence(loci_list(s, d)).where("threshold = 50"), loci(s, d)))
SQL["tool_treewas"] = SQL["tool_treewas"].replace("p.allele IS NULL", "p.genome IS NULL")
query("tool_variants_treewas", LIST, N + """, g AS (SELECT family, threshold, allele, count(DISTINCT genome) AS m FROM loci_list GROUP BY ALL), w AS (
    SELECT *, threshold = 50 AS lowest, m / n AS share, max(CASE WHEN threshold = 50 THEN m / n END) OVER (PARTITION BY family) AS fs FROM g, n
), chosen AS (SELECT CASE WHEN lowest THEN 'accessory' WHEN fs >= 0.95 THEN 'core_alleles' ELSE 'accessory_alleles' END AS kind, threshold, allele FROM w WHERE share BETWEEN 0.05 AND 0.95 AND (NOT lowest OR fs < 0.95))
SELECT DISTINCT kind, allele, genome FROM loci_list JOIN chosen USING (threshold, allele)""")(lambda s, d: tools.variants(loci_list(s, d)))  # fmt: skip
query("sink_binary_fasta", LIST, """, p AS (SELECT DISTINCT genome, family FROM loci_list) SELECT genome, string_agg(CASE WHEN p.genome IS NULL THEN 'C' ELSE 'A' END, '' ORDER BY family) AS seq
FROM (SELECT DISTINCT genome FROM loci) CROSS JOIN (SELECT DISTINCT family FROM p) LEFT JOIN p USING (genome, family) GROUP BY genome""".replace("p.genome IS NULL", "p.there IS NULL").replace("SELECT DISTINCT genome, family FROM loci_list", "SELECT DISTINCT genome, family, 1 AS there FROM loci_list"))(
    lambda s, d: tools.binary_sequences(loci_list(s, d), loci(s, d)))
SQL["tool_treewas"] = SQL["tool_treewas"].replace("p.genome IS NULL", "p.there IS NULL").replace("SELECT DISTINCT genome, allele FROM loci_list", "SELECT DISTINCT genome, allele, 1 AS there FROM loci_list")
query("top1_longest_rep", ["loci", "clusters", "loci_list"], "SELECT family, locus, genome, length FROM (SELECT DISTINCT family, locus, l.genome, length FROM loci_list l JOIN loci USING (locus)) QUALIFY row_number() OVER (PARTITION BY family ORDER BY length DESC, genome, locus) = 1")(
    lambda s, d: tools.representatives(loci_list(s, d), info(s, d)))
SQL["tool_representative"], QUERIES["tool_representative"] = SQL["top1_longest_rep"], QUERIES["top1_longest_rep"]
query("sort_len_desc", ["loci"], "SELECT locus, length, row_number() OVER (ORDER BY length DESC, locus) AS row FROM loci")(lambda s, d: numbered(info(s, d).select("locus", "length"), "row", F.desc("length"), F.col("locus")))
query("semi_paralog", LIST, "SELECT * FROM loci_list WHERE family IN (SELECT family FROM loci_list GROUP BY family, threshold, allele, genome HAVING count(*) > 1)")(
    lambda s, d: loci_list(s, d).join(fam.paralog_families(loci_list(s, d)), "family", "left_semi"))
query("anti_paralog_union_split", LIST, """, p AS (SELECT DISTINCT family FROM loci_list WHERE family < 'g00010') SELECT * FROM loci_list WHERE family NOT IN (SELECT family FROM p)
UNION ALL SELECT locus, family || '_1', threshold, allele, genome FROM loci_list WHERE family IN (SELECT family FROM p)""")(
    lambda s, d: (lambda l: l.join(l.where("family < 'g00010'").select("family").distinct(), "family", "left_anti").select(*l.columns).unionByName(l.where("family < 'g00010'").withColumn("family", F.concat("family", F.lit("_1")))))(loci_list(s, d)))
def cores(s, d):
    """Some loci as cores: (cluster, locus)."""
    return loci(s, d).where("f < 5").select(F.col("f").cast("string").alias("cluster"), "locus")


def firsts(s, d):
    """The highest clusters as members (cluster, locus) of their first locus."""
    c = clusters(s, d).where("threshold = 90")
    return c.join(c.groupBy("cluster").agg(F.min("locus").alias("rep")), "cluster").select(F.col("rep").alias("cluster"), "locus")


query("anti_core", ["loci", "clusters"], "SELECT threshold, cluster, locus FROM clusters WHERE threshold = 70 AND locus NOT IN (SELECT locus FROM loci WHERE f < 5)")(
    lambda s, d: clustering.without(clusters(s, d).where("threshold = 70"), cores(s, d)).select("threshold", "cluster", "locus"))
query("join_cdhit_expand", ["loci", "clusters"], ", r AS (SELECT cluster, min(locus) AS rep FROM clusters WHERE threshold = 90 GROUP BY cluster) SELECT threshold, cluster, locus FROM clusters WHERE threshold < 90")(
    lambda s, d: clustering.expanded(clusters(s, d).where("threshold < 90").join(firsts(s, d).select(F.col("cluster").alias("locus")).distinct(), "locus", "left_semi"), firsts(s, d)))
query("union_core_clusters", ["loci", "clusters"], "SELECT threshold, cluster, locus FROM clusters WHERE locus NOT IN (SELECT locus FROM loci WHERE f < 5) UNION ALL SELECT unnest([50, 70, 90]), 'core_' || f, locus FROM loci WHERE f < 5")(
    lambda s, d: clustering.with_cores(clustering.without(clusters(s, d), cores(s, d)).select("threshold", "cluster", "locus"), cores(s, d), (50, 70, 90)))
query("except_check", LIST, "SELECT locus FROM loci EXCEPT SELECT locus FROM loci_list WHERE threshold = 50")(lambda s, d: loci(s, d).select("locus").join(loci_list(s, d).where("threshold = 50"), "locus", "left_anti"))
query("win_first_row_of_family", LIST, "SELECT family, threshold, allele FROM (SELECT DISTINCT family, threshold, allele FROM loci_list) QUALIFY row_number() OVER (PARTITION BY family ORDER BY threshold, allele) = 1")(
    lambda s, d: fam.first_rows(loci_list(s, d)))
query("agg_recount_genomes", [*LIST, "categories"], ", k AS (SELECT * FROM loci_list WHERE genome IN (SELECT DISTINCT genome FROM loci WHERE event_id % 97 = 0)) SELECT DISTINCT threshold, allele, count(DISTINCT genome) OVER (PARTITION BY threshold, allele) AS number_genomes FROM k")(
    lambda s, d: tools.recounted(filters.by_samples(loci_list(s, d), loci(s, d).where("event_id % 97 = 0"))))
query("tool_subsample", [*LIST, "categories"], """, k AS (SELECT * FROM loci_list WHERE genome IN (SELECT DISTINCT genome FROM loci WHERE event_id % 97 = 0)), n AS (SELECT threshold, allele, count(DISTINCT genome) AS number_genomes FROM k GROUP BY ALL),
copies AS (SELECT family, threshold, allele, genome, coalesce('ff' || ff_group, locus) AS copy, string_agg(locus, ':' ORDER BY locus) AS x, count(*) AS m FROM k LEFT JOIN categories USING (locus) GROUP BY ALL)
SELECT c.family, threshold, allele, genome, number_genomes, string_agg(CASE WHEN m > 1 THEN '(' || x || ')' ELSE x END, ';' ORDER BY CASE WHEN m > 1 THEN '(' || x || ')' ELSE x END) AS cell FROM copies c JOIN n USING (threshold, allele) GROUP BY ALL""")(
    lambda s, d: tools.subsample(fam.cells(loci_list(s, d), categories(s, d)), loci(s, d).where("event_id % 97 = 0").select("genome").distinct()))
query("join_rename_field", LIST, "SELECT coalesce(gene || '_' || event_id, l.locus) AS locus, family, threshold, allele, l.genome FROM loci_list l JOIN loci USING (locus)")(
    lambda s, d: tools.rename_loci(loci_list(s, d), loci(s, d).select("genome", "locus", F.concat("gene", F.lit("_"), F.col("event_id").cast("string")).alias("name"))))
query("tool_loci_subset", LIST, "SELECT * FROM loci_list WHERE family IN ('g00001', 'g00007')")(lambda s, d: tools.loci_subset(loci_list(s, d), s.createDataFrame([("g00001",), ("g00007",)], "family string")))
SQL["semi_loci_in_family"], QUERIES["semi_loci_in_family"] = SQL["tool_loci_subset"], QUERIES["tool_loci_subset"]
query("tool_blast_subset", ["hits", "reps"], "SELECT * FROM hits WHERE q IN (SELECT locus FROM reps WHERE length > 20) AND s IN (SELECT locus FROM reps WHERE length > 20)")(lambda s, d: tools.hit_subset(hits(s, d), representatives(s, d).where("length > 20")))
SQL["semi_blast_in_family"], QUERIES["semi_blast_in_family"] = SQL["tool_blast_subset"], QUERIES["tool_blast_subset"]


def spans(s, d):
    return table(s, d, "part").selectExpr("concat('f', p_partkey) name", "p_partkey * 40 start", "p_partkey * 40 + p_size * 3 end")


query("range_join_pos_feature", [], """SELECT pos, arg_max(name, struct_pack(s := start, n := name)) AS name FROM (SELECT DISTINCT l_partkey * 37 AS pos FROM lineitem) LEFT JOIN
(SELECT 'f' || p_partkey AS name, p_partkey * 40 AS start, p_partkey * 40 + p_size * 3 AS stop FROM part) ON pos BETWEEN start AND stop GROUP BY pos""")(
    lambda s, d: tools.position_features(table(s, d, "lineitem").selectExpr("l_partkey * 37 pos").distinct(), spans(s, d)))
