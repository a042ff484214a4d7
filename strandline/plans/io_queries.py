"""Queries that write files and read them back: sinks give the lines that they wrote, scans what a reader makes of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import sequences as seq
from strandline.functions.names import checkpoint, shared_folder
from strandline.operators import alignment, filters, paralogs, summary, tools, trees
from strandline.operators import families as fam
from strandline.plans.family_queries import SINGLE, single_copies
from strandline.plans.projections import LIST, categories, clusters, hits, info, loci, loci_list, sql, table
from strandline.plans.sequence_queries import ALIGNED, CODE, GFF, aligned, documents, gff_lines, slim_aligned
from strandline.sources import gff, sinks, store, tables

QUERIES, SQL = {}, {}
STATS = [*LIST, "categories", "doses", "stats"]
TABLE = [*STATS, "children", "unique_alleles", "family_rows", "names", "lengths", "at_top", "table"]
TAB = "chr(9)"


def query(name: str, parts: list[str], select: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql(parts, select)
        return f

    return keep


def folder(spark, name: str) -> str:
    """A new place for a query's files."""
    return f"{shared_folder(spark)}/files-{name}-{uuid.uuid4().hex}"


def back(spark, write, name: str = "lines") -> DataFrame:
    """(line) of all files that write(path) has written."""
    write(path := folder(spark, name))
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.col("value").alias("line"))


def read(spark, write, reader, name: str = "table"):
    write(path := folder(spark, name))
    return reader(path)


def contigs(s, d) -> DataFrame:
    """A sequence for each contig of the events' genomes."""
    return loci(s, d).groupBy("genome", "contig").agg(F.repeat(F.lit("ACGTN"), F.count("*").cast("int")).alias("seq"))


def files(s, d) -> DataFrame:
    return read(s, lambda at: sinks.gff(gff.gff_text(gff.features(gff_lines(s, d)), contigs(s, d)), at), lambda at: gff.scan_dir(s, at, "*.txt"))


FILES = f""", {GFF}, f AS (
    SELECT genome, string_agg(concat_ws({TAB}, contig, source, type, start, "end", score, strand, phase, attrs), chr(10) ORDER BY n) AS body, count(*) AS n FROM gff GROUP BY genome
), c AS (SELECT genome, contig, repeat('ACGTN', count(*)::INT) AS seq FROM loci GROUP BY ALL
), g AS (SELECT genome, string_agg('>' || contig || chr(10) || seq, chr(10) ORDER BY contig) AS body FROM c GROUP BY genome
), files AS (SELECT genome, '##gff-version 3' || chr(10) || f.body || chr(10) || '##FASTA' || chr(10) || g.body || chr(10) AS text, n FROM f JOIN g USING (genome)) """
query("scan_gff_dir", ["loci"], FILES + "SELECT genome, text FROM files")(files)
query("sink_gff", ["loci"], FILES + "SELECT unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line FROM files")(lambda s, d: back(s, lambda at: sinks.gff(gff.gff_text(gff.features(gff_lines(s, d)), contigs(s, d)), at)))
query("scan_gff_raw", ["loci"], FILES + """, l AS (SELECT genome, n AS k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM files)
SELECT genome, CAST(n AS INT) AS n, line, CASE WHEN line = '' THEN 'blank' WHEN n = 0 OR n = k + 1 THEN 'pragma' WHEN n <= k THEN 'feature' WHEN line[1] = '>' THEN 'header' ELSE 'sequence' END AS kind FROM l""")(lambda s, d: gff.lines(files(s, d)))  # fmt: skip
query("scan_gff_contigs", ["loci"], FILES + "SELECT * FROM c")(lambda s, d: gff.contigs(gff.lines(files(s, d))))


def coords(s, d) -> DataFrame:
    return gff.coords(gff.features(gff_lines(s, d)))


COORDS = f""", {GFF}, x AS (SELECT genome, 'x' || event_id AS "Name", regexp_replace(coalesce(gene, ''), '_[0-9]+$', '') AS "Gene", start AS "Start", "end" AS "End", "end" - start + 1 AS "Length", type AS "Type",
CASE WHEN strand = '-' THEN 'Reverse' ELSE 'Forward' END AS "Strand", contig AS "Contig", product AS "Product" FROM gff) """
HEAD = "concat_ws(chr(9), 'Name', 'Gene', 'Start', 'End', 'Length', 'Type', 'Strand', 'Contig', 'Product')"
query("sink_coords", ["loci"], COORDS + f"""SELECT line FROM (SELECT concat_ws({TAB}, "Name", "Gene", "Start", "End", "Length", "Type", "Strand", "Contig", "Product") AS line FROM x)
UNION ALL SELECT {HEAD} FROM (SELECT DISTINCT genome FROM x)""")(lambda s, d: back(s, lambda at: sinks.coords(coords(s, d), at)))  # fmt: skip
query("scan_coords", ["loci"], COORDS + """SELECT * REPLACE (nullif("Gene", '') AS "Gene") FROM x""")(lambda s, d: read(s, lambda at: sinks.coords(coords(s, d), at), lambda at: tables.coords(s, at)))
query("sink_genome_list", ["loci"], "SELECT DISTINCT genome AS line FROM loci")(lambda s, d: back(s, lambda at: sinks.genome_list(loci(s, d), at)))
query("scan_sample_list", ["loci"], "SELECT DISTINCT genome FROM loci")(lambda s, d: read(s, lambda at: sinks.text(loci(s, d).select("genome").distinct(), F.concat(F.lit("  "), "genome", F.lit(" and more")), at), lambda at: tables.sample_list(s, at)))
query("sink_genome2loci", ["loci"], f"SELECT concat_ws({TAB}, locus, genome, coalesce(gene, ''), product) AS line FROM loci")(lambda s, d: back(s, lambda at: sinks.genome2loci(loci(s, d), at)))
query("scan_genome2loci", ["loci"], "SELECT locus, genome, gene, product FROM loci")(lambda s, d: read(s, lambda at: sinks.genome2loci(loci(s, d), at), lambda at: tables.genome2loci(s, at)))
query("sink_fasta", ["dna"], "SELECT unnest(string_split('>' || locus || chr(10) || regexp_replace(regexp_replace(dna, '(.{80})', '\\1' || chr(10), 'g'), '\\n$', ''), chr(10))) AS line FROM dna")(
    lambda s, d: back(s, lambda at: sinks.fasta(documents(s, d), at, "locus", "dna", 80)))
query("scan_fasta", ["dna"], "SELECT locus, dna AS seq FROM dna")(lambda s, d: read(s, lambda at: sinks.fasta(documents(s, d).withColumn("dna", F.lower("dna")), at, "locus", "dna", 80), lambda at: tables.fasta(s, at)))
def padded_documents(s, d) -> DataFrame:
    """Documents filled up to the longest: its length is one row, which all tasks get."""
    # Few bytes, much work each: a number of partitions that Spark does not make smaller.
    rows = documents(s, d).repartition(4 * int(s.conf.get("spark.sql.shuffle.partitions")), "locus")
    width = F.broadcast(documents(s, d).agg(F.max(F.length("dna")).cast("int").alias("w")))
    return rows.crossJoin(width).select("locus", F.rpad("dna", F.col("w"), F.lit("-")).alias("aln"))


query("scan_alignment", ["dna"], ", w AS (SELECT max(length(dna)) AS w FROM dna) SELECT locus, rpad(dna, w::INT, '-') AS aln FROM dna, w")(
    lambda s, d: read(s, lambda at: sinks.fasta(padded_documents(s, d), at, "locus", "aln", 60, pressed=True), lambda at: tables.alignment(s, at)))
query("sink_clusters", ["loci", "clusters"], f"SELECT string_agg(locus, {TAB} ORDER BY locus) AS line FROM clusters GROUP BY threshold, cluster")(lambda s, d: back(s, lambda at: sinks.clusters(clusters(s, d), at)))
query("scan_cluster_lines", ["loci", "clusters"], "SELECT threshold, dense_rank() OVER (ORDER BY cluster) AS cluster_ord, locus FROM clusters WHERE threshold = 70")(
    lambda s, d: read(s, lambda at: sinks.clusters(clusters(s, d), at), lambda at: tables.cluster_lines(s, f"{at}/threshold=70", 70)))


def clstr_text(s, d) -> DataFrame:
    """One file: a cluster for each nation, whose suppliers are its sequences, the first of them its representative."""
    rows = table(s, d, "supplier").select("s_nationkey", "s_suppkey")
    each = rows.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("k"))
    line = lambda x, i: F.concat(i.cast("string"), F.lit("\t"), (x + 100).cast("string"), F.lit("aa, >s"), x.cast("string"), F.when(i == 0, "... *").otherwise("... at 98.00%"))
    each = each.select("s_nationkey", F.concat(F.lit(">Cluster "), F.col("s_nationkey").cast("string"), F.lit("\n"), F.array_join(F.transform("k", line), "\n")).alias("x"))
    return each.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_nationkey", "x"))), lambda r: r["x"]), "\n").alias("x"))


query("scan_clstr", [], "SELECT s_nationkey + 1 AS cluster, 's' || s_suppkey AS locus, s_suppkey + 100 AS length, s_suppkey = min(s_suppkey) OVER (PARTITION BY s_nationkey) AS is_rep FROM supplier")(
    lambda s, d: read(s, lambda at: sinks.text(clstr_text(s, d), F.col("x"), at), lambda at: tables.clstr(s, at)))
query("scan_blast", ["hits"], "SELECT * FROM hits")(lambda s, d: read(s, lambda at: sinks.tsv(hits(s, d), at, False), lambda at: tables.hits(s, at)))
query("scan_para_blast", ["hits"], "SELECT q, s, qlen, slen, length, floor(100.0 * length / qlen) AS qcovs, pident, sstart, send FROM hits")(
    lambda s, d: read(s, lambda at: sinks.tsv(hits(s, d).selectExpr("q", "s", "qlen", "slen", "length", "floor(100 * length / qlen) qcovs", "pident", "sstart", "send"), at, False), lambda at: tables.para_hits(s, at)))
query("sink_loci_list", LIST, f"SELECT concat_ws({TAB}, locus, family, threshold, allele, genome) AS line FROM loci_list")(lambda s, d: back(s, lambda at: sinks.loci_list(loci_list(s, d), at)))
query("scan_loci_list", LIST, "SELECT * FROM loci_list")(lambda s, d: read(s, lambda at: sinks.loci_list(loci_list(s, d), at), lambda at: tables.loci_list(s, at)))
@query("line_index_lookup", LIST, "SELECT * FROM loci_list WHERE CAST(substr(family, 2) AS BIGINT) % 20 = 0")
def line_index_lookup(s, d) -> DataFrame:
    """The lines of every twentieth family, from a store of all."""
    rows = loci_list(s, d)
    store.put(rows, path := folder(s, "store"), "family", files=int(s.conf.get("spark.sql.shuffle.partitions")))
    return store.lookup(rows.where("cast(substring(family, 2) as long) % 20 = 0"), path, "family")


query("sink_paralog_clusters", LIST, SINGLE + "SELECT DISTINCT family AS line FROM (SELECT family FROM single GROUP BY family, threshold, allele, genome HAVING count(*) > 1)")(
    lambda s, d: back(s, lambda at: sinks.paralog_clusters(fam.paralog_families(single_copies(s, d)), at)))
query("sink_cluster_alleles", LIST, SINGLE + f"""SELECT concat_ws({TAB}, family, threshold, allele, genome, string_agg(locus, ' ' ORDER BY locus), count(*)) AS line FROM single
WHERE family NOT IN (SELECT family FROM single GROUP BY family, threshold, allele, genome HAVING count(*) > 1) GROUP BY family, threshold, allele, genome""")(lambda s, d: back(s, lambda at: sinks.cluster_alleles(fam.cluster_alleles(single_copies(s, d)), at)))  # fmt: skip


def found_categories(s, d) -> DataFrame:
    """Categories of some families only; the others are errors."""
    return categories(s, d).where("cast(substring(family, 2) as int) % 4 > 0")


CATEGORIES = "SELECT locus, 'g' || f AS family, genome, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS mc, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS ff, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS ff_group, 1 AS length_cluster FROM loci WHERE f % 4 > 0"
query("sink_para_categories", ["loci"], f"SELECT concat_ws({TAB}, locus, family, genome, mc, ff, ff_group, length_cluster) AS line FROM ({CATEGORIES}) UNION ALL SELECT DISTINCT 'g' || f FROM loci WHERE f % 4 = 0")(
    lambda s, d: back(s, lambda at: sinks.paralog_categories(found_categories(s, d), categories(s, d), at)))
query("scan_para_categories", ["loci"], CATEGORIES)(lambda s, d: read(s, lambda at: sinks.paralog_categories(found_categories(s, d), categories(s, d), at), lambda at: tables.paralog_categories(s, f"{at}/categories")))


def halves(s, d) -> DataFrame:
    """Every third family in two groups, by the number of the locus."""
    return loci_list(s, d).where("cast(substring(family, 2) as int) % 3 = 0").withColumn("family", F.concat("family", F.lit("_"), F.expr("cast(substring(locus, 2) as long) % 2 + 1").cast("string")))


query("sink_split_loci", [*LIST, "categories"], f""", h AS (SELECT * REPLACE (family || '_' || (CAST(substr(locus, 2) AS BIGINT) % 2 + 1) AS family), family AS old FROM loci_list WHERE CAST(substr(family, 2) AS INT) % 3 = 0
), k AS (SELECT old, h.family, count(*) AS n, count(DISTINCT genome) AS g, count(DISTINCT genome || '|' || coalesce('ff' || ff_group, locus)) AS t FROM h LEFT JOIN categories USING (locus) WHERE threshold = 50 GROUP BY ALL)
SELECT concat_ws({TAB}, locus, family, threshold, allele, genome) AS line FROM h UNION ALL SELECT old || {TAB} || string_agg(family || '(' || n || '/' || g || '/' || t || ')', {TAB} ORDER BY family) FROM k GROUP BY old""")(
    lambda s, d: back(s, lambda at: sinks.split_loci(halves(s, d), paralogs.split_log(halves(s, d), categories(s, d)), at)))


def table_of(s, d, rows: DataFrame | None = None, every: DataFrame | None = None) -> DataFrame:
    return fam.family_table(loci_list(s, d) if every is None else every, info(s, d), categories(s, d), rows)


def family_files(s, d) -> str:
    every = checkpoint(loci_list(s, d))
    unique = checkpoint(fam.unique_alleles(every))
    path = folder(s, "families")
    all_ = every.select("family", "allele", "threshold").distinct()
    cells = checkpoint(fam.cells(every, categories(s, d)))
    sinks.family_tables(table_of(s, d, every=every), table_of(s, d, unique, every), table_of(s, d, all_, every), fam.genomes_per_allele(every), cells, path)
    return path


CELLS = """, copies AS (SELECT family, threshold, allele, genome, coalesce('ff' || ff_group, locus) AS copy, string_agg(locus, ':' ORDER BY locus) AS x, count(*) AS n FROM loci_list LEFT JOIN categories USING (locus) GROUP BY ALL
), cells AS (SELECT family, threshold, allele, genome, string_agg(CASE WHEN n > 1 THEN '(' || x || ')' ELSE x END, ';' ORDER BY CASE WHEN n > 1 THEN '(' || x || ')' ELSE x END) AS cell FROM copies GROUP BY ALL) """
query("scan_family_table", [*TABLE], CELLS + "SELECT allele AS allele_name, family AS gene_family, CAST(threshold AS VARCHAR) AS threshold, genome, cell FROM cells JOIN unique_alleles USING (family, threshold, allele)")(
    lambda s, d: tables.family_table(s, f"{family_files(s, d)}/unique_alleles")[1])


@query("sink_family_tables", TABLE, """SELECT 'gene_families' AS file, allele AS allele_name, CAST(number_genomes AS VARCHAR) AS number_genomes, CAST(no_loci AS VARCHAR) AS no_loci, products FROM family_table
UNION ALL SELECT k.file, s.allele, CAST(number_genomes AS VARCHAR), CAST(no_loci AS VARCHAR), counted FROM stats s JOIN product_lists USING (threshold, allele)
JOIN (SELECT 'unique_alleles' AS file, family, allele, threshold FROM unique_alleles UNION ALL SELECT DISTINCT 'all_alleles', family, allele, threshold FROM loci_list) k USING (family, threshold, allele)
UNION ALL SELECT 'genomes_per_allele', allele, CAST(count(DISTINCT genome) AS VARCHAR), NULL, NULL FROM loci_list GROUP BY allele, family, threshold""")  # fmt: skip
def sink_family_tables(s, d):
    path, out = family_files(s, d), None
    for name in ("gene_families", "unique_alleles", "all_alleles"):
        meta = tables.family_table(s, f"{path}/{name}")[0].select(F.lit(name).alias("file"), "allele_name", "number_genomes", "no_loci", "products")
        out = meta if out is None else out.unionByName(meta)
    counts = s.read.csv(f"{path}/genomes_per_allele", sep="\t", schema="allele_name string, family string, threshold int, number_genomes string")
    none = F.lit(None).cast("string")
    return out.unionByName(counts.select(F.lit("genomes_per_allele").alias("file"), "allele_name", "number_genomes", none.alias("no_loci"), none.alias("products")))


query("scan_order", LIST, "SELECT DISTINCT family, CAST(substr(family, 2) AS INT) % 5 AS block, CAST(substr(family, 2) AS INT) // 5 AS ord FROM loci_list")(
    lambda s, d: read(s, lambda at: sinks.order(loci_list(s, d).selectExpr("family", "cast(substring(family, 2) as int) % 5 block", "cast(substring(family, 2) as int) div 5 ord").distinct(), at), lambda at: tables.order(s, at)))
query("scan_error_links", ["loci"], "SELECT DISTINCT 'g' || f AS family, 'e' || f // 7 AS error_group FROM loci")(
    lambda s, d: read(s, lambda at: sinks.tsv(loci(s, d).selectExpr("concat('g', f) family", "concat('e', f div 7) error_group").distinct(), at, False), lambda at: tables.error_links(s, at)))
ROARY = CELLS + "SELECT allele || '__' || family AS gene, genome, replace(regexp_replace(cell, '[()]', '', 'g'), ':', ';') AS cell FROM cells JOIN family_rows USING (family, threshold, allele)"


def roary_files(s, d, at: str) -> None:
    every = checkpoint(loci_list(s, d))
    rows = checkpoint(fam.family_rows(fam.unique_alleles(every)))
    cells = checkpoint(fam.cells(every.join(rows, ["family", "allele", "threshold"], "left_semi"), categories(s, d)))
    sinks.roary(tools.roary(table_of(s, d, rows, every)), cells, at)


query("scan_roary_csv", TABLE, ROARY)(lambda s, d: read(s, lambda at: roary_files(s, d, at), lambda at: tables.roary(s, at)))
query("sink_roary", TABLE, "SELECT allele || '__' || family AS \"Gene\", coalesce(consensus_product, '') AS \"Annotation\", CAST(number_genomes AS VARCHAR) AS \"No. isolates\", 'NA' AS \"Genome Fragment\" FROM family_table")(
    lambda s, d: read(s, lambda at: roary_files(s, d, at), lambda at: tables.roary_meta(s, at).select("Gene", F.coalesce("Annotation", F.lit("")).alias("Annotation"), F.col("`No. isolates`"), "Genome Fragment")))
query("scan_vcf_pos", [], "SELECT row_number() OVER (ORDER BY p_partkey) AS record, p_partkey * 11 AS pos FROM part")(
    lambda s, d: read(s, lambda at: sinks.text(table(s, d, "part").agg(F.concat(F.lit("##fileformat=VCFv4.2\n#CHROM\tPOS\n"), F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: F.concat(F.lit("c1\t"), (x * 11).cast("string"), F.lit("\t.\tA"))), "\n")).alias("x")), F.col("x"), at), lambda at: tables.vcf_positions(s, at)))


def results(s, d) -> DataFrame:
    return loci_list(s, d).groupBy(F.col("allele").alias("loci")).agg((F.count("*") % 100 / 100).alias("pvalue"))


RESULTS = ", results AS (SELECT allele AS locus, count(*) % 100 / 100 AS pvalue FROM loci_list GROUP BY allele) "
query("scan_treewas_results", LIST, RESULTS + "SELECT * FROM results")(
    lambda s, d: read(s, lambda at: sinks.text(results(s, d).agg(F.concat(F.lit("# a remark\nloci\tpvalue\n"), F.array_join(F.collect_list(F.concat_ws("\t", "loci", F.col("pvalue").cast("string"))), "\n")).alias("x")), F.col("x"), at), lambda at: tables.treewas_results(s, at)))
query("scan_metadata_header", ["loci"], "SELECT unnest(['gene', 'product', 'length']) AS phenotype")(
    lambda s, d: s.createDataFrame([(c,) for c in read(s, lambda at: sinks.tsv(info(s, d), at), lambda at: tables.metadata_columns(s, at))], "phenotype string"))
query("scan_newick", [], "SELECT 'n' || n_nationkey AS leaf, CAST(n_nationkey + 0.5 AS DOUBLE) AS length FROM nation")(
    lambda s, d: trees.nodes(read(s, lambda at: sinks.text(table(s, d, "nation").agg(F.concat(F.lit("("), F.array_join(F.collect_list(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(":-"), F.col("n_nationkey").cast("string"), F.lit(".5"))), ","), F.lit(");")).alias("x")), F.col("x"), at), lambda at: tables.trees(s, at))).where("leaf").select(F.col("name").alias("leaf"), "length"))


def order_trees(s, d) -> DataFrame:
    """(tree, text): for each customer a tree of orders with their lines, whose lengths are whole numbers; an order's name is quoted."""
    text = lambda c: F.col(c).cast("string")
    each = F.concat(F.lit("l"), text("l_orderkey"), F.lit("_"), text("l_linenumber"), F.lit(":"), F.col("l_quantity").cast("long").cast("string"))
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list(each)), ",").alias("x"))
    rows = table(s, d, "orders").join(lines, "o_orderkey").select(F.col("o_custkey").cast("long").alias("tree"), F.concat(F.lit("("), "x", F.lit(")'o''"), text("o_orderkey"), F.lit("':-"), (F.col("o_orderkey") % 50).cast("string"), F.lit("[an order]")).alias("x"))
    return rows.groupBy("tree").agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list("x")), " , "), F.lit(")c"), F.first("tree").cast("string"), F.lit(";")).alias("text"))


@query("newick_nodes", [], """SELECT CAST(o_custkey AS BIGINT) AS tree, 'l' || l_orderkey || '_' || l_linenumber AS name, 'o''' || o_orderkey AS above, floor(l_quantity)::DOUBLE AS length, true AS leaf FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT o_custkey, 'o''' || o_orderkey, 'c' || o_custkey, (o_orderkey % 50)::DOUBLE, false FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT o_custkey, 'c' || o_custkey, NULL, NULL::DOUBLE, false FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")  # fmt: skip
def newick_nodes(s, d) -> DataFrame:
    rows = trees.nodes(order_trees(s, d))
    named = rows.select("tree", F.col("node").alias("parent"), F.col("name").alias("above"))
    return rows.join(named, ["tree", "parent"], "left").select("tree", "name", "above", "length", "leaf")


query("newick_midpoint", [], """WITH line AS (
    SELECT o_custkey AS tree, o_orderkey AS o, floor(l_quantity) AS q, o_orderkey % 50 + floor(l_quantity) AS way, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_quantity DESC) AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), within AS (SELECT tree, max(d) AS d FROM (SELECT tree, o, sum(q) AS d FROM line WHERE r <= 2 GROUP BY tree, o HAVING count(*) = 2) GROUP BY tree
), across AS (SELECT tree, sum(way) AS d FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY way DESC) AS k FROM line WHERE r = 1) WHERE k <= 2 GROUP BY tree HAVING count(*) = 2)
SELECT CAST(tree AS BIGINT) AS tree, (greatest(coalesce(w.d, 0), coalesce(a.d, 0)) / 2)::DOUBLE AS half FROM within w FULL JOIN across a USING (tree)""")(
    lambda s, d: trees.midpoints(trees.nodes(order_trees(s, d))).select("tree", "half"))
PRESENT = "SELECT DISTINCT allele, genome FROM loci_list WHERE threshold = 50"
GRID = f", here AS ({PRESENT}), grid AS (SELECT a.allele, g.genome, h.genome IS NOT NULL AS has FROM (SELECT DISTINCT allele FROM here) a CROSS JOIN (SELECT DISTINCT genome FROM here) g LEFT JOIN here h ON h.allele = a.allele AND h.genome = g.genome) "


def present(s, d) -> DataFrame:
    return fam.presence(loci_list(s, d)).where("threshold = 50").select(F.col("allele").alias("Gene"), "genome")


query("sink_rtab", LIST, GRID + "SELECT allele AS \"Gene\", genome, CASE WHEN has THEN '1' ELSE '0' END AS n FROM grid")(lambda s, d: read(s, lambda at: sinks.matrix(present(s, d), ["Gene"], "genome", at), lambda at: tables.matrix(s, at, 1)))
query("sink_treewas", LIST, GRID + "SELECT genome AS \"Samples\", allele, CASE WHEN has THEN '1' ELSE '0' END AS n FROM grid")(
    lambda s, d: read(s, lambda at: sinks.matrix(present(s, d).withColumnRenamed("genome", "Samples"), ["Samples"], "Gene", at), lambda at: tables.matrix(s, at, 1, "allele")))
query("sink_para_rtab", [*LIST, "categories", "doses"], """, e AS (SELECT allele, genome, dose - 1 AS n FROM doses WHERE dose > 1 AND threshold = 50)
SELECT a.allele AS "Gene", g.genome, CAST(coalesce(e.n, 0) AS VARCHAR) AS n FROM (SELECT DISTINCT allele FROM e) a CROSS JOIN (SELECT DISTINCT genome FROM e) g LEFT JOIN e ON e.allele = a.allele AND e.genome = g.genome""")(
    lambda s, d: read(s, lambda at: sinks.matrix(tools.paralog_rtab(loci_list(s, d).where("threshold = 50"), categories(s, d), "d").withColumnRenamed("allele", "Gene"), ["Gene"], "genome", at, "n"), lambda at: tables.matrix(s, at, 1)))
query("sink_distmat", LIST, """, a AS (SELECT DISTINCT genome, allele FROM loci_list WHERE threshold = 50), b AS (SELECT x.genome AS g1, y.genome AS g2, count(*) AS m FROM a x JOIN a y USING (allele) GROUP BY ALL), c AS (SELECT genome, count(*) AS n FROM a GROUP BY genome)
SELECT x.genome AS g1, y.genome AS g2, CAST(x.n + y.n - 2 * coalesce(m, 0) AS VARCHAR) AS n FROM c x CROSS JOIN c y LEFT JOIN b ON g1 = x.genome AND g2 = y.genome""")(
    lambda s, d: read(s, lambda at: sinks.distances(loci_list(s, d).where("threshold = 50"), at, pressed=True), lambda at: tables.matrix(s, at, 1, "g2")))
query("sink_annotated", TABLE, RESULTS + f"""SELECT concat_ws({TAB}, r.locus, coalesce(gene_family, ''), coalesce(consensus_gene_name, ''), coalesce(consensus_product, '')) AS line FROM results r
LEFT JOIN (SELECT allele AS locus, family AS gene_family, consensus_gene_name, consensus_product FROM family_table) USING (locus)""")(
    lambda s, d: back(s, lambda at: sinks.tsv(tools.annotate(results(s, d).select(F.col("loci").alias("locus")), table_of(s, d)), at, False)))
query("sink_subset_*", LIST, f"SELECT concat_ws({TAB}, locus, family, threshold, allele, genome) AS line FROM loci_list WHERE genome IN (SELECT genome FROM loci WHERE event_id % 97 = 0)")(
    lambda s, d: back(s, lambda at: sinks.loci_list(filters.by_samples(loci_list(s, d), loci(s, d).where("event_id % 97 = 0")), at)))
query("sink_summary", TABLE, f""", most AS (SELECT max(number_genomes) AS m FROM family_table), t AS (SELECT t.*, list_filter([10, 25, 50, 75, 90, 95, 100], lambda c: 100.0 * number_genomes / m <= c)[1] AS top FROM family_table t, most
), b AS (SELECT u.top, u.low, count(family) AS a, count(*) FILTER (alleles_at_maximum_threshold > 1) AS b, count(*) FILTER (genomes_containing_fissions > 0) AS c, count(*) FILTER (genomes_containing_duplications > 0) AS e
    FROM (SELECT unnest([10, 25, 50, 75, 90, 95, 100]) AS top, unnest([0, 10, 25, 50, 75, 90, 95]) AS low) u LEFT JOIN t ON t.top = u.top GROUP BY ALL)
SELECT concat_ws({TAB}, low || '-' || top || '%', a, b, c, e) AS line FROM b""")(lambda s, d: back(s, lambda at: sinks.summary(summary.buckets(table_of(s, d)), at)).where("line not like '\\\\%isolates%'"))  # fmt: skip


def representatives(s, d) -> DataFrame:
    """Sources as families of documents: the longest with its sequence and protein."""
    rows = documents(s, d).select(F.coalesce("genome", F.lit("none")).alias("family"), "locus", F.concat(F.lit("u"), F.substring("locus", -1, 1)).alias("genome"), "dna")
    best = tools.representatives(rows, rows.select("locus", F.length("dna").alias("length")))
    n = rows.groupBy("family").agg(F.count_distinct("genome").alias("number_genomes"))
    return best.join(n, "family").join(rows.select("locus", F.col("dna").alias("seq")), "locus").withColumn("protein", seq.translated(F.col("seq"))).withColumns({"gene": F.lit(None).cast("string"), "product": F.col("family")})


query("sink_representatives", ["dna"], CODE + """, r AS (SELECT coalesce(genome, 'none') AS family, locus, 'u' || right(locus, 1) AS g, dna FROM dna
), b AS (SELECT *, count(DISTINCT g) OVER (PARTITION BY family) AS n FROM r QUALIFY row_number() OVER (PARTITION BY family ORDER BY length(dna) DESC, g, locus) = 1
), p AS (SELECT locus, string_agg(aa, '' ORDER BY k) AS protein FROM (SELECT locus, k, substr(dna, k * 3 + 1, 3) AS codon FROM (SELECT locus, dna, unnest(range(0, length(dna) // 3)) AS k FROM b)) JOIN code USING (codon) GROUP BY locus
), h AS (SELECT '>' || family || ';representative_genome=' || g || ';locus_tag=' || locus || ';gene_name=;gene_product=' || family || ';number_genomes=' || n AS h, dna, protein FROM b JOIN p USING (locus))
SELECT h AS line FROM h UNION ALL SELECT h FROM h UNION ALL SELECT dna FROM h UNION ALL SELECT protein FROM h""")(lambda s, d: back(s, lambda at: sinks.representatives(representatives(s, d), at)))  # fmt: skip


def concatenated(s, d, at: str) -> None:
    """Documents' letters are kept once, for the offsets and the longest; only the longest are filled up."""
    rows = slim_aligned(s, d)
    order = places(s, d)
    sinks.alignment(alignment.concatenate(rows, order, documents(s, d)), alignment.offsets_gff(alignment.offsets(rows, order)), at)


def places(s, d) -> DataFrame:
    return aligned(s, d).select("family").distinct().select("family", F.lit(1).alias("block"), F.expr("cast(substring(family, 2) as int)").alias("ord"))


query("sink_concat_alignment", ["dna"], f""", {ALIGNED}, c AS (
    SELECT genome, string_agg(CASE WHEN n IS NULL THEN repeat('N', w) WHEN n > 1 THEN repeat('-', w) ELSE replace(aln, '-', 'N') END, '' ORDER BY family) AS aln FROM width CROSS JOIN (SELECT DISTINCT genome FROM aligned) LEFT JOIN best USING (family, genome) GROUP BY genome)
SELECT '>' || genome AS line FROM c UNION ALL SELECT aln FROM c UNION ALL SELECT concat_ws({TAB}, 'Pangenome', 'NA', 'CDS', stop - w + 1, stop, '.', '+', '0', 'ID=' || family || ';gene=' || family) FROM width""")(
    lambda s, d: back(s, lambda at: concatenated(s, d, at)))
