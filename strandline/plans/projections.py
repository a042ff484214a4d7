"""The test tables seen as genomes: events become loci, documents become sequences.

Each view has a DataFrame form and the same in DuckDB SQL, as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.names import padded
from strandline.operators import families

THRESHOLDS = (50, 70, 90)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(locus, genome, contig, pos, strand, k, f, gene, product, length, start, end, category columns)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    rows = e.select(
        F.concat(F.lit("e"), padded(F.col("event_id"), 7)).alias("locus"),
        F.concat(F.lit("u"), padded(F.col("user_id"), 5)).alias("genome"),
        F.to_date("ts").cast("string").alias("contig"),
        F.expr("row_number() over (partition by user_id, to_date(ts) order by ts, event_id)").cast("long").alias("pos"),
        F.when(F.col("event_type").isin("click", "view", "signup"), "+").otherwise("-").alias("strand"),
        "k",
        F.expr("k * k div 100").alias("f"),
        "event_type",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("gene"),
        F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("product"),
        F.floor(F.col("value") * 100).cast("long").alias("length"),
        "event_id",
    )
    return rows


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(threshold, cluster, locus, genome): nested, the cluster's text its order."""
    names = F.array(
        F.struct(F.lit(50).alias("threshold"), padded(F.col("f"), 3).alias("cluster")),
        F.struct(F.lit(70).alias("threshold"), padded(F.col("k"), 3).alias("cluster")),
        F.struct(F.lit(90).alias("threshold"), F.concat(padded(F.col("k"), 3), F.col("event_type")).alias("cluster")),
    )
    return loci(spark, sf_dir).select("locus", "genome", F.explode(names).alias("c")).select("c.threshold", "c.cluster", "locus", "genome")


def loci_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(locus, family, threshold, allele, genome), named."""
    return families.name_clusters(clusters(spark, sf_dir))


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loci(spark, sf_dir).select("locus", "gene", "product", "length")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth locus of a family and genome is a fragment of one gene."""
    part = F.col("event_id") % 5 == 0
    return loci(spark, sf_dir).select(
        "locus", F.concat(F.lit("g"), F.col("f").cast("string")).alias("family"), "genome", F.when(part, 0).otherwise(1).alias("mc"), F.when(part, 1).otherwise(0).alias("ff"),
        F.when(part, 1).otherwise(0).alias("ff_group"), F.lit(1).alias("length_cluster"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(locus, genome, dna): a document's letters as bases."""
    letters, bases = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
    d = table(spark, sf_dir, "documents")
    dna = F.translate(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), letters.upper(), letters), "[^a-z]", ""), letters, bases)
    return d.select(F.concat(F.lit("d"), padded(F.col("doc_id"), 7)).alias("locus"), F.col("source").alias("genome"), dna.alias("dna"))


# Common table expressions in DuckDB SQL, by name; each may use those before it.
CTE = {
    "loci": """loci AS (
    SELECT 'e' || lpad(CAST(event_id AS VARCHAR), greatest(7, length(CAST(event_id AS VARCHAR)))::INT, '0') AS locus,
        'u' || lpad(CAST(user_id AS VARCHAR), greatest(5, length(CAST(user_id AS VARCHAR)))::INT, '0') AS genome,
        CAST(CAST(ts AS DATE) AS VARCHAR) AS contig, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS pos,
        CASE WHEN event_type IN ('click', 'view', 'signup') THEN '+' ELSE '-' END AS strand, k, k * k // 100 AS f, event_type,
        CASE WHEN event_type <> 'error' THEN event_type END AS gene, 'p' || CAST(event_id % 7 AS VARCHAR) AS product, CAST(floor(value * 100) AS BIGINT) AS length, event_id
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))""",
    "clusters": """clusters AS (
    SELECT 50 AS threshold, lpad(CAST(f AS VARCHAR), 3, '0') AS cluster, locus, genome FROM loci
    UNION ALL SELECT 70, lpad(CAST(k AS VARCHAR), 3, '0'), locus, genome FROM loci
    UNION ALL SELECT 90, lpad(CAST(k AS VARCHAR), 3, '0') || event_type, locus, genome FROM loci)""",
    "loci_list": """rooted AS (
    SELECT threshold, cluster, min(root) AS root FROM (SELECT *, first_value(cluster) OVER (PARTITION BY locus ORDER BY threshold) AS root FROM clusters) GROUP BY ALL
), numbered AS (
    SELECT *, 'g' || lpad(CAST(dense_rank() OVER (ORDER BY root) AS VARCHAR), 5, '0') AS family,
        row_number() OVER (PARTITION BY root, threshold = 50 ORDER BY threshold, cluster) AS place FROM rooted
), loci_list AS (
    SELECT locus, family, threshold, CASE WHEN threshold = 50 THEN family ELSE family || '_' || lpad(CAST(place AS VARCHAR), 4, '0') END AS allele, genome
    FROM clusters JOIN numbered USING (threshold, cluster))""",
    "categories": """categories AS (SELECT locus, CASE WHEN event_id % 5 = 0 THEN 1 END AS ff_group FROM loci)""",
    "doses": """doses AS (
    SELECT family, threshold, allele, genome, count(*) AS dose, CAST(sum(n) AS BIGINT) AS n_loci, count(*) FILTER (n > 1) AS n_groups
    FROM (SELECT family, threshold, allele, genome, coalesce('ff' || ff_group, locus) AS copy, count(*) AS n FROM loci_list LEFT JOIN categories USING (locus) GROUP BY ALL) GROUP BY ALL)""",
    "stats": """stats AS (
    SELECT family, threshold, allele, count(*) AS number_genomes, avg(dose) AS average_dose, min(dose) AS min_dose, max(dose) AS max_dose,
        count(*) FILTER (n_groups > 0) AS genomes_containing_fissions, count(*) FILTER (dose > 1) AS genomes_containing_duplications,
        CAST(sum(n_groups) AS BIGINT) AS number_fission_loci, CAST(sum(dose - 1) AS BIGINT) AS number_duplicated_loci,
        CAST(sum(dose) AS BIGINT) AS no_loci, CAST(sum(n_loci) AS BIGINT) AS n_true_loci
    FROM doses GROUP BY ALL)""",
    "children": """linked AS (SELECT *, lead(allele) OVER (PARTITION BY locus ORDER BY threshold) AS next_allele FROM loci_list)""",
    "unique_alleles": """unique_alleles AS (
    SELECT family, allele, threshold FROM linked GROUP BY ALL HAVING count(DISTINCT next_allele) > 1 OR threshold = 90)""",
    "family_rows": """family_rows AS (
    SELECT family, allele, threshold FROM unique_alleles
    QUALIFY row_number() OVER (PARTITION BY family ORDER BY threshold, coalesce(TRY_CAST(regexp_extract(allele, '_([0-9]+)$', 1) AS BIGINT), 0), allele) = 1)""",
    "names": """named AS (
    SELECT threshold, allele, nullif(gene, '') AS gene, nullif(product, '') AS product FROM loci_list JOIN loci USING (locus)
), gene_counts AS (SELECT threshold, allele, gene AS name, count(*) AS n FROM named GROUP BY ALL
), product_counts AS (SELECT threshold, allele, product AS name, count(*) AS n FROM named GROUP BY ALL
), gene_best AS (SELECT threshold, allele, name FROM gene_counts QUALIFY row_number() OVER (PARTITION BY threshold, allele ORDER BY name IS NULL, n DESC, name) = 1
), product_best AS (SELECT threshold, allele, name FROM product_counts QUALIFY row_number() OVER (PARTITION BY threshold, allele ORDER BY name IS NULL, n DESC, name) = 1
), gene_lists AS (SELECT threshold, allele, string_agg(coalesce(name, 'NA') || '(' || n || ')', ':' ORDER BY n DESC, coalesce(name, 'NA')) AS counted FROM gene_counts GROUP BY ALL
), product_lists AS (SELECT threshold, allele, string_agg(coalesce(name, 'NA') || '(' || n || ')', ':' ORDER BY n DESC, coalesce(name, 'NA')) AS counted FROM product_counts GROUP BY ALL)""",
    "lengths": """lengths AS (
    SELECT threshold, allele, min(length) AS min_length, max(length) AS max_length, avg(length) AS average_length FROM loci_list JOIN loci USING (locus) GROUP BY ALL)""",
    "at_top": """at_top AS (SELECT family, count(DISTINCT allele) FILTER (threshold = 90) AS alleles_at_maximum_threshold FROM loci_list GROUP BY family)""",
    "adjacent": """adjacent AS (
    SELECT genome, contig, pos, family, strand, lag(family) OVER o AS before, lag(strand) OVER o AS strand_before
    FROM loci JOIN (SELECT locus, family FROM loci_list WHERE threshold = 50) USING (locus) WINDOW o AS (PARTITION BY genome, contig ORDER BY pos))""",
    "table": """family_table AS (
    SELECT s.*, f.alleles_at_maximum_threshold, gb.name AS consensus_gene_name, pb.name AS consensus_product, gl.counted AS gene_names, pl.counted AS products, min_length, max_length, average_length
    FROM stats s JOIN at_top f USING (family) JOIN family_rows r USING (family, allele, threshold) LEFT JOIN gene_best gb USING (threshold, allele) LEFT JOIN product_best pb USING (threshold, allele)
    LEFT JOIN gene_lists gl USING (threshold, allele) LEFT JOIN product_lists pl USING (threshold, allele) LEFT JOIN lengths USING (threshold, allele))""",
    "all_table": """all_table AS (SELECT family, threshold, allele, number_genomes, average_dose FROM stats)""",
    "dna": """dna AS (
    SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS locus, source AS genome, text,
        translate(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS dna
    FROM documents)""",
}
LIST = ["loci", "clusters", "loci_list"]


def sql(parts: list[str], select: str, recursive: bool = False) -> str:
    """A statement with the named expressions in front."""
    if not parts:
        return select
    return f"WITH {"RECURSIVE " if recursive else ""}{", ".join(CTE[p] for p in parts)}\n{select}"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci with contig, pos, strand and the family of the lowest threshold."""
    named = loci_list(spark, sf_dir).where(f"threshold = {THRESHOLDS[0]}").select("locus", "family")
    return loci(spark, sf_dir).join(named, "locus").select("locus", "genome", "contig", "pos", "strand", "family", "length")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as alignment hits between parts, in the 14 columns; a seventh line is a hit of a part on itself."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('c', l_partkey) q", "concat('c', l_partkey + 7 - l_linenumber) s", "cast(50 + 5 * round(l_discount * 100) as double) pident", "cast(l_quantity as int) length", "l_linenumber mismatch",
        "0 gapopen", "1 qstart", "cast(l_quantity as int) qend", "l_linenumber sstart", "cast(l_quantity + 2 * l_linenumber as int) send", "0D evalue", "floor(l_extendedprice) * 1D bitscore",
        "cast(l_quantity as int) + 3 * l_linenumber qlen", "cast(l_quantity as int) + 9 slen")


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(locus, length): all parts; not all have a hit on themselves."""
    return table(spark, sf_dir, "part").selectExpr("concat('c', p_partkey) locus", "p_size length")


CTE |= {
    "features": """features AS (
    SELECT locus, loci.genome, contig, pos, strand, family, length FROM loci JOIN (SELECT locus, family FROM loci_list WHERE threshold = 50) USING (locus))""",
    "edges": """pairs AS (
    SELECT genome, before, family, strand, strand_before, CASE WHEN strand_before = '+' THEN 'D' ELSE 'U' END AS leave, CASE WHEN strand = '+' THEN 'U' ELSE 'D' END AS enter FROM adjacent WHERE before <> family
), edges AS (
    SELECT src, src_side, dst, dst_side, count(*) AS weight FROM (
        SELECT before AS src, leave AS src_side, family AS dst, enter AS dst_side FROM pairs UNION ALL SELECT family, enter, before, leave FROM pairs) GROUP BY ALL
), nodes AS (SELECT family, count(DISTINCT genome) AS n_genomes, count(*) AS n_loci FROM features GROUP BY family)""",
    "hits": """hits AS (
    SELECT 'c' || l_partkey AS q, 'c' || (l_partkey + 7 - l_linenumber) AS s, CAST(50 + 5 * round(l_discount * 100) AS DOUBLE) AS pident, CAST(l_quantity AS INT) AS length, l_linenumber AS mismatch, 0 AS gapopen, 1 AS qstart,
        CAST(l_quantity AS INT) AS qend, l_linenumber AS sstart, CAST(l_quantity + 2 * l_linenumber AS INT) AS send, 0::DOUBLE AS evalue, floor(l_extendedprice) AS bitscore,
        CAST(l_quantity AS INT) + 3 * l_linenumber AS qlen, CAST(l_quantity AS INT) + 9 AS slen FROM lineitem)""",
    "reps": """reps AS (SELECT 'c' || p_partkey AS locus, p_size AS length FROM part)""",
    "links": """canonical AS (
    SELECT CASE WHEN strand_before = '+' AND strand = '+' THEN before WHEN strand_before <> '+' AND strand <> '+' THEN family WHEN strand_before = '+' THEN least(before, family) ELSE least(before, family) || '-' END AS n1,
        CASE WHEN strand_before = '+' AND strand = '+' THEN family WHEN strand_before <> '+' AND strand <> '+' THEN before WHEN strand_before = '+' THEN greatest(before, family) || '-' ELSE greatest(before, family) END AS n2, count(*) AS weight
    FROM pairs GROUP BY ALL)""",
}
FEATURES = [*LIST, "features", "adjacent"]
