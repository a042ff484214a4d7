"""Queries on features, sequences, clusters and alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import sequences as seq
from strandline.functions.names import checkpoint, gene_root, genome_name, locus_name, padded, stored
from strandline.operators import alignment, clustering, families, joining, paralogs
from strandline.plans.projections import LIST, categories, clusters, documents, loci, loci_list, sql, table
from strandline.sources import gff

QUERIES, SQL = {}, {}


def query(name: str, parts: list[str], select: str | None, recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if select is not None:
            SQL[name] = sql(parts, select, recursive)
        return f

    return keep


def gff_lines(s, d):
    """Events as feature lines of their genome's file; the type is CDS, rRNA or gene."""
    rows = loci(s, d)
    kind = F.when(F.col("event_id") % 11 == 0, "gene").when(F.col("event_id") % 5 == 0, "rRNA").otherwise("CDS")
    attrs = F.concat_ws(";", F.concat(F.lit("ID=x"), F.col("event_id").cast("string")), F.concat(F.lit("gene="), "gene"), F.concat(F.lit("product="), "product"))
    line = F.concat_ws("\t", "contig", F.lit("src"), kind, F.col("pos").cast("string"), (F.col("pos") + F.col("length")).cast("string"), F.lit("."), "strand", F.lit("0"), attrs)
    return rows.select("genome", F.col("event_id").alias("n"), line.alias("line"), F.lit("feature").alias("kind"))


GFF = """gff AS (
    SELECT genome, event_id AS n, contig, 'src' AS source, CASE WHEN event_id % 11 = 0 THEN 'gene' WHEN event_id % 5 = 0 THEN 'rRNA' ELSE 'CDS' END AS type, pos AS start, pos + length AS "end", '.' AS score, strand, '0' AS phase,
        concat_ws(';', 'ID=x' || event_id, 'gene=' || gene, 'product=' || product) AS attrs, gene, product, event_id FROM loci)"""
G = f", {GFF} "
query("scan_gff_features", ["loci"], G + "SELECT * EXCLUDE (gene, product, event_id) FROM gff WHERE type = 'CDS'")(lambda s, d: gff.of_types(gff.features(gff_lines(s, d))))
query("filter_feature_type", ["loci"], G + "SELECT genome, n, type FROM gff WHERE type IN ('CDS', 'rRNA')")(lambda s, d: gff.of_types(gff.features(gff_lines(s, d)), ("CDS", "rRNA")).select("genome", "n", "type"))
query("attr_extract", ["loci"], G + "SELECT n, 'x' || event_id AS id, gene, product, CAST(NULL AS VARCHAR) AS none FROM gff")(
    lambda s, d: gff.features(gff_lines(s, d)).select("n", *(gff.attribute(F.col("attrs"), a).alias(b) for a, b in (("ID", "id"), ("gene", "gene"), ("product", "product"), ("roduct", "none")))))
query("std_locus_name", ["loci"], G + """SELECT n, genome || '_' || CASE WHEN type = 'CDS' THEN '' ELSE type || '_' END || lpad(CAST(k AS VARCHAR), greatest(5, length(CAST(k AS VARCHAR)))::INT, '0') AS locus
FROM (SELECT *, row_number() OVER (PARTITION BY genome, type ORDER BY n) AS k FROM gff)""")(lambda s, d: gff.standardised(gff.features(gff_lines(s, d))).select("n", "locus"))
query("win_locus_counter", ["loci"], G + "SELECT n, row_number() OVER (PARTITION BY genome, type ORDER BY n) AS k FROM gff")(lambda s, d: gff.counted(gff.features(gff_lines(s, d))).select("n", F.col("number").cast("long").alias("k")))
query("attr_rewrite", ["loci"], G + """, k AS (SELECT *, genome || '_' || CASE WHEN type = 'CDS' THEN '' ELSE type || '_' END || lpad(CAST(row_number() OVER (PARTITION BY genome, type ORDER BY n) AS VARCHAR), 5, '0') AS locus FROM gff)
SELECT n, concat_ws(';', 'ID=' || locus, 'locus_tag=' || locus, 'prev_ID=x' || event_id, 'gene=' || gene, 'product=' || product) AS attrs FROM k""")(lambda s, d: gff.standardised(gff.features(gff_lines(s, d))).select("n", "attrs"))  # fmt: skip
query("std_genome_name", [], "SELECT s_suppkey, regexp_replace(regexp_replace(s_name || ' v1.' || s_suppkey || '+-x', '[.,\\s+-]', '_', 'g'), '_+', '_', 'g') AS name FROM supplier")(
    lambda s, d: table(s, d, "supplier").select("s_suppkey", genome_name(F.concat("s_name", F.lit(" v1."), F.col("s_suppkey").cast("string"), F.lit("+-x"))).alias("name")))
query("gene_root", ["loci"], "SELECT event_id, regexp_replace(gene || '_' || k, '_[0-9]+$', '') AS root FROM loci WHERE gene IS NOT NULL")(lambda s, d: loci(s, d).where("gene is not null").select("event_id", gene_root(F.concat("gene", F.lit("_"), F.col("k").cast("string"))).alias("root")))

query("nonacgt_to_n", [], "SELECT doc_id, regexp_replace(upper(regexp_replace(translate(text, 'áéíóúñüößäàâêèçîôûùëïÁÉÍÓÚÑÜÖÄÀÂÊÈÇÎÔÛÙËÏ', ''), '[ \\t\\n\\r\\x0b\\f]', '', 'g')), '[^ACGTN]', 'N', 'g') AS seq FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", seq.clean(F.translate("text", "áéíóúñüößäàâêèçîôûùëïÁÉÍÓÚÑÜÖÄÀÂÊÈÇÎÔÛÙËÏ", "")).alias("seq")))
query("seq_substring", ["dna"], "SELECT locus, substr(dna, 10, 31) AS piece FROM dna")(lambda s, d: documents(s, d).select("locus", seq.piece(F.col("dna"), F.lit(10), F.lit(40)).alias("piece")))
query("seq_revcomp", ["dna"], "SELECT locus, reverse(translate(dna, 'ACGT', 'TGCA')) AS seq FROM dna")(lambda s, d: documents(s, d).select("locus", seq.reverse_complement(F.col("dna")).alias("seq")))
CODE = ", code AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in seq.CODONS.items()) + ") c(codon, aa))"
query("seq_translate", ["dna"], CODE + """, cut AS (SELECT locus, k, substr(dna, k * 3 + 1, 3) AS codon FROM (SELECT locus, dna, unnest(range(0, length(dna) // 3)) AS k FROM dna))
SELECT d.locus, coalesce(p, '') AS protein FROM dna d LEFT JOIN (SELECT locus, string_agg(aa, '' ORDER BY k) AS p FROM cut JOIN code USING (codon) GROUP BY locus) USING (locus)""")(
    lambda s, d: documents(s, d).select("locus", seq.translated(F.col("dna")).alias("protein")))
FRAME = ", f AS (SELECT locus, 'ATG' || dna || 'TAA' AS s FROM dna)"
query("filter_seq_qc", ["dna"], FRAME + "SELECT locus, length(s) AS n FROM f WHERE length(s) % 3 = 0 AND length(s) > 120 AND substr(s, 1, 3) IN ('ATG', 'GTG', 'TTG') AND right(s, 3) IN ('TAA', 'TGA', 'TAG')")(
    lambda s, d: framed(s, d).where(seq.passes(F.col("s"))).select("locus", F.length("s").cast("long").alias("n")))
query("filter_one_stop", ["dna"], CODE + FRAME + """, cut AS (SELECT locus, substr(s, k * 3 + 1, 3) AS codon FROM (SELECT locus, s, unnest(range(0, length(s) // 3)) AS k FROM f))
SELECT locus FROM cut JOIN code USING (codon) GROUP BY locus HAVING count(*) FILTER (aa = '*') = 1""")(lambda s, d: framed(s, d).where(seq.one_stop(seq.translated(F.col("s")))).select("locus"))  # fmt: skip


def framed(s, d):
    return documents(s, d).select("locus", "genome", F.concat(F.lit("ATG"), "dna", F.lit("TAA")).alias("s"))


query("filter_coord_in_contig", ["loci"], ", c AS (SELECT genome, contig, max(pos) * 20 AS size FROM loci WHERE k > 3 GROUP BY ALL) SELECT locus FROM loci JOIN c USING (genome, contig) WHERE pos * 10 + length // 10 <= size")(
    lambda s, d: gff.inside(
        loci(s, d).select("genome", F.col("contig").alias("Contig"), "locus", F.expr("pos * 10 + length div 10").alias("End")),
        loci(s, d).where("k > 3").groupBy("genome", "contig").agg(F.repeat(F.lit("A"), (F.max("pos") * 20).cast("int")).alias("seq"))).select("locus"))
query("filter_contigs_match", ["loci"], ", c AS (SELECT DISTINCT genome, contig FROM loci WHERE k > 0) SELECT DISTINCT genome FROM loci WHERE genome NOT IN (SELECT genome FROM (SELECT DISTINCT genome, contig FROM loci EXCEPT SELECT * FROM c))")(
    lambda s, d: gff.matching(loci(s, d).select("genome", "contig"), loci(s, d).where("k > 0").select("genome", "contig").distinct()).select("genome").distinct())
query("join_seq_to_contig", ["dna"], "SELECT locus, substr(dna, 5, 20) AS piece FROM dna WHERE length(dna) >= 24")(
    lambda s, d: gff.feature_sequences(
        documents(s, d).select(F.col("locus").alias("genome"), F.lit("c").alias("Contig"), F.col("locus").alias("Name"), F.lit(5).alias("Start"), F.lit(24).alias("End"), F.lit("Forward").alias("Strand")),
        documents(s, d).select(F.col("locus").alias("genome"), F.lit("c").alias("contig"), F.col("dna").alias("seq"))).select(F.col("Name").alias("locus"), F.col("seq").alias("piece")))


#: As a run takes them for nucleotides.
K, SHARED = 12, 2


def genes(s, d):
    """The benchmark's texts as bases in four genomes: whole, with some bases changed, with more, and their first half. (family, locus, genome, seq)."""
    rows = items(s, d)
    kinds = [("u0", F.col("seq")), ("u1", F.replace("seq", F.lit("GATC"), F.lit("GTTC"))), ("u2", F.replace("seq", F.lit("TCA"), F.lit("TGA"))), ("u3", F.expr("substring(seq, 1, cast(length(seq) div 2 as int))"))]
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("genome"), x.alias("seq")) for g, x in kinds))).alias("x")
    return rows.select("family", "locus", each).select("family", F.concat("locus", F.lit("_"), "x.genome").alias("locus"), "x.genome", "x.seq")


def items(s, d):
    """The benchmark's texts as bases: sequences of a size that is aligned in full. (family, locus, genome, seq)."""
    letters, bases = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
    dna = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), letters, bases)
    return table(s, d, "benchmark").select(F.expr("concat('g', item_id % 8)").alias("family"), F.concat(F.lit("i"), padded(F.col("item_id"), 5)).alias("locus"), F.expr("concat('u', item_id % 3)").alias("genome"), dna.alias("seq"))


GENES = """, i AS (
    SELECT 'i' || lpad(CAST(item_id AS VARCHAR), greatest(5, length(CAST(item_id AS VARCHAR)))::INT, '0') AS locus, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark
), genes AS (
    SELECT locus || '_u0' AS locus, seq FROM i UNION ALL SELECT locus || '_u1', replace(seq, 'GATC', 'GTTC') FROM i UNION ALL SELECT locus || '_u2', replace(seq, 'TCA', 'TGA') FROM i UNION ALL SELECT locus || '_u3', substr(seq, 1, length(seq) // 2) FROM i) """
query("homology_candidates", ["dna"], GENES + """, k AS (SELECT DISTINCT locus, substr(seq, i, 12) AS kmer FROM (SELECT locus, seq, unnest(range(1, length(seq) - 10)) AS i FROM genes))
SELECT a.locus AS q, b.locus AS s, count(*) AS n FROM k a JOIN k b USING (kmer) WHERE a.locus < b.locus GROUP BY ALL HAVING count(*) >= 2""")(lambda s, d: clustering.candidates(genes(s, d), K, SHARED))  # fmt: skip
query("check_consistency", ["loci", "clusters"], """, c AS (SELECT threshold, locus, CASE WHEN threshold = 90 AND CAST(substr(locus, 2) AS BIGINT) % 50 = 0 THEN 'm' || CAST(cluster[:3] AS INT) // 30 WHEN threshold = 90 AND CAST(cluster[:3] AS INT) < 10 THEN 'n' ELSE cluster END AS cluster FROM clusters
), r AS (SELECT *, first_value(cluster) OVER w AS root, lag(cluster) OVER w AS before FROM c WINDOW w AS (PARTITION BY locus ORDER BY threshold)
), bad AS (SELECT threshold, cluster, list(DISTINCT root) AS roots, min(root) AS root FROM r GROUP BY ALL HAVING count(DISTINCT root) > 1 OR count(DISTINCT before) > 1
), e AS (SELECT root AS a, unnest(roots) AS b FROM bad), edges AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT threshold, cluster, CASE WHEN len(roots) > 1 THEN 'mixed' ELSE 'merged' END AS kind, (SELECT min(b) FROM reach WHERE a = root) AS error_group FROM bad""", True)(lambda s, d: clustering.check_consistency(_twisted(s, d)))  # fmt: skip
query("classify_paralogs", [], None)(lambda s, d: _classified(s, d))
query("split_paralogs", [], None)(lambda s, d: paralogs.split(loci_list(s, d), categories(s, d)))
query("split_paralogs_legacy", [], None)(lambda s, d: paralogs.split(loci_list(s, d), categories(s, d), strict=True))
query("agg_truncation_groups", [*LIST, "categories"], "SELECT threshold, allele, genome, count(DISTINCT coalesce('ff' || ff_group, locus)) AS copies FROM loci_list LEFT JOIN categories USING (locus) WHERE locus NOT IN (SELECT locus FROM loci WHERE event_id % 3 = 0) GROUP BY ALL")(
    lambda s, d: paralogs.truncation_groups(loci_list(s, d), categories(s, d), loci(s, d).where("event_id % 3 = 0")))
query("topn_greedy_disjoint", [], None)(lambda s, d: _classified(s, d).where("ff = 1"))
query("top1_best_score", [*LIST, "categories"], """, c AS (SELECT family, threshold, allele, count(DISTINCT genome || '|' || coalesce('ff' || ff_group, locus)) AS t, count(DISTINCT genome) AS g FROM loci_list LEFT JOIN categories USING (locus) GROUP BY ALL
), n AS (SELECT *, max(g) OVER (PARTITION BY family) AS n FROM c QUALIFY threshold > min(threshold) OVER (PARTITION BY family))
SELECT family, threshold, allele FROM n WHERE g > 1 QUALIFY rank() OVER (PARTITION BY family ORDER BY t - 2 * g) = 1""")(lambda s, d: paralogs.best_scores(loci_list(s, d), categories(s, d)))  # fmt: skip


def _twisted(s, d):
    """Clusters whose nesting is broken: some loci of the highest threshold are in clusters across families, and some clusters are one."""
    k = F.expr("cast(substring(cluster, 1, 3) as int)")
    top = F.col("threshold") == 90
    odd = F.when(top & F.expr("cast(substring(locus, 2) as long) % 50 = 0"), F.concat(F.lit("m"), F.floor(k / 30).cast("string"))).when(top & (k < 10), "n").otherwise(F.col("cluster"))
    return clusters(s, d).withColumn("cluster", odd)


def _classified(s, d):
    """Families of a few loci; a locus' length cluster stands on its own, and hits tell fragments from copies."""
    base = loci(s, d).select("locus", "genome", F.concat(F.lit("g"), F.col("f").cast("string")).alias("family"), "event_id", "length")
    members = base.select("family", "locus", "genome", F.concat("family", F.lit("r"), (F.col("event_id") % 4).cast("string")).alias("rep"))
    reps = members.select(F.col("rep").alias("locus")).distinct().select("locus", (F.crc32("locus") % 300 + 100).cast("int").alias("length"))
    a = reps.select(F.col("locus").alias("q"), F.col("length").alias("qlen"), F.regexp_extract("locus", "^(g[0-9]+)", 1).alias("f"))
    b = a.select(F.col("q").alias("s"), F.col("qlen").alias("slen"), "f")
    hits = a.join(b, "f").where("q != s and crc32(concat(least(q, s), greatest(q, s))) % 3 > 0").select("q", "s", "qlen", "slen", F.least("qlen", "slen").alias("length"), F.lit(80.0).alias("qcovs"), F.lit(90.0).alias("pident"), F.lit(1).alias("sstart"), F.col("slen").alias("send"))
    return paralogs.classify(members, hits, reps)


def _changed(rows):
    """(family, locus, genome, aln) of documents, not filled up."""
    return rows.select(F.concat(F.lit("g"), padded(F.expr("length(dna) % 20"), 5)).alias("family"), "locus", "genome", F.regexp_replace(F.regexp_replace("dna", "TT", "--"), "GG", "NN").alias("aln"))


def aligned(s, d):
    """Documents as aligned sequences, filled up to their family's longest; the family is a document's length class."""
    rows = documents(s, d).repartition("locus").withColumn("family", F.concat(F.lit("g"), padded(F.expr("length(dna) % 20"), 5)))
    width = F.broadcast(rows.groupBy("family").agg(F.max(F.length("dna")).cast("int").alias("w")))  # twenty families
    return _changed(rows).join(width, "family").select("family", "locus", "genome", F.rpad("aln", F.col("w"), F.lit("-")).alias("aln"))


def slim_aligned(s, d):
    """alignment.slim() of aligned(), from one pass over the documents: their letters are kept, and their families' widths follow from those."""
    rows = stored(alignment.slim(_changed(documents(s, d).repartition("locus"))))
    width = F.broadcast(rows.groupBy("family").agg(F.max("_width").alias("w")))
    return rows.join(width, "family").withColumn("_width", F.col("w")).drop("w")


ALIGNED = """aligned AS (SELECT 'g' || lpad(CAST(length(dna) % 20 AS VARCHAR), 5, '0') AS family, locus, genome, rpad(regexp_replace(regexp_replace(dna, 'TT', '--', 'g'), 'GG', 'NN', 'g'), (max(length(dna)) OVER (PARTITION BY length(dna) % 20))::INT, '-') AS aln FROM dna
), width AS (SELECT family, w, sum(w) OVER (ORDER BY family) AS stop FROM (SELECT family, max(length(aln)) AS w FROM aligned GROUP BY family)
), best AS (SELECT family, genome, locus, aln, count(*) OVER (PARTITION BY family, genome) AS n FROM aligned QUALIFY row_number() OVER (PARTITION BY family, genome ORDER BY length(translate(aln, '-N', '')) DESC, locus) = 1)"""
A = f", {ALIGNED} "


def _order(s, d):
    return aligned(s, d).select("family").distinct().select("family", F.lit(1).alias("block"), F.expr("cast(substring(family, 2) as int)").alias("ord"))


query("agg_longest_per_genome", ["dna"], A + "SELECT * FROM best")(lambda s, d: alignment.longest_per_genome(aligned(s, d)))
query("win_cumulative_offset", ["dna"], A + "SELECT family, CAST(stop - w + 1 AS BIGINT) AS start, CAST(stop AS BIGINT) AS \"end\" FROM width")(lambda s, d: alignment.offsets(aligned(s, d), _order(s, d)))
query("aln_gff", ["dna"], A + """SELECT family, concat_ws(chr(9), 'Pangenome', 'NA', 'CDS', stop - w + 1, stop, '.', '+', '0', 'ID=' || family || ';gene=' || family) AS line FROM width""")(
    lambda s, d: alignment.offsets_gff(alignment.offsets(aligned(s, d), _order(s, d))))
query("aln_concat", ["dna"], A + """SELECT genome, string_agg(CASE WHEN n IS NULL THEN repeat('N', w) WHEN n > 1 THEN repeat('-', w) ELSE replace(aln, '-', 'N') END, '' ORDER BY family) AS aln
FROM width CROSS JOIN (SELECT DISTINCT genome FROM aligned) LEFT JOIN best USING (family, genome) GROUP BY genome""")(lambda s, d: alignment.concatenate(aligned(s, d), _order(s, d), documents(s, d)))  # fmt: skip
def aligned_proteins(s, d):
    """As aligned(), of the documents' translations."""
    rows = documents(s, d).withColumn("family", F.concat(F.lit("g"), padded(F.expr("length(dna) % 20"), 5))).withColumn("protein", seq.translated(F.col("dna")))
    # A document's codons, each an amino acid, say how long its protein is.
    width = F.broadcast(rows.groupBy("family").agg(F.max(F.floor(F.length("dna") / 3)).cast("int").alias("w")))
    return rows.join(width, "family").select("family", "locus", "genome", F.rpad("protein", F.col("w"), F.lit("-")).alias("aln"))


query("tool_pan_alignment_aa", ["dna"], CODE + """, cut AS (SELECT locus, k, substr(dna, k * 3 + 1, 3) AS codon FROM (SELECT locus, dna, unnest(range(0, length(dna) // 3)) AS k FROM dna)
), p AS (SELECT locus, string_agg(aa, '' ORDER BY k) AS protein FROM cut JOIN code USING (codon) GROUP BY locus
), named AS (SELECT 'g' || lpad(CAST(length(dna) % 20 AS VARCHAR), 5, '0') AS family, locus, genome, coalesce(protein, '') AS aln FROM dna LEFT JOIN p USING (locus)
), width AS (SELECT family, max(length(aln)) AS w FROM named GROUP BY family
), best AS (SELECT family, genome, aln, count(*) OVER (PARTITION BY family, genome) AS n FROM named QUALIFY row_number() OVER (PARTITION BY family, genome ORDER BY length(translate(aln, '-*', '')) DESC, locus) = 1)
SELECT genome, string_agg(CASE WHEN n IS NULL THEN repeat('X', w) WHEN n > 1 THEN repeat('-', w) ELSE rpad(replace(aln, '*', 'X'), w::INT, 'X') END, '' ORDER BY family) AS aln
FROM width CROSS JOIN (SELECT DISTINCT genome FROM named) LEFT JOIN best USING (family, genome) GROUP BY genome""")(lambda s, d: alignment.concatenate(aligned_proteins(s, d), _order(s, d), documents(s, d), gap="X", amino=True))  # fmt: skip
query("tool_unique_seqs", ["dna"], A + """, u AS (SELECT family, aln, row_number() OVER (PARTITION BY family ORDER BY min(locus)) AS seq_id FROM aligned GROUP BY family, aln) SELECT DISTINCT a.family, seq_id, aln, genome FROM aligned a JOIN u USING (family, aln)""")(
    lambda s, d: alignment.unique_sequences(aligned(s, d)))
SQL["agg_unique_seqs"], QUERIES["agg_unique_seqs"] = SQL["tool_unique_seqs"], QUERIES["tool_unique_seqs"]
query("tool_subset_alignments", ["dna"], A + """, r AS (SELECT family || '_' || CAST(substr(locus, 2) AS BIGINT) % 3 AS allele, genome, locus, aln, count(*) OVER o AS n, row_number() OVER (o ORDER BY length(replace(aln, '-', '')) DESC, locus) AS r
FROM aligned WINDOW o AS (PARTITION BY family, CAST(substr(locus, 2) AS BIGINT) % 3, genome)) SELECT allele, genome, locus, CASE WHEN n > 1 THEN repeat('-', length(aln)) ELSE aln END AS aln FROM r WHERE r = 1 AND ends_with(allele, '_1')""")(
    lambda s, d: (lambda a: alignment.subset(aligned(s, d), a, a.where("allele like '%_1'").select("allele").distinct()))(aligned(s, d).select(F.expr("concat(family, '_', cast(substring(locus, 2) as long) % 3)").alias("allele"), "locus")))
query("aln_overlap_sites", ["dna"], A + """, s AS (SELECT family, locus, list_filter(list_transform(string_split(aln, ''), lambda x, i: CASE WHEN x NOT IN ('-', '') THEN i END), lambda i: i IS NOT NULL) AS s FROM aligned)
SELECT a.family, a.locus AS a, b.locus AS b, len(list_intersect(a.s, b.s)) AS both_, len(list_intersect(a.s, b.s)) >= 0.9 * len(a.s) AND len(list_intersect(a.s, b.s)) >= 0.9 * len(b.s) AS similar FROM s a JOIN s b ON a.family = b.family AND a.locus < b.locus""")(
    lambda s, d: alignment.column_overlaps(aligned(s, d)).withColumnRenamed("both", "both_"))
query("aln_percent_identity", ["dna"], A + """, c AS (SELECT family, unnest(string_split(aln, '')) AS x, unnest(range(1, length(aln) + 1)) AS p FROM aligned
), l AS (SELECT family, p, x, count(*) AS n FROM c WHERE x BETWEEN 'A' AND 'Z' AND length(x) = 1 GROUP BY ALL
), k AS (SELECT family, p, sum(n) AS f, max(n) AS top, sum(n * (n - 1)) AS e FROM l GROUP BY ALL
), s AS (SELECT family, count(*) AS sequences, max(length(aln)) AS width FROM aligned GROUP BY family)
SELECT family, sequences, width, CASE WHEN sum(f * (f - 1)) > 0 THEN 100::DOUBLE * sum(e) / sum(f * (f - 1)) ELSE 0 END AS average, CASE WHEN width > 0 THEN 100::DOUBLE * count(*) FILTER (top = sequences) / width ELSE 0 END AS overall
FROM s LEFT JOIN k USING (family) GROUP BY family, sequences, width""")(lambda s, d: alignment.percent_identity(aligned(s, d)))  # fmt: skip
query("aggregate_multigene", ["dna"], A + "SELECT family, locus, genome, dna AS seq FROM aligned JOIN (SELECT locus, dna FROM dna) USING (locus) WHERE family < 'g00003'")(
    lambda s, d: alignment.family_sequences(aligned(s, d).where("family < 'g00003'").select("family").distinct(), aligned(s, d), documents(s, d).withColumnRenamed("dna", "seq")))
query("seq_align_msa", [], None)(lambda s, d: alignment.align_families(items(s, d)))
query("seq_back_translate", [], None)(lambda s, d: alignment.back_translate(_coding(s, d)))
query("classify_paralogs_aligned", ["dna"], f""", {ALIGNED}, bit AS (SELECT family, locus, genome, CAST(substr(locus, 2) AS BIGINT) AS pos, CAST(translate(regexp_replace(aln, '[^-]', '1', 'g'), '-', '0') || '0' AS BIT) AS s FROM aligned
), pat AS (SELECT family, s, bit_count(s)::BIGINT AS n, row_number() OVER (PARTITION BY family ORDER BY bit_count(s), min(locus)) AS i FROM bit GROUP BY family, s
), lead_(family, i, bank, c) AS (
    SELECT family, i, [s], 1::BIGINT FROM pat WHERE i = 1
    UNION ALL SELECT family, i, CASE WHEN k IS NULL THEN list_append(bank, s) ELSE bank END, coalesce(k, len(bank) + 1)
    FROM (SELECT p.family, p.i, p.s, bank, list_filter(range(1, len(bank) + 1), lambda j: bit_count(bank[j] & p.s) >= 0.9::DOUBLE * p.n AND bit_count(bank[j] & p.s) >= 0.9::DOUBLE * bit_count(bank[j]))[1] AS k
        FROM lead_ l JOIN pat p ON p.family = l.family AND p.i = l.i + 1)
), kind AS (SELECT family, min(n) = max(n) OR max(c) = 1 AS plain FROM pat JOIN lead_ USING (family, i) GROUP BY family
), near AS (SELECT family, locus, genome, pos, s, n, c, coalesce(least(pos - lag(pos) OVER w, lead(pos) OVER w - pos), 0) AS near FROM bit JOIN pat USING (family, s) JOIN lead_ USING (family, i) WINDOW w AS (PARTITION BY family, genome ORDER BY pos, locus)
), row_ AS (SELECT *, row_number() OVER (PARTITION BY family, genome ORDER BY near, pos, locus) AS i FROM near
), walk(family, genome, i, locus, g, s, n, c) AS (
    SELECT family, genome, i, locus, 1, s, n, c FROM row_ WHERE i = 1
    UNION ALL SELECT family, genome, i, locus, CASE WHEN same OR ends THEN g + 1 ELSE g END, CASE WHEN ends THEN s ELSE hs END, CASE WHEN ends THEN n ELSE hn END, CASE WHEN ends THEN c ELSE hc END
    FROM (SELECT *, NOT same AND (n - both_ <= both_ OR both_ > 0.75 * hn OR both_ > 0.75 * n) AS ends
        FROM (SELECT r.*, g, w.s AS hs, w.n AS hn, w.c AS hc, r.c = w.c AS same, bit_count(r.s & w.s)::BIGINT AS both_ FROM walk w JOIN row_ r ON r.family = w.family AND r.genome = w.genome AND r.i = w.i + 1)))
SELECT r.locus, family, genome, CASE WHEN plain OR max(g) OVER (PARTITION BY family, genome) > 1 THEN 1 ELSE 0 END AS mc, CASE WHEN NOT plain AND count(*) OVER (PARTITION BY family, genome, g) > 1 THEN 1 ELSE 0 END AS ff,
    CAST(CASE WHEN NOT plain THEN g WHEN count(*) OVER (PARTITION BY family, genome) > 1 THEN row_number() OVER (PARTITION BY family, genome ORDER BY r.locus) ELSE 0 END AS INT) AS ff_group, CAST(CASE WHEN plain THEN 1 ELSE r.c END AS INT) AS length_cluster
FROM row_ r JOIN walk w USING (family, genome, i) JOIN kind USING (family)""", True)(
    lambda s, d: paralogs.classify_aligned(aligned(s, d), documents(s, d).select("locus", F.expr("cast(substring(locus, 2) as long) pos"))))
query("sink_multicopy_dosage", [*LIST, "categories", "doses"], "SELECT family, genome, dose FROM doses WHERE threshold = 50 AND dose > 1")(
    lambda s, d: families.doses(loci_list(s, d), categories(s, d)).where("threshold = 50 and dose > 1").select("family", "genome", "dose"))


def _coding(s, d):
    """Items cut to whole codons, with a start and a stop."""
    rows = items(s, d).withColumn("seq", F.expr("concat('ATG', substring(seq, 1, cast(length(seq) div 3 * 3 as int)), 'TAA')"))
    return rows.withColumn("protein", seq.translated(F.col("seq")))


@query("tree_fasttree", [], None)
def tree_fasttree(s, d):
    """One row with the tree of all genomes, from the families that they have."""
    rows = checkpoint(loci_list(s, d))
    return joining.newick(joining.tree_of(rows), rows)
