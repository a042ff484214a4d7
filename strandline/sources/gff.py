"""GFF3 with sequences: reading, standardising, and writing it again.

A file is read whole as one row and cut into numbered lines, because what a line means depends on whether ##FASTA has
come before it in its file. Files are many and each is one genome, so a task holds one genome's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.names import gene_root, genome_name, locus_name
from strandline.functions.sequences import clean, one_stop, passes, piece, reverse_complement, translated


def scan_dir(spark: SparkSession, path: str, pattern: str = "*.gff") -> DataFrame:
    """(genome, text) of the files in a folder; a pangenome takes two at least.

    The genome is the file's name without .gff, or that of its folder, genome=<name>, as sinks.gff() writes them.
    """
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    stem = F.col("genome").cast("string") if "genome" in files.columns else F.regexp_replace(F.col("_metadata.file_name"), r"\.gff$", "")
    files = files.select(stem.alias("stem"), F.col("value").alias("text"))
    if files.limit(2).count() < 2:
        raise ValueError("two or more annotated genomes are needed")
    return files.select(genome_name(F.col("stem")).alias("genome"), "text")


def lines(files: DataFrame) -> DataFrame:
    """(genome, n, line, kind): pragma, feature, header (of a sequence), sequence, or blank."""
    rows = files.select("genome", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    rows = rows.withColumn("fasta_at", F.min(F.when(F.col("line").startswith("##FASTA"), F.col("n"))).over(Window.partitionBy("genome")))
    inside = F.coalesce(F.col("n") > F.col("fasta_at"), F.lit(False))
    line = F.col("line")
    kind = F.when(F.trim(line) == "", "blank").when(inside & line.startswith(">"), "header").when(inside, "sequence").when(line.startswith("#"), "pragma").otherwise("feature")
    return rows.select("genome", "n", "line", kind.alias("kind"))


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute, by its whole name; null if it is missing or empty."""
    found = F.regexp_extract(attrs, f"(?:^|;)\\s*{name}=([^;]*)", 1)
    return F.when(found != "", found)


def features(line_rows: DataFrame) -> DataFrame:
    """(genome, n, contig, source, type, start, end, score, strand, phase, attrs) of feature lines."""
    f = F.split("line", "\t")
    at = lambda k: f.getItem(k)
    return line_rows.where("kind = 'feature'").select(
        "genome", "n", at(0).alias("contig"), at(1).alias("source"), at(2).alias("type"), at(3).cast("long").alias("start"), at(4).cast("long").alias("end"),
        at(5).alias("score"), at(6).alias("strand"), at(7).alias("phase"), at(8).alias("attrs"))


def of_types(feature_rows: DataFrame, types: tuple[str, ...] = ("CDS",)) -> DataFrame:
    """Features whose type begins with one of `types`; genes never count."""
    return feature_rows.where(F.col("type").rlike("^(" + "|".join(types) + ")") & (F.col("type") != "gene"))


def contigs(line_rows: DataFrame) -> DataFrame:
    """(genome, contig, seq): each header's name up to white space, its lines joined in order, cleaned."""
    w = Window.partitionBy("genome").orderBy("n")
    rows = line_rows.where("kind in ('header', 'sequence')").withColumn("contig", F.last(F.when(F.col("kind") == "header", F.regexp_extract("line", r"^>\s*(\S+)", 1)), ignorenulls=True).over(w))
    parts = rows.where("kind = 'sequence' and contig is not null").groupBy("genome", "contig").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("p"))
    return parts.select("genome", "contig", clean(F.array_join(F.transform("p", lambda x: x["line"]), "")).alias("seq"))


def matching(feature_rows: DataFrame, contig_rows: DataFrame) -> DataFrame:
    """Features of genomes that have a sequence for every contig they annotate."""
    bad = feature_rows.select("genome", "contig").distinct().join(contig_rows.select("genome", "contig"), ["genome", "contig"], "left_anti").select("genome").distinct()
    return feature_rows.join(bad, "genome", "left_anti")


def counted(feature_rows: DataFrame) -> DataFrame:
    """Features with their number by genome and type, in file order."""
    return feature_rows.withColumn("number", F.row_number().over(Window.partitionBy("genome", "type").orderBy("n")))


def standardised(feature_rows: DataFrame) -> DataFrame:
    """Features with locus names, counted by genome and type in file order, in their attributes; what was there becomes prev_*."""
    rows = counted(feature_rows).withColumn("locus", locus_name(F.col("genome"), F.col("type"), F.col("number"))).drop("number")

    def rewritten(a: Column) -> Column:
        name, value = F.regexp_extract(a, "^([^=]*)=", 1), F.regexp_extract(a, "^[^=]*=(.*)$", 1)
        return F.when(F.trim(name).isin("ID", "locus_tag"), F.concat(F.lit("prev_"), F.trim(name), F.lit("="), value)).when(F.trim(name) == "gene", F.concat(F.lit("gene="), F.translate(value, "/", "_"))).otherwise(a)

    rest = F.filter(F.transform(F.filter(F.split(F.coalesce("attrs", F.lit("")), ";"), lambda a: F.trim(a) != ""), rewritten), lambda a: ~a.startswith("prev_prev_"))
    own = F.array(F.concat(F.lit("ID="), "locus"), F.concat(F.lit("locus_tag="), "locus"))
    return rows.withColumn("attrs", F.array_join(F.concat(own, rest), ";"))


def coords(feature_rows: DataFrame) -> DataFrame:
    """Co-ordinates in the columns of the file format, with genome; the gene falls back on Name."""
    locus = F.coalesce(attribute(F.col("attrs"), "ID"), attribute(F.col("attrs"), "locus_tag"))
    gene = F.coalesce(attribute(F.col("attrs"), "gene"), attribute(F.col("attrs"), "Name"), F.lit(""))
    return feature_rows.select(
        "genome", locus.alias("Name"), gene_root(gene).alias("Gene"), F.col("start").alias("Start"), F.col("end").alias("End"), (F.col("end") - F.col("start") + 1).alias("Length"), F.col("type").alias("Type"),
        F.when(F.col("strand") == "-", "Reverse").otherwise("Forward").alias("Strand"), F.col("contig").alias("Contig"), F.coalesce(attribute(F.col("attrs"), "product"), F.lit("")).alias("Product"))


def genome2loci(coord_rows: DataFrame) -> DataFrame:
    return coord_rows.select(F.col("Name").alias("locus"), "genome", F.col("Gene").alias("gene"), F.col("Product").alias("product"))


def inside(coord_rows: DataFrame, contig_rows: DataFrame) -> DataFrame:
    """coords and seq, their contig's; features beyond their contig, or without one, have no row."""
    return coord_rows.join(contig_rows.withColumnRenamed("contig", "Contig"), ["genome", "Contig"]).where(F.col("End") <= F.length("seq"))


def feature_sequences(coord_rows: DataFrame, contig_rows: DataFrame) -> DataFrame:
    """coords and seq, on its own strand; features beyond their contig, or without one, have no row."""
    rows = inside(coord_rows, contig_rows)
    cut = piece(F.col("seq"), F.col("Start"), F.col("End"))
    return rows.withColumn("seq", F.when(F.col("Strand") == "Reverse", reverse_complement(cut)).otherwise(cut))


def checked_sequences(rows: DataFrame, min_length: int = 120, check: bool = True) -> DataFrame:
    """(locus, genome, seq, protein) of sequences that pass; without check all but those whose protein has not one stop."""
    good = rows.where(passes(F.col("seq"), min_length)) if check else rows
    return good.select(F.col("Name").alias("locus"), "genome", "seq", translated(F.col("seq")).alias("protein")).where(one_stop(F.col("protein")))


def gff_text(feature_rows: DataFrame, contig_rows: DataFrame) -> DataFrame:
    """(genome, text): a file for each genome, features in order, then the sequences in order of their names."""
    line = F.concat_ws("\t", "contig", "source", "type", F.col("start").cast("string"), F.col("end").cast("string"), "score", "strand", "phase", "attrs")
    top = feature_rows.groupBy("genome").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("f"))
    seqs = contig_rows.groupBy("genome").agg(F.array_sort(F.collect_list(F.struct("contig", "seq"))).alias("c"))
    body = F.concat(F.lit("##gff-version 3\n"), F.array_join(F.transform("f", lambda x: x["line"]), "\n"), F.lit("\n##FASTA\n"), F.array_join(F.transform("c", lambda x: F.concat(F.lit(">"), x["contig"], F.lit("\n"), x["seq"])), "\n"), F.lit("\n"))
    return top.join(seqs, "genome").select("genome", body.alias("text"))
