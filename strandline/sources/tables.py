"""Readers of the tabular formats, each with an explicit schema."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions.names import numbered


def _tsv(spark: SparkSession, path, schema: str, header: bool = False, strict: bool = False) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, header=header, quote="", mode="FAILFAST" if strict else "PERMISSIVE")


def coords(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, schemas.COORDS, header=True)


def genome2loci(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, schemas.GENOME2LOCI)


def hits(spark: SparkSession, path) -> DataFrame:
    """12 or 14 columns; qlen and slen are null if missing."""
    return _tsv(spark, path, schemas.HITS14)


def para_hits(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, schemas.PARA_HITS)


def loci_list(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, schemas.LOCI_LIST)


def paralog_categories(spark: SparkSession, path) -> DataFrame:
    """Lines with fewer than seven columns fail."""
    return _tsv(spark, path, schemas.PARALOG_CATEGORIES, strict=True)


def order(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, schemas.ORDER)


def edges(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, schemas.EDGES)


def error_links(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, "family string, error_group string")


def sample_list(spark: SparkSession, path) -> DataFrame:
    """The first token of each line that has one."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("genome")).where("genome != ''")


#: Lines that one task looks through at once for the last value before a line.
STRETCH = 1 << 16


def ordered_lines(spark: SparkSession, path, keep: Column | None = None, sep: str = "\n") -> DataFrame:
    """(file, number, line): the lines to keep, by default those that are not empty, numbered from 1 in the order of files by name and of their lines.

    Spark splits files as always: a line's place is its file, its split and its place there.
    """
    rows = (spark.read.text(path) if sep == "\n" else spark.read.option("lineSep", sep).text(path)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    kept = rows.where(F.col("line") != "" if keep is None else keep)
    return numbered(kept, "number", F.col("file"), F.col("_block"), F.col("_at")).select("file", "number", "line")


def carried(lines: DataFrame, value: Column, name: str, *keys: str) -> DataFrame:
    """lines (number, ...), and name: the value of the line, or of the last one of its keys before it that has any, without a task that sees all lines."""
    rows = lines.withColumns({name: value, "_stretch": F.expr(f"number div {STRETCH}")})
    ends = rows.groupBy(*keys, "_stretch").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("number"))).alias("_end"))
    before = ends.select(*keys, "_stretch", F.last("_end", True).over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    here = F.last(name, True).over(Window.partitionBy(*keys, "_stretch").orderBy("number"))
    return rows.withColumn(name, here).join(before, [*keys, "_stretch"]).withColumn(name, F.coalesce(name, "_before")).drop("_stretch", "_before")


def cluster_lines(spark: SparkSession, path, threshold: int) -> DataFrame:
    """(threshold, cluster_ord, locus): a line is a cluster, numbered in the order of files by name and of their lines."""
    rows = ordered_lines(spark, path)
    return rows.select(F.lit(threshold).alias("threshold"), F.col("number").alias("cluster_ord"), F.explode(F.split("line", "\t")).alias("locus")).where("locus != ''")


def clstr(spark: SparkSession, path) -> DataFrame:
    """(cluster, locus, length, is_rep): clusters from 1, by the last headline before a sequence; a representative has a *."""
    head = F.regexp_extract("line", r"^>Cluster (\d+)", 1)
    lines = carried(ordered_lines(spark, path), F.when(head != "", head.cast("int")), "c").where(~F.col("line").startswith(">") & F.col("line").contains(">"))
    return lines.select((F.col("c") + 1).alias("cluster"), F.regexp_extract("line", r">(.+?)\.\.\.", 1).alias("locus"), F.regexp_extract("line", r"(\d+)(?:aa|nt),", 1).cast("int").alias("length"), F.col("line").endswith("*").alias("is_rep"))


def fasta(spark: SparkSession, path, upper: bool = True) -> DataFrame:
    """(locus, seq): records cut at line starts with >, lines joined, gaps taken out. Spark splits large files."""
    rows = spark.read.option("lineSep", "\n>").text(path).where("trim(value) != ''")
    body = F.regexp_replace(F.regexp_replace("value", r"^>?[^\n]*\n?", ""), r"[\s-]", "")
    return rows.select(F.regexp_extract("value", r"^>?\s*(\S+)", 1).alias("locus"), (F.upper(body) if upper else body).alias("seq")).where("locus != ''")


def alignment(spark: SparkSession, path) -> DataFrame:
    """(locus, aln): as fasta, gaps kept; sequences of unequal length fail."""
    rows = spark.read.option("lineSep", "\n>").text(path).where("trim(value) != ''")
    out = rows.select(F.regexp_extract("value", r"^>?\s*(\S+)", 1).alias("locus"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^>?[^\n]*\n?", ""), r"\s", "")).alias("aln"))
    if out.agg(F.count_distinct(F.length("aln"))).first()[0] > 1:
        raise ValueError("aligned sequences differ in length")
    return out


def meta_width(header: list[str]) -> int:
    """How many columns come before the genomes: 22 if the table is ordered, 20 if it has no_loci, else 19."""
    return 22 if "cluster_order" in header else 20 if "no_loci" in header else 19


def _headed(spark: SparkSession, path) -> tuple[DataFrame, str]:
    """(line) of all files but their headers, which are one and the same, and the header."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("at"))
    header = lines.where("at = 0").first()
    header = header["line"] if header else ""
    return lines.where((F.col("line") != header) & (F.col("line") != "")).select("line"), header


def _fields(line: str, comma: bool) -> list[str]:
    return next(csv.reader([line])) if comma else line.split("\t")


def _first(rows: DataFrame, columns: list[str], comma: bool = False) -> DataFrame:
    """The first columns of lines, as text; null where they are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(_fields(x, comma) if comma else x.split("\t", len(columns)))[: len(columns)] for x in batch.column(0).to_pylist()]
            got = [x + [""] * (len(columns) - len(x)) for x in got]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] or None for x in got], pa.string()) for k in range(len(columns))], names=columns)

    return rows.mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def _long(rows: DataFrame, header: list[str], begin: int, keys: dict[str, int], name: str, value: str, comma: bool = False, empty: bool = False) -> DataFrame:
    """(keys, name, value): a row for each field of lines from `begin` on that is not empty, or for all; keys are fields by their place.

    A line is taken apart in a task; no plan has a column for each field.
    """
    others = pa.array(header[begin:], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                got = _fields(x, comma)
                got += [""] * (len(header) - len(got))
                cells = pa.array([c or None for c in got[begin : len(header)]], pa.string())
                names = others
                if not empty:
                    names, cells = names.filter(cells.is_valid()), cells.drop_null()
                own = [pa.array([got[k] or None] * len(cells), pa.string()) for k in keys.values()]
                yield pa.RecordBatch.from_arrays([*own, names, cells], names=[*keys, name, value])

    return rows.mapInArrow(run, ", ".join(f"`{c}` string" for c in (*keys, name, value)))


def family_table(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(metadata, cells (allele_name, gene_family, threshold, genome, cell)): long from the start, empty cells left out."""
    rows, header = _headed(spark, path)
    columns = header.split("\t")
    n = meta_width(columns)
    keys = {c: columns.index(c) for c in ("allele_name", "gene_family", "threshold")}
    return _first(rows, columns[:n]), _long(rows, columns, n, keys, "genome", "cell")


def matrix(spark: SparkSession, path, keys: int, name: str = "genome", value: str = "n") -> DataFrame:
    """A wide table as long rows: its first columns, then name and value of each other column, as text."""
    rows, header = _headed(spark, path)
    columns = header.split("\t")
    return _long(rows, columns, keys, {c: k for k, c in enumerate(columns[:keys])}, name, value, empty=True)


def roary_meta(spark: SparkSession, path) -> DataFrame:
    """The fourteen columns before the genomes."""
    rows, header = _headed(spark, path)
    return _first(rows, _fields(header, True)[:14], True)


def roary(spark: SparkSession, path) -> DataFrame:
    """(gene, genome, cell) of a quoted table whose genomes begin at column 15."""
    rows, header = _headed(spark, path)
    return _long(rows, _fields(header, True), 14, {"gene": 0}, "genome", "cell", True)


def vcf_positions(spark: SparkSession, path) -> DataFrame:
    """(record, pos): records numbered in file order from 1."""
    rows = ordered_lines(spark, path, (F.col("line") != "") & ~F.col("line").startswith("#"))
    return rows.select(F.col("number").alias("record"), F.split("line", "\t").getItem(1).cast("long").alias("pos"))


def treewas_results(spark: SparkSession, path) -> DataFrame:
    """Results by column name; a header may say loci for locus."""
    df = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False)
    df = df.withColumnRenamed("loci", "locus")
    return df.withColumn("pvalue", F.col("pvalue").cast("double"))


def metadata_columns(spark: SparkSession, path) -> list[str]:
    """Phenotypes: what the header has after the id."""
    return spark.read.csv(path, sep="\t", header=True).columns[1:]


def trees(spark: SparkSession, path) -> DataFrame:
    """(tree, text): trees in Newick form, numbered in the order of files by name and of their lines. A ; ends one, so names have none."""
    rows = ordered_lines(spark, path, F.trim(F.regexp_replace("value", r"\s", " ")) != "", ";")
    return rows.select(F.col("number").alias("tree"), F.col("line").alias("text"))
