"""Writers of the file formats. All write with Spark, to a folder, so that a path may be in any store."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions.sequences import wrapped
from strandline.operators.tools import distance_lines, names_of, wide


#: How text is written whose size follows a filling, or pairs, and not the input; and the rows of such a file, which is read as a whole.
PRESSED, RECORDS = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}, 1000


def text(df: DataFrame, line, path: str, *by: str, pressed: bool = False) -> None:
    """One text line (or several) for each row; a folder for each value of `by`. Pressed: compressed files of RECORDS rows at most."""
    rows = df.select(*by, line.alias("value"))
    writer = rows.write.mode("overwrite")
    writer = writer.options(**PRESSED, maxRecordsPerFile=RECORDS) if pressed else writer
    (writer.partitionBy(*by) if by else writer).text(path)


def tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header, quote="", emptyValue="", nullValue="")


def headed(rows: DataFrame, line: Column, header: str, path: str, pressed: bool = False) -> None:
    """One text line for each row, under the header in every file, compressed if asked. Without a row there is a file with the header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = False
        for batch in batches:
            lines = batch.column(0).drop_null()
            if not told:
                told = True
                yield pa.RecordBatch.from_arrays([pa.array([header], pa.string())], names=["value"])
            yield pa.RecordBatch.from_arrays([lines], names=["value"])

    none = rows.sparkSession.createDataFrame([(None,)], "value string")
    rows.select(line.alias("value")).unionByName(none).mapInArrow(run, "value string").write.mode("overwrite").options(**PRESSED if pressed else {}).text(path)


def field(column: Column | str) -> Column:
    """A value as it stands between tabs: empty for null. One that has a tab or ends a line would shift what follows and is an error."""
    text = F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))
    return F.when(text.rlike("[\\t\\n\\r]"), F.raise_error(F.concat(F.lit("a tab or line end in: "), text))).otherwise(text)


def quoted(column: Column) -> Column:
    """A value in quotes, its own ones doubled."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(column, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def by_genome(rows: DataFrame) -> DataFrame:
    """rows dealt out by genome, over all cores: a genome's folder costs more than its bytes, by which adaptive plans would put tasks together.

    By a hash, as rows that lie by genome already would not be dealt out anew.
    """
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("genome"))


def gff(rows: DataFrame, path: str) -> None:
    """(genome, text): a folder for each genome. Tasks put their own folders in place, which else the driver would do one by one."""
    own = by_genome(rows).select("genome", F.regexp_replace("text", "\n$", "").alias("value"))
    own.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("genome").text(path)


def coords(rows: DataFrame, path: str) -> None:
    names = [c.split()[0] for c in schemas.COORDS.split(", ")]
    by_genome(rows.select("genome", *names)).write.mode("overwrite").partitionBy("genome").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def genome_list(rows: DataFrame, path: str) -> None:
    text(rows.select("genome").distinct().orderBy("genome"), F.col("genome"), path)


def fasta(rows: DataFrame, path: str, name: str = "locus", seq: str = "seq", width: int = 0, *by: str, pressed: bool = False) -> None:
    text(rows, F.concat(F.lit(">"), name, F.lit("\n"), wrapped(F.col(seq), width) if width else F.col(seq)), path, *by, pressed=pressed)


def clusters(rows: DataFrame, path: str) -> None:
    """(threshold, cluster, locus): a line for each cluster, in order, and a folder for each threshold."""
    lines = rows.groupBy("threshold", "cluster").agg(F.array_join(F.array_sort(F.collect_list("locus")), "\t").alias("line"))
    text(lines.orderBy("threshold", "cluster"), F.col("line"), path, "threshold")


def genome2loci(rows: DataFrame, path: str) -> None:
    tsv(rows.select("locus", "genome", "gene", "product"), path, header=False)


def loci_list(rows: DataFrame, path: str) -> None:
    tsv(rows.select("locus", "family", "threshold", "allele", "genome"), path, header=False)


def paralog_clusters(families: DataFrame, path: str) -> None:
    """(family): a name a line."""
    text(families.orderBy("family"), F.col("family"), path)


def cluster_alleles(rows: DataFrame, path: str) -> None:
    """(family, threshold, allele, genome, loci, n_loci)."""
    tsv(rows.select("family", "threshold", "allele", "genome", "loci", "n_loci"), path, header=False)


def paralog_categories(rows: DataFrame, families: DataFrame, path: str) -> None:
    """Categories by family under categories, and under errors the names of families (family) that have none."""
    tsv(rows.select("locus", "family", "genome", "mc", "ff", "ff_group", "length_cluster").orderBy("family", "genome", "locus"), f"{path}/categories", header=False)
    text(families.select("family").distinct().join(rows, "family", "left_anti").orderBy("family"), F.col("family"), f"{path}/errors")


def split_loci(rows: DataFrame, log: DataFrame, path: str) -> None:
    """The divided families' loci under loci, and a line for each family (family, line) under log."""
    loci_list(rows, f"{path}/loci")
    text(log.orderBy("family"), F.col("line"), f"{path}/log")


def order(rows: DataFrame, path: str) -> None:
    tsv(rows.select("family", "block", "ord").orderBy("block", "ord"), path, header=False)


def blocks(syntenic: DataFrame, connected: DataFrame, reversed_: DataFrame, order_rows: DataFrame, path: str) -> None:
    """Four tables, each in a folder: blocks, connected paths (with kind), those that loop back, and the order of families."""
    for name, rows in (("syntenic_blocks", syntenic), ("connected_blocks", connected), ("reversed", reversed_)):
        tsv(rows.orderBy("block_number"), f"{path}/{name}")
    order(order_rows, f"{path}/order")


def representatives(rows: DataFrame, path: str) -> None:
    """(family, locus, genome, gene, product, number_genomes, seq, protein): nucleotides under ffn, amino acids under faa."""
    parts = {"representative_genome": "genome", "locus_tag": "locus", "gene_name": "gene", "gene_product": "product", "number_genomes": "number_genomes"}
    header = F.concat_ws(";", F.concat(F.lit(">"), "family"), *(F.concat(F.lit(f"{n}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for n, c in parts.items()))
    for folder, column in (("ffn", "seq"), ("faa", "protein")):
        text(rows.orderBy("family"), F.concat_ws("\n", header, F.col(column)), f"{path}/{folder}")


def summary(bucket_rows: DataFrame, path: str) -> None:
    """The report: a line for each bucket in order, `low-high%` and its counts."""
    low = F.coalesce(F.lag("bucket_top").over(Window.orderBy("bucket_top")), F.lit(0))  # a handful of rows
    name = F.concat(low.cast("string"), F.lit("-"), F.col("bucket_top").cast("string"), F.lit("%")).alias("%isolates")
    columns = {"n_families": "#clusters", "n_multi_allele": ">1 allele", "n_fission": "fission/fusion", "n_duplication": "multicopy"}
    tsv(bucket_rows.orderBy("bucket_top").select(name, *(F.col(c).alias(n) for c, n in columns.items())), path)


def alignment(rows: DataFrame, features: DataFrame, path: str) -> None:
    """(genome, aln) under fasta, and lines of offsets_gff() under gff."""
    fasta(rows.orderBy("genome"), f"{path}/fasta", "genome", "aln")
    text(features.orderBy("family"), F.col("line"), f"{path}/gff")


def family_table(meta: DataFrame, cells: DataFrame, path: str, genomes: list[str] | None = None) -> None:
    """The wide table: metadata in the format's columns and order, columns of a graph's order if there, then the genomes."""
    names = dict(zip(["min_length", "max_length", "average_length"], schemas.FAMILY_META[-3:], strict=True))
    number = F.when(F.col("average_dose") == F.floor("average_dose"), F.format_string("%d", F.floor("average_dose"))).otherwise(F.format_string("%.2f", "average_dose"))
    rows = meta.withColumn("average_dose", number).withColumn("average_length", F.format_string("%.2f", "average_length")).withColumnsRenamed(names)
    genomes = genomes or names_of(cells, "genome")
    cells = cells.join(meta.select(F.col("allele_name").alias("allele"), "threshold"), ["allele", "threshold"], "left_semi")
    grid, names = wide(cells.select(F.col("allele").alias("allele_name"), "threshold", "genome", "cell"), ["allele_name", "threshold"], "genome", "cell", genomes, "")
    columns = [c for c in (*schemas.FAMILY_META, *schemas.FAMILY_ORDER) if c in rows.columns]
    out = rows.join(grid, ["allele_name", "threshold"])
    headed(out, F.concat_ws("\t", *(field(f"`{c}`") for c in columns), "line"), "\t".join([*columns, *names]), path)


def family_tables(families_: DataFrame, unique: DataFrame, all_: DataFrame, per_allele: DataFrame, cells: DataFrame, path: str, genomes: list[str] | None = None) -> None:
    """Four tables, each in a folder: families, unique alleles and all alleles with their cells, and genomes by allele."""
    genomes = genomes or names_of(cells, "genome")
    for name, meta in (("gene_families", families_), ("unique_alleles", unique), ("all_alleles", all_)):
        family_table(meta, cells, f"{path}/{name}", genomes)
    tsv(per_allele.select("allele", "family", "threshold", "n_genomes"), f"{path}/genomes_per_allele", header=False)


def matrix(rows: DataFrame, keys: list[str], column: str, path: str, value: str | None = None, names: list[str] | None = None) -> None:
    """Long rows as a wide table: 1 for each row without a value column."""
    rows = rows if value else rows.withColumn("_one", F.lit(1))
    grid, names = wide(rows, keys, column, value or "_one", names)
    headed(grid, F.concat_ws("\t", *map(field, keys), "line"), "\t".join([*keys, *names]), path)


def distances(present: DataFrame, path: str, key: str = "g1", pressed: bool = False) -> None:
    """The distances of all genomes to all as a wide table, a line for each genome, compressed if asked; no pair is dealt out."""
    names = names_of(present, "genome")
    headed(distance_lines(present), F.concat_ws("\t", field("genome"), "line"), "\t".join([key, *names]), path, pressed)


def roary(rows: DataFrame, cells: DataFrame, path: str, genomes: list[str] | None = None) -> None:
    """The quoted table: fourteen columns, then the genomes, whose fragments are listed like copies.

    A family's place in the graph is the fragment's, if rows have cluster and cluster_order.
    """
    na = F.lit("NA")
    place = [F.coalesce(F.col(c).cast("string"), na) if c in rows.columns else na for c in ("cluster", "cluster_order")]
    fixed = [F.col("gene"), F.col("non_unique_gene_name"), F.col("annotation"), F.col("n_isolates"), F.col("n_sequences"), F.col("average_per_isolate"), *place, na, na, F.lit(""), F.col("min_length"), F.col("max_length"), F.col("average_length")]
    left = rows.select(*(c.cast("string").alias(n) for c, n in zip(fixed, schemas.ROARY, strict=True)))
    plain = F.replace(F.regexp_replace("cell", "[()]", ""), F.lit(":"), F.lit(";"))
    own = cells.select(F.concat_ws("__", "allele", "family").alias("Gene"), "genome", quoted(plain).alias("cell"))
    grid, names = wide(own, ["Gene"], "genome", "cell", genomes, '""', ",")
    line = F.concat_ws(",", *(quoted(F.regexp_replace(F.col(f"`{c}`"), "[\\n\\r]", " ")) for c in schemas.ROARY), "line")
    doubled = lambda x: '"' + x.replace('"', '""') + '"'
    headed(left.join(grid, "Gene"), line, ",".join(map(doubled, [*schemas.ROARY, *names])), path)


def binary_fasta(rows: DataFrame, path: str) -> None:
    fasta(rows, path, "genome", "seq", 80)
