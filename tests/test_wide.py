"""Wide tables of many columns: written as lines, and taken apart again."""

from __future__ import annotations

import glob
import time

import pytest
from pyspark.sql import functions as F

from strandline.operators import tools
from strandline.sources import sinks, tables


def test_thousands_of_columns(spark, tmp_path):
    """No plan has a column for each of these."""
    n, at = 20_000, str(tmp_path / "m")
    rows = spark.range(n).selectExpr("concat('a', id % 3) Gene", "concat('u', lpad(id, 5, '0')) genome", "id + 1 n")
    began = time.time()
    sinks.matrix(rows, ["Gene"], "genome", at, "n")
    got = tables.matrix(spark, at, 1)
    assert got.count() == 3 * n
    assert got.where("n != '0'").count() == n
    assert got.where("n != '0' and (cast(substring(genome, 2) as int) + 1 != cast(n as int) or cast(substring(genome, 2) as int) % 3 != cast(substring(Gene, 2) as int))").count() == 0
    assert time.time() - began < 60


def test_lines(spark, tmp_path):
    rows = spark.createDataFrame([("x", "b", "1"), ("x", "d", "2"), ("y", "e", None), ("y", "a", "4"), ("z", "q", "5")], "k string, c string, v string")
    grid, names = tools.wide(rows, ["k"], "c", "v", ["a", "b", "c", "d", "e"], "-", ",")
    assert names == ["a", "b", "c", "d", "e"]
    assert {r["k"]: r["line"] for r in grid.collect()} == {"x": "-,1,-,2,-", "y": "4,-,-,-,-", "z": "-,-,-,-,-"}
    grid, names = tools.wide(rows, ["k"], "c", "v", empty="")
    assert (names, sorted(r["line"] for r in grid.collect())) == (["a", "b", "d", "e", "q"], ["\t\t\t\t5", "\t1\t2\t\t", "4\t\t\t\t"])


def test_no_rows(spark, tmp_path):
    at = str(tmp_path / "none")
    sinks.matrix(spark.createDataFrame([], "Gene string, genome string, n int"), ["Gene"], "genome", at, "n", ["u1", "u2"])
    assert {r["value"] for r in spark.read.text(at).collect()} == {"Gene\tu1\tu2"}
    assert tables.matrix(spark, at, 1).count() == 0


def test_a_tab_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="tab or line end"):
        sinks.matrix(spark.createDataFrame([("a\tb", "u1", 1)], "Gene string, genome string, n int"), ["Gene"], "genome", str(tmp_path / "x"), "n")


def test_quotes_and_commas_of_the_quoted_table(spark, tmp_path):
    table = spark.createDataFrame([("f__g", "na\"me", "one, \"two\"", 1, 1, 1.0, 3, 4, 3.5)], "gene string, non_unique_gene_name string, annotation string, n_isolates int, n_sequences int, average_per_isolate double, min_length int, max_length int, average_length double")
    cells = spark.createDataFrame([("f", "g", "u1", "(a:b);c"), ("f", "g", "u,2", "d\"e")], "allele string, family string, genome string, cell string")
    at = str(tmp_path / "roary")
    sinks.roary(table, cells, at, ["u0", "u1", "u,2"])
    assert {tuple(r) for r in tables.roary(spark, at).collect()} == {("f__g", "u1", "a;b;c"), ("f__g", "u,2", "d\"e")}
    meta = tables.roary_meta(spark, at).first()
    assert (meta["Non-unique Gene name"], meta["Annotation"]) == ("na\"me", "one, \"two\"")


def test_a_folder_for_each_genome_is_not_left_to_few_tasks(spark, tmp_path):
    """Rows that lie by genome in few bytes are still written by many tasks, one file for each genome."""
    few = spark.range(40).selectExpr("concat('u', id) genome", "id n").groupBy("genome").agg(F.max("n").alias("n"))
    rows = few.select("genome", F.concat(F.lit("line "), F.col("n").cast("string"), F.lit("\n")).alias("text"))
    dealt = sinks.by_genome(rows)
    assert dealt.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert len({r["p"] for r in dealt.select(F.spark_partition_id().alias("p")).collect()}) > 8
    sinks.gff(rows, at := str(tmp_path / "g"))
    assert len(glob.glob(f"{at}/genome=*/*.txt")) == 40
    assert {(r["genome"], r["value"]) for r in spark.read.text(at).collect()} == {(f"u{k}", f"line {k}") for k in range(40)}
