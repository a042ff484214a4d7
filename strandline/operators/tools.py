"""Tables for other programs, and subsets. Long forms; wide() pivots at the sink."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import checkpoint, numbered
from strandline.operators import families, filters

#: Genomes of a tile, and alleles that a product of two tiles takes at once.
TILE, ALLELES = 512, 8192
#: Tiles that genomes are dealt into before these grow, their most genomes, partitions of products, and pairs of a batch of rows.
TILES, WIDEST, PRODUCTS, ROWS = 64, 2048, 2048, 1 << 16
#: Distances that one task holds to put lines together.
LINE_CELLS = 1 << 26


def names_of(rows: DataFrame, column: str) -> list[str]:
    """The values of a column in order: the names of a wide table's columns, which its header has in one line."""
    return [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def wide(rows: DataFrame, keys: list[str], column: str, value: str, names: list[str] | None = None, empty: object = 0, sep: str = "\t") -> tuple[DataFrame, list[str]]:
    """(keys, line) of long rows, and the names of the columns that a line has: named, or read off the data, in order.

    A line is put together from the places of its values, with `empty` between them, so that no plan has a column for each
    name. Of several values for a place the smallest stands; names that are not asked for have none.
    """
    names = names or names_of(rows, column)
    at = rows.sparkSession.createDataFrame(list(zip(names, range(1, len(names) + 1), strict=True)), "_name string, _at int")
    none = F.lit(str(empty))
    text = F.coalesce(F.col(value).cast("string"), none)
    found = rows.select(*keys, F.col(column).cast("string").alias("_name"), text.alias("_text")).join(at, "_name", "left")
    each = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_text")))).alias("_x"))
    before = lambda i: F.when(i > 0, F.get("_x", i - 1)["_at"]).otherwise(0)
    each = each.withColumn("_x", F.filter("_x", lambda x, i: x["_at"] > before(i)))
    parts = F.transform("_x", lambda x, i: F.concat(F.repeat(F.concat(none, F.lit(sep)), x["_at"] - before(i) - 1), x["_text"]))
    last = F.coalesce(F.get("_x", F.size("_x") - 1)["_at"], F.lit(0))
    rest = F.when(last == 0, F.concat(none, F.repeat(F.concat(F.lit(sep), none), F.lit(len(names) - 1)))).otherwise(F.concat(F.array_join(parts, sep), F.repeat(F.concat(F.lit(sep), none), F.lit(len(names)) - last)))
    return each.select(*keys, rest.alias("line")), names


def rtab(loci: DataFrame, low: float = 0.05, high: float = 0.95, family_low: float = 0, family_high: float = 1, dosage: float = 0, keep_all: bool = False, categories: DataFrame | None = None, n_genomes: int | None = None) -> DataFrame:
    """(family, threshold, allele, genome): the ones of the presence matrix, after the frequency filters."""
    n = n_genomes or loci.agg(F.count_distinct("genome")).first()[0]
    stats = filters.by_family_frequency(families.allele_stats(loci, categories), n, family_low, family_high, keep_all)
    stats = filters.by_dosage(filters.by_allele_frequency(stats, n, low, high), dosage)
    return families.presence(loci).join(stats.select("allele", "threshold"), ["allele", "threshold"], "left_semi")


def paralog_rtab(loci: DataFrame, categories: DataFrame, kind: str = "ff", binary: bool = False, low: float = 0, high: float = 1) -> DataFrame:
    """(family, threshold, allele, genome, n) with n > 0: fragment joins (ff: the number of `:`) or extra copies (d: of `;`) in a cell."""
    d = families.doses(loci, categories)
    if kind == "ff":
        groups = families.with_categories(loci, categories).where("ff_group is not null").groupBy("family", "threshold", "allele", "genome", "ff_group").agg((F.count("*") - 1).alias("m"))
        counts = groups.groupBy("family", "threshold", "allele", "genome").agg(F.sum("m").alias("n"))
    elif kind == "d":
        counts = d.select("family", "threshold", "allele", "genome", (F.col("dose") - 1).alias("n"))
    else:
        raise ValueError("kind is ff or d")
    counts = counts.where("n > 0")
    if binary:
        counts = counts.withColumn("n", F.lit(1).cast("long"))
    total = loci.agg(F.count_distinct("genome")).first()[0]
    in_range = counts.groupBy("threshold", "allele").agg((F.count("*") / total).alias("p")).where(F.col("p").between(low, high))
    return counts.join(in_range.select("threshold", "allele"), ["threshold", "allele"], "left_semi")


def _allele_sets(present: DataFrame) -> tuple[DataFrame, int]:
    """(genome, ids, _n): each genome's alleles as numbers in order and its own number from 0; how many genomes there are."""
    rows = present.select("genome", F.concat_ws("|", F.col("threshold").cast("string"), "allele").alias("a")).distinct()
    ids = numbered(rows.select("a").distinct(), "n", F.col("a")).withColumn("n", F.col("n").cast("int"))
    sets = rows.join(ids, "a").groupBy("genome").agg(F.array_sort(F.collect_list("n")).alias("ids"))
    sets = checkpoint(numbered(sets, "_n", F.col("genome")).withColumn("_n", (F.col("_n") - 1).cast("int")))
    return sets, sets.count()


#: Sets end to end, and how many each has.
Sets = tuple[np.ndarray, np.ndarray]


def _ones(sets: Sets, begin: int, end: int) -> np.ndarray:
    """Sets as rows of ones and zeros, of the alleles from begin to before end."""
    ids, size = sets
    out = np.zeros((len(size), end - begin), dtype=np.float32)
    own = (ids >= begin) & (ids < end)
    out[np.repeat(np.arange(len(size)), size)[own], ids[own] - begin] = 1
    return out


def _shared(x: Sets, y: Sets) -> np.ndarray:
    """How many alleles each two sets of x and y have in common."""
    out = np.zeros((len(x[1]), len(y[1])), dtype=np.int32)
    most = 1 + min(int(ids.max(initial=-1)) for ids, _ in (x, y))
    for begin in range(0, most, ALLELES):
        end = min(most, begin + ALLELES)
        out += np.rint(_ones(x, begin, end) @ _ones(y, begin, end).T).astype(np.int32)
    return out


def _tiles(sets: DataFrame, n: int, tile: int) -> DataFrame:
    """(own, genomes, size, ids): `tile` genomes in the order of their names as one row, in a partition of its own."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows["ids"].chunk(0)
            columns = [rows["genome"].to_pylist()], [pc.list_value_length(ids).to_pylist()], [ids.flatten().to_numpy()]
            kinds = (pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([rows["own"][0].as_py()], pa.int32()), *(pa.array(c, pa.list_(t)) for c, t in zip(columns, kinds, strict=True))], names=["own", "genomes", "size", "ids"])

    dealt = sets.select(F.floor(F.col("_n") / F.lit(tile)).cast("int").alias("own"), "genome", "ids", "_n").repartitionById(-(-n // tile), F.col("own")).sortWithinPartitions("_n")
    return checkpoint(dealt.mapInArrow(packed, "own int, genomes array<string>, size array<int>, ids array<int>"))


def _side(row: pa.RecordBatch, begin: int) -> tuple[pa.Array, Sets]:
    genomes, size, ids = (row.column(begin + k)[0].values for k in (1, 2, 3))
    return genomes, (ids.to_numpy(), size.to_numpy())


def _sides(x: DataFrame, y: DataFrame, condition: Column) -> DataFrame:
    """Each row of x with those of y, by tasks that read them where they lie: none is dealt out for each other."""
    left, right = (df.select(*(F.col(c).alias(f"{c}_{side}") for c in df.columns)) for df, side in ((x, "x"), (y, "y")))
    return left.hint("shuffle_replicate_nl").join(right, condition)


def distances(present: DataFrame, similarity: bool = False, tile: int = TILE) -> DataFrame:
    """(g1, g2, d): for each two genomes how many alleles just one of them has, or with similarity how many both have.

    Genomes are dealt into tiles, and each two tiles are one product of their alleles as ones and zeros, some alleles at
    a time; what only one has follows from the genomes' totals. Every pair of genomes has a row. Tiles grow with the number
    of genomes, up to WIDEST; a genome is dealt out once, and its tile is read by the tasks of its products.
    """
    sets, n = _allele_sets(present)
    if not n:
        return present.sparkSession.createDataFrame([], "g1 string, g2 string, d long")
    tile = max(tile, min(WIDEST, -(-n // TILES)))
    tiles, held = -(-n // tile), _tiles(sets, n, tile)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                own = batch.slice(row, 1)
                (left, x), (right, y) = _side(own, 0), _side(own, 4)
                same = own.column(0)[0] == own.column(4)[0]
                d = _shared(x, y).astype(np.int64)
                if not similarity:
                    d = x[1][:, None].astype(np.int64) + y[1] - 2 * d
                step = max(1, ROWS // len(right))
                for k in range(0, len(left), step):  # some genomes against all of the other tile, in both directions
                    part = d[k : k + step]
                    one, two = left.take(pa.array(np.repeat(np.arange(k, k + len(part)), len(right)))), pa.concat_arrays([right] * len(part))
                    values = pa.array(part.ravel())
                    yield pa.RecordBatch.from_arrays([one, two, values], names=["g1", "g2", "d"])
                    if not same:
                        yield pa.RecordBatch.from_arrays([two, one, values], names=["g1", "g2", "d"])

    both = _sides(held, held, F.col("own_x") <= F.col("own_y")).coalesce(min(tiles * (tiles + 1) // 2, PRODUCTS))
    return both.mapInArrow(compared, "g1 string, g2 string, d long")


def _written(values: np.ndarray, sep: str) -> list[str]:
    """Each row of numbers from 0 as a text, with sep after each number."""
    known = [f"{v}{sep}".encode() for v in range(int(values.max(initial=0)) + 1)]
    width = max(map(len, known))
    letters = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in known), dtype=np.uint8).reshape(-1, width)
    filled = letters != 0
    return [letters[v][filled[v]].tobytes().decode() for v in values]


def distance_lines(present: DataFrame, cells: int = LINE_CELLS, sep: str = "\t") -> DataFrame:
    """(genome, line): the distances() of each genome to all, in the order of their names, as one text; no pair is a row.

    A task holds the distances of some genomes, `cells` of them at most or one genome's, and sees the others in order.
    """
    sets, n = _allele_sets(present)
    if not n:
        return present.sparkSession.createDataFrame([], "genome string, line string")
    few, others = _tiles(sets, n, max(1, min(WIDEST, cells // n))), _tiles(sets, n, TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, parts = None, None, []

        def told() -> Iterator[pa.RecordBatch]:
            for k, genome in enumerate(own):
                line = "".join(x[k] for x in parts)[: -len(sep)]
                yield pa.RecordBatch.from_arrays([pa.array([genome.as_py()], pa.string()), pa.array([line], pa.string())], names=["genome", "line"])
            parts.clear()

        for batch in batches:
            for row in range(len(batch)):
                both = batch.slice(row, 1)
                if at is not None and both.column(0)[0] != at:
                    yield from told()
                at = both.column(0)[0]
                (own, x), (_, y) = _side(both, 0), _side(both, 4)
                parts.append(_written(x[1][:, None] + y[1] - 2 * _shared(x, y), sep))
        if at is not None:
            yield from told()

    return _sides(few, others.coalesce(1).sortWithinPartitions("own"), F.lit(True)).mapInArrow(run, "genome string, line string")


def roary(table: DataFrame, n_loci: str = "no_loci") -> DataFrame:
    """The fixed columns, from the family table; lengths come from their own columns and the number of sequences is real."""
    return table.select(
        F.concat_ws("__", "allele_name", "gene_family").alias("gene"), F.coalesce("consensus_gene_name", F.lit("")).alias("non_unique_gene_name"), F.coalesce("consensus_product", F.lit("")).alias("annotation"), F.col("number_genomes").alias("n_isolates"),
        F.col(n_loci).alias("n_sequences"), F.col("average_dose").alias("average_per_isolate"), "min_length", "max_length", "average_length",
        *(c for c in ("cluster", "cluster_order") if c in table.columns))


def treewas(present: DataFrame, genomes: DataFrame) -> DataFrame:
    """(genome, allele, value): the whole matrix, zeros included, a genome's row at a time."""
    alleles = present.select("allele").distinct()
    grid = genomes.select("genome").distinct().crossJoin(alleles)
    return grid.join(present.select("genome", "allele", F.lit(1).alias("value")).distinct(), ["genome", "allele"], "left").na.fill(0, ["value"])


def variants(loci: DataFrame, low: float = 0.05, high: float = 0.95, core: float = 0.95) -> DataFrame:
    """(kind, allele, genome): inputs of an association study.

    accessory: families below the core; core_alleles and accessory_alleles: alleles of core and of other families.
    """
    n = loci.agg(F.count_distinct("genome")).first()[0]
    stats = families.genomes_per_allele(loci).withColumnRenamed("n_genomes", "number_genomes")
    first = Window.partitionBy("family")
    stats = stats.withColumn("lowest", F.col("threshold") == F.min("threshold").over(first))
    stats = stats.withColumn("family_share", F.max(F.when(F.col("lowest"), F.col("number_genomes") / n)).over(first)).withColumn("share", F.col("number_genomes") / n)
    ok = F.col("share").between(low, high)
    picks = [
        ("accessory", stats.where(F.col("lowest") & ok & (F.col("family_share") < core))),
        ("core_alleles", stats.where(~F.col("lowest") & ok & (F.col("family_share") >= core))),
        ("accessory_alleles", stats.where(~F.col("lowest") & ok & (F.col("family_share") < core))),
    ]
    chosen = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "threshold", "allele") for kind, df in picks])
    return families.presence(loci).join(chosen, ["threshold", "allele"]).select("kind", "allele", "genome")


def annotate(results: DataFrame, table: DataFrame) -> DataFrame:
    """Results (locus, ...) with family, gene and product of the allele they name, if it is known."""
    return results.join(table.select(F.col("allele_name").alias("locus"), "gene_family", "consensus_gene_name", "consensus_product"), "locus", "left")


def position_features(positions: DataFrame, features: DataFrame, width: int = 4096) -> DataFrame:
    """positions (pos) with the feature (name, start, end) that covers each, the last by start then name; null without one.

    Both sides meet in bins of `width` bases, so that no position is held against all features.
    """
    bins = features.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    found = positions.withColumn("_bin", F.floor(F.col("pos") / width)).join(bins, "_bin").where("pos between start and end")
    last = found.groupBy("pos").agg(F.max_by("name", F.struct("start", "name")).alias("name"))
    return positions.join(last, "pos", "left")


def recounted(rows: DataFrame) -> DataFrame:
    """(threshold, allele, number_genomes) of rows (threshold, allele, genome, ...)."""
    return rows.groupBy("threshold", "allele").agg(F.count_distinct("genome").alias("number_genomes"))


def subsample(cell_rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows (threshold, allele, genome, cell) of the chosen samples, with number_genomes counted anew; alleles that none has go."""
    kept = filters.by_samples(cell_rows, samples)
    return kept.join(recounted(kept), ["threshold", "allele"])


def rename_loci(loci: DataFrame, names: DataFrame) -> DataFrame:
    """The loci list with another field (genome, locus, name) in place of the locus, where it is known and not empty."""
    return loci.join(names.select("genome", "locus", F.when(F.col("name") != "", F.col("name")).alias("_name")), ["genome", "locus"], "left").withColumn("locus", F.coalesce("_name", "locus")).drop("_name")


def loci_subset(loci: DataFrame, chosen: DataFrame) -> DataFrame:
    return loci.join(chosen.select("family"), "family", "left_semi")


def hit_subset(hits: DataFrame, loci: DataFrame) -> DataFrame:
    """Hits with both ends among the loci."""
    mine = loci.select("locus").distinct()
    return hits.join(mine.withColumnRenamed("locus", "q"), "q", "left_semi").join(mine.withColumnRenamed("locus", "s"), "s", "left_semi")


def binary_sequences(present: DataFrame, genomes: DataFrame) -> DataFrame:
    """(genome, seq): A for each family that the genome has, C for each other, families in order."""
    rows = present.select("genome", "family").distinct()
    grid = genomes.select("genome").distinct().crossJoin(rows.select("family").distinct())
    marked = grid.join(rows.withColumn("base", F.lit("A")), ["genome", "family"], "left").na.fill("C", ["base"])
    items = F.array_sort(F.collect_list(F.struct("family", "base")))
    return marked.groupBy("genome").agg(F.array_join(F.transform(items, lambda x: x["base"]), "").alias("seq"))


def representatives(loci: DataFrame, info: DataFrame) -> DataFrame:
    """(family, locus, genome, length): each family's longest locus, by genome and locus of ties."""
    rows = loci.join(info.select("locus", "length"), "locus").select("family", "locus", "genome", "length").distinct()
    order = Window.partitionBy("family").orderBy(F.desc("length"), "genome", "locus")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
