"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source's target is its share of all words by weight, at most CAP times what it has; what one can't take goes to
the others by weight. A target is met by complete epochs, in which each document is taken once, and a last, fractional
one: documents in the order of their keys, -ln(u) / w for a uniform u and a quality w, up to the words still wanted.

The order is not made by sorting a source, which may hold a third of all rows, in one task. The range of a source's keys
is cut into bins; their sums say in which bin the budget ends, and that bin is cut again until it holds BIN documents at
most. Only those are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._common import checkpoint

# The weights that sources take in turn, and the largest multiple of a source.
WEIGHTS, CAP = (5, 2, 1), 3
BIN, BINS, SEED, SMALL = 4096, 1024, 42, 50_000
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """0.1 to 1: less the more symbols a text has. The weight of its key."""
    share = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))) / F.length(text)
    return F.when(F.length(text) > 0, F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(5.0) * share)).otherwise(F.lit(0.1))


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from a text that names the document, so that reruns agree."""
    digest = F.md5(F.concat(key, F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if counted and few; else Spark shuffles and splits what is skewed."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) and target: one row for each source goes in, so that one task can order them.

    Sources weigh the weights in turn, by code point, null last. Those with the least room for their weight reach their
    cap first; the share of a unit of weight is settled where the next source has room for it.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (turn % len(weights)).cast("int") + 1)
    w = sources.withColumn("w", weigh).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    w = w.withColumn("before", F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("left", F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(everything))
    share = (F.col("total") - F.col("before")) / F.col("left")
    w = w.withColumn("share", F.when(share <= F.col("most") / F.col("w"), share))
    w = w.withColumn("share", F.max("share").over(everything))
    return w.select("source", "source_size", F.least("most", F.coalesce(F.col("share") * F.col("w"), "most")).alias("target"))


def _rows(docs: DataFrame, seed: int, key: str, text: str, source: str, weight: Column | None, whole: bool = False) -> DataFrame:
    """_size, _at (the sampling key), _source and _key of docs, and if asked the row itself as _row: no name of docs can clash."""
    w = quality(F.col(text)) if weight is None else weight
    # Rows without a key would all get the same number: theirs comes from the text.
    named = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    columns = [words(F.col(text)).alias("_size"), (-F.log(uniform(named, seed)) / w).alias("_at"), F.col(source).alias("_source"), F.col(key).alias("_key")]
    return docs.select(*columns, *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if whole else []))


def _place() -> Column:
    """What orders a source's documents."""
    return F.struct(F.col("_at").alias("at"), F.col("_key").alias("id"), F.col("_size").alias("size"))


def _edges(rows: DataFrame, got: DataFrame) -> DataFrame:
    """(s, budget, lo, hi, base, n): where in the order of _at each source's budget ends.

    The end lies among the n documents whose _at is from lo to hi; base: the words of those before. Each round cuts what
    is left of a source into BINS parts, sums them up and goes on with the one part in which the budget ends, until that
    has BIN documents at most, or one value of _at only. So no task sorts more, however the keys are distributed.
    """
    now = checkpoint(got.select("s", "budget", F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("base"), "n"))
    first = True
    while not now.where((F.col("n") > BIN) & (F.col("lo") < F.col("hi"))).isEmpty():
        large = (F.col("n") > BIN) & (F.col("lo") < F.col("hi"))
        mine = rows.join(_small(now.where(large)), F.col("_source").eqNullSafe(F.col("s")) & F.col("_at").between(F.col("lo"), F.col("hi")))
        # The first cut follows the distribution of keys of weight 1, the others the values themselves.
        at = F.lit(1.0) - F.exp(-F.col("_at")) if first else (F.col("_at") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        sums = mine.groupBy("s", "budget", "base", F.least(F.floor(at * BINS), F.lit(BINS - 1)).alias("bin")).agg(
            F.sum("_size").alias("size"), F.count("*").alias("n"), F.min("_at").alias("lo"), F.max("_at").alias("hi"))
        upto = F.col("base") + F.sum("size").over(Window.partitionBy("s").orderBy("bin"))
        ends = sums.withColumn("upto", upto).where("upto > budget").groupBy("s", "budget").agg(F.min_by(F.struct("lo", "hi", (F.col("upto") - F.col("size")).alias("base"), "n"), "bin").alias("e"))
        now = checkpoint(now.where(~large).unionByName(ends.select("s", "budget", "e.lo", "e.hi", "e.base", "e.n")))
        first = False
    return now


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row for each source: s, source_size, target, epochs, and where the fractional epoch ends.

    cut: the document (by _place) that it takes in part only, null if there is none, and part: how many words of it.
    """
    sources = checkpoint(rows.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n")).withColumnRenamed("_source", "source"))
    got = sources.join(targets(sources, weights, cap).select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("source")
    got = got.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    got = checkpoint(got.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    near = _small(_edges(rows, got).select("s", "budget", "lo", "hi", "base"))
    last = rows.join(near, F.col("_source").eqNullSafe(F.col("s")) & F.col("_at").between(F.col("lo"), F.col("hi")))
    # Rows repeated in full share a place: they count as one, and are taken alike.
    last = last.withColumn("place", _place()).groupBy("s", "budget", "base", "place").agg(F.count("*").alias("m"))
    size = F.col("place.size") * F.col("m")
    upto = F.col("base") + F.sum(size).over(Window.partitionBy("s").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = last.withColumn("part", F.floor((F.col("budget") - upto + size) / F.col("m")).cast("long")).where(F.col("part") < F.col("place.size"))
    cut = last.groupBy("s").agg(F.min_by(F.struct("place", "part"), "place").alias("c")).select(F.col("s").alias("cs"), "c")
    return got.join(cut, F.col("s").eqNullSafe(F.col("cs")), "left").select("s", "source_size", "target", "epochs", F.col("c.place").alias("cut"), F.col("c.part").alias("cut_part"))


def _planned(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows with their source's plan, and part: the words that the fractional epoch takes."""
    part = F.when(F.col("cut").isNull() | (_place() < F.col("cut")), F.col("_size")).when(_place() == F.col("cut"), F.col("cut_part")).otherwise(F.lit(0))
    return rows.join(_small(of), F.col("_source").eqNullSafe(F.col("s"))).withColumn("part", part.cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None) -> DataFrame:
    """(key, size, source_size, target, epochs, part, taken): a row for each row of docs.

    size: the text's words, 0 if it is null. epochs: how often the document is taken whole; part: how many of its first
    words the fractional epoch takes: all, none, or for one document of each source what is left of the budget;
    taken: the words of both.
    Documents of a null source are a source, the last; a row without key is drawn by its text. Equal sampling keys are
    ordered by the row's key, then its size; rows repeated in full are taken alike. An empty table gives an empty
    result; other columns are not read, whatever their names. weight: a document's quality, over 0; by default
    quality() of its text.
    """
    rows = checkpoint(_rows(docs, seed, key, text, source, weight))
    got = _planned(rows, plan(rows, weights, cap))
    return got.select(F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target", "epochs", "part", (F.col("_size") * F.col("epochs") + F.col("part")).alias("taken"))


def draw(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, whole. What mix() takes in part is in if that is half of it or more.

    Nulls, ties, repeated rows and empty tables are as in mix(); a document without words is in once for each complete
    epoch of its source. Columns of docs may have any names and stay.
    """
    rows = _rows(docs, seed, key, text, source, weight, True)
    got = _planned(rows, plan(checkpoint(rows.drop("_row")), weights, cap))
    times = (F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("_size")), 1).otherwise(0)).cast("int")
    return got.withColumn("_n", F.explode(F.array_repeat(F.lit(True), times))).select("_row.*")
